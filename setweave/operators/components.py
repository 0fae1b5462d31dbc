"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import forget, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its neighbours; the minimum is combined before the shuffle."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        linked.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node reachable.

    Each round points every node at the least node it sees (large star), then
    contracts the stars (small star); O(log^2 n) rounds. Nulls and self loops
    add no link; a node that has only self loops is its own component.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    alone = clean.where("u = v").select(F.col("u").alias("node"))
    now = written(clean.where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        nxt = written(_small_star(_large_star(now).where("u <> v").distinct()))
        seen = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = nxt
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    single = alone.distinct().select("node", F.col("node").alias("component"))
    return found.union(roots).union(single).groupBy("node").agg(F.min("component").alias("component"))
