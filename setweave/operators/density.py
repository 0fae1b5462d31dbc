"""Density clustering over grid cells so small that a crowded one needs no pairs."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import forget, written
from setweave.operators.components import connected_components

#: Points of a cell that are compared in one group, and pairs of two parts of cells that are compared point by point instead of being cut further.
POSTING, COMPARED = 1000, 4096


def _gap(n: int) -> Column:
    """Squared least distance of two boxes (lo, hi) and (lo2, hi2)."""
    return sum((F.pow(F.greatest(F.lit(0.0), F.col(f"_lo2{i}") - F.col(f"_hi{i}"), F.col(f"_lo{i}") - F.col(f"_hi2{i}")), 2) for i in range(n)), F.lit(0.0))


def _span(n: int) -> Column:
    """Squared greatest distance of two boxes."""
    return sum((F.pow(F.greatest(F.col(f"_hi2{i}") - F.col(f"_lo{i}"), F.col(f"_hi{i}") - F.col(f"_lo2{i}")), 2) for i in range(n)), F.lit(0.0))


def _boxes(n: int) -> list[Column]:
    return [f(f"_x{i}").alias(f"_{name}{i}") for i in range(n) for f, name in ((F.min, "lo"), (F.max, "hi"))]


def _second(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns marked as the second of a pair."""
    return df.withColumnsRenamed({c: c.rstrip("0123456789") + "2" + c[len(c.rstrip("0123456789")) :] for c in names})


def _box_names(n: int) -> list[str]:
    return [f"_{e}{i}" for i in range(n) for e in ("lo", "hi")]


def _distance(n: int) -> Column:
    return sum(((F.col(f"_x{i}") - F.col(f"_x2{i}")) * (F.col(f"_x{i}") - F.col(f"_x2{i}")) for i in range(n)), F.lit(0.0))


def _touching(places: DataFrame, pairs: DataFrame, n: int, eps: float) -> DataFrame:
    """(cell, cell2) of those pairs of cells that hold two points within eps.

    places are distinct positions (cell, _x.., _u..; u from 0 to 1 within the cell). Cells are halved along every axis, again and again; two parts
    link their cells if their boxes lie wholly within eps, go if these lie further apart, and are compared point by point once they are small. A pair
    of cells that is linked is followed no further, so what is left are parts at the very distance eps.
    """
    links, level = [], 0
    still = written(pairs.select("cell", "cell2", F.lit("").alias("_s"), F.lit("").alias("_s2")))
    xs, x2 = [f"_x{i}" for i in range(n)], [f"_x2{i}" for i in range(n)]

    def part(at: int) -> Column:
        return F.concat_ws("_", *[F.floor(F.col(f"_u{i}") * float(2**at)).cast("string") for i in range(n)]) if at else F.lit("")

    while not still.isEmpty():
        some = still.select("cell").union(still.select("cell2")).distinct()
        cut = written(places.join(some, "cell", "left_semi").select("cell", part(level).alias("_s"), part(level + 1).alias("_c"), *xs))
        parts = written(cut.groupBy("cell", "_s", "_c").agg(F.count(F.lit(1)).alias("_n"), *_boxes(n)))
        other = _second(parts, "cell", "_s", "_c", "_n", *_box_names(n))
        met = still.join(parts, ["cell", "_s"]).join(other, ["cell2", "_s2"])
        met = written(met.select("cell", "cell2", "_c", "_c2", (F.col("_n") * F.col("_n2")).alias("_pairs"), _gap(n).alias("_gap"), _span(n).alias("_span")).where(F.col("_gap") <= eps * eps))
        far = met.where(F.col("_span") > eps * eps)
        inside = met.where(F.col("_span") <= eps * eps).select("cell", "cell2")
        few = far.where(F.col("_pairs") <= COMPARED)
        x = few.join(cut.select("cell", "_c", *xs), ["cell", "_c"]).join(cut.select(F.col("cell").alias("cell2"), F.col("_c").alias("_c2"), *[F.col(a).alias(b) for a, b in zip(xs, x2)]), ["cell2", "_c2"])
        found = written(inside.union(x.where(_distance(n) <= eps * eps).select("cell", "cell2")).distinct())
        links.append(found)
        after = written(far.where(F.col("_pairs") > COMPARED).join(found, ["cell", "cell2"], "left_anti").select("cell", "cell2", F.col("_c").alias("_s"), F.col("_c2").alias("_s2")))
        forget(still, cut, parts, met)
        still, level = after, level + 1
    return functools.reduce(DataFrame.union, links) if links else pairs.select("cell", "cell2")


def dense_clusters(points: DataFrame, key: str, coords: list[str], eps: float, min_samples: int) -> DataFrame:
    """(key, cluster) by density: core points have min_samples neighbours within eps, themselves included.

    Clusters are components of core points within eps, named by their least key; a border point joins the cluster of its nearest core point
    (ties to the smaller key); noise is -1, as are points with a null or NaN coordinate. Keys are numbers, each once.

    Cells have a diagonal of eps: where min_samples points lie in one, all are core and of one cluster, without any pair. Only points of
    cells with fewer look at their neighbours' points, and crowded cells are linked by boxes that are halved where they leave it open.
    """
    n, side = len(coords), eps / math.sqrt(len(coords)) * (1 - 1e-9)
    reach = math.ceil(eps / side)
    known = points.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(coords)]).dropna()
    grid = [F.floor(F.col(f"_x{i}") / side) for i in range(n)]
    inside = [(F.col(f"_x{i}") / side - F.floor(F.col(f"_x{i}") / side)).alias(f"_u{i}") for i in range(n)]
    pts = written(known.select("*", *[g.alias(f"_g{i}") for i, g in enumerate(grid)], *inside).withColumn("cell", F.concat_ws("_", *[f"_g{i}" for i in range(n)])))
    cells = written(pts.groupBy("cell", *[f"_g{i}" for i in range(n)]).agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_rep"), *_boxes(n)))
    crowded = F.col("_n") >= min_samples

    beside = cells
    for i in range(n):
        beside = beside.withColumn(f"_g{i}", F.explode(F.array(*[F.col(f"_g{i}") + s for s in range(-reach, reach + 1)])))
    beside = beside.withColumn("cell2", F.concat_ws("_", *[f"_g{i}" for i in range(n)])).drop(*[f"_g{i}" for i in range(n)])
    other = _second(cells.drop(*[f"_g{i}" for i in range(n)]), "cell", "_n", "_rep", *_box_names(n))
    near_cells = written(beside.join(other, "cell2").where(_gap(n) <= eps * eps).select("cell", "cell2", "_n", "_n2", "_rep", "_rep2", _span(n).alias("_span")))

    # points of cells that are not crowded, each against the points of the cells around it; a crowded cell's are dealt to several groups
    parts = F.ceil(F.col("_n2") / POSTING).cast("int")
    lone = pts.join(near_cells.where(~crowded), "cell").select("_k", *[f"_x{i}" for i in range(n)], "cell2", "_n2", "_rep2", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    sized = pts.join(cells.select("cell", F.ceil(F.col("_n") / POSTING).cast("int").alias("_parts")), "cell")
    dealt = sized.select(F.col("cell").alias("cell2"), F.col("_k").alias("_k2"), *[F.col(f"_x{i}").alias(f"_x2{i}") for i in range(n)], F.pmod(F.xxhash64("_k"), F.col("_parts")).cast("int").alias("_part"))
    near = written(lone.join(dealt, ["cell2", "_part"]).withColumn("_d", _distance(n)).where(F.col("_d") <= eps * eps).select("_k", "_k2", "_d", (F.col("_n2") >= min_samples).alias("_in"), "_rep2"))
    core = written(near.groupBy("_k").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_samples).select("_k"))
    sure = near.join(core.select(F.col("_k").alias("_k2"), F.lit(True).alias("_core")), "_k2", "left").where(F.col("_in") | F.col("_core"))
    sure = written(sure.select("_k", "_k2", "_d", F.when(F.col("_in"), F.col("_rep2")).otherwise(F.col("_k2")).alias("_node")))

    both = near_cells.where(crowded & (F.col("_n2") >= min_samples) & (F.col("cell") < F.col("cell2")))
    places = pts.select("cell", *[f"_x{i}" for i in range(n)], *[f"_u{i}" for i in range(n)]).distinct()
    close = both.where(F.col("_span") <= eps * eps).select("cell", "cell2").union(_touching(places, both.where(F.col("_span") > eps * eps), n, eps))
    heads = cells.where(crowded).select("cell", "_rep")
    named = close.join(heads, "cell").join(heads.select(F.col("cell").alias("cell2"), F.col("_rep").alias("_rep2")), "cell2").select(F.col("_rep").alias("src"), F.col("_rep2").alias("dst"))
    own = heads.select(F.col("_rep").alias("src"), F.col("_rep").alias("dst"))
    links = named.union(own).union(sure.join(core, "_k", "left_semi").select("_k", "_node"))
    comps = written(connected_components(links).select(F.col("node").alias("_node"), F.col("component").alias("cluster")))

    whole = pts.join(heads, "cell").select("_k", F.col("_rep").alias("_node"))
    best = sure.groupBy("_k").agg(F.min(F.struct("_d", "_k2", "_node")).alias("_b")).select("_k", "_b._node")
    found = whole.union(best).join(comps, "_node").select(F.col("_k").alias(key), "cluster")
    out = written(points.select(key).join(found, key, "left").na.fill(-1, ["cluster"]))
    forget(pts, cells, near_cells, near, core, sure, comps)
    return out
