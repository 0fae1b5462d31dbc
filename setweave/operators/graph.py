"""Weighted token graphs: edges, PageRank and roll-ups."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import bucketed, forget, written


def cooccurrence_edges(tokens: DataFrame, by: str = "example_id", token: str = "token", weight: str = "activation", level: str | None = None) -> DataFrame:
    """(src, dst, w): for every ordered pair of different tokens of a set, the sum of the set's activation (times the target's level, if given).

    A set's tokens meet once and its pairs are summed before the shuffle, so what moves is one row for each different pair and task.
    """
    w = F.col(weight) * F.col(level) if level else F.col(weight)
    sets = tokens.groupBy(by).agg(F.collect_list(F.struct(F.col(token).alias("t"), w.alias("w"))).alias("s"))  # a set is bounded by its families
    pairs = sets.select("s", F.explode(F.transform("s", lambda x: x["t"])).alias("src")).select("src", F.explode("s").alias("d")).select("src", F.col("d.t").alias("dst"), F.col("d.w").alias("w"))
    return pairs.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """(node, score) over all nodes, isolated ones included.

    Weights are normalised by row; the mass of nodes without out-edges is lost. Stops when the
    L1 change is under tolerance and returns the vector before that step, or after the given rounds. Each round is one
    join and one aggregation; lineage is cut by writing to the shared folder.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("w").alias("t")).where("t > 0")
    trans = written(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")))
    now = written(nodes.select("node", F.lit(1.0 / n).alias("score")))
    for i in range(rounds):
        flow = trans.join(now, trans.src == now.node).groupBy("dst").agg(F.sum(F.col("p") * F.col("score")).alias("f"))
        nxt = nodes.select("node").join(flow, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) / n + damping * F.coalesce("f", F.lit(0.0))).alias("score"))
        if i % cut_every == cut_every - 1 or tolerance > 0:
            nxt = written(nxt)
        if tolerance > 0:
            moved = nxt.join(now.withColumnRenamed("score", "_b"), "node").agg(F.sum(F.abs(F.col("score") - F.col("_b")))).first()[0] or 0.0
            if moved < tolerance:
                return now
        now = nxt
    return now


def category_rollup(scores: DataFrame, category: str, n_contexts: DataFrame, k: int) -> DataFrame:
    """(category, score): node scores divided by their category's number of contexts, summed, the k highest."""
    return scores.join(F.broadcast(n_contexts), category).groupBy(category).agg(F.sum(F.col("score") / F.col("n_contexts")).alias("score")).orderBy(F.desc("score"), category).limit(k)


def pagerank_of_each(edges: DataFrame, nodes: DataFrame, by: str = "grp", damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(by, node, score, rounds) of many graphs at once: edges (by, src, dst, w), nodes (by, node).

    Each graph is ranked as by pagerank() and stops by itself: when the L1 change of its scores is under tolerance it keeps the vector before that
    step, or the one after the last round; rounds tells how many steps it has taken. One round is one join on (graph, node) for all graphs that still move; edges stay where
    they are, in buckets of their source. A graph of any size is spread over the tasks by its nodes. Nodes without a graph, name or edge: the first two take no part, the third keeps its base score.
    """
    spark = edges.sparkSession
    at = lambda node: F.struct(F.col(by).alias("g"), F.col(node).alias("n"))
    own = nodes.select(by, "node").dropna().distinct()
    own = own.join(own.groupBy(by).agg(F.count(F.lit(1)).alias("_size")), by)
    now = written(own.select(by, "node", "_size", (1.0 / F.col("_size")).alias("score")))
    clean = edges.select(by, "src", "dst", "w").dropna()
    out = clean.groupBy(by, "src").agg(F.sum("w").alias("_t")).where("_t > 0")
    moves = clean.join(out, [by, "src"]).select(F.xxhash64(at("src")).alias("_at"), by, "src", "dst", (F.col("w") / F.col("_t")).alias("p"))
    trans = bucketed(moves, "_at", int(spark.conf.get("spark.sql.shuffle.partitions")))
    done: list[DataFrame] = []
    for i in range(1, rounds + 1):
        from_ = now.select(F.xxhash64(at("node")).alias("_at"), F.col(by).alias("_by"), F.col("node").alias("_node"), "score")
        flow = trans.join(from_, "_at").where((F.col(by) == F.col("_by")) & (F.col("src") == F.col("_node"))).groupBy(by, F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("_f"))
        step = (1 - damping) / F.col("_size") + damping * F.coalesce("_f", F.lit(0.0))
        nxt = written(now.join(flow, [by, "node"], "left").select(by, "node", "_size", F.col("score").alias("_before"), step.alias("score")))
        still = nxt.groupBy(by).agg(F.sum(F.abs(F.col("score") - F.col("_before"))).alias("_moved")).where(F.col("_moved") < tolerance).select(by)
        settled = written(nxt.join(still, by, "left_semi").select(by, "node", F.col("_before").alias("score"), F.lit(i).alias("rounds")))
        done.append(settled)
        going = nxt.join(settled.select(by).distinct(), by, "left_anti").select(by, "node", "_size", "score")
        after = written(going)
        forget(now, nxt)
        now = after
        if now.isEmpty():
            break
    found = functools.reduce(DataFrame.unionByName, [*done, now.select(by, "node", "score", F.lit(rounds).alias("rounds"))])
    result = written(found)
    forget(trans, now, *done)
    return result


def top_mass(scores: DataFrame, k: int, by: str = "grp") -> DataFrame:
    """(by, node, share): the k highest nodes of each graph (ties to the smaller node) with their shares of the sum of these."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", 12)), "node")
    top = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy(by))).select(by, "node", "share", F.col("_r").alias("rank"))


def edges_of_each(tokens: DataFrame, by: str, example: str = "example_id", token: str = "token", weight: str = "activation") -> DataFrame:
    """(by, src, dst, w) for pagerank_of_each(): as cooccurrence_edges(), within each group of examples."""
    sets = tokens.groupBy(by, example).agg(F.collect_list(F.struct(F.col(token).alias("t"), F.col(weight).alias("w"))).alias("s"))  # a set is bounded by its families
    pairs = sets.select(by, "s", F.explode(F.transform("s", lambda x: x["t"])).alias("src")).select(by, "src", F.explode("s").alias("d"))
    return pairs.select(by, "src", F.col("d.t").alias("dst"), F.col("d.w").alias("w")).where("src <> dst").groupBy(by, "src", "dst").agg(F.sum("w").alias("w"))
