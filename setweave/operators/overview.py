"""One row about each of many features: statistics, ranked tokens, families, suppressed tokens and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.operators.graph import edges_of_each, pagerank_of_each, top_mass
from setweave.operators.ranking import rank_within


def token_influences(examples: DataFrame, tokens: DataFrame, by: str, base: str, min_samples: int = 50, high_percentile: float = 0.995) -> DataFrame:
    """(by, base, n_present, n_absent, high_rate, low_rate, ratio, mean_present, mean_absent, delta, effect) of each token base of each feature.

    examples (by, example_id, activation), tokens (by, example_id, base). High are activations from the one at place max(1, n (1 - high_percentile)), from 0, downwards; ratio is
    the base's rate among them over that among the others, 10 where it is in high ones only and 1 where in neither. Absent statistics are totals less the
    present ones; effect pools the sample variance of the present with the population variance of the absent. Bases with fewer than min_samples on either side are left out.
    """
    a = F.col("activation")
    ranked = rank_within(examples.select(by, "example_id", "activation"), [by], "activation", "example_id", "_r", "_n", descending=True)
    place = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * (1 - F.lit(high_percentile)))), F.col("_n") - 1) + 1
    cut = ranked.where(F.col("_r") == place).select(by, a.alias("_cut"))
    marked = examples.select(by, "example_id", "activation").join(cut, by).withColumn("_high", (a >= F.col("_cut")).cast("long"))
    total = marked.groupBy(by).agg(F.count(F.lit(1)).alias("_all"), F.sum("_high").alias("_nh"), F.sum(a).alias("_s"), F.sum(a * a).alias("_q"))
    held = tokens.select(by, "example_id", F.col(base).alias("base")).dropna().distinct().join(marked, [by, "example_id"])
    x = held.groupBy(by, "base").agg(F.count(F.lit(1)).alias("n_present"), F.sum("_high").alias("_h"), F.sum(a).alias("_sp"), F.sum(a * a).alias("_qp"), F.var_samp(a).alias("_vp")).join(total, by)
    x = x.withColumn("n_absent", F.col("_all") - F.col("n_present")).where((F.col("n_present") >= min_samples) & (F.col("n_absent") >= min_samples))
    low = F.col("_all") - F.col("_nh")
    x = x.withColumn("high_rate", F.when(F.col("_nh") > 0, F.col("_h") / F.col("_nh")).otherwise(0.0)).withColumn("low_rate", F.when(low > 0, (F.col("n_present") - F.col("_h")) / low).otherwise(0.0))
    ratio = F.when(F.col("low_rate") > 0.001, F.col("high_rate") / F.col("low_rate")).when(F.col("high_rate") > 0, 10.0).otherwise(1.0)
    x = x.withColumn("mean_present", F.col("_sp") / F.col("n_present")).withColumn("mean_absent", (F.col("_s") - F.col("_sp")) / F.col("n_absent"))
    va = F.when(F.col("n_absent") > 1, F.greatest(F.lit(0.0), (F.col("_q") - F.col("_qp")) / F.col("n_absent") - F.col("mean_absent") * F.col("mean_absent"))).otherwise(0.0)
    pooled = (F.coalesce("_vp", F.lit(0.0)) * F.col("n_present") + va * F.col("n_absent")) / F.col("_all")
    delta = F.col("mean_present") - F.col("mean_absent")
    return x.select(by, "base", "n_present", "n_absent", "high_rate", "low_rate", ratio.alias("ratio"), "mean_present", "mean_absent", delta.alias("delta"), (delta / F.when(pooled > 0, F.sqrt(pooled)).otherwise(1e-10)).alias("effect"))


def _listed(rows: DataFrame, by: str, order: list[Column], item: str, k: int, name: str) -> DataFrame:
    """(by, name): the first k items of each feature as one text."""
    w = Window.partitionBy(by).orderBy(*order)
    r = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(item).cast("string").alias("i")))).alias("_l"))
    return r.select(by, F.array_join(F.transform("_l", lambda x: x["i"]), " ").alias(name))


def feature_overview(examples: DataFrame, tokens: DataFrame, by: str, family: Column, top_k: int = 15, samples: int = 5, rounds: int = 100, tolerance: float = 1e-6, min_samples: int = 50,
                     high_percentile: float = 0.995, floor: float = 0.001) -> DataFrame:
    """One row a feature: n, mean, std, median, sparsity (percent of zeros), floor_rate, top_tokens, families, top_family_share, bottom_tokens, top_contexts, samples.

    examples (by, example_id, ctx, activation), tokens (by, example_id, token, activation), family a column over `token`. top_tokens are the highest by
    PageRank over the feature's weighted co-occurrences, all features ranked in one run; families are ordered by their share of these tokens' mass; bottom_tokens are the families' ten lowest
    ratios under 0.8 among high activations; samples the ids of the highest examples. Features without tokens have empty lists.
    """
    a = F.col("activation")
    told = examples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"), F.median(a).alias("median"), (F.avg((a == 0).cast("double")) * 100).alias("sparsity"), F.avg((a <= floor).cast("double")).alias("floor_rate"))
    scores = pagerank_of_each(edges_of_each(tokens, by), tokens.select(by, F.col("token").alias("node")), by, rounds=rounds, tolerance=tolerance)
    top = top_mass(scores, top_k, by)
    shares = top.withColumnRenamed("node", "token").withColumn("_f", family).groupBy(by, "_f").agg(F.sum("share").alias("_s"))
    low = token_influences(examples, tokens.withColumn("_b", family), by, "_b", min_samples, high_percentile).where(F.col("ratio") < 0.8)
    contexts = examples.groupBy(by, "ctx").agg(F.count(F.lit(1)).alias("_c"))
    parts = [
        _listed(top, by, [F.col("rank")], "node", top_k, "top_tokens"), _listed(shares, by, [F.desc(F.round("_s", 9)), F.col("_f")], "_f", top_k, "families"),
        _listed(low, by, [F.round("ratio", 9), F.col("base")], "base", 10, "bottom_tokens"), _listed(contexts, by, [F.desc("_c"), F.col("ctx")], "ctx", 5, "top_contexts"),
        _listed(examples, by, [F.desc("activation"), F.col("example_id")], "example_id", samples, "samples"), shares.groupBy(by).agg(F.max("_s").alias("top_family_share"))]
    for part in parts:
        told = told.join(part, by, "left")
    return told.na.fill("", ["top_tokens", "families", "bottom_tokens", "top_contexts", "samples"])
