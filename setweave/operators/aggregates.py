"""Statistics, histograms, sweeps and enrichment over activations and tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.operators.ranking import exact_quantile, global_rank, rows_at_ranks


def feature_stats(acts: DataFrame, n_total: int | None = None) -> DataFrame:
    """Per feature: min, max, mean, median, std, q25, q75, n_zeros, n_total, sparsity; with n_total, missing examples count as zeros in the last three only."""
    a = F.col("activation")
    total = F.lit(n_total) if n_total is not None else F.count(F.lit(1))
    zeros = total - F.count_if(a != 0)
    return acts.groupBy("feature_id").agg(
        F.min(a).alias("min"), F.max(a).alias("max"), F.avg(a).alias("mean"), F.expr("percentile(activation, 0.5)").alias("median"), F.stddev_samp(a).alias("std"),
        F.expr("percentile(activation, 0.25)").alias("q25"), F.expr("percentile(activation, 0.75)").alias("q75"),
        zeros.cast("long").alias("n_zeros"), total.cast("long").alias("n_total"), (zeros / total).alias("sparsity"))


def merge_stats(acts: DataFrame, features: DataFrame, n_total: int) -> DataFrame:
    """Per feature of the dimension: count, sum, mean and population std over n_total examples (absent ones zero), min, max, sparsity, in one mergeable pass."""
    a = F.col("activation")
    part = acts.where(a != 0).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("s"), F.sum(a * a).alias("ss"), F.min(a).alias("lo"), F.max(a).alias("hi"))
    z = features.join(part, "feature_id", "left").na.fill(0)
    mean = F.col("s") / n_total
    return z.select("feature_id", F.col("n").alias("n_active"), mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / n_total - mean * mean, F.lit(0.0))).alias("std"),
                    F.when(F.col("n") < n_total, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
                    F.when(F.col("n") < n_total, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"), (1 - F.col("n") / n_total).alias("sparsity"))


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of equal width in [lo, hi], the last one closed; null outside."""
    i = F.floor((value - lo) / ((hi - lo) / bins))
    return F.when((value >= lo) & (value <= hi), F.least(i, F.lit(bins - 1)).cast("int"))


def fixed_histogram(acts: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(feature_id, bin_idx, lower_bound, upper_bound, count) over a fixed range, empty bins included, values outside dropped."""
    binned = acts.withColumn("bin_idx", bin_index(F.col("activation"), F.lit(lo), F.lit(hi), bins)).where("bin_idx is not null")
    counts = binned.groupBy("feature_id", "bin_idx").agg(F.count(F.lit(1)).alias("count"))
    grid = acts.select("feature_id").distinct().withColumn("bin_idx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    w = (hi - lo) / bins
    return grid.join(counts, ["feature_id", "bin_idx"], "left").select(
        "feature_id", "bin_idx", (F.lit(lo) + F.col("bin_idx") * w).alias("lower_bound"), (F.lit(lo) + (F.col("bin_idx") + 1) * w).alias("upper_bound"), F.coalesce("count", F.lit(0)).alias("count"))


def range_histogram(acts: DataFrame, bins: int) -> DataFrame:
    """(feature_id, bin_idx, count) between each feature's own least and greatest value."""
    bounds = acts.groupBy("feature_id").agg(F.min("activation").alias("lo"), F.max("activation").alias("hi"))
    return acts.join(bounds, "feature_id").withColumn("bin_idx", bin_index(F.col("activation"), F.col("lo"), F.col("hi"), bins)).groupBy("feature_id", "bin_idx").agg(F.count(F.lit(1)).alias("count"))


def top_per_bin(acts: DataFrame, bins: int, k: int) -> DataFrame:
    """(feature_id, bin_idx, rank, example_id, activation): the k highest examples of each bin of the feature's range."""
    bounds = acts.groupBy("feature_id").agg(F.min("activation").alias("lo"), F.max("activation").alias("hi"))
    binned = acts.join(bounds, "feature_id").withColumn("bin_idx", bin_index(F.col("activation"), F.col("lo"), F.col("hi"), bins))
    w = Window.partitionBy("feature_id", "bin_idx").orderBy(F.desc("activation"), "example_id")
    return binned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("feature_id", "bin_idx", "rank", "example_id", "activation")


def sparsity_distribution(acts: DataFrame, n_total: int, dead: float = 1.0, ultra: float = 0.999) -> DataFrame:
    """One row: mean, std, least and greatest sparsity of features, numbers of dead and ultra-sparse ones, and quantiles."""
    s = acts.groupBy("feature_id").agg((1 - F.count_if(F.col("activation") > 0) / n_total).alias("s"))
    q = lambda p: F.expr(f"percentile(s, {p})").alias(f"p{int(100 * p)}")
    return s.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("min"), F.max("s").alias("max"),
                 F.count_if(F.col("s") > ultra).alias("n_ultra_sparse"), F.count_if(F.col("s") >= dead).alias("n_dead"), *map(q, (0.05, 0.25, 0.5, 0.75, 0.95)))


def sparsity_ranking(acts: DataFrame, n_total: int, least: float = 0.01, lo: float = 0.01, hi: float = 0.30, k: int = 20) -> DataFrame:
    """Features by mean active value over the root of the active share, where that share lies between lo and hi."""
    on = F.abs("activation") > least
    g = acts.groupBy("feature_id").agg((F.count_if(on) / n_total).alias("frac_active"), F.avg(F.when(on, F.col("activation"))).alias("mean_when_active"))
    g = g.where((F.col("frac_active") > lo) & (F.col("frac_active") < hi)).withColumn("score", F.col("mean_when_active") / F.sqrt("frac_active"))
    return g.orderBy(F.desc("score"), "feature_id").limit(k)


def shares(rows: DataFrame, sets: list[list[str]], k: int) -> DataFrame:
    """Counts and shares of the k commonest values for each grouping set, in one pass: columns kind, value, n, share, rank."""
    expand = F.array(*[F.struct(F.lit("+".join(s)).alias("kind"), F.concat_ws("|", *s).alias("value")) for s in sets])
    n = rows.select(F.inline(expand)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    all_ = F.sum("n").over(Window.partitionBy("kind"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
    return n.withColumn("share", F.col("n") / all_).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dose_response(examples: DataFrame, levels: DataFrame, families: list[str]) -> DataFrame:
    """(family, level, mean, std, stderr, n, delta): activation at each level of each family, absent counting as level 0; delta is against level 0.

    examples (example_id, activation); levels (example_id, family, level) with one highest level each. Absence is
    worked out from totals, so examples are not multiplied by families.
    """
    a = F.col("activation")
    held = levels.where(F.col("family").isin(families)).select("example_id", "family", "level").join(examples.select("example_id", "activation"), "example_id").groupBy("family", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("s"), F.sum(a * a).alias("ss"))
    total = examples.agg(F.count(F.lit(1)).alias("tn"), F.sum(a).alias("ts"), F.sum(a * a).alias("tss"))
    some = held.groupBy("family").agg(F.sum("n").alias("pn"), F.sum("s").alias("ps"), F.sum("ss").alias("pss")).join(F.broadcast(total))
    none = some.select("family", F.lit(0).alias("level"), (F.col("tn") - F.col("pn")).alias("n"), (F.col("ts") - F.col("ps")).alias("s"), (F.col("tss") - F.col("pss")).alias("ss")).where("n > 0")
    rows = held.unionByName(none).withColumn("mean", F.col("s") / F.col("n")).withColumn(
        "std", F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("ss") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1), F.lit(0.0)))))
    base = F.max(F.when(F.col("level") == 0, F.col("mean"))).over(Window.partitionBy("family"))
    return rows.select("family", "level", "mean", "std", (F.col("std") / F.sqrt("n")).alias("stderr"), "n", (F.col("mean") - base).alias("delta"))


def sweep_summary(doses: DataFrame, threshold: float) -> DataFrame:
    """Per family of dose_response: n-weighted mean, least and greatest delta over present levels, and the first level with |delta| over threshold."""
    d = doses.where("level > 0")
    return d.groupBy("family").agg((F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
                                   F.min(F.when(F.abs("delta") > threshold, F.col("level"))).alias("threshold_level"))


def dose_grid(examples: DataFrame, levels: DataFrame, x: str, y: str) -> DataFrame:
    """(level_x, level_y, mean, std, stderr, n, delta) of two families' levels, delta against (0, 0)."""
    of = lambda f, c: levels.where(F.col("family") == f).select("example_id", F.col("level").alias(c))
    rows = examples.join(of(x, "level_x"), "example_id", "left").join(of(y, "level_y"), "example_id", "left").na.fill(0, ["level_x", "level_y"])
    cells = rows.groupBy("level_x", "level_y").agg(F.avg("activation").alias("mean"), F.stddev_samp("activation").alias("std"), F.count(F.lit(1)).alias("n"))
    base = F.max(F.when((F.col("level_x") == 0) & (F.col("level_y") == 0), F.col("mean"))).over(Window.partitionBy())
    return cells.withColumn("stderr", F.col("std") / F.sqrt("n")).withColumn("delta", F.col("mean") - base)


def context_sweep(rows: DataFrame, by: str, least: int = 10, k: int = 20) -> DataFrame:
    """(by, mean, std, n, delta, dominant) of contexts with enough examples, the k largest deltas; dominant tells whether the first is over twice the second."""
    g = rows.groupBy(by).agg(F.avg("activation").alias("mean"), F.stddev_samp("activation").alias("std"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    g = g.join(F.broadcast(rows.agg(F.avg("activation").alias("_g")))).withColumn("delta", F.col("mean") - F.col("_g")).drop("_g")
    w = Window.orderBy(F.desc("delta"), by)
    g = g.orderBy(F.desc("delta"), by).limit(k).withColumn("_r", F.row_number().over(w))
    first, second = (F.max(F.when(F.col("_r") == i, F.col("delta"))).over(Window.partitionBy()) for i in (1, 2))
    return g.withColumn("dominant", F.abs(first) > 2 * F.abs(F.coalesce(second, F.lit(0.0)))).drop("_r")


def high_low_enrichment(rows: DataFrame, by: str, pct: float, k: int = 30) -> DataFrame:
    """Values of by in the top and bottom pct of examples by activation: counts, shares and their ratio (null where the bottom has none), the k largest count differences."""
    n = rows.count()
    r = F.col("_rank") - 1
    ranked = global_rank(rows, "activation", "example_id", "_rank").withColumn(
        "_high", F.when(r >= math.floor(n * (100 - pct) / 100), 1).when(r < math.floor(n * pct / 100), 0))
    g = ranked.where("_high is not null").groupBy(by).agg(F.sum("_high").alias("n_high"), F.sum(1 - F.col("_high")).alias("n_low"))
    th, tl = (F.sum(c).over(Window.partitionBy()) for c in ("n_high", "n_low"))
    g = g.withColumn("pct_high", F.col("n_high") / th).withColumn("pct_low", F.col("n_low") / tl)
    return g.withColumn("ratio", F.when(F.col("n_low") > 0, F.col("pct_high") / F.col("pct_low"))).orderBy(F.desc(F.col("n_high") - F.col("n_low")), by).limit(k)


def token_influence(examples: DataFrame, tokens: DataFrame, token: str = "token", top: float = 0.10, least: int = 50) -> DataFrame:
    """Per token: examples with and without it, share of high examples in each, their ratio, means and Cohen's d.

    High is an activation at or above that of rank max(1, int(n top)) from the highest. Figures of absence are totals less those
    of presence, so nothing is multiplied. Tokens with fewer than least examples on either side drop out.
    """
    a = F.col("activation")
    n = examples.count()
    rank = max(1, int(n * top + 1e-9))
    cut = rows_at_ranks(examples, "activation", "example_id", n - rank + 1, n - rank + 1, n).select(F.col("activation").alias("_cut"))
    marked = examples.select("example_id", "activation").join(F.broadcast(cut)).withColumn("high", (a >= F.col("_cut")).cast("int"))
    total = marked.agg(F.count(F.lit(1)).alias("tn"), F.sum(a).alias("ts"), F.sum(a * a).alias("tss"), F.sum("high").alias("th"))
    g = tokens.select("example_id", token).distinct().join(marked, "example_id").groupBy(token).agg(
        F.count(F.lit(1)).alias("n_present"), F.sum(a).alias("s"), F.sum(a * a).alias("ss"), F.sum("high").alias("h")).join(F.broadcast(total))
    g = g.withColumn("n_absent", F.col("tn") - F.col("n_present")).where((F.col("n_present") >= least) & (F.col("n_absent") >= least))
    mp, ma = F.col("s") / F.col("n_present"), (F.col("ts") - F.col("s")) / F.col("n_absent")
    vp = (F.col("ss") - F.col("n_present") * mp * mp) / (F.col("n_present") - 1)
    va = (F.col("tss") - F.col("ss")) / F.col("n_absent") - ma * ma
    hp, ha = F.col("h") / F.col("n_present"), (F.col("th") - F.col("h")) / F.col("n_absent")
    ratio = F.when(ha > 0, hp / ha).otherwise(F.when(hp > 0, 10.0).otherwise(1.0))
    pooled = F.sqrt(((F.col("n_present") - 1) * vp + F.col("n_absent") * va) / (F.col("tn") - 2))
    return g.select(token, "n_present", "n_absent", hp.alias("rate_present"), ha.alias("rate_absent"), ratio.alias("ratio"), mp.alias("mean_present"), ma.alias("mean_absent"),
                    F.when(pooled > 0, (mp - ma) / pooled).otherwise(0.0).alias("cohens_d"), F.when(ratio < 0.8, "suppressor").when(ratio > 1.2, "enhancer").otherwise("neutral").alias("kind"))


def token_enrichment(examples: DataFrame, tokens: DataFrame, token: str = "token", q: float = 0.90, least_rate: float = 0.01) -> DataFrame:
    """Per token: share of its occurrences among high examples over its share among all; high is the activation of rank floor(q (n - 1)) from below or more."""
    n = examples.count()
    at = int(q * (n - 1) + 0.5)
    cut = rows_at_ranks(examples, "activation", "example_id", at + 1, at + 1, n).select(F.col("activation").alias("_cut"))
    marked = tokens.join(examples.select("example_id", F.col("activation").alias("_a")), "example_id").join(F.broadcast(cut)).withColumn("high", (F.col("_a") >= F.col("_cut")).cast("int"))
    g = marked.groupBy(token).agg(F.count(F.lit(1)).alias("n"), F.sum("high").alias("n_high"))
    g = g.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("rate_high", F.col("n_high") / F.sum("n_high").over(Window.partitionBy()))
    r = F.col("rate_high") / F.col("rate")
    return g.where(F.col("rate") >= least_rate).withColumn("ratio", r).withColumn("kind", F.when(r > 1.2, "enhancer").when(r < 0.8, "suppressor").otherwise("neutral"))


#: Size parameter of quantile sketches and the error of a rank, as a share of all values, that it keeps to with great certainty.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def quantile_sketches(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, sketch): a KLL sketch of each group's values, nulls left out, of a size that hardly grows with them; stored as binary, and merged by merged_sketches()."""
    some = rows.where(F.col(value).isNotNull())
    return some.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: str) -> DataFrame:
    """(by, n, sketch) of several sketches a group, such as those of batches or days."""
    return sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, n, share, quantile): the values at these shares of each group, within SKETCH_ERROR of the rank."""
    cells = F.array(*[F.struct(F.lit(q).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("quantile")) for q in shares])
    return sketches.select(by, "n", F.inline(cells))


def rank_error(quantiles: DataFrame, rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, share, quantile, error): by how much the share of a group's values at a quantile misses the one asked for; 0 where it lies among equal values that span it."""
    v = F.col(value)
    held = rows.where(v.isNotNull()).join(F.broadcast(quantiles), by)
    g = held.groupBy(by, "n", "share", "quantile").agg(F.avg((v < F.col("quantile")).cast("double")).alias("_lt"), F.avg((v <= F.col("quantile")).cast("double")).alias("_le"))
    return g.select(by, "n", "share", "quantile", F.greatest(F.lit(0.0), F.col("_lt") - F.col("share"), F.col("share") - F.col("_le")).alias("error"))


def presence_effect(examples: DataFrame, tokens: DataFrame, token: str = "token", least: int = 30, high_percentile: float = 0.90) -> DataFrame:
    """Per token that `least` examples hold: sizes and mean activations with and without it, their difference and effect size, and its enrichment among high examples.

    High are activations from the one at place max(1, n (1 - high_percentile)), from 0, downwards. enrichment is the rate of the high examples that hold the
    token over that of all; effect pools the sample variance of those with it and the population variance of those without. Where all examples hold a token the mean
    without it and the effect are 0. One aggregation with sums and squares tells both sides.
    """
    a, n = F.col("activation"), examples.count()
    at = n - min(max(1, int(n * (1 - high_percentile))), max(0, n - 1))
    cut = rows_at_ranks(examples, "activation", "example_id", at, at, n).select(a.alias("_cut"))
    marked = examples.select("example_id", "activation").join(F.broadcast(cut)).withColumn("_high", (a >= F.col("_cut")).cast("long"))
    total = marked.agg(F.count(F.lit(1)).alias("tn"), F.sum(a).alias("ts"), F.sum(a * a).alias("tq"), F.sum("_high").alias("th"))
    g = tokens.select("example_id", token).dropna().distinct().join(marked, "example_id").groupBy(token).agg(
        F.count(F.lit(1)).alias("n_with"), F.sum(a).alias("s"), F.sum(a * a).alias("q"), F.var_samp(a).alias("v"), F.sum("_high").alias("n_high_with")).where(F.col("n_with") >= least).join(F.broadcast(total))
    g = g.withColumn("n_without", F.col("tn") - F.col("n_with")).withColumn("mean_with", F.col("s") / F.col("n_with")).withColumn("mean_without", F.when(F.col("n_without") > 0, (F.col("ts") - F.col("s")) / F.col("n_without")).otherwise(0.0))
    without = F.greatest(F.lit(0.0), (F.col("tq") - F.col("q")) / F.col("n_without") - F.col("mean_without") * F.col("mean_without"))
    pooled = (F.col("v") * F.col("n_with") + without * F.col("n_without")) / F.col("tn")
    delta = F.col("mean_with") - F.col("mean_without")
    effect = F.when((F.col("n_with") > 1) & (F.col("n_without") > 1), delta / F.when(pooled > 0, F.sqrt(pooled)).otherwise(1e-10)).otherwise(0.0)
    base, high = F.col("n_with") / F.col("tn"), F.when(F.col("th") > 0, F.col("n_high_with") / F.col("th")).otherwise(0.0)
    return g.select(token, "n_with", "n_without", "mean_with", "mean_without", delta.alias("delta"), effect.alias("effect"), base.alias("baseline_rate"), high.alias("high_rate"), (high / base).alias("enrichment"), "n_high_with")


def conditional_presence(examples: DataFrame, tokens: DataFrame, levels: DataFrame, token: str = "token", rungs: tuple[int, ...] = (0, 12, 29, 41, 57), least: int = 5, least_overall: int = 30) -> DataFrame:
    """(token, level, mean_with, mean_without, delta, n_with, n_without, n_at_level): a token's effect among the examples of one level of a primary family.

    levels (example_id, level) has the highest level of that family, others being at 0. Levels outside rungs, levels with fewer than `least` examples on either side and tokens
    that fewer than least_overall examples hold are left out. Those without a token are the level's total less those with it.
    """
    top = levels.groupBy("example_id").agg(F.max("level").alias("level"))
    at = examples.select("example_id", "activation").join(top, "example_id", "left").na.fill(0, ["level"])
    total = at.where(F.col("level").isin(*rungs)).groupBy("level").agg(F.count(F.lit(1)).alias("n_at_level"), F.sum("activation").alias("_t"))
    held = tokens.select("example_id", token).dropna().distinct().join(at, "example_id").groupBy(token, "level").agg(F.count(F.lit(1)).alias("n_with"), F.sum("activation").alias("_s"))
    held = held.withColumn("_all", F.sum("n_with").over(Window.partitionBy(token))).where(F.col("_all") >= least_overall)
    g = held.join(total, "level").withColumn("n_without", F.col("n_at_level") - F.col("n_with")).where((F.col("n_with") >= least) & (F.col("n_without") >= least))
    g = g.withColumn("mean_with", F.col("_s") / F.col("n_with")).withColumn("mean_without", (F.col("_t") - F.col("_s")) / F.col("n_without"))
    return g.select(token, "level", "mean_with", "mean_without", (F.col("mean_with") - F.col("mean_without")).alias("delta"), "n_with", "n_without", "n_at_level")


def region_breakdown(bands: DataFrame, tokens: DataFrame, k: int = 5, family: str = "family") -> DataFrame:
    """(band, n, pct_of_total, kind, item, count, share, rank): each band's size and its k commonest contexts, by share of its examples, and families, by share of its tokens.

    bands (example_id, ctx, band), null bands being counted in the total only; tokens (example_id, family), one row a token.
    """
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("pct_of_total", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).where("band is not null")
    contexts = bands.where("band is not null").groupBy("band", F.col("ctx").alias("item")).agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("context"))
    families = tokens.select("example_id", F.col(family).alias("item")).join(bands.where("band is not null").select("example_id", "band"), "example_id").groupBy("band", "item").agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("family"))
    by = Window.partitionBy("band", "kind")
    both = contexts.unionByName(families).withColumn("share", F.col("count") / F.sum("count").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("count"), "item")))
    return both.where(F.col("rank") <= k).join(sizes, "band").select("band", "n", "pct_of_total", "kind", "item", "count", "share", "rank")


def range_shares(examples: DataFrame, tokens: DataFrame, low: float, high: float, n_tokens: int = 15, n_contexts: int = 10, token: str = "token") -> DataFrame:
    """(kind, rank, item, count, pct) of the examples whose activation lies between these shares of the range from least to greatest, ends included: the commonest tokens and contexts, in percent of the examples.

    examples (example_id, ctx, activation), tokens (example_id, token), one row an occurrence. Ties go by name; null contexts are not listed.
    """
    a = F.col("activation")
    ends = examples.agg(F.min(a).alias("_lo"), F.max(a).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    inside = examples.select("example_id", "ctx", "activation").join(F.broadcast(ends)).where(a.between(F.col("_lo") + low * width, F.col("_lo") + high * width))
    total = inside.agg(F.count(F.lit(1)).alias("_n"))
    parts = []
    for kind, items, k in (("token", tokens.select("example_id", F.col(token).alias("item")).join(inside.select("example_id"), "example_id"), n_tokens), ("context", inside.select(F.col("ctx").alias("item")), n_contexts)):
        g = items.where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("count"))
        top = g.orderBy(F.desc("count"), "item").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "item")))  # k rows
        parts.append(top.join(F.broadcast(total)).select(F.lit(kind).alias("kind"), "rank", "item", "count", (100.0 * F.col("count") / F.col("_n")).alias("pct")))
    return parts[0].unionByName(parts[1])


def region_kits(region: DataFrame, kits: list[str], k: int = 15) -> DataFrame:
    """(kit, item, n, pct, rank): for each kit column of a region's examples its k commonest items, in percent of the region; null and empty items count for the region only."""
    cells = region.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kit"), F.col(c).cast("string").alias("item")) for c in kits])))
    total = region.agg(F.count(F.lit(1)).alias("_n"))
    g = cells.where("item is not null and item <> ''").groupBy("kit", "item").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    w = Window.partitionBy("kit").orderBy(F.desc("n"), "item")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("kit", "item", "n", (100.0 * F.col("n") / F.col("_n")).alias("pct"), "rank")


def core_tail(examples: DataFrame, tokens: DataFrame, token: str, core: tuple[float, float] = (0.25, 0.75), tail: float = 0.75, q: float = 0.995) -> DataFrame:
    """Per token: shares of core rows (between core[0] M and core[1] M) and of tail rows (over tail M) that hold it, M the q quantile of positive activations; enrichment is tail over core, 10 at most, 1 where neither holds it."""
    m = exact_quantile(examples.where("activation > 0"), "activation", "example_id", q, "_m")
    a = F.col("activation")
    flags = examples.select("example_id", "activation").join(F.broadcast(m)).select(
        "example_id", ((a > core[0] * F.col("_m")) & (a <= core[1] * F.col("_m"))).cast("int").alias("core"), (a > tail * F.col("_m")).cast("int").alias("tail"))
    total = flags.agg(F.sum("core").alias("nc"), F.sum("tail").alias("nt"))
    g = tokens.select("example_id", token).distinct().join(flags, "example_id").groupBy(token).agg(F.sum("core").alias("c"), F.sum("tail").alias("t")).join(F.broadcast(total))
    pc, pt = F.col("c") / F.col("nc"), F.col("t") / F.col("nt")
    return g.select(token, pc.alias("core_share"), pt.alias("tail_share"), F.when(pc > 0, F.least(pt / pc, F.lit(10.0))).otherwise(F.when(pt > 0, 10.0).otherwise(1.0)).alias("tail_enrichment"), (pc < 0.30).alias("tail_marker"))


def context_coverage(examples: DataFrame, ctx: str = "ctx", over: float = 2.0, tail: float = 0.10) -> DataFrame:
    """core_tail() of contexts, with flanderized: enriched in the tail more than `over` times and in over `tail` of its rows."""
    c = core_tail(examples, examples.select("example_id", ctx), ctx).drop("tail_marker")
    return c.withColumn("flanderized", (F.col("tail_enrichment") > over) & (F.col("tail_share") > tail))


def interference(examples: DataFrame, levels: DataFrame, pairs: list[tuple[int, int]], least: int = 5, flat: float = 0.01, by: tuple[str, ...] = (), least_rows: int = 0) -> DataFrame:
    """(by, family, lo, hi, mean_alone, mean_both, n_alone, n_both, delta, kind): within a family, mean activation of examples holding level hi but not lo, and both.

    levels (example_id, family, level) may hold several levels of a family. kind is reduction, enhancement or neutral at `flat`. With by, columns of examples
    such as the context, each group is compared by itself, groups of fewer than least_rows examples left out.
    """
    some = examples.select("example_id", "activation", *by)
    if by and least_rows:
        some = some.join(some.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least_rows).select(*by), list(by))
    held = levels.select("example_id", "family", "level").dropna().groupBy("example_id", "family").agg(F.collect_set("level").alias("held")).join(some, "example_id")
    p = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in pairs]))
    both = F.array_contains("held", F.col("p.lo"))
    x = held.withColumn("p", p).where(F.array_contains("held", F.col("p.hi"))).select(*by, "family", "activation", "p.lo", "p.hi", both.alias("_both"))
    g = x.groupBy(*by, "family", "lo", "hi").agg(
        F.avg(F.when(~F.col("_both"), F.col("activation"))).alias("mean_alone"), F.avg(F.when(F.col("_both"), F.col("activation"))).alias("mean_both"), F.count_if(~F.col("_both")).alias("n_alone"), F.count_if("_both").alias("n_both"))
    g = g.where((F.col("n_alone") >= least) & (F.col("n_both") >= least)).withColumn("delta", F.col("mean_both") - F.col("mean_alone"))
    return g.withColumn("kind", F.when(F.col("delta") < -flat, "reduction").when(F.col("delta") > flat, "enhancement").otherwise("neutral"))


def floor_share(rows: DataFrame, by: str, under: float = 0.1) -> DataFrame:
    """Per group: share of activations under a floor, and whether it is over half."""
    g = rows.groupBy(by).agg(F.avg((F.col("activation") < under).cast("double")).alias("floor_rate"))
    return g.withColumn("floored", F.col("floor_rate") > 0.5)
