"""Set-completion metrics, bootstrap intervals, paired tests and null checks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.tokens import TOTAL, hashed
from setweave.operators.ranking import global_rank, pearson


def multiset_counts(truth: DataFrame, pred: DataFrame, by: str, item: str, n: str) -> DataFrame:
    """(by, both, missing, extra, truth_n, pred_n): sizes of a multiset's intersection and differences per case."""
    t = truth.groupBy(by, item).agg(F.sum(n).alias("_t"))
    p = pred.groupBy(by, item).agg(F.sum(n).alias("_p"))
    x = t.join(p, [by, item], "full_outer").na.fill(0, ["_t", "_p"])
    return x.groupBy(by).agg(F.sum(F.least("_t", "_p")).alias("both"), F.sum(F.greatest(F.col("_t") - F.col("_p"), F.lit(0))).alias("missing"),
                             F.sum(F.greatest(F.col("_p") - F.col("_t"), F.lit(0))).alias("extra"), F.sum("_t").alias("truth_n"), F.sum("_p").alias("pred_n"))


def compare(truth: DataFrame, pred: DataFrame, by: str, item: str, n: str, worst: float = 2.0 * TOTAL) -> DataFrame:
    """multiset_counts with accuracy 1 - L1 / worst and exact_hit."""
    d = F.col("missing") + F.col("extra")
    return multiset_counts(truth, pred, by, item, n).withColumn("accuracy", 1 - d / worst).withColumn("exact_hit", (d == 0).cast("int"))


def completion(truth: DataFrame, observed: DataFrame, pred: DataFrame, by: str, item: str) -> DataFrame:
    """(by, slot_accuracy, observed_recall, violation) for multisets (by, item, n).

    slot_accuracy = |(pred - obs) and (truth - obs)| / |truth - obs|, 1 where nothing is missing, 0 without a
    prediction; observed_recall = |pred and obs| / |obs|; violation tells that obs is not contained in pred.
    """
    of = lambda df, c: df.groupBy(by, item).agg(F.sum("n").alias(c))
    x = of(truth, "t").join(of(observed, "o"), [by, item], "full_outer").join(of(pred, "p"), [by, item], "full_outer").na.fill(0, ["t", "o", "p"])
    zero = F.lit(0)
    need, got = F.greatest(F.col("t") - F.col("o"), zero), F.greatest(F.col("p") - F.col("o"), zero)
    g = x.groupBy(by).agg(F.sum(need).alias("need"), F.sum(F.least(need, got)).alias("hit"), F.sum("o").alias("obs"), F.sum(F.least("p", "o")).alias("kept"), F.sum("p").alias("pn"))
    return g.select(by, F.when(F.col("pn") == 0, 0.0).when(F.col("need") == 0, 1.0).otherwise(F.col("hit") / F.col("need")).alias("slot_accuracy"),
                    F.when(F.col("obs") > 0, F.col("kept") / F.col("obs")).otherwise(1.0).alias("observed_recall"), (F.col("kept") < F.col("obs")).cast("int").alias("violation"))


def top_k_eval(ranked: DataFrame, by: str) -> DataFrame:
    """(by, exact_hit, best_accuracy, first_accuracy, best_rank) over ranks up to the first exact hit. ranked (by, rank, exact_hit, accuracy)."""
    hit = F.min(F.when(F.col("exact_hit") == 1, F.col("rank"))).over(Window.partitionBy(by))
    x = ranked.withColumn("_h", hit).where("_h is null or rank <= _h")
    return x.groupBy(by).agg(F.max("exact_hit").alias("exact_hit"), F.max("accuracy").alias("best_accuracy"), F.min_by("accuracy", "rank").alias("first_accuracy"),
                             F.max(F.struct("accuracy", (-F.col("rank")).alias("r"))).alias("_b")).select(by, "exact_hit", "best_accuracy", "first_accuracy", (-F.col("_b.r")).alias("best_rank"))


def edit_cost(truth: DataFrame, pred: DataFrame, by: str, removed: int = 5, swap: int = 3, step: int = 2) -> DataFrame:
    """(by, cost, cross_family): cost of turning pred's family levels into truth's: swaps of a surplus family for a missing one, removals of further surplus, steps between levels.

    Levels (by, family, level) are compared by their place on the ladder in column step.
    """
    x = truth.select(by, "family", F.col("step").alias("t")).join(pred.select(by, "family", F.col("step").alias("p")), [by, "family"], "full_outer")
    g = x.groupBy(by).agg(F.count_if(F.col("p").isNull()).alias("lack"), F.count_if(F.col("t").isNull()).alias("over"), F.sum(F.abs(F.col("t") - F.col("p"))).alias("steps"))
    s = F.least("lack", "over")
    return g.select(by, (swap * s + removed * (F.greatest("lack", "over") - s) + step * F.coalesce("steps", F.lit(0))).alias("cost"), (s > 0).alias("cross_family"))


#: Cumulative Poisson(1) probabilities in 65536ths; a 16-bit draw's weight is how many lie at or under it.
POISSON_CUTS = (24109, 48219, 60273, 64291, 65296, 65497, 65530, 65535)


def bootstrap_mean(rows: DataFrame, value: str, key: str, resamples: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """(mean, ci_low, ci_high): percentile interval of the mean over resamples of the rows.

    Each row has a Poisson(1) weight in each resample by hash of its key, which is what drawing n of n rows with replacement comes
    to; weights and weighted values are summed before the shuffle, so one row a resample and task moves. Eight weights come
    from one hash. Nulls take no part.
    """
    some = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(key).alias("_key"))
    drawn = some.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // 8)))).withColumn("_h", hashed(F.col("_key"), F.col("_b"), seed))
    # two weights from each eight digits of the hash; the eight of a hash are summed side by side, so a row is told to its resamples' sums without being repeated for them
    pairs = drawn.select("v", "_b", *[F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_q{i}") for i in range(4)])
    digits = [c for i in range(4) for c in (F.shiftright(f"_q{i}", 16), F.col(f"_q{i}").bitwiseAND(65535))]
    weighed = pairs.select("v", "_b", *[sum(((u >= c).cast("int") for c in POISSON_CUTS[1:]), (u >= POISSON_CUTS[0]).cast("int")).alias(f"_w{i}") for i, u in enumerate(digits)])
    sums = weighed.groupBy("_b").agg(*[f.alias(n) for i in range(8) for f, n in ((F.sum(F.col(f"_w{i}") * F.col("v")), f"_s{i}"), (F.sum(f"_w{i}"), f"_n{i}"))])
    lanes = F.array(*[F.struct((F.col("_b") * 8 + i).alias("r"), (F.col(f"_s{i}") / F.col(f"_n{i}")).alias("m")) for i in range(8)])
    means = sums.select(F.inline(lanes)).where(F.col("r") < resamples)
    ci = means.agg(F.expr(f"percentile(m, {alpha / 2})").alias("ci_low"), F.expr(f"percentile(m, {1 - alpha / 2})").alias("ci_high"))
    return some.agg(F.avg("v").alias("mean")).join(F.broadcast(ci))


def bootstrap_mean_diff(rows: DataFrame, a: str, b: str, key: str, resamples: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """bootstrap_mean of the paired differences a - b."""
    return bootstrap_mean(rows.select(key, (F.col(a) - F.col(b)).alias("_diff")), "_diff", key, resamples, seed, alpha)


def paired_stats(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, mean_diff, t, effect): paired t statistic and Cohen's d_z of a - b; 0 where all differences are equal."""
    d = F.col(a) - F.col(b)
    g = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_s"))
    z = F.when(F.col("_s") > 0, F.col("mean_diff") / F.col("_s")).otherwise(0.0)
    return g.select(*by, "n", "mean_diff", (z * F.sqrt("n")).alias("t"), z.alias("effect"))


def wilcoxon(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, w_plus, z): signed-rank statistic with average ranks, zeros split, and its normal score corrected for ties.

    Ranks come from the counts of each distance, so a group's rows are counted, not sorted; z is null where all differences are zero.
    """
    d = F.col(a) - F.col(b)
    sizes = rows.withColumn("_d", d).where("_d is not null").groupBy(*by, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("_d") > 0).alias("_p"))
    w = Window.partitionBy(*by)
    rank = F.sum("_t").over(w.orderBy("_a")) - (F.col("_t") - 1) / 2.0
    plus = F.when(F.col("_a") == 0, F.col("_t") / 2.0).otherwise(F.col("_p").cast("double"))
    g = sizes.withColumn("_r", rank).groupBy(*by).agg(
        F.sum("_t").alias("n"), F.sum(F.col("_r") * plus).alias("w_plus"), F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"), F.max("_a").alias("_most"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    return g.withColumn("z", F.when(F.col("_most") > 0, (F.col("w_plus") - n * (n + 1) / 4.0) / sd)).drop("_ties", "_most")


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: the regularised incomplete beta function of df / (df + t^2), by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1 - _beta_part(1 - x, b, a)
    return _beta_part(x, a, b)


def _beta_part(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 10_000):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + part * d or tiny)
            c = 1 + part / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def p_values(tests: DataFrame, z: str = "z") -> DataFrame:
    """tests with two-sided normal p-values, 1 where there is no difference (null); the table has a row for each comparison, so the error function runs in Python on a few rows."""
    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: normal_p(v) if v == v else 1.0)

    return tests.withColumn("p", p(z))


def t_p_values(tests: DataFrame) -> DataFrame:
    """paired_stats with t_p, the two-sided p-value of t with n - 1 degrees of freedom; 1 where t is 0 or n is under 2."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b - 1) if b > 1 and a else 1.0 for a, b in zip(t, n)], dtype=float)

    return tests.withColumn("t_p", p("t", "n"))


def micro_f1(rows: DataFrame, truth: str, pred: str, label: str, by: list[str]) -> DataFrame:
    """(precision, recall, f1) over all (by, label) cells of 0/1 columns."""
    tp, fp, fn = (F.sum((c).cast("int")) for c in ((F.col(truth) == 1) & (F.col(pred) == 1), (F.col(truth) == 0) & (F.col(pred) == 1), (F.col(truth) == 1) & (F.col(pred) == 0)))
    x = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return x.select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"),
                    (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def split_half(tokens: DataFrame, key: str, token: str, weight: str, splits: int, seed: str, least: int = 5) -> DataFrame:
    """(split, r, n): correlation over common tokens of two random halves' weighted token shares; 0 for fewer than least tokens."""
    x = tokens.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    half = F.conv(F.substring(hashed(F.col(key), F.col("split"), seed), 1, 2), 16, 10).cast("int") % 2
    g = x.groupBy("split", token).agg(F.sum(F.when(half == 0, F.col(weight)).otherwise(0.0)).alias("a"), F.sum(F.when(half == 1, F.col(weight)).otherwise(0.0)).alias("b")).where("a > 0 and b > 0")
    return g.groupBy("split").agg(F.when(F.count(F.lit(1)) >= least, pearson("a", "b")).otherwise(0.0).alias("r"), F.count(F.lit(1)).alias("n"))


def shuffle_null(examples: DataFrame, tokens: DataFrame, rounds: int, top: float, seed: str, key: str = "example_id", token: str = "token") -> DataFrame:
    """(observed, null_mean, p): the commonest token's share of all tokens among the top examples by activation, its mean in shuffled tops, and how often one is as high.

    A round's shuffled top is the examples of least hash, as many as the top holds. The cut is found by counting examples by
    prefix of the hash, and only those of the prefix it falls in are ranked.
    """
    n = examples.count()
    m = max(1, int(n * top + 1e-9))
    # of equal activations the greater keys are in the top
    real = global_rank(examples, "activation", key, "_rank").where(F.col("_rank") > n - m).select(key, F.lit(-1).alias("round"))
    drawn = examples.select(key, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("_h", hashed(F.col(key), F.col("round"), seed)).withColumn("_p", F.substring("_h", 1, 3))
    sizes = drawn.groupBy("round", "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = sizes.withColumn("_u", F.sum("_n").over(Window.partitionBy("round").orderBy("_p")))
    cut = upto.where((F.col("_u") >= m) & (F.col("_u") - F.col("_n") < m)).select("round", F.col("_p").alias("_cut"), (m - F.col("_u") + F.col("_n")).alias("_left"))  # one row a round
    met = drawn.join(F.broadcast(cut), "round")
    last = met.where(F.col("_p") == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy("round").orderBy("_h", key))).where(F.col("_r") <= F.col("_left"))
    tops = real.unionByName(met.where(F.col("_p") < F.col("_cut")).select(key, "round")).unionByName(last.select(key, "round"))
    counts = tops.join(tokens.select(key, token).distinct(), key).groupBy("round", token).agg(F.count(F.lit(1)).alias("c"))
    stat = counts.groupBy("round").agg((F.max("c") / F.sum("c")).alias("s"))
    seen = stat.where("round = -1").select(F.col("s").alias("observed"))
    return stat.where("round >= 0").join(F.broadcast(seen)).groupBy("observed").agg(F.avg("s").alias("null_mean"), F.avg((F.col("s") >= F.col("observed")).cast("double")).alias("p"))


def _log_soft(v: Column) -> Column:
    """Logarithms of the softmax of an array."""
    top = F.array_max(v)
    rest = F.log(F.aggregate(F.transform(v, lambda t: F.exp(t - top)), F.lit(0.0), lambda s, t: s + t))
    return F.transform(v, lambda t: t - top - rest)


def vector_comparison(rows: DataFrame, a: str, b: str, target: str | None = None) -> list[Column]:
    """Columns mse, cosine, kl (softmax a to b), agree (same top entry) of two array columns; with target, an index from 0, also loss_a and loss_b, the cross-entropy of each, and hit_a and hit_b, whether its top entry is the target.

    A target that is null or no index of the vectors is padding: its losses and hits are null. Of equal top entries the first counts.
    """
    x, y = F.col(a), F.col(b)
    from setweave.operators.similarity import dot

    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    mse = total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))) / F.size(x)
    lx, ly = _log_soft(x), _log_soft(y)
    kl = total(F.zip_with(lx, ly, lambda p, q: F.exp(p) * (p - q)))
    best = lambda v: F.array_position(v, F.array_max(v)) - 1
    told = [mse.alias("mse"), (dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).alias("cosine"), kl.alias("kl"), (best(x) == best(y)).cast("int").alias("agree")]
    if target is not None:
        t = F.col(target)
        known = (t >= 0) & (t < F.size(x))
        told += [F.when(known, -F.get(v, t.cast("int"))).alias(n) for v, n in ((lx, "loss_a"), (ly, "loss_b"))]
        told += [F.when(known, (best(v) == t).cast("int")).alias(n) for v, n in ((x, "hit_a"), (y, "hit_b"))]
    return told


def vector_summary(compared: DataFrame) -> DataFrame:
    """One row over the rows of vector_comparison() with a target: n, mean mse, cosine, kl, losses and their increase, top-1 accuracies and their change, and the share of equal top entries; what needs a target is over rows that have one."""
    valid = F.col("loss_a").isNotNull()
    g = compared.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), *[F.avg(c).alias(c) for c in ("mse", "cosine", "kl", "loss_a", "loss_b")], F.avg("hit_a").alias("top1_a"), F.avg("hit_b").alias("top1_b"), F.avg(F.when(valid, F.col("agree"))).alias("top1_match"))
    return g.withColumn("loss_increase", F.col("loss_b") - F.col("loss_a")).withColumn("top1_change", F.col("top1_b") - F.col("top1_a"))
