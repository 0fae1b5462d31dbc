"""Entropy, divergence and information gain over probability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(rows: DataFrame, by: list[str], weight: str, name: str = "p") -> DataFrame:
    """rows with weight over its group's sum; groups of no positive mass drop out."""
    total = F.sum(weight).over(Window.partitionBy(*by))
    return rows.withColumn("_t", total).where("_t > 0").withColumn(name, F.col(weight) / F.col("_t")).drop("_t")


def plogp(p: Column, base: float = 2.0) -> Column:
    return F.when(p > 0, p * F.log(p) / F.log(F.lit(base))).otherwise(0.0)


def entropy(rows: DataFrame, by: list[str], p: str = "p", base: float = 2.0) -> DataFrame:
    """(by, entropy), 0 log 0 being 0."""
    return rows.groupBy(*by).agg((-F.sum(plogp(F.col(p), base))).alias("entropy"))


def normalised_entropy(rows: DataFrame, by: list[str], p: str = "p", eps: float = 1e-10) -> DataFrame:
    """(by, entropy): over log2 of the number of outcomes; 0 for one outcome."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.when(n > 1, -F.sum(F.col(p) * F.log2(F.col(p) + eps)) / F.log2(n)).otherwise(0.0).alias("entropy"))


def jensen_shannon(rows: DataFrame, group: str, outcome: str, p: str = "p") -> DataFrame:
    """(a, b, js) of every pair of groups: H(m) - (H(p) + H(q)) / 2, outcomes that one lacks counting zero."""
    x = rows.select(F.col(group).alias("a"), outcome, F.col(p).alias("x"))
    y = rows.select(F.col(group).alias("b"), outcome, F.col(p).alias("y"))
    g = x.join(y, outcome).where("a < b")
    both = lambda u: plogp(u)
    shared = g.groupBy("a", "b").agg(F.sum(both((F.col("x") + F.col("y")) / 2) - (both(F.col("x")) + both(F.col("y"))) / 2).alias("s"),
                                     F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    # An outcome of one side alone adds p / 2 to the divergence.
    return shared.select("a", "b", (-F.col("s") + (1 - F.col("sx")) / 2 + (1 - F.col("sy")) / 2).alias("js"))


def information_gain(base: DataFrame, given: DataFrame, by: str = "ctx") -> DataFrame:
    """(by, h0, gain, ratio): H0 less the p0-weighted entropies after each token. base (by, token, p0); given (by, given, token, p)."""
    h0 = base.groupBy(by).agg((-F.sum(plogp(F.col("p0")))).alias("h0"))
    h1 = given.groupBy(by, F.col("given").alias("token")).agg((-F.sum(plogp(F.col("p")))).alias("h1"))
    after = base.join(h1, [by, "token"]).groupBy(by).agg(F.sum(F.col("p0") * F.col("h1")).alias("rest"))
    g = F.col("h0") - F.col("rest")
    return h0.join(after, by).select(by, "h0", g.alias("gain"), F.when(F.col("h0") > 0, g / F.col("h0")).otherwise(0.0).alias("ratio"))


def token_gain(base: DataFrame, given: DataFrame, by: str = "ctx") -> DataFrame:
    """(by, token, p0, h1, share): each token's contribution p0 (H0 - H1)."""
    h0 = base.groupBy(by).agg((-F.sum(plogp(F.col("p0")))).alias("h0"))
    h1 = given.groupBy(by, F.col("given").alias("token")).agg((-F.sum(plogp(F.col("p")))).alias("h1"))
    return base.join(h1, [by, "token"]).join(h0, by).select(by, "token", "p0", "h1", (F.col("p0") * (F.col("h0") - F.col("h1"))).alias("share"))


def branchiness(base: DataFrame, given: DataFrame, by: str = "ctx") -> DataFrame:
    """(by, branchiness): p0-weighted divergence of each conditional distribution from p0 without the token, renormalised."""
    q = base.select(by, F.col("token").alias("o"), F.col("p0").alias("q0"))
    left = base.select(by, "token", "p0").join(q, by).where("o <> token").withColumn("q", F.col("q0") / (1 - F.col("p0")))
    both = left.join(given.select(by, F.col("given").alias("token"), F.col("token").alias("o"), "p"), [by, "token", "o"], "left").na.fill(0.0, ["p"])
    js = both.groupBy(by, "token").agg(F.first("p0").alias("p0"), (F.sum((plogp(F.col("p")) + plogp(F.col("q"))) / 2 - plogp((F.col("p") + F.col("q")) / 2))).alias("js"))
    return js.groupBy(by).agg((F.sum(F.col("p0") * F.col("js")) / F.sum("p0")).alias("branchiness"))


def suppression(base: DataFrame, given: DataFrame, m: int = 8, by: str = "ctx") -> DataFrame:
    """(by, suppression): among the m likeliest tokens, p0-weighted sum of max(0, p0 - p(. | token))."""
    w = Window.partitionBy(by).orderBy(F.desc("p0"), "token")
    top = base.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m).select(by, "token", "p0")
    pairs = top.join(top.select(by, F.col("token").alias("o"), F.col("p0").alias("q0")), by).where("o <> token")
    x = pairs.join(given.select(by, F.col("given").alias("token"), F.col("token").alias("o"), "p"), [by, "token", "o"], "left").na.fill(0.0, ["p"])
    return x.groupBy(by).agg(F.sum(F.col("p0") * F.greatest(F.lit(0.0), F.col("q0") - F.col("p"))).alias("suppression"))


def next_tier(tokens: DataFrame, current: DataFrame, by: str = "ctx") -> DataFrame:
    """(by, family, level): the least level of each family above the conditioned one."""
    return tokens.join(current.select(by, "family", F.col("level").alias("_now")), [by, "family"], "left").where(F.col("level") > F.coalesce("_now", F.lit(0))).groupBy(by, "family").agg(F.min("level").alias("level"))


def depth_delta(rows: DataFrame, by: str, discount: float = 0.9) -> DataFrame:
    """(by, delta, gain_per_delta, discounted): expected depth change sum p (after - before), gain over it, and gain discounted by base ** log(depth). rows (by, p, before, after, gain)."""
    g = rows.groupBy(by).agg(F.sum(F.col("p") * (F.col("after") - F.col("before"))).alias("delta"), F.first("gain").alias("gain"), F.sum(F.col("p") * F.col("after")).alias("depth"))
    return g.select(by, "delta", F.when(F.col("delta") != 0, F.col("gain") / F.col("delta")).alias("gain_per_delta"), (F.col("gain") * F.pow(F.lit(discount), F.log(F.greatest("depth", F.lit(1.0))))).alias("discounted"))


def multimodality(base: DataFrame, by: str = "ctx", b: float = 2.0) -> DataFrame:
    """(by, spread, mass, branches): sum 2 p (1 - p), sum p, and base to the entropy of p0 normalised."""
    n = normalised(base, [by], "p0", "q")
    return n.groupBy(by).agg(F.sum(2 * F.col("p0") * (1 - F.col("p0"))).alias("spread"), F.sum("p0").alias("mass"), F.pow(F.lit(b), -F.sum(plogp(F.col("q"), b))).alias("branches"))
