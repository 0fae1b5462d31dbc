"""Filters, slices, seeded samples and splits. Every draw is an order by a seeded hash, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.tokens import hashed
from setweave.operators.ranking import rank_within, sliced_rank


def percentile_slice(rows: DataFrame, lo: float, hi: float, by: list[str], value: str = "activation", tie: str = "example_id") -> DataFrame:
    """Rows ranked ascending within by at [floor(n lo / 100), floor(n hi / 100))."""
    ranked = rank_within(rows, by, value, tie, "_r", "_n")
    return ranked.where((F.col("_r") > F.floor(F.col("_n") * lo / 100)) & (F.col("_r") <= F.floor(F.col("_n") * hi / 100))).drop("_r", "_n")


def _hash_rank(rows: DataFrame, by: list[str], key: str, seed: str, name: str, size: str | None = None) -> DataFrame:
    """rows with their rank from 1 by hash of key within by; slices are the 4096 prefixes of the hash."""
    h = rows.withColumn("_h", hashed(F.col(key), seed))
    return sliced_rank(h, by, F.substring("_h", 1, 3), [F.col("_h"), F.col(key)], name, size).drop("_h")


def sample_n(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows by hash of key; a partial top-n, no full sort."""
    return rows.orderBy(hashed(F.col(key), seed), key).limit(n)


def sample_n_per_group(rows: DataFrame, n: int, by: str, key: str, seed: str) -> DataFrame:
    """At most n rows of each group by hash of key: a reservoir that merges."""
    w = Window.partitionBy(by).orderBy(hashed(F.col(key), seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sample_fraction(rows: DataFrame, fraction: float, key: str, seed: str) -> DataFrame:
    """Rows whose hash of key falls in the first fraction of 65536 slots."""
    return rows.where(F.conv(F.substring(hashed(F.col(key), seed), 1, 4), 16, 10).cast("int") < int(fraction * 65536))


def rebalance(rows: DataFrame, by: str, won: str, key: str, target: float, seed: str) -> DataFrame:
    """Rows with losses (or wins) of each group thinned so that wins make up target.

    With W wins and L losses: under target int(W / target) - W losses stay, else int(L / (1 - target)) - L wins.
    """
    counts = rows.groupBy(by).agg(F.sum(F.col(won).cast("int")).alias("_w"), F.sum((~F.col(won)).cast("int")).alias("_l"))
    counted = _hash_rank(rows, [by, won], key, seed, "_r").join(counts, by)
    low = F.col("_w") / (F.col("_w") + F.col("_l")) < target
    keep = F.when(low, F.when(F.col(won), F.col("_w")).otherwise(F.floor(F.col("_w") / target) - F.col("_w"))).otherwise(
        F.when(F.col(won), F.floor(F.col("_l") / (1 - target)) - F.col("_l")).otherwise(F.col("_l")))
    return counted.where(F.col("_r") <= keep).select(*rows.columns)


def split(rows: DataFrame, key: str, val: float, test: float, seed: str) -> DataFrame:
    """rows with split: train, val, test of exactly int(n (1 - val - test)), int(n val) and the rest.

    The cut points are ranks in hash order. They are found by counting rows per hash prefix and ranking
    within a prefix, so no task sees more than a prefix's rows.
    """
    h = rows.withColumn("_h", hashed(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    ranked = h.join(F.broadcast(before.drop("_n")), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    a = F.floor(F.col("_all") * (1 - val - test) + 1e-9)
    b = a + F.floor(F.col("_all") * val + 1e-9)
    return ranked.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "val").otherwise("test")).drop("_h", "_b", "_before", "_all", "_r")


def stratified_split(rows: DataFrame, by: str, key: str, fraction: float, seed: str) -> DataFrame:
    """rows with is_eval: max(1, round(n fraction)), at most n - 1, of each stratum; strata of one row are all training."""
    n = F.col("_n")
    take = F.when(n < 2, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.round(n * fraction))))
    return _hash_rank(rows, [by], key, seed, "_r", "_n").withColumn("is_eval", F.col("_r") <= take).drop("_r", "_n")


def masked_instances(sets: DataFrame, k: int, key: str = "example_id", items: str = "tokens", seed: str = "mask", skew: float = 1.2, null_token: str | None = None) -> DataFrame:
    """(key, instance, target, observed): k masked copies of each set, and with a null_token one more, instance 0, that shows this token alone.

    The number of removed tokens, 1 to max(1, n - 1), is drawn with probability proportional to (r / sum r) ** skew by inverse
    distribution on a hash; which ones, by hash order of the tokens.
    """
    first = 0 if null_token is None else 1
    x = sets.withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(k - 1 + first))))
    u = F.conv(F.substring(hashed(F.col(key), F.col("instance"), seed), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))
    most = F.greatest(F.lit(1), F.size(items) - 1)
    weights = F.transform(F.sequence(F.lit(1), most), lambda r: F.pow(r / (most * (most + 1) / 2), F.lit(skew)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    run = F.transform(F.sequence(F.lit(1), most), lambda r: F.aggregate(F.slice(weights, F.lit(1), r), F.lit(0.0), lambda a, w: a + w))
    removed = F.least(most, F.size(F.filter(run, lambda c: c <= u * total)) + 1)
    mixed = F.transform(F.array_sort(F.transform(items, lambda t: F.struct(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("instance").cast("string"), t, F.lit(seed))).alias("h"), t.alias("t")))), lambda s: s["t"])
    observed = F.array_sort(F.slice(mixed, F.lit(1), F.greatest(F.lit(0), F.size(items) - removed)))
    if null_token is not None:
        observed = F.when(F.col("instance") == 0, F.array(F.lit(null_token))).otherwise(observed)
    return x.select(key, "instance", F.array_sort(items).alias("target"), observed.alias("observed"))


def mask_items(items: DataFrame, masks: list[int], by: str, item: str, n: str, seed: str) -> DataFrame:
    """(mask, by, item, observed): for each mask, the multiset left after removing that many of its units by hash order."""
    units = items.withColumn("_u", F.explode(F.sequence(F.lit(1), F.col(n)))).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    w = Window.partitionBy("mask", by).orderBy(hashed(F.col(by), F.col("mask"), F.col(item), F.col("_u"), seed), item, "_u")
    return units.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > F.col("mask")).groupBy("mask", by, item).agg(F.count(F.lit(1)).cast("int").alias("observed"))


def outside_windows(rows: DataFrame, events: DataFrame, day: str = "day", at: str = "event_day", length: str = "days") -> DataFrame:
    """rows whose day lies in none of [event, event + days]. Each event's days are listed, so the join is on equality and shuffles by day."""
    covered = events.select(F.explode(F.sequence(F.col(at), F.date_add(at, F.col(length)))).alias(day)).distinct()
    return rows.join(covered, day, "left_anti")


def band_of(value: Column, most: Column, cuts: tuple[float, ...] = (0.0, 0.01, 0.10, 0.25, 0.75, 0.90)) -> Column:
    """Number of the band (lo M, hi M] that a value falls in, the last one open; null at or below zero."""
    out = F.lit(None).cast("int")
    for i, c in enumerate(cuts):
        out = F.when(value > c * most, i).otherwise(out)
    return out
