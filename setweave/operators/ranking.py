"""Top-k, ranks and slices by rank. Ties go to the smaller key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from setweave.functions.session import forget, written


#: Comparisons that one generated expression nests.
_BRANCHES = 64


def _tree(value: Column, bounds: list, first: int = 0) -> Column:
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(value > bounds[m], _tree(value, bounds[m + 1 :], first + m + 1)).otherwise(_tree(value, bounds[:m], first))


def _slice_of(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds lie under value: a balanced tree of comparisons, and where there are many bounds such a tree over every so manieth of them, then those in between one by one."""
    if len(bounds) <= _BRANCHES:
        return _tree(value, bounds)
    step = -(-len(bounds) // _BRANCHES)
    before = _tree(value, bounds[step - 1 :: step]) * step
    return before + F.size(F.filter(F.slice(F.lit(bounds), before + 1, F.lit(step)), lambda b: b < value))


#: Rows of a slice that a rank is made from, and the least and most slices.
SLICE_ROWS, LEAST_SLICES, MOST_SLICES = 1_000_000, 64, 4096


def _cuts(rows: DataFrame, value: str) -> list:
    """Approximate quantiles that cut rows into slices of about SLICE_ROWS; a value that many rows share comes several times.

    One pass where LEAST_SLICES are enough, a second one for finer cuts where they are not.
    """

    def cut(slices: int) -> tuple[int, list]:
        n, found = rows.agg(F.count(F.lit(1)), F.percentile_approx(value, [i / slices for i in range(1, slices)], 10 * slices)).first()
        return n, found or []

    n, found = cut(LEAST_SLICES)
    slices = min(MOST_SLICES, n // SLICE_ROWS)
    return cut(slices)[1] if slices > LEAST_SLICES else found


def slice_bounds(rows: DataFrame, value: str) -> list:
    return sorted(set(_cuts(rows, value)))


def slices_of(rows: DataFrame, value: str, tie: str, descending: bool = False) -> Column:
    """Number of a row's slice in order of value, then tie. A value that fills several slices is cut by quantiles of its ties, where these are numbers."""
    cuts = _cuts(rows, value)
    at = _slice_of(F.col(value), sorted(set(cuts)))
    at = -at if descending else at
    times = {v: cuts.count(v) for v in set(cuts)}
    heavy = {v: n for v, n in times.items() if n > 1}
    if not heavy or not isinstance(rows.schema[tie].dataType, NumericType):
        return at
    most = max(heavy.values())
    share = [F.percentile_approx(tie, [i / (most + 1) for i in range(1, most + 1)], 10 * (most + 1)).alias("q")]
    found = rows.where(F.col(value).isin(list(heavy))).groupBy(value).agg(*share).collect()
    within = F.lit(most + 1 if descending else 0)  # a cut is the greatest value of its slice
    for r in found:
        own = sorted(set(r["q"][:: max(1, most // heavy[r[value]])]))
        within = F.when(F.col(value) == r[value], _slice_of(F.col(tie), own)).otherwise(within)
    return at * (most + 2) + within


def sliced_rank(rows: DataFrame, by: list[str], sliced: Column, order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """rows with their rank from 1 within by, where rows of a smaller `sliced` come first and order settles the rest.

    Slices of a group are ranked apart and offset by the sizes of those before, so no task sorts more than a slice, however
    large a group; only the sizes are summed in one place. size names a column for the rows of the group.
    """
    cut = rows.withColumn("_s", sliced)
    group = Window.partitionBy(*by)
    sizes = cut.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*by, "_s", (F.sum("_n").over(group.orderBy("_s")) - F.col("_n")).alias("_b"), F.sum("_n").over(group).alias("_all"))
    place = F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))
    met = cut.alias("cut").join(before.alias("before"), [F.col("cut._s") == F.col("before._s"), *[F.col(f"cut.{c}").eqNullSafe(F.col(f"before.{c}")) for c in by]])
    out = met.select("cut.*", "before._b", "before._all").withColumn(name, F.col("_b") + place)
    return (out.withColumn(size, F.col("_all")) if size else out).drop("_s", "_b", "_all")


def global_rank(rows: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """rows with their rank from 1 by value, then tie, over the whole table; slices are cut at approximate quantiles."""
    return sliced_rank(rows, [], slices_of(rows, value, tie), [F.col(value), F.col(tie)], name)


def rank_within(rows: DataFrame, by: list[str], value: str, tie: str, name: str, size: str | None = None, descending: bool = False) -> DataFrame:
    """rows with their rank from 1 by value (or falling value), then tie, within each group."""
    return sliced_rank(rows, by, slices_of(rows, value, tie, descending), [F.desc(value) if descending else F.col(value), F.col(tie)], name, size)


def rows_at_ranks(rows: DataFrame, value: str, tie: str, first: int, last: int, n: int) -> DataFrame:
    """The rows with ranks first to last of n, from 1 by value, then tie, with column _rank; null values are not ranked.

    Approximate quantiles on both sides of the ranks and one count leave only the rows between them to be ranked.
    """
    known, wide = rows.where(F.col(value).isNotNull()), 1.0 / MOST_SLICES
    share = [max(0.0, (first - 1) / max(1, n) - wide), min(1.0, last / max(1, n) + wide)]
    lo, hi = known.agg(F.percentile_approx(value, share, 4 * MOST_SLICES)).first()[0] or (None, None)
    if lo is None:
        return global_rank(known, value, tie, "_rank").limit(0)
    below, held = known.agg(F.count_if(F.col(value) < lo), F.count_if(F.col(value).between(lo, hi))).first()
    near, at = known.where(F.col(value).between(lo, hi)), first - below
    if at < 1 or last - below > held:  # the quantiles were further off than their error allows
        near, at, held = known, first, n
    ranked = near.withColumn("_rank", F.row_number().over(Window.orderBy(value, tie))) if held <= SLICE_ROWS else global_rank(near, value, tie, "_rank")
    return ranked.where(F.col("_rank").between(at, at + last - first)).withColumn("_rank", F.col("_rank") + (first - at))


def exact_quantile(rows: DataFrame, value: str, tie: str, q: float, name: str) -> DataFrame:
    """One row: the q quantile of value, interpolated between its two ranks; null of an empty table."""
    n = rows.where(F.col(value).isNotNull()).count()
    pos = q * max(0, n - 1)
    lo, part = int(pos), pos - int(pos)
    at = rows_at_ranks(rows, value, tie, lo + 1, lo + 1 + (part > 0), n)
    return at.agg(((1 - part) * F.min(value) + part * F.max(value)).alias(name))


def top_per_group(rows: DataFrame, by: str, k: int, value: str = "activation", tie: str = "example_id", least: float | None = None) -> DataFrame:
    """The k highest rows of each group with rank from 1; Spark prunes to k per task before the shuffle."""
    if least is not None:
        rows = rows.where(F.col(value) > least)
    w = Window.partitionBy(by).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_and_bottom(rows: DataFrame, by: str, k: int, value: str, tie: str) -> DataFrame:
    """(by, sign, rank, tie, value): the k highest positive and k lowest negative rows of each group."""
    up = Window.partitionBy(by, "sign").orderBy(F.desc(F.abs(value)), tie)
    signed = rows.where(F.col(value) != 0).withColumn("sign", F.when(F.col(value) > 0, "+").otherwise("-"))
    return signed.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= k).select(by, "sign", "rank", tie, value)


def percentile_rank(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows with pct: percentage of the group strictly below in magnitude; null values have none and count for none.

    Magnitudes are counted first, so a group's zeros are one row when they are ranked, in slices of the different magnitudes.
    """
    sized = rows.withColumn("_m", F.abs(value))
    counts = sized.where("_m is not null").groupBy(by, "_m").agg(F.count(F.lit(1)).alias("_c"))
    cut = counts.withColumn("_s", _slice_of(F.col("_m"), slice_bounds(counts, "_m")))
    group = Window.partitionBy(by)
    sums = cut.groupBy(by, "_s").agg(F.sum("_c").alias("_n"))
    before = sums.select(F.col(by).alias("_by"), F.col("_s").alias("_t"), (F.sum("_n").over(group.orderBy("_s")) - F.col("_n")).alias("_b"), F.sum("_n").over(group).alias("_all"))
    inside = F.sum("_c").over(Window.partitionBy(by, "_s").orderBy("_m")) - F.col("_c")
    told = cut.withColumn("_w", inside).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_s") == F.col("_t"))).select(F.col(by).alias("_by"), F.col("_m").alias("_v"), (100.0 * (F.col("_b") + F.col("_w")) / F.col("_all")).alias("pct"))
    return sized.join(told, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_m") == F.col("_v")), "left").drop("_m", "_by", "_v")


def pearson(x: str, y: str) -> Column:
    """Correlation over the rows that hold both columns; null where one of them is constant, for which Spark's own raises an error."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _settled(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns written once: a mean of doubles can differ in its last digits whenever it is computed again, and rows would then miss the slices that were cut at it."""
    return written(rows.select(*dict.fromkeys(columns)))


def spearman(rows: DataFrame, by: list[str], x: str, y: str, tie: str) -> DataFrame:
    """(by, pearson, spearman, n): correlation of values and of ordinal ranks, ties by position."""
    held = _settled(rows, *by, x, y, tie)
    r = rank_within(rank_within(held, by, x, tie, "_x"), by, y, tie, "_y")
    r = r.withColumn("_x", F.col("_x").cast("double")).withColumn("_y", F.col("_y").cast("double"))
    out = written(r.groupBy(*by).agg(pearson(x, y).alias("pearson"), pearson("_x", "_y").alias("spearman"), F.count(F.lit(1)).alias("n")))
    forget(held)
    return out


def extreme_slices(rows: DataFrame, value: str, outcome: str, key: str, fraction: float) -> DataFrame:
    """(side, n, mean, members): the ceil(fraction n) lowest and highest rows by value (ties by key), their mean outcome and keys in order; a row on both sides is at the bottom. Null values take no part."""
    rows = _settled(rows, value, outcome, key)
    n = rows.where(F.col(value).isNotNull()).count()
    take = math.ceil(n * fraction)
    if not take:
        return rows.limit(0).groupBy(F.lit("bottom").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"), F.lit("").alias("members"))
    low = rows_at_ranks(rows, value, key, 1, take, n).withColumn("side", F.lit("bottom"))
    high = rows_at_ranks(rows, value, key, max(n - take, take) + 1, n, n).withColumn("side", F.lit("top")) if n > take else low.limit(0)
    out = written(low.unionByName(high).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"), F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("members")))
    forget(rows)
    return out


def top_share_or_count(rows: DataFrame, by: str, spec: str, value: str = "activation", tie: str = "example_id") -> DataFrame:
    """The highest rows of each group: a number ("200") or a share rounded up ("10pct")."""
    r = rank_within(rows, [by], value, tie, "rank", "_n", descending=True)
    keep = F.ceil(F.col("_n") * float(spec[:-3]) / 100) if spec.endswith("pct") else F.lit(int(spec))
    return r.where(F.col("rank") <= keep).drop("_n")


def priority(rows: DataFrame, done: DataFrame, by: str, k: int) -> DataFrame:
    """(by, n, priority): groups by count over the greatest count, without those done."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("priority", F.col("n") / F.max("n").over(Window.partitionBy()))
    return g.join(done.select(by), by, "left_anti").orderBy(F.desc("priority"), by).limit(k)
