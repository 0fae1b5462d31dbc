"""Similarity, correlation, overlap and matrix products over long-form activations."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import forget, written
from setweave.operators.components import connected_components
from setweave.operators.density import dense_clusters  # noqa: F401  one of the similarity operators
from setweave.operators.matrices import matrix_product
from setweave.operators.ranking import pearson


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_neighbours(vectors: DataFrame, key: str, vector: str, target: int, k: int, eps: float = 1e-8) -> DataFrame:
    """(key, cosine): the k rows nearest to one row by cosine (norms plus eps), the row itself left out."""
    q = vectors.where(F.col(key) == target).select(F.col(vector).alias("_q")).limit(1)
    v = F.col(vector)
    cos = dot(v, F.col("_q")) / ((F.sqrt(dot(v, v)) + eps) * (F.sqrt(dot(F.col("_q"), F.col("_q"))) + eps))
    return vectors.where(F.col(key) != target).join(F.broadcast(q)).select(key, cos.alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


#: Vectors and cells of a block, blocks being compared pair by pair, and sums of a pair of blocks held at once.
POSTING, CELLS, SUMS = 16_384, 4_000_000, 1 << 22


def _partial_index(cells: DataFrame, least: float) -> DataFrame:
    """(key, token, v, rest): the part of every unit vector that has to be looked up to find all pairs of cosine over least.

    Tokens are ordered from the most to the least widespread. What is left out at the front has a norm (rest) under least, so no vector reaches
    least with it alone, and two vectors of such a cosine share a token of both looked-up parts.
    """
    spread = cells.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    of = Window.partitionBy("key").orderBy(F.desc("_df"), "token")
    summed = cells.join(spread, "token").withColumn("_front", F.sum(F.col("v") * F.col("v")).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    kept = summed.withColumn("_in", F.col("_front") >= least * least - 1e-9)
    left_out = F.max(F.when(~F.col("_in"), F.col("_front"))).over(Window.partitionBy("key"))
    return kept.withColumn("rest", F.sqrt(F.coalesce(left_out, F.lit(0.0)))).where("_in").select("key", "token", "v", "rest")


def _numbered(cells: DataFrame) -> DataFrame:
    """(token, number): the tokens numbered from 0, the most widespread first."""
    spread = cells.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    held = written(spread.orderBy(F.desc("_df"), "token").select("token", F.monotonically_increasing_id().alias("_at")))
    part, at = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, sizes = [0], {r.p: r.n for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a task
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    return held.select("token", (F.get(F.lit(before), part) + at).cast("int").alias("number"))


class _Block:
    """Unit vectors (key, t, v, n) of one block, cell by cell in order of the tokens; the last n of each are looked up."""

    def __init__(self, table: pa.Table) -> None:
        lists = table["t"].combine_chunks()
        self.keys, self.size = table["key"].combine_chunks(), table.num_rows
        self.t, self.v = lists.flatten().to_numpy(), table["v"].combine_chunks().flatten().to_numpy()
        self.length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        own = np.repeat(np.arange(self.size), self.length)
        upto = np.cumsum(self.v * self.v)
        before = np.concatenate([[0.0], upto])[self.start]
        #: norm of what lies before a cell in its vector
        front = np.sqrt(np.maximum(0.0, upto - self.v * self.v - before[own]))
        first = self.end - table["n"].to_numpy()
        self.rest, self.bound = front[first], self.t[first]
        kept = np.flatnonzero(np.arange(len(self.t)) >= first[own])
        kept = kept[np.argsort(self.t[kept], kind="stable")]
        self.kept_t, self.kept_v, self.kept_own, self.kept_front = self.t[kept], self.v[kept], own[kept], front[kept]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all cells of the rows, one after the other, and where each row's begin."""
        n = self.length[rows]
        begin = np.cumsum(n) - n
        return np.repeat(self.start[rows] - begin, n) + np.arange(n.sum()), begin


def _may_reach(x: _Block, y: _Block, least: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x from lo to hi, row of y) that can have a cosine over least; within one block the second is the greater."""
    tokens, first, count = np.unique(y.kept_t, return_index=True, return_counts=True)
    mine = np.flatnonzero((x.kept_own >= lo) & (x.kept_own < hi))[::-1]  # from the rarest token on
    at = np.searchsorted(tokens, x.kept_t[mine])
    met = at < len(tokens)
    met[met] = tokens[at[met]] == x.kept_t[mine][met]
    mine, at = mine[met], at[met]
    total, rest = np.zeros((hi - lo) * y.size), np.full((hi - lo) * y.size, -np.inf)
    chunk = np.cumsum(count[at]) // SUMS
    for k in np.unique(chunk):
        some = chunk == k
        n, i = count[at[some]], np.repeat(mine[some], count[at[some]])
        j = np.repeat(first[at[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if x is y:
            i, j = (z[x.kept_own[i] < y.kept_own[j]] for z in (i, j))
        a, b = x.kept_own[i], y.kept_own[j]
        place = (a - lo) * y.size + b
        np.add.at(total, place, x.kept_v[i] * y.kept_v[j])
        # what is not looked up on both sides lies in the longer front, and before the first token that both look up: of one place's values the last, its first token's, stays
        rest[place] = np.where(x.bound[a] >= y.bound[b], x.rest[a] * y.kept_front[j], y.rest[b] * x.kept_front[i])
    found = np.flatnonzero(total + rest > least - 1e-9)
    return found // y.size + lo, found % y.size


def _compared(least: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        within = key[0] == key[1]
        if not left.num_rows or not (within or right.num_rows):
            names = (left if left.num_rows else right)["key"].slice(0, 0)
            return pa.table({"a": names, "b": names, "cosine": pa.array([], pa.float64())})
        x = _Block(left)
        y = x if within else _Block(right)
        tokens = np.unique(x.t)
        mine, theirs = np.searchsorted(tokens, x.t), np.searchsorted(tokens, y.t)
        theirs[tokens[np.minimum(theirs, len(tokens) - 1)] != y.t] = len(tokens)
        dense = np.zeros(len(tokens) + 1)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, SUMS // y.size)
        for lo in range(0, x.size, step):
            i, j = _may_reach(x, y, least, lo, min(lo + step, x.size))
            for row, begin, end in zip(*(z.tolist() for z in _runs(i))):
                own, others = slice(x.start[row], x.end[row]), j[begin:end]
                dense[mine[own]] = x.v[own]
                places, starts = y.cells(others)
                cosine = np.add.reduceat(dense[theirs[places]] * y.v[places], starts)
                dense[mine[own]] = 0.0
                over = cosine > least
                out.append((np.full(over.sum(), row), others[over], cosine[over]))
        i, j, c = (np.concatenate(z) for z in zip(*out))
        return pa.table({"a": x.keys.take(pa.array(i)), "b": y.keys.take(pa.array(j)), "cosine": c})

    return run


def _runs(sorted_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of each run of equal numbers."""
    rows, begin, n = np.unique(sorted_rows, return_index=True, return_counts=True)
    return rows, begin, begin + n


def cosine_pairs(rows: DataFrame, key: str, token: str, value: str, least: float) -> DataFrame:
    """(a, b, cosine), a < b: all pairs of sparse vectors (key, token, value) with a cosine over least > 0.

    Vectors lie in blocks that meet pair by pair, each pair of blocks a task's work of bounded memory. In it vectors meet on the tokens of their partial indexes
    only, and a pair goes on if what these give and the norms of the fronts that they leave out can reach least; what goes on is computed whole, and only the pairs
    found leave the task. Values of a cell given twice add up; null keys, tokens and values and vectors of zeros take no part.
    """
    if least <= 0:
        raise ValueError("least must be over 0: pairs without a common token have cosine 0")
    raw = rows.select(F.col(key).alias("key"), F.col(token).alias("token"), F.col(value).cast("double").alias("v")).dropna()
    raw = written(raw.groupBy("key", "token").agg(F.sum("v").alias("v")).where("v <> 0"))
    norms = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
    order = _numbered(raw)
    cells = written(raw.join(order, "token").join(norms, "key").select("key", F.col("number").alias("token"), (F.col("v") / F.col("_n")).alias("v")))
    forget(raw, order)
    looked_up = _partial_index(cells, least).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    listed = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("token", "v"))).alias("s")).join(looked_up, "key")
    n_cells, n_keys = cells.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    n = max(1, math.ceil(n_keys / POSTING), math.ceil(n_cells / CELLS))
    vectors = written(listed.select("key", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("lo"), F.col("s.token").alias("t"), F.col("s.v").alias("v"), "n"))
    forget(cells)
    # a block pair with itself is on the first side only
    first = vectors.withColumn("hi", F.explode(F.sequence("lo", F.lit(n - 1))))
    own = vectors.select(F.col("lo").alias("hi"), *[F.col(c).alias(c) for c in ("key", "t", "v", "n")])  # columns of their own, so that the two sides share none
    second = own.withColumn("lo", F.explode(F.when(F.col("hi") > 0, F.sequence(F.lit(0), F.col("hi") - 1))))
    kind = f"a {vectors.schema['key'].dataType.simpleString()}, b {vectors.schema['key'].dataType.simpleString()}, cosine double"
    met = first.groupBy("lo", "hi").cogroup(second.groupBy("lo", "hi")).applyInArrow(_compared(least), kind)
    out = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine"))
    forget(vectors)
    return out


def correlations(acts: DataFrame, least_pairs: int, features: list[int] | None = None) -> DataFrame:
    """(a, b, n, r): Pearson correlation of two features over the examples that hold both, for pairs with enough of them and some spread."""
    x = acts if features is None else acts.where(F.col("feature_id").isin(features))
    held = x.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature_id").alias("f"), F.col("activation").alias("v")))).alias("s"))  # an example holds each feature once
    one = held.select("s", F.posexplode("s").alias("i", "l"))
    pairs = one.select(F.col("l.f").alias("a"), F.col("l.v").alias("x"), F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("r"))
    g = pairs.select("a", F.col("r.f").alias("b"), "x", F.col("r.v").alias("y")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("r"))
    return g.where((F.col("n") >= least_pairs) & F.col("r").isNotNull() & ~F.isnan("r"))


def feature_relationship(acts: DataFrame, influences: DataFrame, a: int, b: int, token: str = "token") -> DataFrame:
    """(token, held_by, raw_a, raw_b, net_a, net_b, kind, n_shared, correlation) of two features over the examples in which both are active.

    acts (feature_id, example_id, activation), influences (feature_id, token, value). A token's net influence on a feature is its value times the sum of the feature's activations over the
    shared examples; agree or conflict by the signs of both, neutral where either is under 0.01 an example. held_by tells which feature has a value for the token, the other's being 0.
    correlation is that of the shared activations, 0 where there are fewer than two or one side is constant.
    """
    active = acts.where((F.col("activation") > 0) & F.col("feature_id").isin(a, b))
    of = lambda f: F.max(F.when(F.col("feature_id") == f, F.col("activation")))
    shared = active.groupBy("example_id").agg(of(a).alias("_x"), of(b).alias("_y")).dropna()
    total = shared.agg(F.count(F.lit(1)).alias("n_shared"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_sx"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("_sy"), pearson("_x", "_y").alias("_c"))
    raw = influences.where(F.col("feature_id").isin(a, b)).groupBy(token).agg(*[F.max(F.when(F.col("feature_id") == f, F.col("value"))).alias(n) for f, n in ((a, "_a"), (b, "_b"))])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = raw.join(F.broadcast(total)).withColumn("net_a", zero("_a") * F.col("_sx")).withColumn("net_b", zero("_b") * F.col("_sy"))
    bound = F.when(F.col("n_shared") > 0, 0.01 * F.col("n_shared")).otherwise(0.01)
    kind = F.when((F.abs("net_a") < bound) | (F.abs("net_b") < bound), "neutral").when(F.col("net_a") * F.col("net_b") > 0, "agree").otherwise("conflict")
    held = F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").otherwise("both")
    return x.select(token, held.alias("held_by"), zero("_a").alias("raw_a"), zero("_b").alias("raw_b"), "net_a", "net_b", kind.alias("kind"), "n_shared", zero("_c").alias("correlation"))


def correlation_clusters(corr: DataFrame, threshold: float) -> DataFrame:
    """(component, size, members): connected components of features correlated at threshold or more, largest first."""
    c = connected_components(corr.where(F.col("r") >= threshold), "a", "b")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("members"))


def shared_drivers(tops: DataFrame, tokens: DataFrame, token: str = "token", least: int = 2) -> DataFrame:
    """(token, n_features, total): tokens among the top examples of several features."""
    g = tops.select("feature_id", "example_id").join(tokens.select("example_id", token), "example_id").groupBy(token).agg(F.count_distinct("feature_id").alias("n_features"), F.count(F.lit(1)).alias("total"))
    return g.where(F.col("n_features") >= least)


def coactive_features(acts: DataFrame, examples: DataFrame, per_example: int, k: int) -> DataFrame:
    """(feature_id, n, share, mean): among the strongest features of each of the given examples."""
    w = Window.partitionBy("example_id").orderBy(F.desc("activation"), "feature_id")
    x = acts.join(examples.select("example_id").distinct(), "example_id", "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_example)
    n = examples.select("example_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
    g = x.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.avg("activation").alias("mean")).join(F.broadcast(n))
    return g.select("feature_id", "n", (F.col("n") / F.col("_n")).alias("share"), "mean").orderBy(F.desc("n"), "feature_id").limit(k)


def overlap_counts(members: DataFrame, item: str, of: str) -> DataFrame:
    """(a, b, n): items that two sets share, the diagonal being set sizes: the product of the membership matrix with itself, block by block.

    An item in very many sets is one inner key of dense blocks, whatever the number of pairs it makes.
    """
    m = members.select(item, of).distinct()
    one = F.lit(1.0)
    n = matrix_product(m.select(F.col(of).alias("a"), item, one.alias("x")), m.select(item, F.col(of).alias("b"), one.alias("y")), "a", item, "b")
    return n.select("a", "b", F.round("value").cast("long").alias("n"))


def n_way_overlap(members: DataFrame, item: str, of: str) -> DataFrame:
    """(kind, n): items in all sets ('shared') and in one only ('unique:<set>')."""
    m = members.select(item, of).distinct()
    n = m.agg(F.count_distinct(of).alias("_n"))
    g = m.groupBy(item).agg(F.count(F.lit(1)).alias("c"), F.min(of).alias("only")).join(F.broadcast(n))
    kind = F.when(F.col("c") == F.col("_n"), F.lit("shared")).when(F.col("c") == 1, F.concat(F.lit("unique:"), F.col("only").cast("string")))
    return g.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def verify_columns(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, max_abs, mean_abs) of the difference of two columns."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.agg(F.count(d).alias("n"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))
