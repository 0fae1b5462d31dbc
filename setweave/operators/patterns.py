"""Itemsets that set one band of examples apart from another, by parallel FP-growth.

Items are ordered by how many sets of the high band hold them, the commonest first. A set is dealt to the shards of its
items: for each, what stands before it. A shard's distinct prefixes, with their counts in both bands, are its
conditional base, from which a prefix tree grows the itemsets that end in its item; so every itemset is counted whole
in one shard and in both bands at once. A shard with too many prefixes for one tree is dealt out again, by its last two items.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import forget, written
from setweave.operators.ranking import rows_at_ranks

#: Distinct prefixes that one tree is built from.
TREE_ROWS = 200_000
COUNTS = ["n_high", "n_base"]


class PrefixTree:
    """Paths of items with counts in two bands; items are ranks, smaller ones nearer the root."""

    def __init__(self) -> None:
        self.item, self.parent, self.high, self.base = [-1], [0], [0], [0]
        self.child: dict[tuple[int, int], int] = {}
        self.header: dict[int, list[int]] = {}

    def add(self, path: list[int], high: int, base: int) -> None:
        at = 0
        for item in path:
            node = self.child.get((at, item))
            if node is None:
                node = self.child[at, item] = len(self.item)
                self.item.append(item)
                self.parent.append(at)
                self.high.append(0)
                self.base.append(0)
                self.header.setdefault(item, []).append(node)
            self.high[node] += high
            self.base[node] += base
            at = node

    def way(self, node: int) -> list[int]:
        """The items above a node, from the root."""
        out, at = [], self.parent[node]
        while at:
            out.append(self.item[at])
            at = self.parent[at]
        return out[::-1]

    def grow(self, suffix: tuple[int, ...], least: int, most: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(items, count in high, count in base) of the itemsets of up to `most` items that end in suffix and that `least` high sets hold."""
        for item, nodes in self.header.items():
            high, base = sum(self.high[n] for n in nodes), sum(self.base[n] for n in nodes)
            if high < least:
                continue
            found = (item, *suffix)
            yield found, high, base
            if len(found) < most:
                conditional = PrefixTree()
                for n in nodes:
                    if above := self.way(n):
                        conditional.add(above, self.high[n], self.base[n])
                yield from conditional.grow(found, least, most)


def _grown(least: int, most: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = PrefixTree()
        for prefix, high, base in zip(rows["prefix"], rows["n_high"], rows["n_base"]):
            tree.add(list(prefix), high, base)
        return pd.DataFrame([(list(items), high, base) for items, high, base in tree.grow(tuple(key[0]), least, most)], columns=["items", *COUNTS])

    return run


def _dealt(rows: DataFrame, suffix: Column) -> DataFrame:
    """(suffix, prefix, counts): each path cut at every place, the item there before the suffix and what stands before it as the prefix; equal ones count together."""
    at = rows.select(suffix.alias("_s"), "path", *COUNTS, F.posexplode("path").alias("i", "item"))
    cut = at.select(F.concat(F.array("item"), "_s").alias("suffix"), F.slice("path", F.lit(1), F.col("i")).alias("prefix"), *COUNTS)
    return cut.groupBy("suffix", "prefix").agg(*[F.sum(c).alias(c) for c in COUNTS])


def frequent_itemsets(sets: DataFrame, least: int, most: int) -> DataFrame:
    """(items, n_high, n_base): itemsets of 2 to `most` items that at least `least` high sets hold, and how many sets of each band do.

    sets (tokens array, high boolean; false is the other band). items are sorted arrays. Only items frequent in the
    high band enter, and equal sets count together from the start.
    """
    tokens = F.array_sort(F.array_distinct(F.array_compact("tokens")))
    equal = written(sets.groupBy(tokens.alias("tokens")).agg(F.count_if("high").alias("n_high"), F.count_if(~F.col("high")).alias("n_base")))
    held = equal.select(F.explode("tokens").alias("token"), "n_high").groupBy("token").agg(F.sum("n_high").alias("n")).where(F.col("n") >= least)
    known = written(held.select("token", "n", F.monotonically_increasing_id().alias("item")))
    met = equal.select("tokens", *COUNTS, F.explode("tokens").alias("token")).join(known, "token").groupBy("tokens", *COUNTS)
    ordered = met.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token", "item"))).alias("o"))
    paths = ordered.select(F.col("o.item").alias("path"), *COUNTS).where(F.size("path") > 1)

    base = written(_dealt(paths, F.array().cast("array<bigint>")).where(F.size("prefix") > 0))
    done, used = [], [equal, base]
    for size in range(2, most + 1):
        large = base.groupBy("suffix").count().where(F.col("count") > TREE_ROWS).select("suffix")
        some = not large.isEmpty()
        small = base.join(large, "suffix", "left_anti") if some else base
        done.append(written(small.groupBy("suffix").applyInPandas(_grown(least, most), "items array<bigint>, n_high long, n_base long")))
        if not some:
            break
        further = written(_dealt(base.join(large, "suffix", "left_semi").withColumnRenamed("prefix", "path"), F.col("suffix")))
        done.append(written(further.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in COUNTS]).where(F.col("n_high") >= least).withColumnRenamed("suffix", "items")))
        used += [further]
        if size < most:
            base = written(further.where(F.size("prefix") > 0).join(done[-1].select(F.col("items").alias("suffix")), "suffix", "left_semi"))
            used += [base]
    found = functools.reduce(DataFrame.unionByName, done)
    named = found.select("items", *COUNTS, F.explode("items").alias("item")).join(known.select("item", "token"), "item").groupBy("items", *COUNTS)
    out = written(named.agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.col("tokens").alias("items"), *COUNTS))
    forget(*used, *done, known)
    return out


def banded(sets: DataFrame, value: str, tie: str, high_pct: float, middle: tuple[float, float]) -> DataFrame:
    """sets of the top high_pct percent by value (ties: by key) with high true, and of the ranks between the middle shares with high false; others and null values go."""
    n = sets.where(F.col(value).isNotNull()).count()
    at = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))

    def from_rank(rank: int) -> Column:
        """Whether a row has this rank, from 0, or a higher one."""
        if rank >= n:
            return F.lit(False)
        row = rows_at_ranks(sets, value, tie, rank + 1, rank + 1, n).select(value, tie).first()
        return at >= F.struct(F.lit(row[0]).cast(sets.schema[value].dataType).alias("v"), F.lit(row[1]).cast(sets.schema[tie].dataType).alias("t"))

    high = from_rank(int(n * (1 - high_pct / 100)))
    inside = from_rank(int(n * middle[0])) & ~from_rank(int(n * middle[1]))
    return sets.where(F.col(value).isNotNull()).withColumn("high", F.when(high, True).when(inside, False)).where("high is not null")


def contrastive_itemsets(sets: DataFrame, value: str = "activation", tie: str = "example_id", high_pct: float = 5.0, middle: tuple[float, float] = (0.25, 0.75), most: int = 4,
                         commonest: int = 200, k: int = 50, least_share: float = 0.01, least_support: float = 0.001, least_lift: float = 1.5) -> DataFrame:
    """(size, itemset, count_high, support_high, support_base, lift): for each size from 2 the k itemsets of highest lift.

    sets (tokens array, value, tie). The top high_pct percent by value are set against those between the middle shares of the ranks, sets of one
    token left out of both. An itemset counts if max(2, least_share of the high sets) hold it, if it is among the commonest of its size there, and if its
    support is over least_lift times that of the middle, which is taken as least_support at least. Without sets in either band there are none.
    """
    bands = banded(sets, value, tie, high_pct, middle).withColumn("tokens", F.array_distinct(F.array_compact("tokens"))).where(F.size("tokens") > 1)
    bands = written(bands.select("tokens", "high"))
    total = bands.agg(F.count_if("high").alias("h"), F.count_if(~F.col("high")).alias("b")).first()
    found = frequent_itemsets(bands if total.h and total.b else bands.limit(0), max(2, int(total.h * least_share)), most)
    forget(bands)
    by_size = Window.partitionBy("size")
    sized = found.select(F.size("items").alias("size"), F.array_join("items", "|").alias("itemset"), F.col("n_high").alias("count_high"), "n_base")
    common = sized.withColumn("_r", F.row_number().over(by_size.orderBy(F.desc("count_high"), "itemset"))).where(F.col("_r") <= commonest)
    high, base = F.col("count_high") / float(max(1, total.h)), F.greatest(F.col("n_base") / float(max(1, total.b)), F.lit(least_support))
    lifted = common.select("size", "itemset", "count_high", high.alias("support_high"), base.alias("support_base"), (high / base).alias("lift")).where(F.col("lift") > least_lift)
    best = lifted.withColumn("_r", F.row_number().over(by_size.orderBy(F.desc(F.round("lift", 9)), "itemset"))).where(F.col("_r") <= k)
    return best.drop("_r")
