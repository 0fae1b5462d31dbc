"""Many patterns in many texts, met by equality instead of by comparing each with each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import forget, written

#: Bytes (UTF-8) of the piece by which a pattern looks for its texts, 4 at most; a shorter pattern is a piece itself.
GRAM = 4
#: Bytes of text cut into pieces at once, and the powers of two between which the bits of a table of pieces lie (32 MB at most).
PART, LEAST_BITS, MOST_BITS = 1 << 20, 16, 28


def longest_prefix(rows: DataFrame, categories: DataFrame, token: str = "token") -> DataFrame:
    """rows with category, the longest of categories.name that the token starts with, followed by an underscore, and rest, what follows that; both null where there is none.

    A token's prefixes end at its underscores, so it joins the names on as many keys as it has underscores, whatever the number of names.
    """
    words = F.split(token, "_")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), "_"))
    own = rows.select(token).dropna().distinct().where(F.contains(F.col(token), F.lit("_"))).select(token, F.explode(cuts).alias("name"))
    best = own.join(categories.select("name").distinct(), "name").groupBy(token).agg(F.max_by("name", F.length("name")).alias("category"))
    best = best.withColumn("rest", F.substring(token, F.length("category") + 2, F.length(token)))
    return rows.join(best, token, "left")


def _mixed(pieces: np.ndarray) -> np.ndarray:
    return (pieces.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MOST_BITS)


def _parts(texts: list[bytes], overlap: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers, bytes) of the texts, about PART bytes at a time; a longer text comes in several that overlap."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), PART):
            piece = text[at : at + PART + overlap]
            if held and size + len(piece) > PART:
                yield tuple(zip(*held))
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        yield tuple(zip(*held))


def _pieces(texts: list[bytes], sizes: list[int], bits: np.ndarray | None = None, power: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, pieces): the different pieces of these sizes of each text as numbers, part by part, those only that the bit table holds."""
    for numbers, part in _parts(texts, max(sizes, default=1) - 1):
        data = np.frombuffer(b"".join(part), np.uint8).astype(np.int64)
        length = np.array([len(x) for x in part])
        left, own = np.repeat(np.cumsum(length), length) - np.arange(len(data)), np.repeat(np.array(numbers, np.int64), length)
        found = []
        for size in sizes:
            n = len(data) - size + 1
            if n <= 0:
                continue
            piece = np.full(n, size << 32, np.int64)
            for j in range(size):
                piece |= data[j : j + n] << (8 * j)
            take = left[:n] >= size
            if bits is not None:
                place = (_mixed(piece) >> np.uint64(MOST_BITS - power)).astype(np.int64)
                take &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0
            found.append(pd.DataFrame({"t": own[:n][take], "p": piece[take]}))
        if found:
            different = pd.concat(found).drop_duplicates()
            yield different["t"].to_numpy(), different["p"].to_numpy()


def _of_patterns(gram: int):
    """A row (pattern, piece, place) for each piece of `gram` bytes of a pattern, or for all of a shorter one; place is where the bit table has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = b["raw"].tolist()
            for size in range(1, gram + 1):
                some = [i for i, x in enumerate(raw) if (len(x) == size if size < gram else len(x) >= gram)]
                for t, p in _pieces([raw[i] for i in some], [size]):
                    yield pd.DataFrame({"pattern": b["pattern"].iloc[np.array(some, int)[t]].to_numpy(), "piece": p, "place": _mixed(p).astype(np.int64)})

    return run


def _of_texts(sizes: list[int], bits, power: int, counted: bool):
    """A row (id, piece) for each different piece of a text that the bit table holds; counted: (piece, n), the texts of each, one of several parts once a part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, p in _pieces(b["raw"].tolist(), sizes, bits.value, power):
                if counted:
                    piece, n = np.unique(p, return_counts=True)
                    yield pd.DataFrame({"piece": piece, "n": n})
                else:
                    yield pd.DataFrame({"id": b["id"].iloc[t].to_numpy(), "piece": p})

    return run


def _bit_table(pieces: DataFrame) -> tuple[np.ndarray, int]:
    """(packed bits, power of two) of all pieces (piece, place): 16 bits for each up to MOST_BITS; beyond that it passes more, and loses none."""
    n = pieces.select("piece").distinct().count()
    power = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, n) - 1).bit_length()))
    place = F.shiftright("place", MOST_BITS - power) + 1  # Spark's bitmaps count from 1
    maps = pieces.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(1 << power - 3, np.uint8)
    for r in maps.collect():  # 4 KB each, 8,192 rows at most
        part, at = np.frombuffer(r.bits, np.uint8), (r.bucket - 1) * 4096
        table[at : at + len(part)] = part[: len(table) - at]
    return table, power


def _looked_up(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, id): the texts (id, text) that hold the rarest piece of a pattern (pattern), as pairs to be compared; neither side null or empty.

    The texts are read twice: once to count those of each piece that any pattern has, and once for the pieces that patterns look by. Only ids move.
    """
    spark = patterns.sparkSession
    own = written(patterns.select("pattern", F.col("pattern").cast("binary").alias("raw")).mapInPandas(_of_patterns(GRAM), "pattern string, piece long, place long"))
    raw = texts.select("id", F.col("text").cast("binary").alias("raw"))

    def held(pieces: DataFrame, counted: bool, kind: str) -> DataFrame:
        sizes = sorted(r.s for r in pieces.select(F.shiftright("piece", 32).alias("s")).distinct().collect())
        bits, power = _bit_table(pieces)
        return raw.mapInPandas(_of_texts(sizes, spark.sparkContext.broadcast(bits), power, counted), kind)

    spread = held(own, True, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # a pattern with a piece that no text holds looks no further
    rarest = own.join(spread, "piece", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece", "place")).alias("m")).where("m.n > 0")
    rarest = written(rarest.select("pattern", "m.piece", "m.place"))
    out = written(held(rarest, False, f"id {texts.schema['id'].dataType.simpleString()}, piece long").distinct().join(rarest.select("pattern", "piece"), "piece").select("pattern", "id"))
    forget(own, rarest)
    return out


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def occurrences(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, text): which of the different patterns (pattern) occur in which of the different texts (text); empty and null ones take no part.

    A pattern looks for texts by that of its pieces of GRAM bytes that the fewest texts hold, and is then compared as a whole; a pattern with a piece that
    no text holds looks no further. Shorter patterns are pieces themselves. So a common piece meets few patterns and a rare one few texts. Pairs are
    found by digests of the texts; a text itself moves once, to the patterns it has to be compared with.
    """
    p = patterns.select("pattern").where("pattern is not null and pattern <> ''").distinct()
    t = texts.select("text").where("text is not null and text <> ''").select(_digest(F.col("text")).alias("id"), "text")
    lists = _looked_up(p, t).groupBy("id").agg(F.collect_list("pattern").alias("_ps"))
    met = t.join(lists, "id").groupBy("id").agg(F.any_value("text").alias("text"), F.any_value("_ps").alias("_ps"))
    return met.select("text", F.explode(F.filter("_ps", lambda x: F.contains(F.col("text"), x))).alias("pattern")).select("pattern", "text")


def category_by_substring(rows: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """rows with category of the first rule (by rule_order) whose name contains the row's or lies in it, ignoring case; null names and names without any have none.

    An empty name lies in every rule's, so it has the first; an empty rule lies in every name. Rules are looked for in names as in occurrences(), and each
    name is compared with those it may hold where it lies; names that are no longer than the longest rule are looked for in the rules.
    """
    first = F.min(F.struct("rule_order", "category")).alias("_b")
    low = written(rules.select(F.lower("rule_name").alias("rule"), "category", "rule_order").dropna(subset=["rule"]).groupBy("rule").agg(first))
    some = low.where("rule <> ''")
    named = rows.withColumn("_name", F.lower(name)).withColumn("_id", _digest(F.col("_name")))
    texts = named.where("_name <> ''")
    may = _looked_up(some.select(F.col("rule").alias("pattern")), texts.select(F.col("_id").alias("id"), F.col("_name").alias("text")))
    lists = may.withColumnRenamed("pattern", "rule").join(some, "rule").groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("_b", "rule")).alias("_may"))
    longest = some.agg(F.max(F.octet_length("rule")).alias("n")).first().n or 0
    short = texts.where(F.octet_length("_name") <= longest).select(F.col("_name").alias("pattern")).distinct()
    inside = _looked_up(short, some.select(F.col("rule").alias("id"), F.col("rule").alias("text"))).withColumnRenamed("id", "rule").where(F.contains(F.col("rule"), F.col("pattern")))
    lying = inside.join(some, "rule").groupBy(_digest(F.col("pattern")).alias("_id")).agg(F.min("_b").alias("_in"))
    always = low.where("rule = ''").agg(F.min("_b").alias("_e"))  # one row
    whole = low.agg(F.min("_b").alias("_w"))  # one row
    holds = F.array_min(F.transform(F.filter("_may", lambda c: F.contains(F.col("_name"), c["rule"])), lambda c: c["_b"]))
    met = named.join(lists, "_id", "left").withColumn("_h", holds).drop("_may").join(lying, "_id", "left").join(F.broadcast(always)).join(F.broadcast(whole))
    best = met.withColumn("_b", F.least("_h", "_in"))
    other = F.when(F.col("_b").isNull() | (F.col("_e.rule_order") < F.col("_b.rule_order")), F.coalesce("_e", "_b")).otherwise(F.col("_b"))
    pick = F.when(F.col("_name") == "", F.col("_w")).when(F.col("_name").isNotNull(), other)
    return best.withColumn("category", pick["category"]).drop("_id", "_name", "_h", "_in", "_b", "_e", "_w")
