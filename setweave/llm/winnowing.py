"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item, or a whole item of fewer. Of the hashes of a
window's word k-grams (k: half the window) the least is its fingerprint, so a text keeps
one fingerprint for several windows and equal windows have equal ones: every shared window is
met. Fingerprints of texts that no item has are left out by a bit table of the benchmark's, the rest are joined
with them, and the hits are extended to the windows they stand for, which are joined by digest with
the benchmark's distinct windows. Both joins are on keys that are unique on the benchmark's side, so a
phrase in many items and many texts makes no pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import forget, written
from setweave.llm.workers import lean

WINDOW = 10
#: Bytes of text hashed at once, and the powers of two between which the bit table's size lies (32 MB at most).
PIECE, LEAST_BITS, MOST_BITS = 1 << 19, 16, 28
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])  # of lower-cased UTF-8
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def _pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of a text; pieces end where no word goes on."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and _IS_WORD[raw[end]]:
            end += 1
        yield at, raw[at:end]
        at = end


class Words:
    """Where the words of some lower-cased texts lie, and a 64-bit hash of each: text, start, end, hash."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        held, size, parts = [], 0, []
        for i, raw in enumerate(texts):
            for offset, piece in _pieces(raw):
                if held and size + len(piece) > PIECE:
                    parts.append(self._hashed(held))
                    held, size = [], 0
                held.append((i, offset, piece))
                size += len(piece)
        parts.append(self._hashed(held))
        self.text, self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts))

    @staticmethod
    def _hashed(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b" ".join([p for _, _, p in held]) + b" ", np.uint8)
        inside = _IS_WORD[data]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        s, e = edges[::2], edges[1::2]
        # sums of value * base ** place; divided by base ** start a word's sum does not depend on where it stands
        up, down = _powers(len(data), _BASE), _powers(len(data), pow(_BASE, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up)])
        h = _mix((sums[e] - sums[s]) * down[s])
        begin = np.cumsum([0, *(len(p) + 1 for _, _, p in held)])
        own = np.searchsorted(begin, s, "right") - 1
        shift = np.array([o for _, o, _ in held], np.int64)[own] - begin[own] if len(s) else np.zeros(0, np.int64)
        return np.array([i for i, _, _ in held], np.int64)[own] if len(s) else np.zeros(0, np.int64), s + shift, e + shift, h

    def grams(self, k: int) -> np.ndarray:
        """Hashes of k words in a row, whatever texts they lie in."""
        out = self.hash
        for j in range(1, k):
            out = _mix(out[:-1] * np.uint64(_BASE + 2 * j) + self.hash[j:]) if len(out) > 1 else out[:0]
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of all windows of `size` words that lie in one text."""
        k = (size + 1) // 2
        least = self.grams(k)
        step, width = 1, size - k + 1
        while step < width:  # minima of `step` grams in a row
            more = min(step, width - step)
            least = np.minimum(least[:-more], least[more:]) if len(least) > more else least[:0]
            step += more
        at = np.arange(len(least))
        at = at[self.text[at] == self.text[at + size - 1]] if len(at) else at
        return at, least[at]

    def digest(self, first: int, size: int) -> bytes:
        """Of the words themselves, one space between them."""
        raw, w = self.texts[self.text[first]], range(first, first + size)
        return hashlib.md5(b" ".join([raw[self.start[i] : self.end[i]] for i in w]), usedforsecurity=False).digest()


def _lowered(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[bytes]]]:
    """(values of the other columns, lower-cased texts) of about a piece's bytes at a time; the text is the last column."""
    names, texts, size = [], [], 0
    for b in batches:
        for *n, t in b.itertuples(index=False, name=None):
            raw = _lowered(t)
            if texts and size + len(raw) > PIECE:
                yield names, texts
                names, texts, size = [], [], 0
            names.append(n)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield names, texts


def _of_items(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, texts in _grouped(batches):
            words = Words(texts)
            count = np.bincount(words.text, minlength=len(texts))
            out = []
            for size in range(1, window + 1):
                at, h = words.windows(size)
                whole = count[words.text[at]]
                take = whole >= window if size == window else whole == size
                out += [(*names[words.text[i]], f, size, words.digest(i, size)) for i, f in zip(at[take].tolist(), h[take].view(np.int64).tolist())]
            if out:
                yield pd.DataFrame(out, columns=["item", "h", "size", "digest"])

    return run


def _of_texts(sizes: list[int], bits, power: int):
    """A row (key, doc_id, n_words) for every text, and one (key, h, start, size, digest) for every window whose fingerprint the bit table holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = bits.value
        for rows, texts in _grouped(batches):
            words = Words(texts)
            n = np.bincount(words.text, minlength=len(texts))
            first = np.cumsum(n) - n
            keys = [k for k, _ in rows]
            yield pd.DataFrame({"key": keys, "doc_id": [d for _, d in rows], "n_words": n, "h": None, "start": None, "size": None, "digest": None})
            out = []
            for size in sizes:
                at, h = words.windows(size)
                place = h >> np.uint64(64 - power)
                take = table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                own = words.text[at[take]]
                out += [(keys[t], None, None, f, i - first[t], size, words.digest(i, size)) for t, i, f in zip(own.tolist(), at[take].tolist(), h[take].view(np.int64).tolist())]
            if out:
                yield pd.DataFrame(out, columns=["key", "doc_id", "n_words", "h", "start", "size", "digest"])

    return run


def bit_table(windows: DataFrame) -> tuple[np.ndarray, int]:
    """(packed bits, power of two) of all fingerprints: 16 bits for each up to MOST_BITS; beyond that it passes more, and loses none."""
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, windows.count())))))
    place = F.shiftrightunsigned("h", 64 - power) + 1  # Spark's bitmaps count from 1
    maps = windows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << power - 3, np.uint8)
    for r in maps.collect():  # 4 KB each, 8,192 rows at most
        part, at = np.frombuffer(r.bits, np.uint8), (r.bucket - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return out, power


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs.

    spans are the maximal runs of hit words (start, stop) in order, items the sorted ids, as text, of the items any of
    whose windows occurs; empty arrays where none. Null and empty texts have no words, and items without words no
    windows. Rows of one item_id are one item; a null id is the empty text. Repeated rows are
    reported alike, ids may be null or repeated, texts are read whole, and other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = written(items.mapInPandas(lean(_of_items(window)), "item string, h long, size int, digest binary"))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # ten at most
    bits, power = bit_table(windows)
    table = spark.sparkContext.broadcast(bits)
    scanned = written(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        lean(_of_texts(sizes, table, power)), "key long, doc_id string, n_words long, h long, start long, size int, digest binary"))

    holders = windows.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("items_id", F.md5(F.to_json("items")))
    holders = written(holders)
    met = scanned.where("size is not null").join(windows.select("h").distinct(), "h", "left_semi")
    hits = written(met.join(holders.select("digest", "items_id"), "digest").select("key", "start", (F.col("start") + F.col("size")).alias("stop"), "items_id"))

    of = Window.partitionBy("key").orderBy("start", "stop")
    before = F.max("stop").over(of.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("_new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("_run", F.sum("_new").over(of))
    runs = runs.groupBy("key", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    sets = holders.select("items_id", "items").dropDuplicates(["items_id"])
    named = hits.select("key", "items_id").distinct().join(sets, "items_id").select("key", F.explode("items").alias("item"))
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none_spans, none_items = F.array().cast("array<struct<start:bigint,stop:bigint>>"), F.array().cast("array<string>")
    out = scanned.where("size is null").select("key", "doc_id", "n_words").join(spans, "key", "left").join(named, "key", "left")
    out = written(out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", F.coalesce("spans", none_spans).alias("spans"), F.coalesce("items", none_items).alias("items")))
    forget(windows, scanned, holders, hits)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in whose texts no window of the benchmark occurs, all columns as they are."""
    key = F.md5(F.coalesce("text", F.lit("")))
    told = report(docs.select(key.alias("doc_id"), "text"), benchmark, window)
    hit = told.where(F.size("spans") > 0).select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(hit, "_key", "left_anti").select(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs, counted from its report."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return report(docs, benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
