"""Exact substring dedup through per-shard suffix arrays.

Which bytes lie in a string of `length` bytes that also starts elsewhere is
settled in five steps, each over all texts:

1. Texts are collapsed by digest; a text that occurs twice repeats wholly.
2. Every window of `length` bytes has one anchor, the K-byte string of least hash in
   it. Equal windows have equal anchors at equal places, so windows whose anchor
   occurs once are unique and leave the work.
3. What surrounds an anchor's windows is a context. Equal contexts of different places repeat wholly.
4. The other contexts of an anchor meet in a shard. The shard's suffix array is
   refined by doubling on the groups that are still unsorted (Larsson-Sadakane), Kasai's walk gives common
   prefixes, and neighbours that share `length` bytes are equal windows.
5. An anchor with very many contexts is split over several shards; their sorted
   window digests are merged by binary search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import bucketed, forget, written
from setweave.llm.similar_sets import whole_buckets
from setweave.llm.workers import lean

LENGTH, K = 200, 40
#: Contexts of one anchor in one shard, bytes of a shard's text, bytes of text of one bucket of the collapsed texts.
SPLIT, SHARD_BYTES, BUCKET_BYTES = 2000, 900_000, 24_000_000
_BITS = 24  # positions within one scanned block


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings, by doubling."""
    by = {1: _mix(data.astype(np.uint64) + np.uint64(0x51ED2701))}
    size = 1
    while 2 * size <= K:
        h = by[size]
        by[2 * size] = h[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + h[size:]
        size *= 2
    out, at = by[size], size
    while at < K:
        step = max(s for s in by if s <= K - at)
        right = by[step][at:]
        out = out[: len(right)] * np.uint64(0xA0761D6478BD642F) + right
        at += step
    return _mix(out)


def anchors_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor position, first window start, last window start, anchor hash) of texts of `length` bytes or more."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    grams = gram_hashes(data)
    n, width = len(grams), length - K + 1
    low = np.uint64((1 << _BITS) - 1)
    best = (grams & ~low) | (low - np.arange(n, dtype=np.uint64))  # the rightmost of equal hashes is least
    step = 1
    while 2 * step <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    at = (low - (best & low)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    start = np.arange(len(at))
    valid = start + length <= (begin + sizes)[text]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    last = np.append(first[1:], len(at)) - 1
    ends = (begin + sizes - length)[text[first]]
    last = np.minimum(last, ends)
    own = text[first]
    return own, at[first] - begin[own], first - begin[own], last - begin[own], grams[at[first]].view(np.int64)


def _scan(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(keys: list, texts: list) -> Iterator[pd.DataFrame]:
            if texts:
                own, p, lo, hi, h = anchors_of(texts, length)
                yield pd.DataFrame({"key": np.array(keys, object)[own], "p": p, "lo": lo, "hi": hi, "h": h})

        for b in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(b["key"], b["text"]):
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                if size + len(raw) > 80_000:  # arrays of eight bytes a byte stay in cache
                    yield from found(keys, texts)
                    keys, texts, size = [], [], 0
                if len(raw) > 8_000_000:  # in pieces that overlap by a window less one byte
                    yield from _scan_long(k, raw, length)
                    continue
                keys.append(k)
                texts.append(raw)
                size += len(raw)
            yield from found(keys, texts)

    return run


def _scan_long(key: bytes, raw: bytes, length: int) -> Iterator[pd.DataFrame]:
    step = 8_000_000
    for lo in range(0, len(raw) - length + 1, step):
        _, p, a, z, h = anchors_of([raw[lo : lo + step + length - 1]], length)
        yield pd.DataFrame({"key": [key] * len(p), "p": p + lo, "lo": a + lo, "hi": z + lo, "h": h})


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of data (under 2**20 bytes) in order, by Larsson-Sadakane refinement.

    Ranks start from five bytes; each round doubles the depth and sorts only the
    members of groups that are not single yet, by (rank, rank at the depth, place) packed in one word.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for j in range(5):
        word = word << np.uint64(8) | padded[j : j + n]
    place = np.uint64(20)
    packed = np.sort(word << place | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
    head = np.ones(n, bool)
    head[1:] = (packed[1:] >> place) != (packed[:-1] >> place)
    h = 5
    rank = np.empty(n, np.int64)
    while True:
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = group
        open_ = ~head | ~np.append(head[1:], True)
        slots = np.flatnonzero(open_)
        if not len(slots):
            return order
        who = order[slots]
        ahead = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        packed = np.sort(rank[who].astype(np.uint64) << np.uint64(42) | ahead.astype(np.uint64) << np.uint64(20) | who.astype(np.uint64))
        order[slots] = (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (packed[1:] >> place) != (packed[:-1] >> place)
        head[slots] = fresh
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int, lane: int = 512) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it, at most cap, by Kasai's walk.

    The walk goes through the text, each step losing one byte of the last prefix
    at most; lanes of the text walk side by side, each from zero, eight bytes compared at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    padded = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    plcp = np.zeros(n, np.int64)
    for t in range(min(lane, n)):
        i = starts + t
        if i[-1] >= n:
            i, h = i[:-1], h[:-1]
            starts = starts[:-1]
        j = before[i]
        h = np.maximum(h - 1, 0)
        go = np.flatnonzero((j >= 0) & (h < cap))
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            diff = words[a] ^ words[b]
            same = np.where(diff == 0, 8, np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            room = np.minimum(cap - h[go], n - np.maximum(a, b))
            h[go] += np.minimum(same, room)
            go = go[(same == 8) & (room > 8)]
        h[j < 0] = 0
        plcp[i] = h
    return plcp[order]


def equal_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, class) of every window of `length` bytes in the contexts; equal windows share a class."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    order = suffix_array(data)
    classes = np.cumsum(common_prefixes(data, order, length) < length)
    own = np.repeat(np.arange(len(contexts)), sizes)[order]
    start = order - begin[own]
    is_window = start + length <= sizes[own]
    return own[is_window], start[is_window], classes[is_window]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def _shard(length: int):
    """Rows (ctx_id, h, part, parts, seen, ctx) sorted by (h, part): each shard's own repeats, and window digests where an anchor is split."""

    def solve(rows: list) -> pd.DataFrame:
        own, start, cls = equal_windows([r.ctx for r in rows], length)
        seen = np.array([r.seen for r in rows])[own]
        split = np.array([r.parts > 1 for r in rows])
        _, inverse, count = np.unique(cls, return_inverse=True, return_counts=True)
        many = np.bincount(inverse, weights=seen) >= 2
        out = []
        dup = many[inverse]
        by = np.argsort(own[dup], kind="stable")
        o, s = own[dup][by], start[dup][by]
        cut = np.flatnonzero(np.diff(o)) + 1
        for x, y in zip(np.append(0, cut), np.append(cut, len(o))):
            if y > x:
                for a, z in _ranges(s[x:y]):
                    out.append((rows[o[x]].ctx_id, a, z, None))
        if split.any():
            first = np.full(len(count), -1)
            first[inverse[::-1]] = np.arange(len(inverse))[::-1]
            for c in np.flatnonzero(split[own[first]]):
                r, a = rows[own[first[c]]], int(start[first[c]])
                out.append((r.ctx_id, a, -1 if many[c] else a, hashlib.blake2b(r.ctx[a : a + length], digest_size=16).digest()))
        return pd.DataFrame(out, columns=["ctx_id", "first", "last", "digest"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group, size, group_size, name = [], [], 0, 0, None
        for b in batches:
            for r in b.itertuples(index=False):
                if (r.h, r.part) != name:
                    held, size = held + group, size + group_size
                    group, group_size, name = [], 0, (r.h, r.part)
                group.append(r)
                group_size += len(r.ctx)
                if held and size + group_size > SHARD_BYTES:
                    yield solve(held)
                    held, size = [], 0
        if held or group:
            yield solve(held + group)

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards' window digests, dealt and merged in order of digest: those that several shards hold, found by binary search in the distinct ones."""
    for rows in whole_buckets(batches, ["digest"]):
        d = np.array(rows["digest"].tolist(), "V16").view([("a", ">u8"), ("b", ">u8")]).ravel()
        firsts, counts = np.unique(d, return_counts=True)
        many = counts[np.searchsorted(firsts, d)] >= 2
        yield rows[["ctx_id", "first", "last"]][many & (rows["last"] >= 0).to_numpy()]


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): the distinct texts (key, text, copies), in buckets of the key, and (key, first, last) ranges of window starts that repeat.

    A text with two copies or more has no ranges: it repeats wholly.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # With no fewer buckets than shuffle partitions, joins on the key move the small side only.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))
    keyed = docs.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = bucketed(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "key", buckets)

    kind = "key binary, p int, lo int, hi int, h long"
    anchors = written(texts.select("key", "text").mapInPandas(lean(_scan(length)), kind))
    # Written, so that the anchors of a very common passage are the split side of a plain join.
    often = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    kept = anchors.join(often, "h").groupBy("key").agg(F.collect_list(F.struct("p", "lo", "hi", "h")).alias("at"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, at in zip(b["key"], b["text"], b["at"]):
                raw = text.encode("utf-8", "surrogatepass")
                for x in at:
                    p, lo, hi, h = x["p"], x["lo"], x["hi"], x["h"]
                    own = hashlib.blake2b(b"%d %d " % (h, p - lo) + raw[lo : hi + length], digest_size=16).digest()
                    out.append((own, h, key, lo, hi))
            yield pd.DataFrame(out, columns=["ctx_id", "h", "key", "lo", "hi"])

    met = texts.select("key", "text").join(kept.hint("shuffle_hash"), "key")
    places = written(met.mapInPandas(lean(contexts), "ctx_id binary, h long, key binary, lo int, hi int"))
    forget(anchors, often)
    distinct = written(places.groupBy("ctx_id").agg(
        F.count(F.lit(1)).alias("seen"), F.min(F.struct("key", "lo", "hi", "h")).alias("at")).select("ctx_id", "seen", "at.*"))
    groups = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("least")).where("n > 1 and least = 1")
    groups = written(groups.select("h", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))
    some = distinct.join(groups, "h").withColumn("part", F.pmod(F.xxhash64("ctx_id"), F.col("parts")).cast("int"))
    by_text = some.groupBy("key").agg(F.collect_list(F.struct("ctx_id", "h", "part", "parts", "seen", "lo", "hi")).alias("at"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, at in zip(b["text"], b["at"]):
                raw = text.encode("utf-8", "surrogatepass")
                out.extend((x["ctx_id"], x["h"], x["part"], x["parts"], x["seen"], raw[x["lo"] : x["hi"] + length]) for x in at)
            yield pd.DataFrame(out, columns=["ctx_id", "h", "part", "parts", "seen", "ctx"])

    cut = texts.select("key", "text").join(by_text.hint("shuffle_hash"), "key").mapInPandas(
        lean(cut_out), "ctx_id binary, h long, part int, parts int, seen long, ctx binary")
    solved = written(cut.repartition("h", "part").sortWithinPartitions("h", "part").mapInPandas(
        lean(_shard(length)), "ctx_id binary, first int, last int, digest binary"))
    across = solved.where("digest is not null").repartition("digest").sortWithinPartitions("digest").mapInPandas(lean(_merge), "ctx_id binary, first int, last int")
    inside = solved.where("digest is null").select("ctx_id", "first", "last").union(across)
    whole = distinct.where("seen > 1").select("ctx_id", F.lit(0).alias("first"), (F.col("hi") - F.col("lo")).alias("last"))
    ranges = written(places.join(whole.union(inside), "ctx_id").select("key", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last")))
    forget(places, distinct, groups, solved)
    return texts, ranges


def _covered(ranges: list, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs [a, z) of the windows that start in the ranges."""
    out: list[list[int]] = []
    for a, z in sorted((x["first"], x["last"] + length) for x in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, min(z, n)) for a, z in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every distinct text.

    Removed is each UTF-8 byte covered by a string of `length` bytes that also starts anywhere
    else in any text or copy; strings are judged on the input. Null text is empty.
    kept_text drops bytes of characters that were cut in two. Windows are compared
    as bytes within a shard and by 128-bit digest across copies, equal contexts and shards.
    """
    texts, ranges = repeated_starts(docs, length)
    spans = ranges.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, copies, found in zip(b["key"], b["text"], b["copies"], b["ranges"]):
                raw = text.encode("utf-8", "surrogatepass")
                n = len(raw)
                if copies > 1 and n >= length:
                    cut = [(0, n)]
                else:
                    cut = _covered(found, n, length) if found is not None else []
                ends = [0, *(e for c in cut for e in c), n]
                kept = b"".join(raw[a:z] for a, z in zip(ends[::2], ends[1::2]))
                row = (key, n, n - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            yield pd.DataFrame(out, columns=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    kind = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(spans.hint("shuffle_hash"), "key", "left").mapInPandas(lean(run), kind)


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs; repeated rows are copies of one another.

    Null and empty texts have no bytes and keep none; null ids are returned as they are; other columns are not read.
    """
    found = written(remove_repeats(docs, length))
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(found, "key").drop("key")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of text and n_chars counted anew; every row stays."""
    found = remove_repeats(docs, length, with_text=True).select(F.col("key").alias("_key"), F.col("kept_text").alias("_kept"))
    kept = docs.withColumn("_key", text_key(F.col("text"))).drop("text").join(found, "_key")
    return kept.withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("_kept").cast("long")).select(*docs.columns)
