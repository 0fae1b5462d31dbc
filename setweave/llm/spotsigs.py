"""SpotSigs fingerprints: chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import forget, written
from setweave.llm import similar_sets
from setweave.llm.workers import lean
from setweave.operators.components import connected_components

#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec ce dans de des du en est et la le les par pas pour que qui sur un une "
    "als auch auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "al como con del el lo los las más no para por se su una y".split())
#: Content words of a chain, characters of a bucket of neighbouring documents, likeness of near-duplicates.
CHAIN, BUCKET_CHARS, LIKENESS = 2, 16_000_000, 0.8


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text.

    One for each anchor and the next `chain` words after it that are no anchors;
    texts without any are one signature of their own.
    """
    from xxhash import xxh32_intdigest

    words = text.lower().split()
    content, spots = [], []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    found = {xxh32_intdigest(" ".join([w, *content[k : k + chain]])) for w, k in spots if k <= last}
    if not found:
        found = {xxh32_intdigest(text, seed=1)}
    return np.array(sorted(found), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two signature sets; 0 without comparing where their lengths alone keep it under least."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def fingerprint(sigs: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, in order."""
    return sigs.astype(">u4").tobytes().hex()


#: Approximate quantiles that are asked for at once; finer buckets cut these ranges by place.
QUANTILES = 10_000


def neighbours(docs: DataFrame, groups: DataFrame, columns: str, process) -> DataFrame:
    """mapInPandas over (doc_id, text, own, group), in order of falling nearness: each text comes right after the one of the next smaller doc_id.

    After the smallest comes the largest. Order is by id, then text; null ids are smallest, null texts
    empty. Rows go to buckets of neighbouring ids, cut at approximate quantiles so that each holds a like
    number, and within a bucket of one repeated id by the text's first hash bits; the last row of each bucket is handed to the next one
    (own 0), so texts are shuffled once and only a row's id and place a bucket passes through the driver. groups (doc_id, component_id)
    are dealt to the same buckets and come before their texts (own 2), so they cost no join.
    """
    least = -(1 << 63)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("at"))
    total = ready.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(12, math.ceil(total / BUCKET_CHARS))
    asked = min(n, QUANTILES)
    cuts = ready.agg(F.percentile_approx("at", [i / asked for i in range(1, asked)], 10 * asked)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))
    finer = math.ceil(n / asked)

    @F.pandas_udf("int")
    def bucket_of(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        b = np.searchsorted(bounds, x)
        if finer > 1:  # ids of one range are cut at equal distances
            lo = np.append(np.int64(least), bounds)[b].astype(float)
            hi = np.append(bounds, np.int64((1 << 63) - 1))[b].astype(float)
            b = b * finer + np.clip(((x - lo) / np.maximum(hi - lo, 1) * finer).astype(np.int64), 0, finer - 1)
        return pd.Series(b.astype(np.int32))

    ready = ready.withColumn("bucket", bucket_of("at"))
    tops = sorted((r.bucket, r.top) for r in ready.groupBy("bucket").agg(F.max("at").alias("top")).collect())
    handed = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    to = docs.sparkSession.createDataFrame(handed, "at long, target int")
    carried = ready.join(F.broadcast(to), "at").groupBy("at", "target").agg(F.max("text").alias("text"))
    none = F.lit(None)
    rows = ready.select("doc_id", "text", "bucket", "at", F.lit(1).alias("own"), none.cast("long").alias("group")).unionByName(
        carried.select(none.cast("long").alias("doc_id"), "text", F.col("target").alias("bucket"), F.lit(least).alias("at"), F.lit(0).alias("own"), none.cast("long").alias("group"))).unionByName(
        groups.select("doc_id", F.lit("").alias("text"), bucket_of(F.col("doc_id")).alias("bucket"), F.col("doc_id").alias("at"), F.lit(2).alias("own"), F.col("component_id").alias("group")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from process((r for b in batches for r in b.itertuples(index=False)))

    dealt = rows.withColumn("first", (F.col("own") == 0).cast("int"))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("first"), "at", F.desc("own"), "text").drop("first").mapInPandas(lean(run), columns)


def fingerprint_edits(docs: DataFrame, threshold: float = LIKENESS) -> DataFrame:
    """For every row: fingerprints of its text and of its edited text, their likenesses, and the group of its near-duplicates.

    The edited text's last floor(n_chars / 2) characters are the first as many of the next document (all, if it
    has fewer). A single document is its own next one. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and component_id out of near_duplicates(), null for a null id. Repeated rows are
    returned each; other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"]
    kinds = {"doc_id": "Int64", "component_id": "Int64"}

    def process(rows: Iterator) -> Iterator[pd.DataFrame]:
        out, before, before_sigs, group = [], "", None, (None, None)
        for r in rows:
            if r.own == 2:
                group = (int(r.doc_id), int(r.group))
                continue
            sigs = signatures(r.text)
            if r.own:
                n = len(r.text)
                edited = r.text[: n - n // 2] + before[: n // 2]
                new = signatures(edited)
                raw = edited.encode("utf-8", "surrogatepass")
                name = None if pd.isna(r.doc_id) else int(r.doc_id)
                out.append((name, n, hashlib.sha256(raw).hexdigest(), fingerprint(sigs), fingerprint(new), likeness(sigs, new), likeness(sigs, before_sigs), group[1] if name is not None and group[0] == name else None))
            before, before_sigs = r.text, sigs
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=names).astype(kinds)
                out = []
        yield pd.DataFrame(out, columns=names).astype(kinds)

    groups = written(near_duplicates(docs, threshold).groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    return neighbours(docs, groups, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long", process)


def near_duplicates(docs: DataFrame, threshold: float = LIKENESS) -> DataFrame:
    """(doc_id, component_id) of every row with an id: texts linked by a likeness of threshold or more; component_id is the least doc_id reachable.

    Sets are partitioned by length so that only sets of the same or the next partition can reach
    the threshold, and meet on the signatures of their prefix that such a pair must share. Neighbours are compared first, then all pairs
    that are still apart and whose sizes, places and bitmaps allow the likeness, so no pair is lost. Null texts are empty; equal sets are one.
    """
    grow = math.log(1 / threshold)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                made = [signatures(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n": [len(x) for x in made], "bitmap": [similar_sets.bitmap_of(x.astype(np.uint64)) for x in made], "set": [x.tobytes() for x in made]})

    ready = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = written(ready.mapInPandas(lean(sets), "doc_id long, n int, bitmap binary, set binary").withColumn("digest", F.unhex(F.md5("set"))))
    distinct = written(marked.groupBy("digest").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bitmap", "set")]))

    def wide(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.uint32).astype(np.uint64) << np.uint64(32)

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                yield pd.DataFrame({"h": np.concatenate([wide(x) for x in b["set"].iloc[lo : lo + 500]]).view(np.int64)})

    common = similar_sets.common_elements(similar_sets.counted(distinct, "digest").select("set").mapInPandas(lean(every), "h long"))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                made = [wide(x) for x in b["set"].iloc[lo : lo + 500]]
                n = np.array([len(x) for x in made])
                first = [similar_sets.prefix_of(x, threshold, common) for x in made]
                sizes = [len(x) for x in first]
                part = np.floor(np.log(n) / grow + 1e-9).astype(np.int64)
                own, pos = np.repeat(np.arange(len(made)), sizes), np.concatenate([np.arange(k) for k in sizes])
                h = (np.concatenate(first) >> np.uint64(32)).astype(np.int64)
                for step in (0, 1):  # each set meets those of its own and of the next partition
                    yield pd.DataFrame({"h": (part[own] + step) << 32 | h, "id": b["id"].to_numpy()[lo : lo + 500][own], "n": n[own], "pos": pos})

    shared = similar_sets.shared_prefixes(distinct.select("id", "set").mapInPandas(lean(prefixes), "h long, id long, n int, pos int"))
    sketches = distinct.select("id", "n", "bitmap")

    def sets_of(asked: DataFrame) -> DataFrame:
        return distinct.select("id", "set").join(asked, "id")

    def verified(pairs: DataFrame) -> DataFrame:
        return similar_sets.verified(pairs, sketches, sets_of, threshold, np.uint32)

    links = verified(similar_sets.beside(shared, threshold))
    joined = written(connected_components(links, "a", "b"))
    more = verified(similar_sets.apart(shared, joined, sketches, threshold))
    comps = connected_components(links.union(more), "a", "b")
    named = distinct.select("digest", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    found = written(marked.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id"))
    forget(marked, distinct, shared, links, joined, more)
    return found
