"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Two fingerprints that differ in at most three of 64 bits agree in one of four 16-bit
segments, and then differ in at most one bit of one half of the other 48. Each
half is decoded with the perfect (23,12) Golay code: the keys of a half are the indices of
all codewords within distance four, one or six of them. Halves within two bits
of one another always share an index, so (segment, half, segment's bits, codeword
index) finds every such pair, errors within the half included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import bucketed, forget, written
from setweave.operators.components import connected_components
from setweave.llm.similar_sets import apart, beside, bitmap_of, common_elements, counted, neighbour_pairs, prefix_of, shared_prefixes, verified
from setweave.llm.workers import lean

#: Fixed value: generator polynomial of the (23,12) Golay code.
GOLAY = 0xC75
SEED, MAX_BITS = 42, 3


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for i in range(22, 10, -1):
        x ^= np.where(x >> i & 1, GOLAY << (i - 11), 0)
    return x


@lru_cache(1)
def golay_patterns() -> np.ndarray:
    """By syndrome: the error patterns that lead to all codewords within distance four (column 0 the nearest, -1 where there are no others)."""
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, int)
    for weight in range(5):
        words = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(_remainder(words), words):
            table[s, used[s]] = e
            used[s] += 1
    return table


def golay_keys(half: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words, -1 where there are fewer."""
    e = golay_patterns()[_remainder(half)]
    return np.where(e < 0, -1, (half[:, None] ^ e) >> 11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every fuzzy key of unsigned 64-bit fingerprints."""
    keys, rows = [], []
    for seg in range(4):
        shift = np.uint64(16 * seg)
        exact = (fps >> shift & np.uint64(0xFFFF)).astype(np.int64)
        low = fps & np.uint64((1 << 16 * seg) - 1)
        high = fps >> (shift + np.uint64(16)) if seg < 3 else np.zeros_like(fps)
        rest = low | high << shift
        for half in range(2):
            g = golay_keys((rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.int64))
            row, col = np.nonzero(g >= 0)
            keys.append(((seg * 2 + half) << 28) | exact[row] << 12 | g[row, col])
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def simhash(text: str, width: int = 3) -> int:
    """64-bit SimHash of a whole text: ASCII lower case, words between ASCII white space, shingles of width words by XXH64 with seed 42."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    raw = np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[lo : lo + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long: the bits of the fingerprint) of every whole text; null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([simhash(t, width) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(lean(run), "doc_id long, fp long")


class Forest:
    """Union by least root; join() tells whether the edge was new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links_within(fps: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Edges that connect what is linked within one bucket of distinct fingerprints: a search from each member over those not yet reached, n - 1 edges at most."""
    left = fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                for y in left[near]:
                    yield int(x), int(y)
                todo.extend(left[near])
                left = left[~near]


def _link(bits: int):
    small = 24

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()

        def settle(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
            if not len(keys):
                return []
            cut = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(keys))
            size = np.repeat(ends - starts, ends - starts)
            found = []
            for step in range(1, small):
                at = np.flatnonzero((size[:-step] > step) & (size[:-step] <= small) & (keys[:-step] == keys[step:])) if step < len(keys) else np.array([], int)
                if not len(at):
                    break
                at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= bits]
                found.extend(zip(fps[at].tolist(), fps[at + step].tolist()))
            for s, e in zip(starts[ends - starts > small], ends[ends - starts > small]):
                found.extend(links_within(fps[s:e], bits))
            return [(a, b) for a, b in set(found) if forest.join(a, b)]

        keys, fps = np.array([], np.int64), np.array([], np.uint64)
        for b in batches:
            keys = np.concatenate([keys, b["key"].to_numpy(np.int64)])
            fps = np.concatenate([fps, b["fp"].to_numpy(np.int64).view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if cut:
                new = settle(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
                yield pd.DataFrame(np.array(new, np.uint64).reshape(-1, 2).view(np.int64), columns=["src", "dst"])
        new = settle(keys, fps)
        yield pd.DataFrame(np.array(new, np.uint64).reshape(-1, 2).view(np.int64), columns=["src", "dst"])

    return run


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) edges between distinct fingerprints of column fp at most `bits` (3 or fewer) apart.

    Every edge is verified, and what is linked at that distance is connected by the edges; the pairs of a
    bucket are not all emitted. Equal keys meet in one task as 12-byte
    rows of distinct fingerprints, sorted and streamed bucket by bucket.
    """
    if bits > 3:
        raise ValueError("the keys find pairs up to three differing bits")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = b["fp"].to_numpy(np.int64)
            for lo in range(0, len(f), 8192):
                part = f[lo : lo + 8192]
                key, row = keys_of(part.view(np.uint64))
                yield pd.DataFrame({"key": key.astype(np.int32), "fp": part[row]})

    keyed = fps.select("fp").distinct().mapInPandas(lean(emit), "key int, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(lean(_link(bits)), "src long, dst long")


def simhash_components(docs: DataFrame, width: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the least doc_id reachable over links of at most `bits`
    differing bits, the document itself included; texts without words have fingerprint zero and link
    like any other. Null ids get a component without being its name (null only if no member has an id);
    repeated rows are returned each.
    """
    marked = written(fingerprints(docs, width))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = connected_components(fingerprint_links(least, bits))
    named = least.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates of the cleaning stage: words of a shingle, least Jaccard likeness, most differing bits of the
#: word fingerprints of a candidate pair.
STAGE_WIDTH, STAGE_LIKENESS, STAGE_BITS = 5, 0.8, 12
#: Characters of a bucket of the distinct texts.
BUCKET_CHARS = 24_000_000


def word_fingerprint(text: str) -> int:
    """64-bit SimHash of a text's different words: an edit moves one word, not five shingles, so near copies stay close."""
    words = list(set(text.encode("utf-8", "surrogatepass").lower().split()))
    if not words:
        return 0
    raw = np.frombuffer(b"".join([_digest(w) for w in words]), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def _digest(word: bytes) -> bytes:
    from xxhash import xxh64_digest

    return xxh64_digest(word, SEED)


def shingle_set(text: str, width: int = STAGE_WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different word shingles; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))], np.uint64))


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, turned fingerprint, row): codeword indices of two of three segments (23, 23 and 18 bits).

    One of the two gives its nearest codeword, the other all within distance four, so several errors in
    each are bridged; the fingerprint is turned by another number of bits for each choice of segments.
    """
    seg = [golay_keys((fps >> np.uint64(s) & np.uint64(m)).astype(np.int64)) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF))]
    keys, turned, rows = [], [], []
    for n, (i, j) in enumerate(((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))):
        row, col = np.nonzero(seg[j] >= 0)
        keys.append(seg[i][row, 0] << 12 | seg[j][row, col] | n << 24)
        by = np.uint64(10 * n + 2)
        turned.append((fps << by | fps >> (np.uint64(64) - by))[row])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(turned), np.concatenate(rows)


#: Share of the hash range whose common shingles are counted; prefixes hold the lowest.
COUNTED_HASHES = 0.4


def _common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    def low(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [shingle_set(t, width) for t in b["text"]]
            made = [x[: np.searchsorted(x, np.uint64(int(COUNTED_HASHES * 2**64)))] for x in made]
            yield pd.DataFrame({"h": np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64)})

    return common_elements(counted(texts, "text").select("text").mapInPandas(lean(low), "h long"))


def _prefixes(alone: DataFrame, likeness: float, width: int) -> DataFrame:
    """(h, id, n, pos) of the shingles of every text's prefix, those that are common in the corpus last."""
    common = _common_shingles(alone, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                made = [shingle_set(t, width) for t in b["text"].iloc[lo : lo + 256]]
                first = [prefix_of(x, likeness, common) for x in made]
                sizes = [len(x) for x in first]
                yield pd.DataFrame({"h": np.concatenate(first).view(np.int64), "id": np.repeat(b["id"].to_numpy()[lo : lo + 256], sizes),
                                    "n": np.repeat([len(x) for x in made], sizes), "pos": np.concatenate([np.arange(k) for k in sizes])})

    return alone.mapInPandas(lean(run), "h long, id long, n int, pos int")


def keep_one_of_each(docs: DataFrame, likeness: float = STAGE_LIKENESS, width: int = STAGE_WIDTH, bits: int = STAGE_BITS) -> DataFrame:
    """docs with one row, that of the least doc_id, of each group of near-duplicates.

    Equal texts are one group. Others are linked when the Jaccard likeness of their sets of word shingles
    is `likeness` or more. Texts whose word fingerprints share a pair of Golay keys meet first, each with its neighbours in the key's order
    within `bits` bits, as do neighbours on a shingle of their prefixes: two pairs a row at most. What the verified pairs link is a
    component; then every two texts of different components that share a shingle of their prefixes are
    verified, which leaves out no pair of that likeness, however large a group. Null texts are empty;
    rows with a null id stay; of rows that repeat an id one stays. Columns are unchanged.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                fps = np.array([word_fingerprint(t) for t in part["text"]], np.uint64).view(np.int64)
                made = [shingle_set(t, width) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "digest": part["digest"], "chars": part["text"].str.len(), "fp": fps,
                                    "n": [len(x) for x in made], "bitmap": [bitmap_of(x) for x in made]})

    text = F.coalesce("text", F.lit(""))
    ready = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), F.struct(*docs.columns).alias("row"))
    marked = written(ready.select("doc_id", "text", "digest").mapInPandas(lean(mark), "doc_id long, digest binary, chars long, fp long, n int, bitmap binary"))
    texts = written(marked.groupBy("digest").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "n", "bitmap")]))
    chars = marked.agg(F.sum("chars")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / BUCKET_CHARS))
    own = ready.withColumnRenamed("doc_id", "id").join(texts.select("id", F.col("digest").alias("its")).hint("shuffle_hash"), "id").where("digest = its")
    alone = bucketed(own.select("id", "row"), "id", buckets)
    plain, sketches = alone.select("id", F.coalesce("row.text", F.lit("")).alias("text")), texts.select("id", "n", "bitmap")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                yield pd.DataFrame({"id": part["id"], "set": [shingle_set(t, width).tobytes() for t in part["text"]]})

    def sets_of(asked: DataFrame) -> DataFrame:
        return plain.join(asked.hint("shuffle_hash"), "id").mapInPandas(lean(sets), "id long, set binary")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f, ids, n = b["fp"].to_numpy(np.int64), b["id"].to_numpy(np.int64), b["n"].to_numpy(np.int32)
            for lo in range(0, len(f), 4096):
                key, turned, row = pair_keys(f[lo : lo + 4096].view(np.uint64))
                yield pd.DataFrame({"key": key.astype(np.int32), "at": turned.view(np.int64), "id": ids[lo : lo + 4096][row], "n": n[lo : lo + 4096][row]})

    keyed = texts.select("fp", "id", "n").mapInPandas(lean(emit), "key long, at long, id long, n int")
    golay = written(neighbour_pairs(keyed, likeness, bits).distinct())
    shared = shared_prefixes(_prefixes(plain, likeness, width))
    links = verified(golay.union(beside(shared, likeness)), sketches, sets_of, likeness)
    forget(golay)
    joined = written(connected_components(links, "a", "b"))
    more = verified(apart(shared, joined, sketches, likeness), sketches, sets_of, likeness)
    forget(shared, joined)
    comps = connected_components(links.union(more), "a", "b")
    kept = texts.select(F.col("id").alias("node")).distinct().join(comps, "node", "left").where("component is null or component = node").select(F.col("node").alias("id"))
    counts = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("doc_id", "id")
    chosen = written(kept.join(counts, "id"))
    forget(links, more, marked, texts)
    rows = alone.join(chosen.hint("shuffle_hash"), "id")
    again = rows.where("_n > 1").dropDuplicates(["id"])
    return rows.where("_n = 1").union(again).select("row.*").unionByName(docs.where("doc_id is null"))
