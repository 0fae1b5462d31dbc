"""Similarity joins of sets that lose no pair: neighbours on shared elements first, then all pairs of what is still apart.

Sets come as sorted 64- or 32-bit hashes. Two sets of a likeness share an element of their prefixes, the first of each in an
order common to all; what a pair shares at most is known from sizes, places in the prefixes and parity bitmaps
before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import forget, written
from setweave.llm.workers import lean

#: Rows of a block of a common element, bits of a row's order that deal the rows of one key.
BLOCK, DEAL = 1024, 2


def bitmap_of(shingles: np.ndarray) -> bytes:
    """How often, odd or even, the set's hashes fall on each of about twice as many places as it has hashes.

    Two sets differ in at least as many hashes as their bitmaps in bits, whatever the number of places.
    """
    places = 1 << min(max((2 * len(shingles) - 1).bit_length(), 6), 16)
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Hashes by which two sets differ at least, from their bitmaps; the larger is folded to the size of the smaller."""
    if len(x) < len(y):
        x, y = y, x
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x)
    while size > len(y):
        size //= 2
        a = (a >> 8 * size) ^ (a & ((1 << 8 * size) - 1))
    return (a ^ b).bit_count()


#: Sets that make an element common, one set in so many is counted for it, bits of the table.
COMMON, COUNTED, TABLE_BITS = 96, 8, 24


def prefix_of(elements: np.ndarray, likeness: float, common: np.ndarray) -> np.ndarray:
    """The first of a set's sorted 64-bit hashes, in an order that all sets share, of which two sets of that likeness hold one in common.

    The order is by hash, those marked in the bit table `common` last: any table gives the same
    linked sets, a good one keeps widespread elements out of the prefixes.
    """
    size = len(elements) - int(np.ceil(likeness * len(elements) - 1e-9)) + 1
    place = (elements >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    late = common[place >> 3] >> (place & 7) & 1
    return elements[np.argsort(late, kind="stable")[:size]]


def counted(sets: DataFrame, by: str) -> DataFrame:
    """The sets whose elements are counted to find the common ones: one in COUNTED, by hash of a column. Only the order of prefixes depends on it."""
    return sets.where(F.pmod(F.xxhash64(by), F.lit(COUNTED)) == 0)


def common_elements(elements: DataFrame) -> np.ndarray:
    """Bit table, of fixed size, of the elements (h) that COMMON sets or more hold, from the rows of counted() sets."""
    many = elements.groupBy("h").count().where(F.col("count") >= COMMON // COUNTED)
    place = F.shiftrightunsigned("h", 64 - TABLE_BITS).cast("int")
    cells = many.select((place / 32).cast("int").alias("cell"), F.expr(f"shiftleft(1L, shiftrightunsigned(h, {64 - TABLE_BITS}) % 32)").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 5), np.uint32)
    table[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return table.astype("<u4").view(np.uint8)


def neighbours(bits: int | None, likeness: float):
    """Pairs (a, b) of rows (key, at, id, n) in order of (key, at): each with the row before it and with the first of its key.

    A key's rows stream by, two pairs each at most. Sizes must allow the likeness, and with `bits` given, at holds fingerprints no further apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the first row of the last key, and the last row
        for b in batches:
            if not len(b):
                continue
            key, at, ids, n = (b[c].to_numpy(np.int64) for c in ("key", "at", "id", "n"))
            if kept is not None:
                key, at, ids, n = (np.concatenate([k, x]) for k, x in zip(kept, (key, at, ids, n)))
            new = np.append(True, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            i = np.append(np.arange(1, len(key)), np.arange(1, len(key)))
            j = np.append(np.arange(len(key) - 1), first[1:])
            ok = (key[i] == key[j]) & (ids[i] != ids[j]) & (np.minimum(n[i], n[j]) >= likeness * np.maximum(n[i], n[j]) - 1e-9)
            if bits is not None:
                ok &= np.bitwise_count((at[i] ^ at[j]).view(np.uint64)) <= bits
            ends = [first[-1], len(key) - 1]
            kept = [x[ends] for x in (key, at, ids, n)]
            pairs = np.unique(np.sort(np.stack([ids[i[ok]], ids[j[ok]]], axis=1), axis=1), axis=0)
            yield pd.DataFrame(pairs, columns=["a", "b"])

    return run


def shared_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of h without those whose h occurs once."""
    last, again = None, False  # the row that may go on in the next batch, and whether its h occurred before
    for b in batches:
        if last is not None:
            b = pd.concat([last, b], ignore_index=True)
        if not len(b):
            continue
        h = b["h"].to_numpy()
        same = h[1:] == h[:-1]
        kept = np.append(again if last is not None else False, same) | np.append(same, False)
        last, again = b.iloc[-1:], bool(kept[-1])
        yield b[:-1][kept[:-1]]
    if again:
        yield last


def unlinked_pairs(likeness: float):
    """Pairs (a, b) of one shingle in different components that have the likeness as far as sizes, places and bitmaps tell.

    Rows come in order of (h, part_a, part_b, n); a common shingle's rows lie in blocks, and a
    bucket of two different blocks pairs rows across them only.
    """
    share, apart = likeness / (1 + likeness), (1 - likeness) / (1 + likeness)

    def settle(across: bool, comp, ids, n, pos, side, bitmaps) -> Iterator[np.ndarray]:
        size = np.array([len(x) for x in bitmaps])
        for words in np.unique(size):
            own = np.flatnonzero(size == words)
            maps = np.frombuffer(b"".join(bitmaps[own]), np.uint64).reshape(len(own), -1)
            # Of sets whose sizes allow the likeness, the larger has as many places or twice as many.
            over = np.flatnonzero(size == 2 * words)
            if len(over):
                folded = np.bitwise_xor.reduce(np.frombuffer(b"".join(bitmaps[over]), np.uint64).reshape(len(over), 2, -1), axis=1)
                own, maps = np.append(own, over), np.concatenate([maps, folded])
            ends = np.searchsorted(n[own], n[own] / likeness + 1e-9, side="right")
            for i in range(int((size == words).sum())):
                a, b = own[i], own[i + 1 : ends[i]]
                ok = comp[b] != comp[a]
                if across:
                    ok &= side[b] != side[a]
                # Nothing before the lesser place and nothing after the other's end can be shared besides what lies on both sides.
                both = n[b] + n[a]
                ok &= np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= share * both - 1e-6
                at = np.flatnonzero(ok)
                if len(at):
                    at = at[np.bitwise_count(maps[i + 1 + at] ^ maps[i]).sum(1) <= apart * both[at] + 1e-9]
                    if len(at):
                        yield np.stack([np.minimum(ids[b[at]], ids[a]), np.maximum(ids[b[at]], ids[a])], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_buckets(batches, ["h", "part_a", "part_b"]):
            change = np.zeros(len(rows) - 1, bool)
            for k in ("h", "part_a", "part_b"):
                x = rows[k].to_numpy()
                change |= x[1:] != x[:-1]
            across = (rows["part_a"] != rows["part_b"]).to_numpy()
            parts = [rows[c].to_numpy(np.int64) for c in ("component", "id", "n", "pos", "side")] + [rows["bitmap"].to_numpy()]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(rows)]
            made = [x for lo, hi in zip(cuts, cuts[1:]) for x in settle(across[lo], *(p[lo:hi] for p in parts))]
            if made:
                yield pd.DataFrame(np.unique(np.concatenate(made), axis=0), columns=["a", "b"])

    return run


def whole_buckets(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows again, which come in order of the keys, in frames that end where a key changes."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        goes_on = np.ones(len(b), bool)
        for k in keys:
            goes_on &= (b[k] == b[k].iat[-1]).to_numpy()
        cut = len(b) - int(goes_on.sum())
        if held and (cut or any(held[-1][k].iat[-1] != b[k].iat[0] for k in keys)):
            yield pd.concat([*held, b[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield b[:cut]
        held.append(b[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def neighbour_pairs(keyed: DataFrame, likeness: float, bits: int | None = None) -> DataFrame:
    """(a, b) of rows (key, at, id, n) that are neighbours in order of at among those of their key; a key's rows are dealt by the highest bits of at."""
    dealt = keyed.repartition("key", F.shiftrightunsigned("at", 64 - DEAL)).sortWithinPartitions("key", "at")
    return dealt.mapInPandas(lean(neighbours(bits, likeness)), "a long, b long")


def shared_prefixes(prefixes: DataFrame) -> DataFrame:
    """Those of the rows (h, id, n, pos) whose element h several rows hold."""
    return written(prefixes.repartition("h").sortWithinPartitions("h").mapInPandas(lean(shared_only), "h long, id long, n int, pos int"))


def beside(shared: DataFrame, likeness: float) -> DataFrame:
    """(a, b): sets next to one another among those that share an element, in an order of its own for each element; two pairs a row at most."""
    return neighbour_pairs(shared.select(F.col("h").alias("key"), F.xxhash64("h", "id").alias("at"), "id", "n"), likeness)


def apart(shared: DataFrame, joined: DataFrame, sketches: DataFrame, likeness: float) -> DataFrame:
    """(a, b): every pair of different components (node, component) that shares an element and can have the likeness.

    Elements of one component alone leave first; the rows of a common one are dealt to blocks, and blocks meet pair by pair.
    """
    placed = shared.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    met = placed.join(mixed.select("h", F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts")), "h")
    met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.join(sketches.select("id", "bitmap"), "id").select(
        "h", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), (F.col("part") > F.col("other")).cast("int").alias("side"), "component", "id", "n", "pos", "bitmap")
    return met.repartition("h", "part_a", "part_b").sortWithinPartitions("h", "part_a", "part_b", "n").mapInPandas(lean(unlinked_pairs(likeness)), "a long, b long")


def verified(pairs: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], likeness: float, kind: type = np.uint64) -> DataFrame:
    """Those of the pairs (a, b) that have the likeness: by sizes and bitmaps (id, n, bitmap) first, which leave out no such pair, the rest on whole sets.

    sets_of gives (id, set), the bytes of the sorted hashes, for a frame of ids.
    """
    most_apart = (1 - likeness) / (1 + likeness)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = most_apart * (b["n_a"] + b["n_b"]).to_numpy() + 1e-9
            ok = np.fromiter((least_difference(x, y) <= m for x, y, m in zip(b["x"], b["y"], most)), bool, len(b))
            yield b.loc[ok, ["a", "b"]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["x"], b["y"]):
                p, q = np.frombuffer(x, kind), np.frombuffer(y, kind)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= likeness * (len(p) + len(q) - both) - 1e-9)
            yield b.loc[ok, ["a", "b"]]

    def side(name: str, value: str) -> DataFrame:
        return sketches.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(value))

    met = pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b")
    met = met.where((F.col("n_a") >= likeness * F.col("n_b") - 1e-9) & (F.col("n_b") >= likeness * F.col("n_a") - 1e-9))
    likely = written(met.select("a", "b", "n_a", "n_b", "x", "y").mapInPandas(lean(near), "a long, b long"))
    made = written(sets_of(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()))
    both = likely.join(made.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(made.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    found = written(both.select("a", "b", "x", "y").mapInPandas(lean(verify), "a long, b long"))
    forget(likely, made)
    return found
