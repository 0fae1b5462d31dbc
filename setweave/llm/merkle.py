"""A Merkle manifest of a table: one eight-way hash tree a group and one over the groups, kept in blocks.

Leaves are numbered in order within their group and cut into aligned blocks of 8**4. A block is a
complete subtree whose nodes are stored in van Emde Boas order: the upper half of its levels first, laid out
likewise, then every subtree below it. The roots of a group's blocks are the leaves of its next layer, until one block
is left. Proofs come down the same layers: what stands above a block is found once for the block, and its
leaves add their siblings inside it.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import forget, written

ARITY = 8
#: Levels of nodes in a block of a group that needs several blocks, and the leaves of such a block.
LEVELS = 5
BLOCK = ARITY ** (LEVELS - 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def size_of(levels: int) -> int:
    """Nodes of a complete tree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Slots of the nodes `index` of one depth (the root's is 0) of a complete tree of `levels` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(depth, index, upper)
    lower, span = levels - upper, ARITY ** (depth - upper)
    return size_of(upper) + index // span * size_of(lower) + address(depth - upper, index % span, lower)


@functools.lru_cache
def _addresses(depth: int, levels: int) -> np.ndarray:
    return address(depth, np.arange(ARITY**depth), levels)


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def levels_for(n: int, total: int) -> int:
    """Levels of a block of n leaves: as few as hold them where it is the group's only block, else all."""
    levels = 1
    while total > BLOCK and levels < LEVELS or ARITY ** (levels - 1) < n:
        levels += 1
    return levels


def build(leaves: list[bytes], levels: int) -> np.ndarray:
    """The stored block: digests in van Emde Boas order, zeros where a part of the complete tree is missing."""
    store, n = np.zeros((size_of(levels), 32), np.uint8), len(leaves)
    store[_addresses(levels - 1, levels)[:n]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(n, 32)
    for depth in range(levels - 2, -1, -1):
        below, n_up = _addresses(depth + 1, levels), -(-n // ARITY)
        for i, slot in enumerate(_addresses(depth, levels)[:n_up]):
            run = store[below[i * ARITY : min(n, (i + 1) * ARITY)]]
            store[slot] = np.frombuffer(digest(run.tobytes().hex()), np.uint8)
        n = n_up
    return store


def siblings(store: bytes, n: int, levels: int) -> list[list[str]]:
    """For each depth from the leaves up to the root's children: the hex digests of every run, in order."""
    nodes, out = np.frombuffer(store, np.uint8).reshape(-1, 32), []
    for depth in range(levels - 1, 0, -1):
        text = nodes[_addresses(depth, levels)[:n]].tobytes().hex()
        out.append([text[a : a + 64 * ARITY] for a in range(0, len(text), 64 * ARITY)])
        n = -(-n // ARITY)
    return out


def path(runs: list[list[str]], i: int) -> list[str]:
    """What stands left and right of leaf i's way up, level by level: left, right, left, right, ..."""
    out = []
    for level in runs:
        run, at = level[i // ARITY], i % ARITY * 64
        out += [run[:at], run[at + 64 :]]
        i //= ARITY
    return out


def fold(leaf: str, way: list[str]) -> str:
    """The root that a leaf and its way up give."""
    for left, right in zip(way[::2], way[1::2]):
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (grp, ...) with `at`, the place in the group's order from 0, and `total`, the group's rows.

    Rows are dealt by range of (grp, order), equal rows included, so no group or repeated row fills one task; what is added
    up in one place is one count for each task and group.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = ["grp", *order, "_tie"]
    placed = written(tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_row", 33)
    counts = placed.groupBy("grp", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    of = Window.partitionBy("grp")
    starts = counts.select("grp", "_part", "_first", (F.sum("_n").over(of.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("total"))
    return placed.withColumn("_part", part).join(starts, ["grp", "_part"]).withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_first", "_before", "_part")


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    n, total = len(rows), int(rows["total"].iloc[0])
    levels = levels_for(n, total)
    store = build(rows["node"].tolist(), levels)
    return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "total": [total], "n": [n], "levels": [levels], "store": [store.tobytes()], "top": [store[0].tobytes()]})


def blocks_of(nodes: DataFrame) -> list[DataFrame]:
    """The stored layers (grp, block, total, n, levels, store, top) over nodes (grp, at, total, node), from the leaves up.

    top is the block's root. A group is finished in the layer where its total fits one block; a layer holds 8**4 times fewer rows than the one below it.
    """
    layers: list[DataFrame] = []
    while not layers or not nodes.isEmpty():
        blocked = nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("grp", "block")
        layers.append(written(blocked.applyInPandas(_block, "grp string, block long, total long, n int, levels int, store binary, top binary")))
        nodes = layers[-1].where(F.col("total") > BLOCK).select("grp", F.col("block").alias("at"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("node"))
    return layers


def roots_of(layers: list[DataFrame]) -> DataFrame:
    """(grp, node): the root of each group's tree."""
    done = [x.where(F.col("total") <= BLOCK).select("grp", F.col("top").alias("node")) for x in layers]
    return functools.reduce(DataFrame.unionByName, done)


def _ways(batches):
    """The way up of every leaf of the blocks, what stands above the block included."""
    for b in batches:
        for r in b.itertuples(index=False):
            runs = siblings(r.store, r.n, r.levels)
            ways = [path(runs, i) + list(r.above) for i in range(r.n)]
            yield pd.DataFrame({"grp": r.grp, "at": np.arange(r.n) + r.block * BLOCK, "above": ways, "roots": [list(r.roots)] * r.n})


def with_ways(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The blocks of the lowest layer with `above`, the way from each block's root up, and `roots`, the roots it ends at.

    tops (grp, above, roots) says what stands above each group's root.
    """
    ways = None
    for layer in reversed(layers):
        top = F.lower(F.hex("top"))
        found = layer.where(F.col("total") <= BLOCK).join(tops, "grp").withColumn("roots", F.concat(F.array(top), "roots"))
        if ways is not None:
            found = found.unionByName(layer.where(F.col("total") > BLOCK).join(ways.withColumnRenamed("at", "block"), ["grp", "block"]))
        if layer is layers[0]:
            return found
        ways = written(found.mapInPandas(_ways, "grp string, at long, above array<string>, roots array<string>"))
    raise ValueError("no layers")


def _proofs(key: tuple, leaves: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    leaves, b = leaves.sort_values("at"), block.iloc[0]
    runs, above, (subroot, root) = siblings(b["store"], int(b["n"]), int(b["levels"])), list(b["above"]), b["roots"]
    shared, out = "".join(above), []
    for i, (doc_id, node, other) in enumerate(zip(leaves["doc_id"], leaves["node"], leaves["tampered"])):
        inside, leaf = path(runs, i), node.hex()
        folded = fold(other.hex() if other is not None else leaf, inside + above)
        out.append((doc_id, leaf, subroot, root, hashlib.sha256(("".join(inside) + shared).encode()).hexdigest(), folded, folded == root))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def leaf_digests(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, node, tampered): each row's digest, and that of its lower-cased text where 3 divides crc32 of its id; grp sorts as lang, null first."""

    def piece(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    text = F.col("text")
    plain = F.octet_length(text) == F.length(text)  # ASCII only: the faster function does the same
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    head = F.concat(*[piece(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), "doc_id", F.unhex(F.sha2(F.concat(head, piece(text)), 256)).alias("node"),
        F.when(changed, F.unhex(F.sha2(F.concat(head, piece(lowered)), 256))).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    Null values are leaves too ('-'), a null lang is a group of its own, first in order. Null ids come first
    in their group and are not tampered; rows of one id are ordered by leaf digest, so repeated rows have neighbouring leaves. An empty
    table has no rows and no root. Texts are hashed where they are read; however long, only digests move. Other columns are not read.
    """
    leaves = written(leaf_digests(docs))
    nodes = written(numbered(leaves, "doc_id", "node"))
    layers = blocks_of(nodes.select("grp", "at", "total", "node"))
    groups = written(numbered(roots_of(layers).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), "name"))
    over = blocks_of(groups.select("grp", "at", "total", "node"))
    none = F.array().cast("array<string>")
    ways = with_ways(over, roots_of(over).select("grp", none.alias("above"), none.alias("roots"))).mapInPandas(_ways, "grp string, at long, above array<string>, roots array<string>")
    tops = written(groups.join(ways, ["grp", "at"]).select(F.col("name").alias("grp"), "above", "roots"))
    blocks = with_ways(layers, tops).select("grp", "block", "n", "levels", "store", "above", "roots")
    named = nodes.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block", F.floor(F.col("at") / BLOCK))  # as text: pandas would make nullable integers inexact
    forget(leaves)
    proofs = named.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInPandas(
        _proofs, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proofs.withColumn("doc_id", F.col("doc_id").cast("long"))
