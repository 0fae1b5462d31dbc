"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm.workers import lean

#: Tokens of a sequence, documents and characters of a group on average, whichever makes more groups.
SEQUENCE, GROUP_DOCS, GROUP_CHARS = 1024, 2000, 12_000_000
#: Fixed value: how vocabularies of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others for 256 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """Whole texts to ids as little-endian unsigned 16-bit bytes, as `tokenizers` gives them for the byte-level BPE file at path with add_special_tokens=False.

    The file's vocabulary is run by tiktoken, which takes a third of the CPU
    time for the same ids: a merge's rank is the id of its result, and ids rise in merge order. As in that library, the
    strings of the file's added tokens in a text become those tokens.
    """
    if path not in _ENCODERS:
        spec = json.loads(Path(path).read_text())
        byte_of = _byte_alphabet()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        _ENCODERS[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    made = _ENCODERS[path]
    marks = made.special_tokens_set

    def one(text: str) -> list[int]:
        return made.encode(text, allowed_special=marks) if any(m in text for m in marks) else made.encode_ordinary(text)

    return lambda texts: [np.array(one(t), "<u2").tobytes() for t in texts]


def tokenized(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids, copy): every whole text's ids with end_id after the last, as little-endian unsigned 16-bit bytes; null text is empty.

    copy counts the rows before it in its task that repeat the row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], "<u2").tobytes()
        seen: Counter = Counter()
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                ids = [x + end for x in encode(part["text"].tolist())]
                copies = []
                for row in zip(part["doc_id"].fillna(-1), ids):
                    name = hash(row)
                    copies.append(seen[name])
                    seen[name] += 1
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": ids, "copy": copies})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(lean(run), "doc_id long, ids binary, copy int")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, largest first, each into the leftmost bin with room.

    A tournament tree over the bins holds the largest free room below each
    node, so the leftmost fitting bin is found in one descent.
    """
    leaves = 1 << max(1, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i] = at - leaves
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def pack_group(lengths: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of one group.

    Whole multiples of capacity fill sequences of their own; the remainders go
    first-fit decreasing. Then the emptiest sequences are taken apart and cut to
    fill the gaps of the fuller ones, which leaves one partly filled sequence.
    """
    out, rest = [], []
    seq = 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for j in range(whole):
            out.append((d, j * capacity, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rest.append((d, whole * capacity, n % capacity))
    held: dict[int, list] = {}
    for piece, b in zip(rest, first_fit_decreasing([r[2] for r in rest], capacity)):
        held.setdefault(b, []).append(piece)
    bins = sorted(held.values(), key=lambda p: -sum(x[2] for x in p))
    fill = [sum(x[2] for x in p) for p in bins]
    lo, hi = 0, len(bins) - 1
    while lo < hi:
        gap = capacity - fill[lo]
        if not gap:
            lo += 1
            continue
        d, start, n = bins[hi].pop()
        take = min(gap, n)
        bins[lo].append((d, start, take))
        fill[lo] += take
        fill[hi] -= take
        if take < n:
            bins[hi].append((d, start + take, n - take))
        if not bins[hi]:
            hi -= 1
    for p in bins:
        if p:
            at = 0
            for d, start, n in p:
                out.append((d, start, n, seq, at))
                at += n
            seq += 1
    return out


def pack(docs: DataFrame, path: str, capacity: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    Documents go to groups of group_docs or GROUP_CHARS on average by a seeded hash of id, text, partition and number of the
    repeat, so a group is a bounded random share whatever the key distribution, copies of one row included; tokens are shuffled once. Null text is
    one end id; repeated rows are packed each; other columns are not read. padded_to is capacity, or the
    sequence's length where that is a power of two.
    """
    rows, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    groups = max(1, math.ceil(rows / group_docs), math.ceil((chars or 0) / GROUP_CHARS))
    made = tokenized(docs, path)
    made = made.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "ids", F.spark_partition_id(), "copy"), F.lit(groups))).drop("copy")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "ids"], kind="stable")
        ids = [np.frombuffer(x, "<u2") for x in rows["ids"]]
        names = rows["doc_id"].tolist()
        pieces = pack_group([len(x) for x in ids], capacity)
        total: dict[int, int] = {}
        for _, _, n, s, _ in pieces:
            total[s] = total.get(s, 0) + n
        return pd.DataFrame(
            [(names[d], a, n, zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()), len(ids[d]), (int(key[0]) << 32) + s, at,
              total[s] if total[s] & (total[s] - 1) == 0 else capacity) for d, a, n, s, at in pieces],
            columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"]).astype({"doc_id": "Int64"})

    return made.groupBy("pack_group").applyInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")
