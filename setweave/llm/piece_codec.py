"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges run from an agenda ordered by the vocabulary's scores, as in the library's
merge-type models. A candidate that comes up is skipped when the keyed hash of its document, its
unit's number, its place and its result falls under the dropout rate, so every occurrence of a word is cut its own
way, the same in every run. What the vocabulary lacks falls back to bytes,
so any segmentation decodes to the text it came from.

The agendas of thousands of units are processed side by side in numpy: a column is a unit, a row a
place in it, and each cell holds the order of the candidate that starts there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from setweave.llm.workers import lean

#: Rate at which candidates are skipped, units processed side by side, longest unit of those.
DROPOUT, SIDE_BY_SIDE, LONGEST = 0.1, 24_000, 100
#: Fixed value: how vocabularies of this kind write a space.
MARK = "▁"
_M1, _M2, _M3, _FULL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, (1 << 64) - 1
_NONE = np.int32(2**31 - 1)
#: Symbols above the vocabulary stand for characters it lacks.
_OTHER = 1 << 20
_MODELS: dict[str, "PieceModel"] = {}


def mixed(x: int) -> int:
    """64 bits that all depend on all bits of x; mixed_all() is the same for arrays."""
    x = (x ^ x >> 30) * _M2 & _FULL
    return x ^ x >> 31


def mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_M2)
    return x ^ x >> np.uint64(31)


def document_key(doc_id: object, seed: int) -> int:
    return xxh64_intdigest(f"{seed} {doc_id}".encode())


def unit_key(document: int, number: int) -> int:
    """Key of a document's unit; a candidate's hash is candidate_hash(unit_key, place, piece)."""
    return mixed(document + number * _M1 & _FULL)


def candidate_hash(unit: int, place: int, piece: int) -> int:
    return mixed((unit ^ place * _M1 + piece * _M3 & _FULL) & _FULL)


class PairTable:
    """Which two symbols merge into which piece: open addressing over arrays."""

    BITS = 20

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.key = np.full(1 << self.BITS, -1, np.int64)
        self.piece = np.full(1 << self.BITS, -1, np.int32)
        left = np.array([a << 21 | b for a, b in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.key[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.key[at], self.piece[at] = left[chosen], made[chosen]
            keep = np.ones(len(left), bool)
            keep[chosen] = False
            left, made, slot = left[keep], made[keep], (slot[keep] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(_M1) >> np.uint64(64 - self.BITS)).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece of each pair of symbols, -1 where they do not merge."""
        key = a.astype(np.int64) << 21 | b
        slot = self._slot(key)
        there = self.key[slot]
        out = np.where(there == key, self.piece[slot], np.int32(-1))
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)
            there = self.key[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.piece[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class PieceModel:
    """A merge-type vocabulary with byte fallback, its pieces written with plain spaces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id, self.raw, self.id_of, score = np.zeros(256, np.int32), [], {}, np.zeros(sp.get_piece_size())
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                text = piece.replace(MARK, " ")
                self.raw.append(text.encode())
                self.id_of[text] = i
                score[i] = -sp.get_score(i)
        self.order = np.unique(score, return_inverse=True)[1].astype(np.int32)  # place of a piece in the order of merges
        self.splits_lines = not any("\n" in p for p in self.id_of)
        self.symbol = np.arange(_OTHER, _OTHER + 0x110000, dtype=np.int32)
        for text, i in self.id_of.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        pairs = {}
        for text, i in self.id_of.items():
            for cut in range(1, len(text)):
                a, b = text[:cut], text[cut:]
                sides = [self.id_of.get(x, _OTHER + ord(x) if len(x) == 1 else None) for x in (a, b)]
                if None not in sides:
                    pairs[tuple(sides)] = i
        self.pairs, self.merge = pairs, PairTable(pairs)

    def _starts(self, text: np.ndarray) -> np.ndarray:
        """Where units begin that no merge crosses: at a line break and after it, and at spaces, which lead what follows them."""
        space = text == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        if self.splits_lines:
            line = text == 10
            new |= line
            new[1:] |= line[:-1]
        new[:1] = True
        return np.flatnonzero(new)

    def _side_by_side(self, sym: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Symbols after all merges of units of up to LONGEST characters: sym is (place, unit), -1 past the end and where a symbol was merged away."""
        size, n = sym.shape
        flat = sym.reshape(-1)
        after = np.broadcast_to(np.arange(1, size + 1, dtype=np.int16)[:, None], sym.shape).copy().reshape(-1)
        before = np.broadcast_to(np.arange(-1, size - 1, dtype=np.int16)[:, None], sym.shape).copy().reshape(-1)
        piece = np.full(sym.shape, -1, np.int32)
        if size > 1:
            piece[:-1] = self.merge(sym[:-1].reshape(-1), sym[1:].reshape(-1)).reshape(size - 1, n)
        agenda = np.where(piece >= 0, self.order[piece] << 7 | np.arange(size, dtype=np.int32)[:, None], _NONE)
        who = np.arange(n)  # the units of the agenda's columns
        piece = piece.reshape(-1)
        while True:
            best = agenda.min(axis=0)
            live = best != _NONE
            if (count := int(live.sum())) == 0:
                return sym
            if count < 0.7 * len(who):
                agenda, who, best = agenda[:, live], who[live], best[live]
                cols = np.arange(len(who))
            else:
                cols = np.flatnonzero(live)
                best = best[cols]
            unit = who[cols]
            i = (best & 127).astype(np.int64)
            at = i * n + unit
            made = piece[at]
            agenda[i, cols] = _NONE
            if limit:
                h = mixed_all(keys[unit] ^ (i.astype(np.uint64) * np.uint64(_M1) + made.astype(np.uint64) * np.uint64(_M3)))
                go = h >= np.uint64(limit)
                cols, unit, i, at, made = cols[go], unit[go], i[go], at[go], made[go]
            j = after[at].astype(np.int64)
            gone = j * n + unit
            k = after[gone]
            flat[at], flat[gone] = made, -1
            agenda[j, cols] = _NONE
            after[at] = k
            for_right = np.flatnonzero(k < size)
            right = k[for_right].astype(np.int64) * n + unit[for_right]
            before[right] = i[for_right]
            ended = flat[right] < 0  # past the unit's end
            h = before[at].astype(np.int64)
            for_left = np.flatnonzero(h >= 0)
            left = h[for_left] * n + unit[for_left]
            a = np.append(flat[at[for_right]], flat[left])
            b = np.append(np.where(ended, -1, flat[right]), flat[at[for_left]])
            spot = np.append(at[for_right], left)
            place = np.append(i[for_right], h[for_left])
            new = self.merge(a, np.where(b < 0, 0, b))
            new[b < 0] = -1
            piece[spot] = new
            agenda[place, np.append(cols[for_right], cols[for_left])] = np.where(new >= 0, self.order[new] << 7 | place.astype(np.int32), _NONE)

    def _alone(self, sym: list[int], key: int, limit: int) -> list[int]:
        """The same for one long unit, its agenda a heap."""
        pairs, order, n = self.pairs, self.order, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(int(order[p]), i, p) for i in range(n - 1) if (p := pairs.get((sym[i], sym[i + 1]), -1)) >= 0]
        heapq.heapify(agenda)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            if sym[i] < 0 or (j := after[i]) >= n or pairs.get((sym[i], sym[j])) != p:
                continue
            if limit and candidate_hash(key, i, p) < limit:
                continue
            sym[i], sym[j] = p, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pairs.get((p, sym[k]), -1)) >= 0:
                    heapq.heappush(agenda, (int(order[q]), i, q))
            if (h := before[i]) >= 0 and (q := pairs.get((sym[h], p), -1)) >= 0:
                heapq.heappush(agenda, (int(order[q]), h, q))
        return [s for s in sym if s >= 0]

    def _spelled(self, syms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, symbol of each id): pieces as they are, other characters as the ids of their UTF-8 bytes."""
        other = syms >= _OTHER
        if not other.any():
            return syms, np.arange(len(syms))
        c = syms[other] - _OTHER
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        sizes = np.ones(len(syms), np.int64)
        sizes[other] = size
        owner = np.repeat(np.arange(len(syms)), sizes)
        ids = syms[owner]
        c, size = np.repeat(c, size), np.repeat(size, size)
        spot = np.flatnonzero(ids >= _OTHER)
        step = spot - (np.cumsum(sizes) - sizes)[owner[spot]]
        tail = 0x80 | c >> 6 * (size - 1 - step) & 0x3F
        head = np.select([size == 1, size == 2, size == 3], [c, 0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18)
        ids[spot] = self.byte_id[np.where(step == 0, head, tail)]
        return ids, owner

    def encode_all(self, texts: list[str], keys: list[int], dropout: float = DROPOUT) -> list[bytes]:
        """Whole texts' ids, little-endian unsigned 16-bit; dropout 0 gives the library's own segmentation."""
        limit = int(dropout * (1 << 64))
        raws = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        starts = [self._starts(r) for r in raws]
        counts, lens = np.array([len(s) for s in starts]), np.array([len(r) for r in raws])
        if not counts.sum():
            return [b""] * len(texts)
        text = self.symbol[np.concatenate(raws)]
        first = np.concatenate([s + o for s, o in zip(starts, np.cumsum(lens) - lens)])
        size = np.diff(np.append(first, len(text)))
        number = np.concatenate([np.arange(c) for c in counts])
        own = np.repeat(np.array(keys, np.uint64), counts)
        unit = mixed_all(own + number.astype(np.uint64) * np.uint64(_M1))
        if limit >> 64:  # nothing merges
            out = text
        else:
            out = np.full(len(text), -1, np.int32)
            order = np.argsort(size, kind="stable")
            order = order[: np.searchsorted(size[order], LONGEST, side="right")]
            for lo in range(0, len(order), SIDE_BY_SIDE):
                some = order[lo : lo + SIDE_BY_SIDE]
                place = np.arange(size[some[-1]])[:, None]
                at = first[some] + place
                inside = place < size[some]
                out[at[inside]] = self._side_by_side(np.where(inside, text[np.minimum(at, len(text) - 1)], np.int32(-1)), unit[some], limit)[inside]
            for u in np.flatnonzero(size > LONGEST).tolist():
                done = self._alone(text[first[u] : first[u] + size[u]].tolist(), int(unit[u]), limit)
                out[first[u] : first[u] + len(done)] = done
        kept = np.flatnonzero(out >= 0)
        ids, owner = self._spelled(out[kept])
        ends = np.searchsorted(kept[owner], np.cumsum(lens))
        ids = ids.astype("<u2")
        return [ids[a:z].tobytes() for a, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]

    def decode(self, ids: bytes) -> str:
        """The text that ids came from."""
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u2").tolist()])[1:].decode("utf-8", "surrogatepass")


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = 11) -> DataFrame:
    """(doc_id, ids, lossless, n_chars) of every whole text.

    Null text is empty and has no ids. lossless tells whether decoding the ids gave the text back. Rows that repeat id and
    text repeat the segmentation; a null id is a document like any other. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            sizes = b["text"].str.len().cumsum().to_numpy()
            lo = 0
            while lo < len(b):  # some 400,000 characters at a time
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + 400_000, side="right")))
                part, lo = b.iloc[lo:hi], hi
                names = part["doc_id"].astype("Int64")
                ids = m.encode_all(part["text"].tolist(), [document_key(d, seed) for d in names.astype(object).where(names.notna(), None)], dropout)
                yield pd.DataFrame({"doc_id": names, "ids": ids, "lossless": [m.decode(i) == t for i, t in zip(ids, part["text"])], "n_chars": part["text"].str.len()})

    ready = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ready.mapInPandas(lean(run), "doc_id long, ids binary, lossless boolean, n_chars long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from rows with doc_id and ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": [m.decode(i) for i in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(lean(run), "doc_id long, text string")
