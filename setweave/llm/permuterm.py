"""Spelling variants by permuterm rotations.

A word of n characters, its end marked, has n + 1 rotations. Rotating a replaced, deleted or inserted character to the
end makes two near words share all that stands before it: the rotations of both, sorted, start
with the same key. A word enters once under each rotation less its last character (the edited one) and once under each
whole rotation (a character is missing there). A key's group holds at most one word with nothing after the key and one for each
character of the alphabet, so groups are small whatever the corpus holds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions.session import forget, written
from setweave.llm.workers import lean

RUN = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FACTOR, DELETE_ONE_IN = 7, 2, 10, 31
#: Marks a word's end; words never hold it.
END = "$"
#: Characters from which on a word meets others by sums of its two sides instead of the text of its rotations, which grows with the square of its length.
LONG = 100
#: Different words a task counts before it hands them on, and words whose rotations one task makes.
HELD, ROTATED = 300_000, 50_000
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


def _counted(least: int):
    pattern = re.compile(f"[{RUN}]{{{least},}}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def told() -> pd.DataFrame:
            return pd.DataFrame({"word": list(held), "n": np.fromiter(held.values(), np.int64, len(held))})

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if text is None:
                    continue
                state = zlib.crc32(f"{doc_id or ''}:".encode())
                found = Counter(pattern.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), state)
                    if h % DELETE_ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return run


def words_of(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of at least `least` characters, A-Z lower-cased, that occur `count` times over all docs.

    Where 31 divides crc32 of `doc_id:run`, the run's character at crc32 modulo its length is deleted first. Each task adds up its own words before they move.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(lean(_counted(least)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, last, n) of the words of up to LONG characters; last is '' where the key is a whole rotation.

    A word of LONG characters enters without its whole rotations: what is longer does not meet here.
    """
    w, size = F.col("word"), F.length("word")
    after = lambda i: F.substring(w, i, size)  # noqa: E731  Spark's places start from 1
    edited = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.concat(after(i + 1), F.lit(END), F.substring(w, F.lit(1), i - 1)).alias("key"), F.substring(w, i, F.lit(1)).alias("last")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.concat(after(i + 1), F.lit(END), F.substring(w, F.lit(1), i)).alias("key"), F.lit("").alias("last")))
    both = F.when(size < LONG, F.concat(edited, whole)).otherwise(edited)
    return words.where(size <= LONG).select("n", F.inline(both)).select("key", "last", "n")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, whole groups at a time; those alone with their key are left out before they become Python objects."""
    held: pa.Table | None = None

    def shared(t: pa.Table) -> pd.DataFrame:
        keys = t["key"].combine_chunks()
        same = np.zeros(len(keys) + 1, bool)
        if len(keys) > 1:
            same[1:-1] = pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        return t.filter(pa.array(same[1:] | same[:-1])).to_pandas()

    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = held["key"].combine_chunks()
        tail = len(keys) - 1
        while tail > 0 and keys[tail - 1] == keys[-1]:  # a group holds no more rows than the alphabet has letters
            tail -= 1
        if tail > 0:
            yield shared(held.slice(0, tail))
            held = held.slice(tail)
    if held is not None and len(held):
        yield shared(held)


def _members(rows: pd.DataFrame) -> Iterator[tuple[str, list[tuple]]]:
    """(key, rows without the key) of every group."""
    keys = rows["key"].tolist()
    rest = list(zip(*(rows[c].tolist() for c in rows.columns if c != "key")))
    at = 0
    while at < len(keys):
        end = at + 1
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        yield keys[at], rest[at:end]
        at = end


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, best_n, best): for each word of a group how many near words the group shows, and the most frequent of them.

    Words that differ in a run of equal letters share a key at each of its places; only the run's last place counts.
    """
    kind = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    for rows in _groups(batches, ["key", "last", "n"]):
        out = []
        for key, members in _members(rows):
            after, _, before = key.partition(END)
            short = [(-n, before + after) for last, n in members if not last]
            edited = sorted((-n, before + last + after, after[:1] != last) for last, n in members if last)
            closing = [x for x in edited if x[2]]
            for i, (_, word, closes) in enumerate(edited):
                best = [edited[1 if i == 0 else 0][:2]] if len(edited) > 1 else []
                near = len(edited) - 1
                if short and closes:
                    best, near = [min(*best, short[0])] if best else short, near + 1
                if near:
                    out.append((word, near, -best[0][0], best[0][1]))
            if short and closing:
                out.append((short[0][1], len(closing), -closing[0][0], closing[0][1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kind.types)], schema=kind)


def _long_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, id, last) of long words: sums over both sides of an edited or missing character stand for the rotation's text."""
    for b in batches:
        for word, word_id in zip(b["word"], b["id"]):
            left, right = [0], [0]
            for c in word:
                left.append((left[-1] * _BASE + ord(c) + 1) % _PRIME)
            for c in reversed(word):
                right.append((right[-1] * _BASE + ord(c) + 1) % _PRIME)
            n, rows = len(word), []
            if n > LONG:
                for i, c in enumerate(word):
                    rows.append((f"{n - 1}:{left[i]:x}:{right[n - 1 - i]:x}", word_id, c + ("" if word[i + 1 : i + 2] == c else END)))
            rows += [(f"{n}:{left[i]:x}:{right[n - i]:x}", word_id, "") for i in range(n + 1)]
            for a in range(0, len(rows), 100_000):
                yield pd.DataFrame(rows[a : a + 100_000], columns=["key", "id", "last"])


def _long_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, other) of near long words, both ways, each once; last ends with END where a missing character counts."""
    kind = pa.schema([("id", pa.binary()), ("other", pa.binary())])
    for rows in _groups(batches, ["key", "id", "last"]):
        out = []
        for _, members in _members(rows):
            for a, x in members:
                for b, y in members:
                    if a != b and (x and y or (x or y).endswith(END)):
                        out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*out) if out else [[]] * 2)], schema=kind)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best): number and most frequent (ties: least) of the words that differ from each by one inserted, deleted or replaced character; words without any are left out."""
    kind = "word string, near long, best_n long, best string"
    told = rotations(words).repartition("key").sortWithinPartitions("key").mapInArrow(_neighbours, kind)
    known = words.where(F.length("word") >= LONG).select("word", "n", F.unhex(F.md5("word")).alias("id"))
    rows = known.select("word", "id").mapInPandas(_long_rows, "key string, id binary, last string")
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_long_pairs, "id binary, other binary")
    other = known.select(F.col("id").alias("other"), F.col("n").alias("best_n"), F.col("word").alias("best"))
    long = pairs.join(known.select("id", "word"), "id").join(other, "other").select("word", F.lit(1).cast("long").alias("near"), "best_n", "best")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    found = told.unionByName(long).groupBy("word").agg(F.sum("near").alias("near"), best.alias("b"))
    return found.select("word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots_of(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, twice as far each round; counts grow tenfold a step, so the rounds are few."""
    links = written(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = written(links.join(on, "root", "left"))
        forget(links)
        links = joined.select("word", F.coalesce("_next", "root").alias("root"))
        if joined.where("_next is not null").isEmpty():
            return links
        links = written(links)
        forget(joined)


def variants(docs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs.

    A word's form is its near word of largest n (ties: least in code-point order), if that is `factor` times the word's
    own n; root follows forms to the last and is the word itself where there is none. Null and empty texts have no words; a null
    id counts as the empty text in the checksum; repeated rows count again. Words of any length take part: from LONG characters on they meet on 127-bit sums of
    both sides of the edit. Other columns are not read.
    """
    words = written(words_of(docs))
    near = words.join(near_words(words.repartition(max(1, -(-words.count() // ROTATED)))), "word", "left")  # a word has some twenty rotations, so few files would make large tasks
    has = F.col("best_n") >= factor * F.col("n")
    told = written(near.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    out = told.join(roots_of(told.where("form is not null")), "word", "left")
    forget(words)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
