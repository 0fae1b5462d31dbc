"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself; a text's is the average of the vectors of its different words, words without any
embedded n-gram aside and NEUTRAL words without weight added, so that long texts are not diluted and one word alone decides nothing. Embeddings and
softmax are fitted together, so a misspelling or an inflection that no labelled text
holds still shares most of its n-grams with words that were seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.llm.workers import give_back, lean

#: Labelled texts of each class that are fitted, and characters a fitted text has at most. Scoring has no bound.
SAMPLE, SAMPLE_CHARS = 1500, 40_000
#: Embedding size, texts an n-gram occurs in at least, deviations that make it telling, neutral words of an average, passes, step size, decay, words a task remembers.
DIM, LEAST_TEXTS, TELLING, NEUTRAL, PASSES, STEP, DECAY, CACHE = 8, 4, 4.0, 10, 200, 0.1, 2e-4, 150_000
_EDGE = ".,;:!?\"'()[]{}<>|%$&*#@~_-+=/\\"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids whose labels are never learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def grams(word: str) -> list[str]:
    """A word's character 3- to 5-grams with marked ends, and the whole word; none without a letter or digit."""
    w = word.strip(_EDGE)
    if not w:
        return []
    w = f"<{w}>"
    return [w, *[w[i : i + 3] for i in range(len(w) - 2)], *[w[i : i + 4] for i in range(len(w) - 3)], *[w[i : i + 5] for i in range(len(w) - 4)]]


def _sums(values: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row sums of values[index] between starts; no segment is empty."""
    return np.add.reduceat(values[index], starts, axis=0)


def _telling(pairs: list[np.ndarray], flat: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """N-grams worth an embedding: in LEAST_TEXTS texts or more, and more or less often in toxic texts, by TELLING deviations, than their share of the words."""
    tox, all_ = np.zeros(n), np.zeros(n)
    for words, label in zip(pairs, labels):
        rows = np.unique(np.concatenate([flat[w] for w in words]))
        all_[rows] += 1
        tox[rows] += label
    share = sum(len(p) for p, y in zip(pairs, labels) if y) / sum(map(len, pairs))
    share = min(max(share, labels.mean() / 2), (1 + labels.mean()) / 2)
    off = np.abs(tox - all_ * share) / np.sqrt(np.maximum(all_ * share * (1 - share), 1e-9))
    return np.flatnonzero((all_ >= LEAST_TEXTS) & (off >= TELLING))


def fit(texts: list[str], labels: list[int], seed: int = 1) -> tuple[dict[str, float], float]:
    """(weight of every n-gram kept, bias) after joint training: a word's logit is the mean weight of its n-grams, others counting zero, a text's the mean of its words' that have one."""
    if len(set(labels)) < 2:
        return {}, 4.0 if labels and labels[0] else -4.0
    vocab: dict[str, int] = {}
    pairs = [np.unique(np.array([vocab.setdefault(w, len(vocab)) for w in t.lower().split()] or [vocab.setdefault("", len(vocab))])) for t in texts]
    names: dict[str, int] = {}
    flat = [np.array([names.setdefault(g, len(names)) for g in grams(w)], np.int64) for w in vocab]
    known = _telling(pairs, flat, np.array(labels), len(names))
    place = np.full(len(names), len(known))
    place[known] = np.arange(len(known))
    full = np.array([len(r) for r in flat])
    own = np.repeat(np.arange(len(flat)), full)
    cell = place[np.concatenate(flat)]
    keep = cell < len(known)
    own, cell = own[keep], cell[keep]
    prior = float(np.log(np.mean(labels) / (1 - np.mean(labels))))
    if not len(cell):
        return {}, prior
    # Only words that hold a kept n-gram carry weight.
    words = np.unique(own)
    spot = np.full(len(flat), -1)
    spot[words] = np.arange(len(words))
    own, size = spot[own], full[words]
    pairs = [spot[p][spot[p] >= 0] for p in pairs]
    length = np.array([float(NEUTRAL + len(p)) for p in pairs])
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in pairs])
    word = np.concatenate(pairs)
    weight = (1 / length[doc]).astype(np.float32)[:, None]
    # words x n-grams and texts x words, each in both orders
    by_cell = np.argsort(cell, kind="stable")
    _, word_starts = np.unique(own, return_index=True)
    _, cell_starts = np.unique(cell[by_cell], return_index=True)
    some, doc_starts = np.unique(doc, return_index=True)
    by_word = np.argsort(word, kind="stable")
    _, of_word = np.unique(word[by_word], return_index=True)

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(known), DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    truth = np.eye(2, dtype=np.float32)[np.array(labels)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    for t in range(1, PASSES + 1):
        vec = _sums(emb, cell, word_starts) / size[:, None]
        text = np.zeros((len(texts), DIM), np.float32)
        text[some] = np.add.reduceat(vec[word] * weight, doc_starts, axis=0)
        logit = text @ out + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - truth) / len(texts)
        d_text = err @ out.T
        d_word = np.add.reduceat(d_text[doc[by_word]] * weight[by_word], of_word, axis=0) / size[:, None]
        d_emb = np.add.reduceat(d_word[own[by_cell]], cell_starts, axis=0) + DECAY * emb / len(texts)
        for q, g, (m, v) in zip((emb, out, bias), (d_emb, text.T @ err, err.sum(0)), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = (emb @ (out[:, 1] - out[:, 0])).tolist()
    grams_of = list(names)
    return {grams_of[g]: x for g, x in zip(known, weights)}, float(bias[1] - bias[0])


class Scorer:
    """Scores texts with a fitted table; remembers the logits of words met."""

    def __init__(self, table: dict[str, float], bias: float) -> None:
        self.table, self.bias, self.known = table, bias, {}

    def word(self, w: str) -> float | None:
        """Mean weight of a word's n-grams; None where none has a weight."""
        found = grams(w)
        return sum(map(self.table.get, found, repeat(0.0))) / len(found) if any(map(self.table.__contains__, found)) else None

    def __call__(self, text: str) -> float:
        words = set(text.lower().split())
        known = self.known
        new = words.difference(known)
        if new:
            if len(known) + len(new) > CACHE:
                first = list(known.items())[: CACHE // 3]  # the first met are the frequent ones
                known.clear()
                known.update(first)
                new = words.difference(known)
            for w in new:
                known[w] = self.word(w)
        told = [x for x in map(known.__getitem__, words) if x is not None]
        z = self.bias + math.fsum(told) / (NEUTRAL + len(told))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Fit on at most `sample` labelled texts of each class, taken by hash of the id outside the held-out fifth.

    The share of toxic rows among all labels that may be learnt sets the bias.
    Without labels of both classes every text scores the class there is.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    chosen = None
    for toxic in (0, 1):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    table, bias = fit([r.text for r in rows], [r.toxic for r in rows])
    n1 = sum(r.toxic for r in rows)
    if 0 < n1 < len(rows) and counts.get(0) and counts.get(1):
        bias += math.log(counts[1] / counts[0]) - math.log(n1 / (len(rows) - n1))
    return table, bias


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """docs' doc_id, held_out, score, predicted for every row; null text is empty and scores the bias alone. A null id counts as not held out.

    Whole texts are scored, however long; repeated rows are scored each and alike; a score of exactly 0.5 is predicted toxic; other columns are not read.
    """
    table, bias = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(table, bias)
        for b in batches:
            s = np.array([scorer(t) for t in b["text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return ready.mapInPandas(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """docs without the rows predicted toxic; columns and all other rows unchanged."""
    table, bias = model

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(table, bias)
        try:
            for t in texts:
                yield pd.Series([scorer(x) for x in t], dtype=float)
        finally:
            scorer.known.clear()
            give_back()

    return docs.where(toxic(F.coalesce("text", F.lit(""))) < 0.5)
