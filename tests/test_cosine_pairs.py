"""All pairs of sparse vectors over a cosine against every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from setweave.operators import similarity


def brute(rows, least):
    by = {}
    for k, t, v in rows:
        if None not in (k, t, v):
            by.setdefault(k, {}).setdefault(t, 0.0)
            by[k][t] += v
    norm = {k: math.sqrt(sum(v * v for v in x.values())) for k, x in by.items()}
    out = {}
    for a in by:
        for b in by:
            if a < b and norm[a] and norm[b]:
                c = sum(v * by[b].get(t, 0.0) for t, v in by[a].items()) / norm[a] / norm[b]
                if c > least + 1e-9:
                    out[a, b] = c
    return out


def vectors(n=90, seed=4):
    """Vectors over words of falling frequency; one word is nearly everywhere, some vectors are copies or hold one word, some values are negative."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if k % 9 == 1:
            rows += [(k, t, v) for q, t, v in rows if q == k - 1]
            continue
        rows.append((k, "all", r.uniform(0.5, 3)))
        if k % 10:
            rows += [(k, f"t{int(r.paretovariate(0.7))}", r.uniform(-1, 2)) for _ in range(r.randrange(1, 12))]
    return rows


@pytest.mark.parametrize("least", [0.1, 0.5, 0.93])
@pytest.mark.parametrize("posting", [1000, 7, 1])
def test_pairs(spark, monkeypatch, least, posting):
    """Postings of one block and of many."""
    monkeypatch.setattr(similarity, "POSTING", posting)
    rows = vectors() + [(3, "all", 1.0), (500, None, 1.0), (None, "all", 1.0), (501, "all", None), (502, "all", 0.0), (503, "only here", 1.0)]
    got = {(r.a, r.b): r.cosine for r in similarity.cosine_pairs(spark.createDataFrame(rows, "k long, t string, v double"), "k", "t", "v", least).collect()}
    want = brute(rows, least)
    assert set(got) == set(want) and want
    assert all(got[p] == pytest.approx(c) for p, c in want.items())


def test_widespread_tokens_stay_out_of_the_index(spark):
    """Vectors that share a heavy part only in one token each: at 0.8 the index leaves the common front out, so few cells are looked up."""
    rows = [(k, "all", 1.0) for k in range(300)] + [(k, f"own{k}", 3.0) for k in range(300)]
    cells = spark.createDataFrame(rows, "key long, token string, v double").withColumn("v", F.col("v") / math.sqrt(10))
    index = similarity._partial_index(cells, 0.8).collect()
    assert {r.token for r in index} == {f"own{k}" for k in range(300)}
    assert all(r.rest == pytest.approx(1 / math.sqrt(10)) for r in index)


def test_overlap_counts(spark):
    r = random.Random(1)
    rows = [(i, s) for i in range(60) for s in "abcde" if r.random() < 0.4] + [(i, "all") for i in range(60)] + [(0, "all")]
    got = {(x.a, x.b): x.n for x in similarity.overlap_counts(spark.createDataFrame(rows, "i long, s string"), "i", "s").collect()}
    sets = {s: {i for i, t in rows if t == s} for _, s in rows}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if sets[a] & sets[b]}


def test_few_pairs_go_on(monkeypatch):
    """Of vectors that meet on a token, those only are compared whole whose fronts leave room for the cosine; none is lost, however small the chunks."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similarity, "SUMS", 300)
    r, least = np.random.default_rng(3), 0.7
    dense = np.where(r.random((120, 60)) < np.linspace(0.9, 0.05, 60), r.random((120, 60)) + 0.1, 0.0) * np.linspace(0.2, 1, 60)
    dense[60:70] = dense[:10] * (1 + 0.1 * r.random((10, 60)))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    t = [np.flatnonzero(x) for x in dense]
    n = [int((np.cumsum(x[i] ** 2) >= least * least - 1e-9).sum()) for x, i in zip(dense, t)]
    block = similarity._Block(pa.table({"key": list(range(120)), "t": [i.astype(np.int32) for i in t], "v": [x[i] for x, i in zip(dense, t)], "n": n}))
    i, j = similarity._may_reach(block, block, least, 0, 120)
    cosine, went_on = dense @ dense.T, set(zip(i.tolist(), j.tolist()))
    true = {(a, b) for a in range(120) for b in range(a + 1, 120) if cosine[a, b] > least}
    looked_up = [set(k[-m:]) for k, m in zip(t, n)]
    met = {(a, b) for a in range(120) for b in range(a + 1, 120) if looked_up[a] & looked_up[b]}
    assert true and true <= went_on <= met and len(went_on) < 0.7 * len(met)
