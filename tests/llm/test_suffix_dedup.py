"""Suffix-array dedup against a dictionary of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from setweave.llm import queries, suffix_dedup


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:-1] & ~gone[:-2]).sum() + gone[0]) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, texts, length):
    want = dict(enumerate(brute(texts, length)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == want


def test_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows], 200)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_array_dedup(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("split", [2000, 3])
def test_planted(spark, monkeypatch, split):
    """Passages in random text, copies, periodic and short texts; with few contexts a shard, so that split anchors are merged."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rng = np.random.default_rng(split)
    word = lambda n: "".join(rng.choice(list("abcdé fgh\n"), n))
    passages = [word(n) for n in (199, 200, 201, 260, 700)]
    texts = [None, "", "short", "z" * 450, "xy" * 150, word(900)]
    texts += [word(int(rng.integers(1, 90))) + p + word(int(rng.integers(0, 90))) for p in passages for _ in range(9)]
    texts += [texts[5], passages[4][:350] + word(40) + passages[4][300:], passages[3] + word(5) + passages[3]]
    df = spark.createDataFrame([(i, t, b"k") for i, t in enumerate(texts)], "doc_id long, text string, key binary")
    check(suffix_dedup.substring_dedup(df.repartition(3)).collect(), texts, 200)
    kept = suffix_dedup.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == len(texts)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "q" * 10 + "r" * 190 + "s"), (1, "q" * 10 + "r" * 190 + "s"), (None, None)], "doc_id long, text string")
    rows = suffix_dedup.substring_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 201), (1, 201)]
    assert suffix_dedup.substring_dedup(df.limit(0)).count() == 0
