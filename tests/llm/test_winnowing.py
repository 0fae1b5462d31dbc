"""Decontamination against every window of every text."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from setweave.llm import queries, winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, window=10):
    by = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if m else 0):
            by.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    sizes, out = {len(x) for x in by}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in by:
                    hit |= set(range(i, i + m))
                    found |= by[tuple(w[i : i + m])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(queries.op12_winnowing_decontamination(spark, small))
    assert got == brute(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect())
    assert any(r[-1] for r in got)


def test_sql_with_short_items(spark, small, tmp_path):
    """The SQL on items of every length, some of them words that most texts hold."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    long = words(docs.where("doc_id = 3").first().text)
    items = [(i, " ".join(long[i * 7 : i * 7 + i])) for i in range(1, 16)] + [(90, "The"), (91, ""), (92, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(winnowing.contamination(docs, bench))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    benchmark = bench.toPandas()
    con.register("benchmark", benchmark)
    sql = con.execute(queries.ORACLE_SQL["op12_winnowing_decontamination"]).df()
    want = sorted((tuple(r) for r in sql[["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]].itertuples(index=False)), key=str)
    assert got == [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in want] == brute(docs.select("doc_id", "text").collect(), items)


ODD_ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (1, "a second row of the first item"), (2, "é"), (3, "same same same same same same same same same same same same"),
             (None, "no id here but words enough to make a whole window of ten"), (5, None), (6, ""), (7, "ONE, two; THREE four-five (six) SEVEN eight nine TEN"), (8, "x" * 3000), (9, ". , ;")]
ODD_TEXTS = [None, "", "One two three four five six seven eight nine ten eleven twelve", "say é once", "É", "same " * 30, "x" * 3000, "x" * 2999, "no id here but words enough to make a whole window of ten",
             "two three four five six seven eight nine ten", "\x00a second\x7frow of the first item", "a second row of the first", "word " * 9 + "y" * 700_000 + " One two three four five six seven eight nine ten", "one two three four five six seven eight nine ten"]


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, ODD_TEXTS[2]), (2, ODD_TEXTS[2]), (2, "another text of this id")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item_id string, n_words int")
    bench = spark.createDataFrame([(*i, "clash") for i in ODD_ITEMS], "item_id long, text string, doc_id string")
    got = rows(winnowing.contamination(df, bench))
    assert got == brute(docs, ODD_ITEMS)
    told = {r.doc_id: r for r in winnowing.report(df.where("doc_id <> 2"), bench).collect()}
    assert [tuple(s) for s in told[3].spans] == [(1, 2)] and told[3]["items"] == ["2"] and told[9].spans == []
    clean = winnowing.keep_clean(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == sum(not b[-1] for b in brute(docs, ODD_ITEMS))
    none = rows(winnowing.contamination(df, bench.limit(0)))
    assert none == brute(docs, [])
    assert winnowing.contamination(df.limit(0), bench).count() == 0


def test_overlaps_and_shared_phrases(spark):
    """Passages of few words, cut at random, share windows among items and texts."""
    r = random.Random(7)
    stream = [r.choice("abcdefgh") for _ in range(400)]
    cut = lambda n: (lambda a: " ".join(stream[a : a + n]))(r.randrange(380))
    items = [(i, cut(r.randrange(1, 40))) for i in range(60)]
    docs = [(i, " . ".join(cut(r.randrange(5, 60)) for _ in range(4))) for i in range(80)]
    got = rows(winnowing.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)


@pytest.mark.parametrize("size", range(1, 11))
def test_a_window_has_one_fingerprint_wherever_it_stands(size):
    """The guarantee of winnowing: a span of `size` words gives the same least k-gram hash in any text."""
    r = random.Random(size)
    span = " ".join(r.choice(["ab", "é", "x1", "long" * 9]) for _ in range(size))
    texts = [(" ".join(["pre"] * n) + " " + span + " post").encode() for n in range(4)] + [("y" * 600_000 + " " + span).encode()]
    seen = set()
    for n, t in zip([0, 1, 2, 3, 1], texts):
        at, h = winnowing.Words([b"other words", t]).windows(size)
        seen.add(int(h[np.flatnonzero(at == 2 + n)[0]]))
    assert len(seen) == 1
