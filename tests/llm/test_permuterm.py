"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from setweave.llm import permuterm, queries

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(n):
    out, forms = [], {}
    by = {}
    for w in n:  # only words that share all but one character of one side can be near
        for i in range(len(w) + 1):
            by.setdefault((w[:i], w[i:]), set()).add(w)
            if i < len(w):
                by.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    around = {w: set() for w in n}
    for g in by.values():
        for a in g:
            around[a] |= {b for b in g if b != a and near(a, b)}
    for w, k in n.items():
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * k else None
    for w, k in n.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, k, len(around[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = rows(queries.op11_permuterm_variants(spark, small))
    assert got == brute(counted(docs))
    assert len(got) > 100


WORDS = ["colour", "colours", "colourss", "coloours", "colouur", "cölours", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaa", "abababab", "babababa", "ababababa", "zzzzzzzé", "zzzzzzzè", "zzzzzzz", "colour×s", "colourz"]


def test_crowded_words(spark):
    """Runs of one letter, edits at both ends, ties, chains of forms, three scripts of accents."""
    r = random.Random(3)
    text = [" ".join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in r.choices(WORDS, [4 ** (i % 5) for i in range(len(WORDS))], k=300)) for _ in range(12)]
    docs = list(enumerate(text))
    for length in (7, 8, 9):
        docs += [(100 + i, " ".join("".join(r.choice("ab") for _ in range(length)) for _ in range(60))) for i in range(8)]
    got = rows(permuterm.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(counted(docs))
    assert any(x[1] for x in got) and any(x[2] != x[1] and x[1] for x in got)


@pytest.mark.parametrize("length", [97, 98, 99, 100, 101, 250])
def test_long_words(spark, length):
    """Edits of words around the length from which sums stand for rotations."""
    r = random.Random(length)
    word = "".join(r.choice("abc") for _ in range(length))
    some = [word, "q" + word, word + "q", word[:50] + word[51:], word[:50] + "é" + word[51:], word[:-1], word[1:], word + "qq", word[:30] + word[29:], word[:9] + "zz" + word[11:]]
    docs = [(1, " ".join([*some * 2, *[word] * 40]))]
    assert rows(permuterm.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(counted(docs))


def test_odd_rows(spark):
    docs = [(None, "Nullids nullids"), (1, None), (2, ""), (3, "ab " * 9), (4, "Größere GRößere größerE größere GRÖSSERE"), (4, "Größere GRößere größerE größere GRÖSSERE"), (5, "x" * 60_000 + " " + "x" * 60_000 + "y " + "x" * 60_000 + " " + "x" * 60_000 + "y"), (6, "naïvely\x00naïvely_naïvely1naivety naivety ŸŸŸŸŸŸŸ")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = rows(permuterm.variants(df))
    want = counted(docs)
    long = {w for w in want if len(w) > 1000}
    assert len(long) == 2
    assert [x for x in got if len(x[0]) < 1000] == brute({w: k for w, k in want.items() if w not in long})
    assert all(x[4] == 1 and x[1] is None for x in got if len(x[0]) > 1000)
    assert permuterm.variants(df.limit(0)).count() == 0
