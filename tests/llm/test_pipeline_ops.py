"""Language ID, chaining, the near-dedup stage and the pipeline on planted cases and odd inputs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from setweave.functions.session import written
from setweave.llm import chaining, langid, similar_sets, simhash, toxicity
from setweave.operators.components import connected_components
from tests.llm.test_exact_ops import check_packing

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "ng", "sh", "st", "lo")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, text, rate):
    return " ".join("zz" + w if rng.random() < rate else w for w in text.split())


def test_components_odd(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 9), (None, 4), (7, 5), (5, 6), (2, 1)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 5: 5, 6: 5, 7: 5}
    path = spark.range(300).selectExpr("id * 7919 % 1009 as src", "(id + 1) * 7919 % 1009 as dst")
    assert connected_components(path).select("component").distinct().count() == 1
    assert connected_components(df.limit(0)).count() == 0


def test_best_chains_against_quadratic():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        m = np.unique(rng.integers(0, 60, (n, 2)), axis=0)
        x, y = m[:, 0], m[:, 1]
        score = []
        for j in range(len(x)):
            best = max((score[i] - chaining.GAP * (x[j] - x[i] + y[j] - y[i]) for i in range(j) if x[i] < x[j] and y[i] < y[j]), default=0)
            score.append(chaining.KMER + max(0, best))
        x0, x1, y0, y1 = chaining.best_chains(x, y)[0]
        ends = [(x[j] + chaining.KMER, y[j] + chaining.KMER) for j in range(len(x)) if abs(score[j] - max(score)) < 1e-9]
        assert (x1, y1) in ends and x0 < x1 and y0 < y1


def test_planted_passages_are_found(spark):
    rng = np.random.default_rng(6)
    shared = prose(rng, 70)
    texts = {i: prose(rng, 200) for i in range(40)}
    for i in (3, 11, 19, 27):
        texts[i] += " " + edited(rng, shared, 0.06) + " " + prose(rng, 50)
    texts[30] = texts[5]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(50, None, 0), (51, "", 0), (None, shared, 0), (52, "w " * 500, 0)], "doc_id long, text string, pos int")
    rows = chaining.fuzzy_passages(df).collect()
    assert {r.doc_id for r in rows} | {r.other_id for r in rows} == {3, 11, 19, 27, 5, 30}
    for r in rows:
        if r.doc_id != 30:
            assert r.first_word <= 205 and r.last_word >= 258 and r.identity >= 0.8
    assert [(r.first_word, r.last_word, r.other_id) for r in rows if r.doc_id == 30] == [(0, 200, 5)]
    assert chaining.fuzzy_passages(df.limit(0)).count() == 0


def test_passages_survive_earlier_texts_with_parts_of_them(spark):
    rng = np.random.default_rng(15)
    shared = [f"s{i}" for i in range(40)]
    texts = {i: " ".join([prose(rng, 60), *shared[lo : lo + 22], prose(rng, 60)]) for i, lo in enumerate((0, 9, 18))}  # every six words are in one of these
    texts |= {i: " ".join([prose(rng, 60), *shared, prose(rng, 60)]) for i in (10, 11, 12)}
    rows = chaining.fuzzy_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    linked = {(r.doc_id, r.other_id) for r in rows}
    assert len(linked) >= 2 and {i for p in linked for i in p} == {10, 11, 12}
    assert all(r.first_word == r.other_first == 60 and r.last_word == r.other_last == 100 for r in rows)


def test_a_passage_behind_many_fragments(spark):
    rng = np.random.default_rng(21)
    shared = [f"s{i}" for i in range(60)]
    texts = {i: " ".join([prose(rng, 30), *shared[5 * i : 5 * i + 11], prose(rng, 30)]) for i in range(10)}
    texts |= {20: "\n " + " ".join([prose(rng, 40), *shared, prose(rng, 40)]), 21: " ".join([*shared, prose(rng, 40)])}
    rows = chaining.fuzzy_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_word, r.last_word, r.other_id, r.other_first, r.other_last) for r in rows] == [(21, 0, 60, 20, 40, 100)]


def test_passages_at_every_place_of_a_text(spark):
    rng = np.random.default_rng(22)
    shared = prose(rng, 50)
    start = " ".join(shared.split()[:14])
    texts = {1: f"{start} {prose(rng, 60)} {shared} {prose(rng, 30)}", 2: f"{start} {prose(rng, 40)} {shared} {prose(rng, 70)} {shared}"}
    rows = chaining.fuzzy_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_word, r.last_word, r.other_first, r.other_last) for r in rows} == {(2, 54, 104, 74, 124), (2, 174, 224, 74, 124)}


def test_passages_of_odd_rows(spark):
    rng = np.random.default_rng(23)
    one, other, long = prose(rng, 40), prose(rng, 45), "w " * 3000
    rows = [(1, "\n" + one), (2, "\n" + one), (2, "\n" + one), (3, other), (3, one + " x"), (4, long), (5, long + "end"), (6, "")]
    got = chaining.fuzzy_passages(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, words string")).collect()
    assert [(r.first_word, r.last_word, r.other_last) for r in got if r.doc_id == 2 and r.other_id == 1] == [(0, 40, 40)]
    assert {(r.doc_id, r.other_id) for r in got} >= {(2, 1), (3, 1), (5, 4)} and all(r.doc_id > r.other_id for r in got)


def pages(spark):
    de, fr = "und der die das nicht ich ein zu haben werden über", "et le la les des une pas pour être avec où"
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        lang, words = (("de", de), ("fr", fr))[i % 2]
        declared = lang if i % 10 else {"de": "fr", "fr": "de"}[lang]
        body = " ".join(rng.choice(words.split(), 40)) if i % 7 else ""
        rows.append((i, f"http://www.{'abc'[i % 2]}.example.{lang}/x?{i}", f'<html lang="{declared}"><script>und und</script><p>{body}</p></html>', "clash"))
    return spark.createDataFrame(rows + [(900, None, None, None), (901, "", "<p>12 34</p>", ""), (902, "not a url", "no tags und der die", "")], "page_id long, url string, html string, host string")


def test_language_evidence(spark):
    df = pages(spark)
    got = {r.page_id: r for r in langid.identify_pages(df).collect()}
    assert len(got) == 203
    # wrongly declared pages follow their text; pages without text follow the host's prior and the tag
    assert np.mean([got[i].language == ("de", "fr")[i % 2] for i in range(200)]) > 0.97
    assert got[900].language == got[901].language == "und" and got[902].language == "de"
    assert langid.identify_pages(df.limit(0)).count() == 0


def test_identified_documents_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where("trim(text) <> ''").count()
    odd = docs.limit(5).selectExpr("doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    assert langid.keep_identified(docs.union(odd)).count() == docs.count()
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_rare_and_unknown_languages(spark):
    rng = np.random.default_rng(16)
    say = {"de": "und der die das nicht ich ein haben werden", "is": "og ekki það sem þetta við hún fyrir", "el": "και το της είναι στο για που δεν"}
    page = lambda i, tag, words: (i, "", f"<html{tag and f' lang={tag!r}'}><p>{' '.join(rng.choice(say[words].split(), 30))}</p></html>")
    rows = [page(i, "de", "de") for i in range(6000)] + [page(i, "is", "is") for i in range(7000, 7025)] + [page(8000, "", "is"), page(8001, "", "el")]
    got = {r.page_id: r.language for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(7000, 7025)} == {"is"} and got[8000] == "is"  # under 0.5 % of the pages
    assert got[8001] == "und" and got[0] == "de"


def test_repeated_long_and_tied_rows_of_language_id(spark):
    say = {"de": "und der die das nicht ich ein haben werden ", "fr": "et le la les des une pas pour avec "}
    rows = [(i, "de" if i % 2 else "fr", say["de" if i % 2 else "fr"] * 3, "s" if i % 3 else None) for i in range(60)]
    rows += [(100, None, say["de"] * 20_000, "s"), (101, "de", None, None), (102, "", "", ""), (103, None, "12 34", "s"), (1, "de", say["de"] * 3, "s"), (1, "de", say["de"] * 3, "s")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, lang string, text string, source string, host double")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted([*range(60), 1, 1, 100])
    pages = spark.createDataFrame([(7, "http://a.de/", f"<html lang='de'>{say['de'] * 9}</html>")] * 30 + [(8, "http://a.de/", say["de"] * 30_000)], "page_id long, url string, html string")
    got = [(r.page_id, r.language) for r in langid.identify_pages(pages).collect()]
    assert len(got) == 31 and set(got) == {(7, "de"), (8, "de")}


def test_documents_stay_where_no_language_can_be_learnt(spark):
    docs = spark.createDataFrame([(i, "plain words here", None, "s", 16) for i in range(30)] + [(99, "", "", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.keep_identified(docs).count() == 30


def test_near_duplicate_stage(spark):
    rng = np.random.default_rng(9)
    texts = {i: prose(rng, int(rng.integers(60, 300))) for i in range(60)}
    for i in range(20):  # near copies in the first words only, exact copies, fuzzier ones
        texts[100 + i] = edited(rng, texts[i], (0.004, 0.01, 0.0, 0.08)[i % 4])
    texts |= {200: "", 201: "", 202: "a b", 203: "a b", 204: "a b c"}
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in texts.items()}
    df = spark.createDataFrame([(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], "src long, dst long")
    gone = {r.node for r in connected_components(df).where("node <> component").collect()}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()] + [(None, texts[1], "en", "s", 0), (202, "a b", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(texts) - gone) and ids.count(None) == 1
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def without_repeats(texts, length=200):
    """Texts without the bytes of strings of that length that start twice."""
    raws = {d: t.encode() for d, t in texts.items()}
    seen = Counter(r[i : i + length] for r in raws.values() for i in range(len(r) - length + 1))
    out = {}
    for d, r in raws.items():
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out[d] = bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore")
    return out


def test_pipeline_against_brute_force(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "SimHash near-dedup", "suffix-array dedup", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    scorer = toxicity.Scorer(*toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet")))
    clean = {d: t for d, t in texts.items() if scorer(t) < 0.5 and t.split()}
    sets = {d: set(simhash.shingle_set(t).tolist()) for d, t in clean.items()}
    up = {d: d for d in clean}
    for a, b in combinations(sorted(clean), 2):
        if up[a] != up[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = max(up[a], up[b]), min(up[a], up[b])
            up = {k: y if v == x else v for k, v in up.items()}
    left = without_repeats({d: t for d, t in clean.items() if up[d] == d})
    tables = set(corpus_pipeline.MADE)
    rows = corpus_pipeline.run(spark, small).collect()
    check_packing(rows, left)
    assert len(set(corpus_pipeline.MADE) - tables) == 1  # the result alone is left behind
    assert spark.conf.get(corpus_pipeline.ARROW_KEY) != str(corpus_pipeline.ARROW_ROWS)


def test_stages_of_odd_rows(spark, small):
    rng = np.random.default_rng(41)
    base = prose(rng, 80)
    rows = [(1, base, "en", "s", 0), (1, base, "en", "s", 0), (2, base + " more", "en", None, 0), (3, None, None, None, None), (4, "", "en", "s", 0), (None, base, "en", "s", 1),
            (5, "w " * 30_000, "en", "s", 0), (6, prose(rng, 40) + " " + base, "en", "s", 7)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, key int")
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, data, small)
            if name != "packing":
                assert out.columns == docs.columns
                data = written(out)
            elif docs is not data:
                assert {r.doc_id for r in out.collect()} <= {1, 5, 6, None}


def test_near_duplicate_stage_against_brute_force_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    texts, line = {}, prose(rng, 12)
    for i in range(150):  # copies at 0.80 to 0.86 by an appended block, the start alone or scattered edits; one line is everywhere
        words = (prose(rng, int(rng.integers(60, 300))) + " " + line).split()
        more = int(len(words) * rng.uniform(0.16, 0.25))
        texts[i] = " ".join(words)
        texts[1000 + i] = (" ".join(words + [f"new{rng.integers(10**6)}" for _ in range(more)]), " ".join(words[: len(words) - int(more * 0.8)]), edited(rng, texts[i], 0.02))[i % 3]
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 100
    gone = {r.node for r in connected_components(spark.createDataFrame(near, "src long, dst long")).where("node <> component").collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == set(texts) - gone


def test_large_groups_of_copies_split_as_by_brute_force(spark):
    rng = np.random.default_rng(13)
    base = prose(rng, 300)
    texts = {i: edited(rng, base, 0.022) for i in range(300)}
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    gone = {r.node for r in connected_components(spark.createDataFrame(near, "src long, dst long")).where("node <> component").collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert 10 < len(gone) < 300 and {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == set(texts) - gone


def test_large_keys_give_two_candidates_a_row():
    rng = np.random.default_rng(14)
    n = 100_000  # a quadratic search of this key takes 10,000,000,000 comparisons
    fps = np.sort((rng.integers(0, 2**60, 1).astype(np.uint64)[0] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))).view(np.int64))
    frame = pd.DataFrame({"key": np.zeros(n, np.int64), "at": fps, "id": np.arange(n), "n": 100})
    made = pd.concat(similar_sets.neighbours(12, 0.8)(iter([frame[:40_000], frame[40_000:40_001], frame[40_001:]])))
    assert len(made) < 2 * n and len(set(made.a) | set(made.b)) == n
    assert {(i, i + 1) for i in (0, 39_998, 39_999, 40_000, 40_001, n - 2)} <= set(zip(made.a, made.b))


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(17)
    for n, m in ((1, 1), (40, 50), (200, 250), (900, 1100), (4000, 5000)):
        pool = rng.integers(0, 2**64, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.append(pool[: int(n * rng.uniform(0.5, 1))], pool[n:][: m // 9]))
        least = similar_sets.least_difference(similar_sets.bitmap_of(a), similar_sets.bitmap_of(b))
        assert least <= len(np.setxor1d(a, b)) and least == similar_sets.least_difference(similar_sets.bitmap_of(b), similar_sets.bitmap_of(a))


@pytest.mark.parametrize("n", [36, 90])
def test_reordered_texts_keep_their_own_copies(spark, n):
    rng = np.random.default_rng(n)
    words = [f"{a}{i}" for i, a in enumerate(rng.choice(WORDS, 200))]
    texts = {}
    for i in range(n):  # equal word sets in other orders: alike by word fingerprints only; each with one near copy
        order = rng.permutation(words).tolist()
        texts[2 * i], texts[2 * i + 1] = " ".join(order), " ".join([*order[:100], "inserted", *order[100:]])
    kept = simhash.keep_one_of_each(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 2 * n, 2))


def test_blocks_of_a_common_shingle_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "BLOCK", 7)
    test_large_groups_of_copies_split_as_by_brute_force(spark)


def test_repeated_ids_and_hot_copies(spark):
    rng = np.random.default_rng(18)
    base = prose(rng, 80)
    rows = [(i, base) for i in range(40)] + [(100, prose(rng, 50)), (100, prose(rng, 50)), (100, None), (7, base), (None, base)]
    got = [r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x is not None) == [0, 100] and got.count(None) == 1


@pytest.mark.parametrize("length", [40, 60, 100])
def test_fragments_in_older_texts_hide_no_passage(spark, length):
    """Twenty passages in two texts each, and every 29 words of them, which are no passage, in older texts."""
    r = random.Random(length)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    around = lambda n: [word() for _ in range(n)]
    docs, wanted, old = [], set(), 0
    for i in range(20):
        passage = around(length)
        for at in range(length - 28):
            docs.append((old, " ".join(around(20) + passage[at : at + 29] + around(20))))
            old += 1
        docs += [(100_000 + 2 * i + j, " ".join(around(30) + passage + around(30))) for j in (0, 1)]
        wanted.add((100_001 + 2 * i, 100_000 + 2 * i))
    rows = chaining.fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(x.doc_id, x.other_id) for x in rows if x.last_word - x.first_word >= 0.9 * length}
    assert found == wanted


def test_a_tag_of_copies_is_learnt(spark):
    """Twenty thousand rows of one text under one tag, beside a tag of different texts, in any order of their hashes."""
    rng = np.random.default_rng(4)
    for trial in range(3):
        copy = " ".join(f"zu{a}{b}" for a in "aeiou" for b in ("pf", "tz", "ck")) + f" zug{trial}"
        df = spark.range(20_000).selectExpr(f"'{copy}' as text", "'de' as declared").union(spark.createDataFrame([(prose(rng, 30), "en") for _ in range(600)], "text string, declared string"))
        languages, table = langid.train(df)
        assert languages == ["de", "en"]
        (ll, words, known), = langid.TextModel(table, 2)([copy])
        assert known and words and int(np.argmax(ll)) == 0
