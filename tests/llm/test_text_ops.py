"""Toxicity, SpotSigs and the SentencePiece codec on tables and odd inputs."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from setweave.llm import piece_codec, queries, spotsigs, toxicity

ODD = [(0, ""), (1, None), (2, "a"), (3, "the cat"), (3, "the cat"), (None, "x y z"), (5, " lead  and  trail "), (6, "w" * 20000), (7, "é▁ \n\n\t the of and to is")]


def odd(spark):
    return spark.createDataFrame([(i, t, 9, "c") for i, t in ODD], "doc_id long, text string, score int, held_out string")


def test_toxicity_held_out(spark, small):
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, small.replace("0.001", "0.01")).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(small.replace("0.001", "0.01") + "/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for d, r in rows.items())
    test = [(rows[d].predicted, y) for d, y in labels.items() if rows[d].held_out]
    assert np.mean([p == y for p, y in test]) > 0.9


def test_toxicity_odd_and_unseen_forms(spark):
    rng = np.random.default_rng(3)
    plain = ["table", "window", "garden", "river", "paper", "cloud", "street", "music"]
    text = lambda bad: " ".join([*rng.choice(plain, 30), *(rng.choice(["scoundrel", "scoundrels"], 2) if bad else [])])
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scorer = toxicity.Scorer(*model)
    assert scorer("table scoundreel window scoundrely river") > scorer("table window river cloud music")
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows if r.doc_id in (0, 1)} == {scorer("")}
    assert toxicity.keep_clean(odd(spark), model).columns == odd(spark).columns
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_scores_are_averages_of_subword_vectors():
    rng = np.random.default_rng(5)
    texts = [" ".join([*rng.choice(["table", "window", "garden", "river"], 12), *(["scoundrel"] if i % 2 else [])]) for i in range(60)]
    table, bias = toxicity.fit(texts, [i % 2 for i in range(60)])
    scorer = toxicity.Scorer(table, bias)
    for text in ("", "table", "scoundrel river", "scoundrely scoundrels garden " * 400, "42 !!", *texts[:4]):
        weights = []
        for w in sorted(set(text.split())):
            pieces = [f"<{w}>"] + [f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)] if w.isalpha() else []
            if any(g in table for g in pieces):
                weights.append(sum(table.get(g, 0) for g in pieces) / len(pieces))
        z = bias + sum(weights) / (len(weights) + toxicity.NEUTRAL)
        assert abs(scorer(text) - 1 / (1 + np.exp(-z))) < 1e-9


def own_signatures(text):
    """Hashes of each common word and the two words after it that are not common, by definition."""
    words = text.lower().split()
    found = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
        if w in spotsigs.ANCHORS and len(after) == 2:
            found.add(xxhash.xxh32_intdigest(" ".join([w, *after])))
    return found or {xxhash.xxh32_intdigest(text, seed=1)}


def brute_spots(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    sets = [own_signatures(t) for _, t in order]
    near = lambda a, b: len(a & b) / len(a | b)
    hexed = lambda x: "".join(f"{v:08x}" for v in sorted(x))
    up = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if order[j][0] is not None and up[i] != up[j] and near(sets[i], sets[j]) >= 0.8:
                a, b = max(up[i], up[j]), min(up[i], up[j])
                up = [b if x == a else x for x in up]
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[i - 1][1]
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        new = own_signatures(edited)
        group = None if d is None else min(order[k][0] for k in range(len(order)) if order[k][0] is not None and up[k] == up[i])
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), hexed(sets[i]), hexed(new), near(sets[i], new), near(sets[i], own_signatures(nxt)), group))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["table", "odd", "one", "none", "many"])
def test_spotsigs_edits(spark, small, which):
    docs = {"table": spark.read.parquet(f"{small}/documents.parquet"), "odd": odd(spark), "one": odd(spark).limit(1), "none": odd(spark).limit(0),
            "many": spark.createDataFrame([(9, f"text {i % 7}") for i in range(30)], "doc_id long, text string")}[which]
    rows = spotsigs.fingerprint_edits(docs).collect()
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.component_id) for r in rows), key=str)
    assert got == brute_spots([(r.doc_id, r.text or "") for r in docs.collect()])


def test_spotsigs_buckets_cut_finer(spark, small, monkeypatch):
    monkeypatch.setattr(spotsigs, "QUANTILES", 5)
    test_spotsigs_edits(spark, small, "table")


def test_spotsigs_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(31)
    texts = {}
    for i in range(60):  # texts of all lengths, each with edited copies near the threshold
        words = [w for k in range(int(rng.integers(3, 60))) for w in ("the", f"a{rng.integers(400)}", f"b{k}")]
        texts[i] = " ".join(words)
        for c in range(3):
            texts[100 + 10 * i + c] = " ".join("zz" + w if w != "the" and rng.random() < (0.02, 0.05, 0.08)[c] else w for w in words)
    sets = {i: own_signatures(t) for i, t in texts.items()}
    up = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and up[a] != up[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = max(up[a], up[b]), min(up[a], up[b])
                up = {k: y if v == x else v for k, v in up.items()}
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == up and len(set(up.values())) < 0.8 * len(texts)


def test_spotsigs_duplicates(spark):
    base = " ".join(f"the w{i} of v{i} u{i}" for i in range(60))
    near = base.replace("w7 ", "x7 ")
    df = spark.createDataFrame([(1, base), (2, near), (3, base), (4, "the other text of something else"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


PIECES = "piece_bpe_32k.model"


def test_pieces_match_the_library_without_dropout(small):
    import sentencepiece

    path = queries.vocabulary(PIECES)
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.model(path)
    texts = ["", " ", "  two  spaces\n\n and lines ", "hello world", "ünïcödé 中文 🙂", "x" * 3000, "tab\tand", "ab" * 49 + " " + "ab" * 50 + " " + "ab" * 51]
    for t, ids in zip(texts, m.encode_all(texts, [5] * len(texts), 0.0)):
        assert np.frombuffer(ids, "<u2").tolist() == sp.encode(t)


def brute_pieces(text, document, dropout):
    """Ids by trying all candidates of a unit again and again; a skipped candidate comes back only when a neighbour has changed."""
    import re

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(PIECES))
    mixed = lambda x: (y := (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64) ^ y >> 31
    known = {sp.id_to_piece(i).replace("▁", " "): i for i in range(259, sp.get_piece_size())}
    out = []
    for number, unit in enumerate(re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + text) if text else []):
        key = mixed((document + number * 0x9E3779B97F4A7C15) % 2**64)
        syms, skipped = [(i, c) for i, c in enumerate(unit)], set()
        while True:
            open_ = [(-sp.get_score(known[a[1] + b[1]]), a[0], n) for n, (a, b) in enumerate(zip(syms, syms[1:])) if a[1] + b[1] in known and (a, b) not in skipped]
            if not open_:
                break
            _, place, n = min(open_)
            a, b = syms[n : n + 2]
            if mixed(key ^ (place * 0x9E3779B97F4A7C15 + known[a[1] + b[1]] * 0xD6E8FEB86659FD93) % 2**64) < int(dropout * 2**64):
                skipped.add((a, b))
            else:
                syms[n : n + 2] = [(place, a[1] + b[1])]
        for _, s in syms:
            out += [known[s]] if s in known else [3 + x for x in s.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_merge_dropout_against_brute_force(spark, small, dropout):
    m = piece_codec.model(queries.vocabulary(PIECES))
    docs = [r.text[:3000] for r in spark.read.parquet(f"{small}/documents.parquet").limit(12).collect()]
    texts = ["", "internationalization of segmentations", "a  b\n\n c 🙂ü中", "th" * 60 + " " + "inter" * 30, *docs]
    keys = [piece_codec.document_key(i, 11) for i in range(len(texts))]
    for t, k, ids in zip(texts, keys, m.encode_all(texts, keys, dropout)):
        assert np.frombuffer(ids, "<u2").tolist() == brute_pieces(t, k, dropout)


def test_pieces_decode_losslessly(spark, small):
    path = queries.vocabulary(PIECES)
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd(spark)):
        coded = piece_codec.encode(docs, path, dropout=0.3)
        assert coded.where("not lossless").count() == 0
        back = sorted((r.doc_id or -1, r.text) for r in piece_codec.decode(coded, path).collect())
        assert back == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    again = [[r.ids for r in piece_codec.encode(odd(spark).where(w), path).collect()] for w in ("doc_id = 3", "doc_id is null")]
    assert again[0][0] == again[0][1] and len(again[1]) == 1  # a repeated row repeats its cuts
    assert piece_codec.encode(odd(spark).limit(0), path).count() == 0


def test_every_occurrence_is_cut_its_own_way():
    m = piece_codec.model(queries.vocabulary(PIECES))
    word = "internationalization"
    ids = m.encode_all([f"{word} " * 300, f"{word} " * 300], [1, 2], 0.3)
    assert ids[0] != ids[1] and m.encode_all([f"{word} " * 300], [1], 0.3) == ids[:1]
    assert len({m.encode_all([word], [k], 0.3)[0] for k in range(300)}) > 20
    nothing = m.encode_all([word], [1], 1.0)[0]
    assert m.decode(nothing) == word and len(nothing) == 2 * len(" " + word)
