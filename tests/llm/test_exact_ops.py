"""Packing, SimHash, chat formatting and top-k search against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from setweave.llm import chat, packing, queries, simhash, topk

ODD = ["", None, "a", "  two  spaces ", "tab\tand\nline \n end\n", "x" * 5000, "é ü ñ <|endoftext|> ok", "a<|endoftext|>", " <|endoftext|><|endoftext|>  b <|endoftext|", "same text here", "same text here", " lead", "trail "]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None)] + [(9, "same text here", "en", "s", 0, "clash")],
                                 "doc_id long, text string, lang string, source string, n_chars long, ids string")


def check_packing(rows, docs):
    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    used = sum(len(x) for x in ids.values())
    assert sum(p[0].padded_to for p in by_seq.values()) <= used + 1024


def test_packing_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_packing(queries.op3_packing(spark, small).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_packing_odd(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs.where("doc_id is null or doc_id <> 9"), queries.vocabulary("byte_bpe_50k.json")).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect() if r.doc_id != 9})
    assert packing.pack(docs, queries.vocabulary("byte_bpe_50k.json")).where("doc_id = 9").count() == 2
    assert packing.pack(docs.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_spreads_repeats(spark):
    docs = spark.createDataFrame([(1, "one text " * 20)] * 400 + [(2, "w " * 30_000)], "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), group_docs=40).collect()
    groups = defaultdict(int)
    for r in rows:
        if r.doc_id == 1 and r.start == 0:
            groups[r.sequence_id >> 32] += 1
    assert sum(groups.values()) == 400 and len(groups) > 6 and max(groups.values()) < 100
    assert sum(r.length for r in rows if r.doc_id == 2) == next(r.doc_tokens for r in rows if r.doc_id == 2)


def test_first_fit_is_leftmost():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    room, want = [100] * 300, [0] * 300
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        want[i] = next(b for b in range(300) if room[b] >= sizes[i])
        room[want[i]] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == want


def brute_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{doc: component} of {doc: fingerprint}."""
    comp = {}
    for d in sorted(fps):
        if d in comp:
            continue
        todo = [d]
        comp[d] = d
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in comp and bin(fps[x] ^ fps[y]).count("1") <= 3:
                    comp[y] = d
                    todo.append(y)
    return comp


def test_simhash_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fps = {d: brute_fingerprint(t) for d, t in docs.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_near_dedup(spark, small).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in docs}


def test_simhash_odd(spark):
    rows = simhash.simhash_components(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 2
    got = {r.doc_id: r for r in rows}
    assert got[0].fingerprint == got[1].fingerprint == "0" * 16 and got[1].component_id == 0
    assert got[10].component_id == 9 and got[None].component_id is None
    assert simhash.simhash_components(odd_docs(spark).limit(0)).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:  # chains and clusters of up to three flipped bits each
        x = int(b)
        for _ in range(20):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r.src, r.dst) for r in simhash.fingerprint_links(df).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in edges)
    forest = simhash.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = brute_components(dict(enumerate(fps)))
    roots = [forest.root(s) for s in signed]
    assert all((roots[i] == roots[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_golay_halves_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        y = x.copy()
        for k in range(flips):
            y ^= 1 << ((rng.integers(0, 11, len(x)) + 11 * k) % 23)
        a, b = simhash.golay_keys(x), simhash.golay_keys(y)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b))


def test_chat_round_trip(spark, small):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, small).collect()}
    assert set(got) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_odd(spark):
    rows = [(1, 0, "user", "a\\b</turn>\n### x:\n"), (1, 1, "user", "</part>"), (1, 2, "assistant", None), (1, 3, "assistant", "é#\\l"),
            (1, 4, None, ""), (2, None, "a:b", "x"), (2, 1, "a:b", "x"), (2, 1, "a:b", "x"), (None, 0, "assistant", "q")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(made).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", rows[0][3]), ("user", "</part>"), ("assistant", ""), ("assistant", "é#\\l"), ("", "")]
    assert got[1].loss_texts == ["", "é#\\l"] and len(got[2].turns) == 3 and got[2].turns[0].role == "a:b" and got[None].loss_texts == ["q"]
    assert {r.conv_id: r.formatted.count("### ") for r in made.collect()} == {1: 3, 2: 1, None: 1}
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_top(vectors, k=5):
    ints = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors.items()}
    want = {}
    for q in ints:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
            want.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(scores)})
    return want


def test_top_k_table(spark, small):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in queries.op10_exact_top_k(spark, small).collect()}
    assert got == brute_top(vectors)


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-1.0, 0.001])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(df).collect()}
    assert got == brute_top({i: v for i, v in rows if i not in (3, 4, 5)})
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CAND_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = {i: rng.integers(-3, 4, 12).tolist() for i in range(0, 1500, 3)}  # many ties
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(df).collect()}
    assert got == brute_top(rows)


@pytest.mark.parametrize("n", [1, 6, 400])
def test_bound_drops_no_winner(n):
    rng = np.random.default_rng(n)
    m = rng.integers(-200, 200, (64, n))
    m[:, : n // 3] *= 5
    q = rng.integers(-200, 200, 64)
    s, v = topk.top_of_block(q, m, np.arange(n), -1, 5, -np.inf)
    want = sorted((-int(x), i) for i, x in enumerate(q @ m))[:5]
    assert [(-a, b) for a, b in zip(s.tolist(), v.tolist())] == want


def test_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, small).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(str, got[columns].to_numpy().tolist())) == sorted(map(str, want[columns].to_numpy().tolist()))


def test_many_queries_side_by_side():
    """Queries searched together find what each finds alone, at the same floors, and take a small part of the time; ties, own rows and products over 2 ** 53 too."""
    import time

    import numpy as np

    r = np.random.default_rng(7)
    cols, q = (np.floor(256 * r.normal(size=(64, n))).astype(np.int64) for n in (4096, 256))
    cols[:, 9] = cols[:, 40] = q[:, 0]
    ids, own = r.permutation(4096).astype(np.int64), np.arange(256)
    for scale, n in ((1, 256), (1 << 20, 20)):
        for floors in (np.full(n, -np.inf), np.partition((q[:, :n] * scale).T @ (cols[:, :500] * scale), 495, axis=1)[:, 495].astype(float)):
            t = time.perf_counter()
            j, s, v = topk.tops_of_block(q[:, :n] * scale, cols * scale, ids, own[:n], 5, floors)
            together, t = time.perf_counter() - t, time.perf_counter()
            alone = [topk.top_of_block(q[:, i] * scale, cols * scale, ids, i, 5, floors[i]) for i in range(n)]
            alone_s = time.perf_counter() - t
            for i, (scores, found) in enumerate(alone):
                some = scores >= floors[i]
                assert s[j == i].tolist()[: some.sum()] == scores[some].tolist() and v[j == i].tolist()[: some.sum()] == found[some].tolist()
            assert scale > 1 or together < 0.5 * alone_s
