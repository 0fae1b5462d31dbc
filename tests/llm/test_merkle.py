"""The Merkle manifest against a tree built in one place."""

import hashlib
import zlib

import numpy as np
import pytest

from setweave.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    """(root, for each leaf the runs it lies in and its place there)."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k, members in enumerate(under[a : a + 8]):
                for i in members:
                    ways[i].append((run, k))
            up.append(sha("".join(run)))
            over.append(sum(under[a : a + 8], []))
        nodes, under = up, over
    return nodes[0], ways


def brute(docs):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    by = {}
    for r in docs:
        by.setdefault(r.lang, []).append((r.doc_id, leaf(r, r.text), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    out, roots, trees = [], [], []
    for lang in langs:
        rows = sorted(by[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sub, ways = tree([x[1] for x in rows])
        roots.append(sub)
        trees.append((rows, ways))
    root, above = tree(roots) if roots else (None, [])
    for (rows, ways), up, sub in zip(trees, above, roots):
        for (doc_id, own, r), way in zip(rows, ways):
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            folded = leaf(r, r.text.translate(low) if r.text is not None else None) if tampered else own
            proof = ""
            for run, k in way + up:
                proof += "".join(run[:k] + run[k + 1 :])
                folded = sha("".join(run[:k] + [folded] + run[k + 1 :]))
            out.append((doc_id, own, sub, root, sha(proof), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", range(1, 6))
def test_addresses_fill_the_layout(levels):
    slots = np.concatenate([merkle.address(d, np.arange(8**d), levels) for d in range(levels)])
    assert sorted(slots) == list(range(merkle.size_of(levels)))
    assert merkle.address(0, np.arange(1), levels)[0] == 0


def test_small_subtrees_lie_together():
    # of five levels the upper two come first, and each three-level subtree below them is one stretch
    assert sorted(merkle.address(1, np.arange(8), 5)) == list(range(1, 9))
    one = [merkle.address(d, np.arange(8 ** (d - 2)) + 8 ** (d - 2) * 5, 5) for d in (2, 3, 4)]
    assert sorted(np.concatenate(one)) == list(range(9 + 5 * 73, 9 + 6 * 73))


def test_fold_of_a_path_gives_the_root():
    for n in (1, 2, 8, 9, 64, 65, 500):
        leaves = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
        levels = merkle.levels_for(n, n)
        store = merkle.build(leaves, levels)
        runs, root = merkle.siblings(store.tobytes(), n, levels), store[0].tobytes().hex()
        assert root == tree([x.hex() for x in leaves])[0]
        assert all(merkle.fold(x.hex(), merkle.path(runs, i)) == root for i, x in enumerate(leaves))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = rows(merkle.manifest(docs))
    assert got == brute(docs.collect())
    assert 20 < sum(not r[-1] for r in got) < 120


def test_several_layers_of_blocks(spark):
    """Groups of more than one block, one of them with a single leaf in its last block."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, grp string"
    docs = [(i, f"Text {i}", "aa" if i % 3 else "bb", "s", 6, "clash") for i in range(6150)] + [(10**6 + i, "x", f"l{i}", None, 1, "clash") for i in range(40)]
    df = spark.createDataFrame(docs, kind)
    assert df.where("lang = 'aa'").count() == 4100
    assert rows(merkle.manifest(df)) == brute(df.collect())


def test_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, at string, total int"
    docs = [(1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, None, 2), (2, "", "en", "s", 0, None, 2), (None, "ÀB", "en", "s", 2, None, 2), (3, "Ünï A" * 40_000, "é", "", 7, None, 2),
            (4, "x", "", "s", 1, None, 2), (2**62 + 1, "Big", "en", "s", 3, None, 2), (2**62 + 2, "Big", "en", "s", 3, None, 2), (-5, "MINUS", "en", "s", 3, None, 2), (2, "OTHER", "en", "s", 0, None, 2)]
    df = spark.createDataFrame(docs, kind)
    assert rows(merkle.manifest(df)) == brute(df.collect())
    one = df.where("doc_id = 3")
    assert rows(merkle.manifest(one)) == brute(one.collect())
    assert merkle.manifest(df.limit(0)).count() == 0
