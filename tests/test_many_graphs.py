"""PageRank of many graphs at once, and what is told about each feature, against one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from setweave.operators import graph, overview


def ranked(edges, nodes, rounds, tolerance):
    n = len(nodes)
    out = {}
    for s, d, w in edges:
        out[s] = out.get(s, 0.0) + w
    now = {x: 1.0 / n for x in nodes}
    for i in range(1, rounds + 1):
        nxt = {x: 0.15 / n for x in nodes}
        for s, d, w in edges:
            if out[s] > 0:
                nxt[d] += 0.85 * w / out[s] * now[s]
        if sum(abs(nxt[x] - now[x]) for x in nodes) < tolerance:
            return now, i
        now = nxt
    return now, rounds


@pytest.mark.parametrize("rounds,tolerance", [(100, 1e-4), (3, 1e-9)])
def test_each_graph_stops_by_itself(spark, rounds, tolerance):
    """A pair, a chain that loses its mass, random graphs, one with isolated nodes only, and one whose edges weigh nothing."""
    r = random.Random(2)
    graphs = {"pair": [("a", "b", 1.0), ("b", "a", 2.0)], "chain": [("a", "b", 1.0), ("b", "c", 1.0)], "alone": [], "light": [("a", "b", 0.0)],
              **{f"r{k}": [(f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.random()) for _ in range(8 * k)] for k in (1, 2, 3)}}
    nodes = {g: sorted({x for s, d, _ in e for x in (s, d)} | {"a", "lone"}) for g, e in graphs.items()}
    merged = {g: [(s, d, sum(w for s2, d2, w in e if (s2, d2) == (s, d))) for s, d in {(s, d) for s, d, _ in e}] for g, e in graphs.items()}
    edges = spark.createDataFrame([(g, *x) for g, e in merged.items() for x in e] + [(None, "a", "b", 1.0)], "grp string, src string, dst string, w double")
    all_nodes = spark.createDataFrame([(g, x) for g, n in nodes.items() for x in n] + [("pair", None)], "grp string, node string")
    got = {}
    for x in graph.pagerank_of_each(edges, all_nodes, rounds=rounds, tolerance=tolerance).collect():
        got.setdefault(x.grp, {})[x.node] = (x.score, x.rounds)
    want = {g: ranked(merged[g], nodes[g], rounds, tolerance) for g in graphs}
    assert {g: set(n) for g, n in got.items()} == {g: set(s) for g, (s, _) in want.items()}
    for g, (scores, took) in want.items():
        assert {x: s for x, (s, _) in got[g].items()} == pytest.approx(scores) and {t for _, t in got[g].values()} == {took}
    assert tolerance < 1e-8 or len({t for _, t in want.values()}) > 2


def test_influences_of_each_feature(spark):
    r = random.Random(6)
    ex = [(f, i, r.choice([0.0, r.random() * (1 + i % 3)])) for f in ("x", "y") for i in range(150)]
    tok = [(f, i, b) for f, i, a in ex for b in ("p", "q", "rare") if r.random() < {"p": 0.3 + 0.3 * (a > 1), "q": 0.5, "rare": 0.05}[b]]
    e, t = spark.createDataFrame(ex, "f string, example_id long, activation double"), spark.createDataFrame(tok + tok[:9], "f string, example_id long, b string")
    got = {(x.f, x.base): x for x in overview.token_influences(e, t, "f", "b", 20, 0.9).collect()}
    assert set(got) == {(f, b) for f in "xy" for b in "pq"}
    for (f, b), x in got.items():
        acts = {i: a for g, i, a in ex if g == f}
        cut = sorted(acts.values(), reverse=True)[max(1, int(150 * (1 - 0.9)))]
        have = {i for g, i, c in tok if (g, c) == (f, b)}
        high = {i for i, a in acts.items() if a >= cut}
        hi, lo = len(have & high) / len(high), len(have - high) / (150 - len(high))
        p, q = [acts[i] for i in have], [a for i, a in acts.items() if i not in have]
        mp, mq = sum(p) / len(p), sum(q) / len(q)
        vp, vq = sum((v - mp) ** 2 for v in p) / (len(p) - 1), sum((v - mq) ** 2 for v in q) / len(q)
        effect = (mp - mq) / ((vp * len(p) + vq * len(q)) / 150) ** 0.5
        assert (x.n_present, x.high_rate, x.low_rate, x.ratio, x.delta, x.effect) == pytest.approx((len(p), hi, lo, hi / lo, mp - mq, effect))


def test_overview_of_a_feature_without_tokens(spark):
    e = spark.createDataFrame([("x", 1, "c", 0.0), ("x", 2, "c", 2.0), ("y", 1, "d", 1.0)], "f string, example_id long, ctx string, activation double")
    t = spark.createDataFrame([("x", 2, "a_3", 2.0), ("x", 2, "b_6", 2.0)], "f string, example_id long, token string, activation double")
    got = {r.f: r for r in overview.feature_overview(e, t, "f", F.regexp_replace("token", "_[0-9]+$", "")).collect()}
    assert (got["x"].n, got["x"].sparsity, got["x"].top_tokens, got["x"].families, got["x"].samples) == (2, 50.0, "a_3 b_6", "a b", "2 1")
    assert (got["y"].top_tokens, got["y"].bottom_tokens, got["y"].top_contexts, got["y"].top_family_share) == ("", "", "d", None)
