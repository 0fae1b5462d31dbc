"""Density clusters and nearest sets against every pair."""

import math
import itertools
import random

import pytest

from setweave.operators import baskets, density


def brute(points, eps, least):
    at = {k: x for k, *x in points if all(v is not None and not math.isnan(v) for v in x)}
    d2 = {(a, b): sum((p - q) * (p - q) for p, q in zip(at[a], at[b])) for a in at for b in at}
    near = {a: [b for b in at if d2[a, b] <= eps * eps] for a in at}
    core = {a for a in at if len(near[a]) >= least}
    name = {}
    for a in sorted(core):
        if a not in name:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in name:
                    name[x] = a
                    todo += [y for y in near[x] if y in core]
    out = {}
    for k, *_ in points:
        cores = [(d2[k, b], b) for b in near.get(k, []) if b in core]
        out[k] = name[min(cores)[1]] if cores else -1
    return out


def cloud(seed, n, d):
    """Crowded spots, chains at about the distance, copies of one point, a ring of noise, points exactly one eps apart."""
    r = random.Random(seed)
    pts = [[r.gauss(c % 3, 0.05) for _ in range(d)] for c in range(6) for _ in range(n // 12)]
    pts += [[0.31 * i, *[0.0] * (d - 1)] for i in range(n // 12)] + [[5.0] * d] * (n // 12) + [[5.0 + 0.25, *[5.0] * (d - 1)]] * 4
    pts += [[r.uniform(-1, 6) for _ in range(d)] for _ in range(n // 6)]
    r.shuffle(pts)
    return [(i * 3, *p) for i, p in enumerate(pts)]


@pytest.mark.parametrize("d,eps,least,compared", [(2, 0.25, 5, 4096), (2, 0.25, 3, 1), (1, 0.3, 4, 2), (3, 0.4, 6, 4), (2, 1e-9, 2, 1)])
def test_clusters(spark, monkeypatch, d, eps, least, compared):
    """Also with boxes halved down to single points, and postings of a few points."""
    monkeypatch.setattr(density, "COMPARED", compared)
    monkeypatch.setattr(density, "POSTING", 3 if compared < 9 else 1000)
    pts = cloud(d * 10 + compared, 240, d) + [(9001, *[None] * d), (9004, *[float("nan")] * d)]
    df = spark.createDataFrame(pts, "id long, " + ", ".join(f"c{i} double" for i in range(d)))
    got = {r.id: r.cluster for r in density.dense_clusters(df, "id", [f"c{i}" for i in range(d)], eps, least).collect()}
    assert got == brute(pts, eps, least)
    assert len(set(got.values())) > 1


def test_crowded_cells_make_no_pairs(spark):
    """Ten thousand points in two touching cells and two apart: one cluster each side, found from boxes."""
    df = spark.range(20_000).selectExpr("id", "case when id % 2 = 0 then 0.0 else 50.0 end + (id % 1000) / 1000.0 as x", "(id % 7) / 70.0 as y")
    got = density.dense_clusters(df, "id", ["x", "y"], 0.5, 5).groupBy("cluster").count().collect()
    assert sorted((r.cluster, r["count"]) for r in got) == [(0, 10_000), (1, 10_000)]


def test_nearest_sets(spark):
    r = random.Random(8)
    items = [f"i{int(r.paretovariate(0.6)) % 40}" for _ in range(4000)]
    make = lambda first, n: [(first + i, f"c{i % 3}", t) for i in range(n) for t in set(r.sample(items, r.randrange(1, 9)))]
    own, ref = make(0, 120), make(1000, 90)
    own += [(500, "c1", t) for _, c, t in ref if (_, c) == (1001, "c1")] + [(501, "none", "i1"), (502, "c1", "unknown"), (503, "c1", None)]
    kind = "example_id long, ctx string, family string"
    got = {x.example_id: x.nearest for x in baskets.nearest_jaccard(spark.createDataFrame(own, kind), spark.createDataFrame(ref, kind)).collect()}
    sets = lambda rows: {k: (c, {t for k2, _, t in rows if k2 == k and t}) for k, c, _ in rows}
    refs = list(sets(ref).values())
    want = {k: max(len(s & q) / len(s | q) for c2, q in refs if c2 == c) for k, (c, s) in sets(own).items() if c != "none"}
    assert got == pytest.approx(want) and 1.0 in got.values() and 0.0 in got.values()


@pytest.mark.parametrize("subsets", [1024, 12, 1])
def test_nearest_sets_by_subsets(spark, monkeypatch, subsets):
    """Sets of one to eleven of twelve items, listed by their subsets, in part or not at all."""
    monkeypatch.setattr(baskets, "SUBSETS", subsets)
    r = random.Random(subsets)
    items = [f"i{i}" for i in range(12)]
    make = lambda first, n: {first + i: (f"c{i % 2}", frozenset(r.sample(items, r.randrange(1, 12)))) for i in range(n)}
    own, ref = make(0, 80), make(1000, 25)
    flat = lambda sets: spark.createDataFrame([(k, c, x) for k, (c, s) in sets.items() for x in s], "example_id long, ctx string, family string")
    got = {x.example_id: x.nearest for x in baskets.nearest_jaccard(flat(own), flat(ref)).collect()}
    assert got == pytest.approx({k: max(len(s & q) / len(s | q) for c2, q in ref.values() if c2 == c) for k, (c, s) in own.items()})


def test_subsets_leave_out_what_a_likeness_allows(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d", "e"],)], "s array<string>")
    for t, least in ((0.8, 4), (0.6, 3), (0.0, 1)):
        found = ["".join(x) for x in rows.select(baskets._subsets("s", t).alias("x")).first().x]
        assert sorted(found) == sorted("".join(c) for n in range(least, 6) for c in itertools.combinations("abcde", n))
