"""Blocked products and linear codes against dense ones in one place."""

import numpy as np
import pytest

from setweave.operators import matrices


def cells(rng, n, m, share, names):
    return [(f"{names[0]}{i}", f"{names[1]}{j}", float(rng.normal())) for i in range(n) for j in range(m) if rng.random() < share]


def product(left, right):
    out = {}
    for r, k, x in left:
        for k2, c, y in right:
            if k == k2 and None not in (r, k, c, x, y):
                out[r, c] = out.get((r, c), 0.0) + x * y
    return out


@pytest.mark.parametrize("side", [1024, 4, 1])
@pytest.mark.parametrize("share", [1.0, 0.15])
def test_product(spark, monkeypatch, side, share):
    monkeypatch.setattr(matrices, "SIDE", side)
    rng = np.random.default_rng(side)
    left, right = cells(rng, 9, 7, share, "rk"), cells(rng, 7, 6, share, "kc")
    left += [left[0], ("r1", None, 1.0), (None, "k1", 1.0), ("r1", "k1", None), ("alone", "nowhere", 2.0)]
    got = matrices.matrix_product(spark.createDataFrame(left, "r string, k string, x double"), spark.createDataFrame(right, "k string, c string, y double"), "r", "k", "c").collect()
    want = product(left, right)
    assert {(x.r, x.c) for x in got} == set(want) and len(got) == len(want)
    assert all(x["value"] == pytest.approx(want[x.r, x.c]) for x in got)


def test_product_of_nothing(spark):
    left = spark.createDataFrame([], "r long, k int, x double")
    right = spark.createDataFrame([(1, 2, 1.0)], "k int, c long, y double")
    assert matrices.matrix_product(left, right, "r", "k", "c").count() == 0


def test_encode_and_decode(spark, monkeypatch):
    monkeypatch.setattr(matrices, "SIDE", 5)
    rng = np.random.default_rng(2)
    x, w, b, c = rng.normal(size=(12, 8)) * 3, rng.normal(size=(8, 6)), rng.normal(size=8), rng.normal(size=6)
    x[rng.random(x.shape) < 0.5] = 0
    w[:, 5] = 0
    x[3] = 0  # a row that holds one cell, a zero
    long = lambda m, kind, keep=lambda v: True: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if keep(m[i, j]) or (i, j) == (3, 0)], kind)
    one = lambda v, kind: spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], kind)
    sparse, weights, shift = long(x, "row long, f int, x double", lambda v: v != 0), long(w, "f int, unit int, w double"), one(b, "f int, b double")
    h = matrices.linear_encode(sparse, weights, shift, one(c, "unit int, c double"), "row", "f", "unit")
    want = np.clip((x - b) @ w + c, 0, 6)
    got = {(r.row, r.unit): r.h for r in h.collect()}
    assert len(got) == want.size and all(got[i, j] == pytest.approx(want[i, j], abs=1e-9) for i, j in np.ndindex(*want.shape))
    assert {0.0, 6.0} <= set(got.values())
    norm = np.maximum(np.sqrt((w * w).sum(0)), 1e-12)
    back = want @ (w / norm).T + b
    decoded = matrices.linear_decode(h, weights, shift, "row", "f", "unit")
    got = {(r.row, int(r.f)): r["value"] for r in decoded.collect()}
    assert len(got) == back.size and all(got[i, j] == pytest.approx(back[i, j], abs=1e-9) for i, j in np.ndindex(*back.shape))

    groups = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(12)], "row long, g string")
    told = {r.g: r for r in matrices.representation_metrics(sparse, decoded, h, groups, "row", "f", "g", 0.5).collect()}
    for g, at in ((None, slice(0, 12)), ("a", slice(0, 5)), ("b", slice(5, 12))):
        mse, l0 = ((x[at] - back[at]) ** 2).mean(), (want[at] > 0.5).mean()
        dead = (1 - l0) * 100
        distance = np.sqrt(sum(np.log(max(v / t, 0.1)) ** 2 for v, t in ((mse, 0.1), (l0, 0.1), (dead, 50.0))))
        r = told[g]
        assert (r.mse, r.l0, r.dead_percent, r.distance) == pytest.approx((mse, l0, dead, distance))
        assert (r.l1, r.magnitude) == pytest.approx((want[at].sum(1).mean(), want[at].mean()))
