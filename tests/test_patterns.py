"""FP-growth in two bands against all subsets."""

import random
from collections import Counter
from itertools import combinations

import pytest

from setweave.operators import patterns


def some_sets(n=400, items=14, seed=5):
    """Sets in which some items go together, one item is nearly everywhere, and many sets are equal."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = {"all"} | {f"i{j}" for j in range(items) if r.random() < 0.15 + 0.3 * (j % 3 == 0)}
        if r.random() < 0.3:
            s |= {"x", "y", "z"}
        out.append((i, sorted(s) if i % 7 else ["all", "i0"], float(i * 31 % 97), i % 3 == 0))
    return out


def counted(sets, least, most):
    high, base = Counter(), Counter()
    for tokens, is_high in sets:
        for size in range(2, most + 1):
            for c in combinations(sorted(set(tokens)), size):
                (high if is_high else base)[c] += 1
    return sorted((c, n, base[c]) for c, n in high.items() if n >= least)


@pytest.mark.parametrize("tree_rows", [10**6, 40, 1])
@pytest.mark.parametrize("most", [2, 4])
def test_itemsets_equal_all_subsets(spark, monkeypatch, tree_rows, most):
    """One tree a shard, shards dealt out again once, and dealt out to the end."""
    monkeypatch.setattr(patterns, "TREE_ROWS", tree_rows)
    rows = [(t, h) for _, t, _, h in some_sets()]
    df = spark.createDataFrame(rows, "tokens array<string>, high boolean")
    got = sorted((tuple(r["items"]), r.n_high, r.n_base) for r in patterns.frequent_itemsets(df, 12, most).collect())
    assert got == counted(rows, 12, most) and len(got) > 50


def contrast(rows, high_pct=5.0, k=50, commonest=200):
    rows = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0]))
    n = len(rows)
    sets = [(set(r[1] or ()) - {None}, i >= int(n * (1 - high_pct / 100))) for i, r in enumerate(rows) if i >= int(n * (1 - high_pct / 100)) or int(n * 0.25) <= i < int(n * 0.75)]
    sets = [s for s in sets if len(s[0]) > 1]
    nh, nb = sum(h for _, h in sets), sum(not h for _, h in sets)
    out = []
    for size in (2, 3, 4):
        found = [x for x in counted(sets, 1, 4) if len(x[0]) == size]
        found = sorted(found, key=lambda x: (-x[1], "|".join(x[0])))[:commonest]
        kept = [("|".join(c), h, h / nh, max(b / nb, 0.001)) for c, h, b in found if h >= max(2, int(nh * 0.01)) and nb]
        kept = [(size, *x, x[2] / x[3]) for x in kept if x[2] / x[3] > 1.5]
        out += sorted(kept, key=lambda x: (-round(x[-1], 9), x[1]))[:k]
    return sorted(out)


@pytest.mark.parametrize("high_pct,k,commonest", [(5.0, 50, 200), (20.0, 7, 30)])
def test_contrast(spark, high_pct, k, commonest):
    rows = [(i, t, v) for i, t, v, _ in some_sets(600)] + [(1000, None, 5.0), (1001, ["all", None, "all", "x"], 96.0), (1002, [], 96.0), (1003, ["x", "y"], None)]
    df = spark.createDataFrame(rows, "example_id long, tokens array<string>, activation double")
    got = sorted(tuple(r) for r in patterns.contrastive_itemsets(df, high_pct=high_pct, k=k, commonest=commonest).collect())
    want = contrast(rows, high_pct, k, commonest)
    assert [x[:3] for x in got] == [x[:3] for x in want] and got
    assert all(a == pytest.approx(b) for x, y in zip(got, want) for a, b in zip(x[3:], y[3:]))


def test_no_sets(spark):
    df = spark.createDataFrame([(1, ["a", "b"], 1.0)], "example_id long, tokens array<string>, activation double")
    assert patterns.contrastive_itemsets(df).count() == 0 and patterns.contrastive_itemsets(df.limit(0)).count() == 0
