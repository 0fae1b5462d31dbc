"""Prefixes, substrings, counted ranks and effects against plain loops."""

import math
import random
import statistics

import pytest

from setweave.operators import aggregates, evaluation, matching, ranking


def test_longest_prefix(spark):
    names = ["a", "a_b", "a_b_c", "tri", "tri_stringer", "", "x_", "é"]
    tokens = ["a_1", "a_b_1", "a_b_c", "a_b_c_d", "a", "tri_stringer_swim_12", "trip_1", "_lead", "x__y", "é_3", "none_1", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)] + [(99, "a_1")], "id int, token string")
    got = {r.id: (r.category, r.rest) for r in matching.longest_prefix(rows, spark.createDataFrame([(n,) for n in names + names], "name string")).collect()}
    want = {}
    for i, t in [*enumerate(tokens), (99, "a_1")]:
        best = max((n for n in names if t is not None and t.startswith(n + "_")), key=len, default=None)
        want[i] = (best, t[len(best) + 1 :] if best is not None else None)
    assert got == want


@pytest.mark.parametrize("gram", [4, 2, 1])
def test_occurrences(spark, monkeypatch, gram):
    """Patterns shorter and longer than the piece they look with, over few letters so that pieces are common."""
    monkeypatch.setattr(matching, "GRAM", gram)
    r = random.Random(gram)
    word = lambda n: "".join(r.choice("abé ") for _ in range(n))
    patterns = [word(r.randrange(0, 9)) for _ in range(60)] + [None, "zzzz", "q"]
    texts = [word(r.randrange(0, 30)) for _ in range(50)] + [None, "", "ab"]
    got = sorted((x.pattern, x.text) for x in matching.occurrences(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect())
    assert got == sorted({(p, t) for p in patterns for t in texts if p and t and p in t})


@pytest.mark.parametrize("empty_rule", [False, True])
def test_category_by_substring(spark, empty_rule):
    rules = [("Roller", "roller", 5), ("Carbon Roller", "roller", 6), ("BRUSH", "brush", 7), ("ab", "short", 1)] + ([("", "any", 6)] if empty_rule else [])
    names = ["carbon roller deco", "roller", "Roll", "Inkbrush", "brush roller", "AB", "b", "", None, "nothing", "xaby roller"]
    got = {r.id: r.category for r in matching.category_by_substring(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string"), spark.createDataFrame(rules, "rule_name string, category string, rule_order int")).collect()}
    want = {i: next((c for w, c, _ in sorted(rules, key=lambda x: x[2]) if n is not None and (w.lower() in n.lower() or n.lower() in w.lower())), None) for i, n in enumerate(names)}
    assert got == want


def test_percentile_rank_of_zeros(spark):
    rows = [("g", i, 0.0 if i % 4 else (-1) ** i * float(i % 20)) for i in range(200)] + [("h", 500, 2.0), ("h", 501, None), (None, 502, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {r.id: r.pct for r in ranking.percentile_rank(df, "g", "v").collect()}
    for g, i, v in rows:
        own = [abs(x) for h, _, x in rows if h == g and x is not None]
        assert got[i] == (None if v is None else pytest.approx(100 * sum(x < abs(v) for x in own) / len(own)))


def test_extreme_slices(spark):
    rows = [(i, float(i * 7 % 10), float(i)) for i in range(25)] + [(99, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double, o double")
    for fraction in (0.1, 0.6, 0.0):
        got = {r.side: (r.n, r["mean"], sorted(r.members.split(","))) for r in ranking.extreme_slices(df, "v", "o", "k", fraction).collect()}
        order, take = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])), math.ceil(25 * fraction)
        sides = {"bottom": order[:take], "top": order[max(take, 25 - take) :]}
        assert got == {s: (len(x), pytest.approx(sum(r[2] for r in x) / len(x)), sorted(str(r[0]) for r in x)) for s, x in sides.items() if x}


def examples(n=200, seed=3):
    r = random.Random(seed)
    return [(i, r.choice("uvw"), round(r.random() * 10, 2)) for i in range(n)], [(i, t) for i in range(n) for t in ("p", "q", "all", "few") if t == "all" or r.random() < {"p": 0.4, "q": 0.7, "few": 0.05}[t]], [(i, r.choice("FG"), r.choice((3, 15, 29))) for i in range(n) for _ in range(3)]


def test_presence(spark):
    ex, tok, lev = examples()
    e, t = spark.createDataFrame(ex, "example_id int, ctx string, activation double"), spark.createDataFrame(tok + tok[:5], "example_id int, token string")
    got = {r.token: r for r in aggregates.presence_effect(e, t).collect()}
    assert set(got) == {"p", "q", "all"}
    acts = {i: a for i, _, a in ex}
    cut = sorted(acts.values(), reverse=True)[max(1, int(200 * (1 - 0.90)))]
    for name, r in got.items():
        have = {i for i, x in tok if x == name}
        p, q = [acts[i] for i in have], [a for i, a in acts.items() if i not in have]
        rate = sum(a >= cut for a in p) / sum(a >= cut for a in acts.values())
        assert (r.n_with, r.mean_with, r.high_rate, r.enrichment) == pytest.approx((len(p), statistics.mean(p), rate, rate / (len(p) / 200)))
        if q:
            pooled = (statistics.variance(p) * len(p) + statistics.pvariance(q) * len(q)) / 200
            assert (r.delta, r.effect) == pytest.approx((statistics.mean(p) - statistics.mean(q), (statistics.mean(p) - statistics.mean(q)) / pooled**0.5))
        else:
            assert (r.mean_without, r.effect) == (0.0, 0.0)
    levels = spark.createDataFrame([(i, v) for i, f, v in lev if f == "F"], "example_id int, level int")
    at = {i: max((v for j, f, v in lev if (j, f) == (i, "F")), default=0) for i in acts}
    got = {(r.token, r.level): r for r in aggregates.conditional_presence(e, t, levels, rungs=(0, 15, 29)).collect()}
    for name in ("p", "q"):
        for level in (0, 15, 29):
            p, q = ([acts[i] for i in acts if at[i] == level and ((i, name) in set(tok)) == side] for side in (True, False))
            if len(p) >= 5 and len(q) >= 5:
                r = got.pop((name, level))
                assert (r.n_with, r.n_without, r.n_at_level, r.mean_with, r.mean_without) == pytest.approx((len(p), len(q), len(p) + len(q), statistics.mean(p), statistics.mean(q)))
    assert not got


@pytest.mark.parametrize("by", [(), ("ctx",)])
def test_interference_within_a_family(spark, by):
    ex, _, lev = examples(seed=9)
    e = spark.createDataFrame(ex, "example_id int, ctx string, activation double")
    got = {(*[r[c] for c in by], r.family, r.lo, r.hi): r for r in aggregates.interference(e, spark.createDataFrame(lev, "example_id int, family string, level int"), [(3, 15), (15, 29)], least=3, by=by, least_rows=20).collect()}
    want = {}
    for ctx in "uvw" if by else [None]:
        for f in "FG":
            for lo, hi in ((3, 15), (15, 29)):
                held = {i: {v for j, g, v in lev if (j, g) == (i, f)} for i, c, _ in ex if ctx in (None, c)}
                alone, both = ([a for i, _, a in ex if i in held and hi in held[i] and (lo in held[i]) == b] for b in (False, True))
                if len(alone) >= 3 and len(both) >= 3:
                    want[(*([ctx] if by else []), f, lo, hi)] = (len(alone), len(both), statistics.mean(both) - statistics.mean(alone))
    assert {k: (r.n_alone, r.n_both, pytest.approx(r.delta)) for k, r in got.items()} == want
    # family p at 6 everywhere and q at 3 in half the examples: no family holds both
    apart = spark.createDataFrame([(i, "p", 6) for i in range(40)] + [(i, "q", 3) for i in range(0, 40, 2)], "example_id int, family string, level int")
    assert aggregates.interference(e, apart, [(3, 6)], least=1).count() == 0


def test_compared_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 2) for _ in range(5)], [r.gauss(0, 2) for _ in range(5)], t) for i, t in enumerate([0, 4, 2, 5, -1, None, 1, 1])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, t int")
    compared = df.select("id", *evaluation.vector_comparison(df, "a", "b", "t"))
    got = {x.id: x for x in compared.collect()}
    logs = lambda v: [x - math.log(sum(map(math.exp, v))) for x in v]
    valid = []
    for i, a, b, t in rows:
        p, q = logs(a), logs(b)
        assert got[i].kl == pytest.approx(sum(math.exp(x) * (x - y) for x, y in zip(p, q)))
        if t is None or not 0 <= t < 5:
            assert (got[i].loss_a, got[i].hit_b) == (None, None)
        else:
            valid.append((-p[t], -q[t], *(int(h) for h in (a.index(max(a)) == t, b.index(max(b)) == t, a.index(max(a)) == b.index(max(b))))))
            assert (got[i].loss_a, got[i].loss_b, got[i].hit_a, got[i].hit_b) == pytest.approx(valid[-1][:4])
    s, mean = evaluation.vector_summary(compared).first(), [sum(x) / len(valid) for x in zip(*valid)]
    assert (s.n, s.n_valid, s.loss_a, s.loss_b, s.top1_a, s.top1_b, s.top1_match) == pytest.approx((8, 5, *mean))
    assert (s.loss_increase, s.top1_change) == pytest.approx((mean[1] - mean[0], mean[3] - mean[2]))


def test_long_texts_move_by_digest(spark, monkeypatch):
    """Texts cut into several parts, with letters of one to four bytes: pairs hold no text, and are those of a plain search."""
    monkeypatch.setattr(matching, "PART", 500)
    r = random.Random(8)
    texts = ["".join(r.choice("abcdeé中𝄞 ") for _ in range(3000)) for _ in range(12)] * 2
    patterns = sorted({t[i : i + n] for t in texts[:6] for i in (7, 490, 2990) for n in (1, 3, 4, 9)})
    p, t = spark.createDataFrame([(x,) for x in patterns], "pattern string"), spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    met = matching._looked_up(p, t)
    assert met.columns == ["pattern", "id"]
    pairs, held = {(x.pattern, x.id) for x in met.collect()}, {(x, i) for x in patterns for i, y in enumerate(texts) if x in y}
    assert held <= pairs and len(pairs) == met.count() < len(patterns) * len(texts)
    assert {(x.pattern, x.text) for x in matching.occurrences(p, t).collect()} == {(x, texts[i]) for x, i in held}
