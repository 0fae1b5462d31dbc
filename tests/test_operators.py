"""Hand-checked cases of the operators."""

import pytest
from pyspark.sql import functions as F

from setweave.functions import tokens as T
from setweave.operators import aggregates, baskets, evaluation, graph, information, ranking, reshape, sampling, similarity
from setweave.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ACTS = [(0, 0, .95), (0, 1, .10), (1, 0, .05), (1, 1, .88), (1, 2, .50), (2, 0, .60), (2, 2, .75), (3, 1, .30), (3, 2, .02)]


@pytest.fixture
def acts(spark):
    return frame(spark, ACTS, "example_id int, feature_id int, activation double")


def test_top_orders(acts):
    got = {}
    for r in ranking.top_per_group(acts, "feature_id", 3).orderBy("feature_id", "rank").collect():
        got.setdefault(r.feature_id, []).append(r.example_id)
    assert got == {0: [0, 2, 1], 1: [1, 3, 0], 2: [2, 1, 3]}


def test_feature_stats(acts):
    r = {r.feature_id: r for r in aggregates.feature_stats(acts, 4).collect()}
    assert r[0].n_zeros == 1 and r[0].sparsity == 0.25 and r[0].median == 0.6 and r[1].max == 0.88


def test_histogram_edges(spark):
    df = frame(spark, [(0, i, v) for i, v in enumerate((0.0, 0.1, 9.95, 10.0, 10.1, -1.0))], "feature_id int, example_id int, activation double")
    got = {r.bin_idx: r["count"] for r in aggregates.fixed_histogram(df, 0.0, 10.0, 100).where("count > 0").collect()}
    assert got == {0: 1, 1: 1, 99: 2}


def test_match_log_melt(spark):
    slots = [f"{t}{i}" for t in "AB" for i in range(1, 5)]
    row = {**{f"{s}-weapon": f"{s}_w" for s in slots}, **{f"{s}-abilities": f"{s}_abilities" for s in slots}, "period": 1, "game-ver": "1.0", "lobby": "open", "mode": "sz", "win": "A"}
    df = spark.createDataFrame([row])
    out = reshape.melt_groups(df, {s: [int(s[1]), s[0]] for s in slots}, ["player_no", "team"], ["weapon", "abilities"], ["period", "game-ver", "lobby", "mode", "win"])
    assert out.count() == 8 and set(out.columns) == {"weapon", "abilities", "player_no", "team", "period", "game-ver", "lobby", "mode", "win"}
    names = spark.createDataFrame([(f"{s}_w", str(i)) for i, s in enumerate(slots)], "weapon string, weapon_id string")
    d = reshape.derive_player_columns(out, names)
    assert {(r.team, r.win) for r in d.select("team", "win").collect()} == {("A", True), ("B", False)}


def test_tokens(spark):
    df = frame(spark, [("ninja_squid",), ("ink_saver_main_3",), ("invalid_token",)], "token string")
    got = {r.token: (r.f, r.l) for r in df.select("token", T.family_of(F.col("token")).alias("f"), T.level_in(F.col("token")).alias("l")).collect()}
    assert got == {"ninja_squid": ("ninja_squid", None), "ink_saver_main_3": ("ink_saver_main", 3), "invalid_token": ("invalid_token", None)}
    m = frame(spark, [({"swim": 12, "squid": 10, "jump": 2},), ({},)], "ap map<string,int>")
    rows = m.select(T.cumulative_tags(F.col("ap"), ["jump", "squid", "swim"], ["squid"]).alias("c"), T.capstone_tags(F.col("ap"), ["squid"]).alias("k")).collect()
    assert rows[0].c == ["squid", "swim_3", "swim_6", "swim_12"] and rows[0].k == ["squid", "swim_12"] and rows[1].k == [T.NULL]


@pytest.mark.parametrize("ap,want", [(57, (3, 9)), (10, (1, 0)), (3, (0, 1)), (0, (0, 0)), (1, None), (13, (1, 1))])
def test_slots(spark, ap, want):
    s = spark.range(1).select(T.slots(F.lit(ap)).alias("s")).first().s
    assert (s and (s.mains, s.subs)) == want


def test_vocabulary_grows_stably(spark):
    t = frame(spark, [("comeback", 0), ("ninja_squid", 1), ("stealth_jump", 2), ("comeback", 3)], "token string, first_seen int")
    empty = frame(spark, [], "token string, token_id int")
    v = reshape.extend_vocabulary(t, empty)
    assert {r.token: r.token_id for r in v.collect()} == {"comeback": 0, "ninja_squid": 1, "stealth_jump": 2, T.PAD: 3}
    w = reshape.extend_vocabulary(t, v)
    assert sorted(w.collect()) == sorted(v.collect())
    more = reshape.extend_vocabulary(frame(spark, [("zeta", 0)], "token string, first_seen int"), v)
    assert {r.token: r.token_id for r in more.collect()} == {"comeback": 0, "ninja_squid": 1, "stealth_jump": 2, "zeta": 3, T.PAD: 4}


def test_split_sizes(spark):
    s = sampling.split(spark.range(10), "id", 0.1, 0.2, "s")
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 7, "val": 1, "test": 2}


def test_masking(spark):
    df = frame(spark, [(1, ["a", "b", "c"]), (2, ["d"])], "example_id int, tokens array<string>")
    rows = sampling.masked_instances(df, 4).collect()
    assert len(rows) == 8 and all(set(r.observed) < set(r.target) for r in rows)


def test_multi_hot_and_padding(spark):
    df = frame(spark, [(1, [1, 2, 0]), (1, [2, 3, 3, 3])], "b int, ids array<int>")
    assert [r.h for r in df.select(reshape.multi_hot(F.col("ids"), 4, 0).alias("h")).collect()] == [[0, 1, 1, 0], [0, 0, 1, 1]]
    assert sorted((r.ids, r["mask"]) for r in reshape.padded(df, "b", "ids", 99).collect())[0] == ([1, 2, 0, 99], [False, False, False, True])


def test_violations(spark):
    b = frame(spark, [(1, "a", 60, 2, "head"), (2, "a", 10, 10, "head"), (3, "a", -1, 0, "shoes"), (4, "a", 3, 1, "head"), (4, "a", 3, 1, "head"), (5, "a", 3, 1, "head")], "build_id int, family string, ap int, subs int, slot string")
    got = {(r.build_id, r.rule) for r in reshape.violations(b, frame(spark, [("a", "head")], "family string, slot string")).collect()}
    assert got == {(1, "total"), (2, "sub slots"), (3, "negative"), (3, "wrong slot"), (4, "family twice")}


def test_pagerank_keeps_isolated_and_loses_dangling(spark):
    e = frame(spark, [("a", "b", 1.0)], "src string, dst string, w double")
    n = frame(spark, [("a",), ("b",), ("c",)], "node string")
    got = {r.node: round(r.score, 6) for r in graph.pagerank(e, n, tolerance=1e-9).collect()}
    assert got == {"a": 0.05, "b": round(0.05 + 0.85 * 0.05, 6), "c": 0.05}


def test_information(spark):
    p = frame(spark, [("x", "a", .5), ("x", "b", .5), ("y", "c", 1.0)], "g string, o string, p double")
    assert {r.g: r.entropy for r in information.entropy(p, ["g"]).collect()} == {"x": 1.0, "y": 0.0}
    q = frame(spark, [("x", "a", .5), ("x", "b", .5), ("y", "a", 1.0)], "g string, o string, p double")
    assert abs(information.jensen_shannon(q, "g", "o").first().js - 0.311278) < 1e-6


def test_completion_metrics(spark):
    of = lambda rows: frame(spark, rows, "k int, item string, n int")
    t, o, p = of([(1, "a", 2), (1, "b", 1)]), of([(1, "a", 1)]), of([(1, "a", 2), (1, "c", 1)])
    r = evaluation.completion(t, o, p, "k", "item").first()
    assert (r.slot_accuracy, r.observed_recall, r.violation) == (0.5, 1.0, 0)
    c = evaluation.compare(t, p, "k", "item", "n").first()
    assert (c.both, c.missing, c.extra, c.exact_hit) == (2, 1, 1, 0)


def test_paired_tests_of_equal_columns(spark):
    df = frame(spark, [(1, 2.0, 2.0), (1, 3.0, 3.0)], "g int, a double, b double")
    r = evaluation.paired_stats(df, ["g"], "a", "b").first()
    assert (r.mean_diff, r.t, r.effect) == (0.0, 0.0, 0.0)
    z = evaluation.p_values(evaluation.wilcoxon(df, ["g"], "a", "b")).first()
    assert z.w_plus == 1.5 and abs(z.p - 1) < 1e-9


def test_dense_clusters(spark):
    pts = [(i, i * 0.01, 0.0) for i in range(6)] + [(10 + i, 5 + i * 0.01, 1.0) for i in range(5)] + [(99, 50.0, 50.0)]
    got = {r.k: r.cluster for r in similarity.dense_clusters(frame(spark, pts, "k int, x double, y double"), "k", ["x", "y"], 0.5, 5).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{10 + i: 10 for i in range(5)}, 99: -1}


def test_itemsets(spark):
    df = frame(spark, [(["a", "b"], True), (["a", "b"], True), (["a"], False), (["a", "b"], False), (["b"], False)], "tokens array<string>, high boolean")
    r = baskets.itemset_lift(df, 2, 0.5, 10).first()
    assert (r.itemset, r.n_high, r.n_base, r.lift) == ("a|b", 2, 1, 3.0)


def test_itemsets_of_four_conditioned_and_by_family(spark):
    rows = [(["a_1", "b_1", "c_2", "d_1", "x"], True)] * 3 + [(["a_2", "b_1", "x"], False), (["x"], True), (["a_1"], True)]
    df = frame(spark, rows, "tokens array<string>, high boolean")
    sets = baskets.collapsed(baskets.conditioned(df, "x"), lambda t: F.substring_index(t, "_", 1))
    got = {r.itemset: (r.n_high, r.n_base, r.lift) for r in baskets.itemset_lift(sets, (2, 3, 4), 0.5, 50).collect()}
    assert got["a|b|c|d"] == (3, 0, 999.0) and got["a|b"] == (3, 1, 1.0) and len(got) == 6 + 4 + 1
    with pytest.raises(ValueError):
        baskets.subsets(F.col("tokens"), 5)


def test_mode_completion_keeps_and_fills(spark):
    refs = frame(spark, [("w", ["a", "a", "b"])] * 3 + [("w", ["a", "b", "b", "c"])] * 2 + [("w", ["c", "d"])], "ctx string, full array<string>")
    cases = frame(spark, [(1, "w", ["a"]), (2, "w", ["b", "b"]), (3, "w", ["z"]), (4, "w", ["a", "a", "a"]), (5, "w", []), (6, "v", ["a"]), (7, "w", ["a"])], "example_id int, ctx string, observed array<string>")
    got = {r.example_id: r.completed for r in baskets.mode_completion(cases, refs, 5).collect()}
    assert got == {1: "a|a|a|b|b", 2: "a|b|b|b|c", 3: "a|a|a|b|z", 4: "a|a|a|a|b", 5: "a|a|a|a|b", 6: None, 7: "a|a|a|b|b"}


def test_nearest_jaccard_without_common_items(spark):
    refs = frame(spark, [(1, "w", "a"), (1, "w", "b"), (2, "w", "c")], "example_id int, ctx string, family string")
    sets = frame(spark, [(8, "w", "a"), (8, "w", "c"), (9, "w", "z")], "example_id int, ctx string, family string")
    assert {r.example_id: round(r.nearest, 4) for r in baskets.nearest_jaccard(sets, refs).collect()} == {8: 0.5, 9: 0.0}


def test_bootstrap_covers_the_spread_of_the_mean(spark):
    df = spark.range(2000).selectExpr("id", "cast(id * 7919 % 2000 as double) as v")
    r = evaluation.bootstrap_mean(df, "v", "id", 400, "s").first()
    half = 1.96 * 577.5 / 2000**0.5  # of a uniform spread
    assert r.mean == 999.5 and abs(r.ci_high - r.ci_low - 2 * half) < 0.25 * half and r.ci_low < 999.5 < r.ci_high
    d = evaluation.bootstrap_mean_diff(df.withColumn("w", F.col("v") - 3), "v", "w", "id", 50, "s").first()
    assert (d.mean, d.ci_low, d.ci_high) == (3.0, 3.0, 3.0)


def test_student_tail():
    for t, df, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (1.0, 1, 0.5), (2.0, 2, 0.18350342), (0.1, 300, 0.92041169), (9.0, 5, 0.00028110)):
        assert abs(evaluation.student_p(t, df) - p) < 1e-4


def test_wilcoxon_ties(spark):
    df = frame(spark, [(1, float(x), 0.0) for x in (1, 1, -1, 2, 0, 0, 3)], "g int, a double, b double")
    r = evaluation.wilcoxon(df, ["g"], "a", "b").first()
    assert (r.n, r.w_plus) == (7, 1.5 + 4 + 4 + 6 + 7) and abs(r.z - (22.5 - 14) / (35 - (6 + 24) / 48) ** 0.5) < 1e-9


def test_ranks_within_groups_of_any_size(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 10 = 0, 'b', if(id % 7 = 0, null, 'a')) as g", "cast(id * 37 % 101 as double) as v")
    want = {}
    for g in ("a", "b", None):
        rows = sorted(((-r.v, r.id) for r in df.collect() if r.g == g))
        want.update({i: (n + 1, len(rows)) for n, (_, i) in enumerate(rows)})
    got = {r.id: (r.r, r.n) for r in ranking.rank_within(df, ["g"], "v", "id", "r", "n", descending=True).collect()}
    assert got == want


def test_ranks_of_a_value_that_most_rows_share(spark):
    df = spark.range(4000).selectExpr("id * 7919 % 4001 as id", "if(id % 3 = 0, cast(id % 50 as double), 7.0) as v", "'g' as g")
    for down in (False, True):
        want = [i for _, i in sorted(((-r.v if down else r.v), r.id) for r in df.collect())]
        got = ranking.rank_within(df, ["g"], "v", "id", "r", descending=down)
        assert [r.id for r in got.orderBy("r").collect()] == want
        sizes = df.withColumn("s", ranking.slices_of(df, "v", "id", down)).groupBy("s").count().agg(F.max("count")).first()[0]
        assert sizes < 400


def test_usage_is_a_fold_of_batches(spark):
    from setweave.streaming import streams

    rows = [(1, t, t, float(t * t % 7)) for t in range(10)] + [(2, 3, 3, 5.0)]
    df = frame(spark, rows, "k int, t int, i int, v double")
    first = streams.usage_merge(None, df.where("t < 4"), "k", "t", "i", "v")
    second = streams.usage_merge(first, df.where("t >= 4"), "k", "t", "i", "v")
    want = 0.0
    for _, _, _, v in rows[:10]:
        want = 0.99 * want + 0.01 * v
    got = {r.k: (round(r.usage, 12), r.n) for r in second.collect()}
    assert got == {1: (round(want, 12), 10), 2: (0.05, 1)}


def test_empty_csv_mark(spark):
    e = frame(spark, [], "ts timestamp")
    assert files.high_water_mark(e, "ts") is None and files.newer_than(e, "ts", None).count() == 0


def test_global_rank_and_quantile(spark):
    df = spark.range(1000).selectExpr("id", "cast(id * 37 % 101 as double) as v")
    want = sorted((r.v, r.id) for r in df.collect())
    got = sorted((r["rank"], r.v, r.id) for r in ranking.global_rank(df, "v", "id").collect())
    assert [(v, i) for _, v, i in got] == want and [r for r, _, _ in got] == list(range(1, 1001))
    assert ranking.exact_quantile(df, "v", "id", 0.995, "q").first().q == df.agg(F.expr("percentile(v, 0.995)")).first()[0]
    assert ranking.exact_quantile(df.limit(0), "v", "id", 0.5, "q").first().q is None


def test_rebalance_reaches_the_target(spark):
    df = spark.range(100).selectExpr("id", "'g' as g", "id < 30 as won")
    rows = sampling.rebalance(df, "g", "won", "id", 0.6, "s").collect()
    assert sum(r.won for r in rows) == 30 and len(rows) == 50


@pytest.mark.parametrize("hot", [0, 900])
def test_rows_at_ranks(spark, monkeypatch, hot):
    df = spark.range(1000).selectExpr("id", f"case when id < {hot} then 5.0 when id = 999 then null else cast(id * 37 % 101 as double) end as v")
    want = sorted((r.v, r.id) for r in df.collect() if r.v is not None)
    for rows in (10**6, 3):  # small slices: the rows between the quantiles are ranked by slices as well
        monkeypatch.setattr(ranking, "SLICE_ROWS", rows)
        for first, last in ((1, 1), (1, 30), (500, 501), (999, 999), (640, 700)):
            got = sorted((r["_rank"], r.v, r.id) for r in ranking.rows_at_ranks(df, "v", "id", first, last, 999).collect())
            assert got == [(first + i, *x) for i, x in enumerate(want[first - 1 : last])]


def test_sketches_merge_within_their_error(spark):
    """Skewed values in parts of very different sizes, merged in two steps."""
    df = spark.range(60_000).selectExpr("id", "case when id % 3 = 0 then 'a' else 'b' end as g", "case when id % 5 = 0 then 1.0 else pow(id * 7919 % 60000, 3) end as v", "case when id < 100 then 0 when id < 5000 then 1 else id % 3 + 2 end as part")
    parts = [aggregates.quantile_sketches(df.where(f"part = {i}"), "g", "v") for i in range(5)]
    two = aggregates.merged_sketches(parts[0].unionByName(parts[1]), "g")
    whole = aggregates.merged_sketches(two.unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]), "g")
    shares = (0.01, 0.1, 0.5, 0.9, 0.999)
    got = aggregates.rank_error(aggregates.sketch_quantiles(whole, "g", shares), df, "g", "v").collect()
    assert len(got) == 10 and {r.n for r in got} == {20_000, 40_000}
    assert max(r.error for r in got) <= aggregates.SKETCH_ERROR
    assert whole.select(F.max(F.length("sketch"))).first()[0] < 60_000  # against 320,000 bytes of values


@pytest.mark.parametrize("n", [0, 1, 64, 65, 200, 4095])
def test_slices_of_many_bounds(spark, n):
    bounds = [i * 1.5 for i in range(n)]
    values = [-1.0, 0.0, 0.1, 1.5, 95.0, 96.0, 97.5, 1e9, *[i * 1.5 + 0.5 for i in range(0, n, 7)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(ranking._slice_of(F.col("v"), bounds).alias("s")).collect()] == [sum(b < v for b in bounds) for v in values]
