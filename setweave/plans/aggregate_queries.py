"""Queries of joins, aggregations, rankings and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from setweave.functions import tokens as T
from setweave.functions.session import table
from setweave.operators import aggregates as A
from setweave.operators import ranking as K
from setweave.operators import similarity as M
from setweave.operators.baskets import rarest_item
from setweave.plans import relations as X

Q: dict = {}
SQL: dict = {}
#: Decimals kept of computed doubles, so that the order of summing does not show.
D = 4


def query(name: str, sql: str | None = None, **rounded: int):
    """Registers f under name; its double columns are rounded to D decimals (or as given), as its SQL does."""

    def add(f):
        def run(spark, d):
            df = f(spark, d)
            return df.select(*[F.round(c, rounded.get(c, D)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        run.__name__ = name
        Q[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def n_vectors(spark, d) -> int:
    return table(spark, d, "embeddings").count()


@query("e1_activations_with_examples", f"WITH {X.ACTS_SQL} SELECT e.label, feature_id, count(*) AS n, round(avg(activation), 4) AS mean FROM acts JOIN embeddings e ON e.vec_id = example_id AND e.label = acts.label GROUP BY ALL")
def e1(spark, d):
    meta = table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id"), "label")
    return X.acts(spark, d).drop("label").join(meta, "example_id").groupBy("label", "feature_id").agg(F.count(F.lit(1)).alias("n"), F.avg("activation").alias("mean"))


@query("e3_examples_with_properties", "SELECT n_name, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 GROUP BY 1")
def e3(spark, d):
    dim = F.broadcast(table(spark, d, "nation").where("n_regionkey < 3"))
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


_CORR = "SELECT a.feature_id AS a, b.feature_id AS b, count(*) AS n, round(corr(a.activation, b.activation), 4) AS r FROM acts a JOIN acts b USING (example_id) WHERE a.feature_id < b.feature_id"


@query("e4_feature_correlations", f"WITH {X.ACTS_SQL} {_CORR} AND a.activation > 0 AND b.activation > 0 GROUP BY ALL HAVING count(*) >= 10")
def e4(spark, d):
    return M.correlations(X.acts(spark, d).where("activation > 0"), 10)


@query("e5_cross_source_key_join", f"WITH {X.TOKS_SQL}, k AS (SELECT example_id, ctx, activation, string_agg(token, '|' ORDER BY token) AS key FROM toks GROUP BY ALL), m AS (SELECT ctx, key, max(activation) AS a FROM k GROUP BY ALL) SELECT x.key, x.a AS left_max, y.a AS right_max FROM m x JOIN m y USING (key) WHERE x.ctx = 'BUILDING' AND y.ctx = 'MACHINERY'")
def e5(spark, d):
    k = X.toks(spark, d).groupBy("example_id", "ctx", "activation").agg(F.array_join(F.array_sort(F.collect_list("token")), "|").alias("key"))
    m = lambda c, n: k.where(F.col("ctx") == c).groupBy("key").agg(F.max("activation").alias(n))
    return m("BUILDING", "left_max").join(m("MACHINERY", "right_max"), "key")


@query("e6_multiset_containment", f"WITH {X.LINES_SQL}, c AS (SELECT example_id, ctx, tier, family, CAST(floor(ap / 20) AS INT) AS n FROM lines WHERE ap >= 20), need AS (SELECT * FROM c WHERE tier = '1-URGENT'), sz AS (SELECT example_id, count(*) AS z FROM need GROUP BY 1), "
       "hit AS (SELECT need.example_id, c.example_id AS other, count(*) AS z FROM need JOIN c ON c.ctx = need.ctx AND c.family = need.family AND c.n >= need.n AND c.tier = '2-HIGH' GROUP BY ALL) SELECT sz.example_id, count(hit.other) AS n_containing FROM sz LEFT JOIN hit ON hit.example_id = sz.example_id AND hit.z = sz.z GROUP BY 1")
def e6(spark, d):
    """Sets meet by their distinct profiles and the family of a profile that the fewest others hold, so the work follows the profiles that share it."""
    c = X.lines(spark, d).where("ap >= 20").withColumn("n", F.floor(F.col("ap") / 20).cast("int"))
    profile = F.array_sort(F.collect_list(F.struct("family", "n")))
    families = lambda p: F.transform(p, lambda x: x["family"])
    sets = c.groupBy("example_id", "ctx", "tier").agg(profile.alias("p"))
    need = sets.where("tier = '1-URGENT'")
    have = sets.where("tier = '2-HIGH'").groupBy("ctx", "p").agg(F.count(F.lit(1)).alias("times")).withColumn("held", families("p")).withColumn("have", F.map_from_entries("p")).drop("p")
    asked = need.select("ctx", "p", families("p").alias("needed")).distinct()
    rare = rarest_item(asked.select("ctx", "needed").distinct(), have, ["ctx"], "needed", "held").where("_rare is not null")
    fits = F.forall("p", lambda x: F.coalesce(F.try_element_at(F.col("have"), x["family"]), F.lit(0)) >= x["n"])
    met = asked.join(rare, ["ctx", "needed"]).join(have.select("ctx", "have", "times", F.explode("held").alias("_rare")), ["ctx", "_rare"])
    found = met.where(fits).groupBy("ctx", "p").agg(F.sum("times").alias("n_containing"))
    return need.join(found, ["ctx", "p"], "left").select("example_id", F.coalesce("n_containing", F.lit(0)).alias("n_containing"))


@query("e7_full_outer_token_maps", f"WITH {X.TOKS_SQL}, a AS (SELECT token, count(*) AS na FROM toks WHERE ctx = 'BUILDING' GROUP BY 1), b AS (SELECT token, count(*) AS nb FROM toks WHERE ctx = 'FURNITURE' AND level > 6 GROUP BY 1) SELECT token, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (token)")
def e7(spark, d):
    t = X.toks(spark, d)
    a = t.where("ctx = 'BUILDING'").groupBy("token").agg(F.count(F.lit(1)).alias("na"))
    b = t.where("ctx = 'FURNITURE' and level > 6").groupBy("token").agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, "token", "full_outer").na.fill(0)


@query("e8_known_contexts", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def e8(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(known, "o_custkey", "left_semi").select("o_orderkey")


@query("e9_signature_overlap", f"WITH {X.LINES_SQL}, k AS (SELECT example_id, tier, ctx || ':' || string_agg(family, '|' ORDER BY family) AS key FROM lines GROUP BY example_id, tier, ctx) SELECT key IN (SELECT key FROM k WHERE tier < '3') AS overlap, count(*) AS n FROM k WHERE tier >= '3' GROUP BY 1")
def e9(spark, d):
    k = X.lines(spark, d).groupBy("example_id", "tier", "ctx").agg(F.array_join(F.array_sort(F.collect_list("family")), "|").alias("f")).withColumn("key", F.concat_ws(":", "ctx", "f"))
    train, rest = k.where("tier < '3'").select("key").distinct(), k.where("tier >= '3'")
    tag = lambda df, v: df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(v).alias("overlap"), "n")
    return tag(rest.join(train, "key", "left_semi"), True).unionByName(tag(rest.join(train, "key", "left_anti"), False))


@query("e10_unlabelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def e10(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("e11_conflicting_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) > 1 AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def e11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("l_partkey") > 1).alias("conflict")).where("n > 1")


_LABELS = "a AS (SELECT doc_id AS feature_id, 'q' || quality AS dash FROM labels), b AS (SELECT doc_id AS feature_id, lang AS research, CAST(n_chars AS DOUBLE) / 100000 AS confidence FROM documents)"


@query("e12_label_merge", f"WITH {_LABELS} SELECT feature_id, coalesce(dash, research) AS display_name, CASE WHEN dash IS NULL THEN 'research' WHEN research IS NULL THEN 'dashboard' ELSE 'merged' END AS source, round(max(confidence), 6) AS confidence FROM a FULL JOIN b USING (feature_id) GROUP BY ALL", confidence=6)
def e12(spark, d):
    a = table(spark, d, "labels").select(F.col("doc_id").alias("feature_id"), F.concat(F.lit("q"), "quality").alias("dash"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("feature_id"), F.col("lang").alias("research"), (F.col("n_chars") / 100000).alias("confidence"))
    x = a.join(b, "feature_id", "full_outer")
    source = F.when(F.col("dash").isNull(), "research").when(F.col("research").isNull(), "dashboard").otherwise("merged")
    return x.groupBy("feature_id", F.coalesce("dash", "research").alias("display_name"), source.alias("source")).agg(F.max("confidence").alias("confidence"))


@query("f1_feature_stats", f"WITH {X.ACTS_SQL} SELECT feature_id, round(min(activation), 4) AS min, round(max(activation), 4) AS max, round(avg(activation), 4) AS mean, round(quantile_cont(activation, 0.5), 4) AS median, round(stddev_samp(activation), 4) AS std, round(quantile_cont(activation, 0.25), 4) AS q25, round(quantile_cont(activation, 0.75), 4) AS q75, "
       "count(*) FILTER (activation = 0) AS n_zeros, count(*) AS n_total, round(count(*) FILTER (activation = 0) / count(*), 4) AS sparsity FROM acts GROUP BY 1")
def f1(spark, d):
    return A.feature_stats(X.acts(spark, d))


@query("f1b_sketched_quantiles", f"WITH {X.ACTS_SQL} SELECT feature_id, share, count(*) AS n, true AS within FROM acts, (VALUES (0.25), (0.5), (0.75), (0.99)) q(share) GROUP BY ALL", share=2)
def f1b(spark, d):
    """Sketches of each label's activations, merged over labels, against the exact ranks."""
    a = X.acts(spark, d)
    parts = A.quantile_sketches(a.withColumn("_k", F.struct("feature_id", "label")), "_k", "activation")
    q = A.sketch_quantiles(A.merged_sketches(parts.select("_k.feature_id", "n", "sketch"), "feature_id"), "feature_id", (0.25, 0.5, 0.75, 0.99))
    return A.rank_error(q, a, "feature_id", "activation").select("feature_id", "share", "n", (F.col("error") <= A.SKETCH_ERROR).alias("within"))


@query("f2_mergeable_stats", f"WITH {X.ACTS_SQL}, t AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT * FROM acts WHERE activation > 0) SELECT f.feature_id, count(activation) AS n_active, round(coalesce(sum(activation), 0) / n, 4) AS mean, round(sqrt(greatest(coalesce(sum(activation * activation), 0) / n - pow(coalesce(sum(activation), 0) / n, 2), 0)), 4) AS std, "
       "round(CASE WHEN count(activation) < n THEN 0 ELSE min(activation) END, 4) AS min, round(coalesce(max(activation), 0), 4) AS max, round(1 - count(activation) / n, 4) AS sparsity FROM (SELECT unnest(range(70)) AS feature_id) f CROSS JOIN t LEFT JOIN p USING (feature_id) GROUP BY f.feature_id, n")
def f2(spark, d):
    return A.merge_stats(X.acts(spark, d).where("activation > 0"), spark.range(70).select(F.col("id").cast("int").alias("feature_id")), n_vectors(spark, d))


@query("f3_fixed_histogram", f"WITH {X.ACTS_SQL}, b AS (SELECT feature_id, least(CAST(floor((activation + 0.5) / 0.1) AS INT), 9) AS bin_idx, count(*) AS count FROM acts WHERE activation BETWEEN -0.5 AND 0.5 GROUP BY ALL) "
       "SELECT feature_id, bin_idx, round(-0.5 + bin_idx * 0.1, 4) AS lower_bound, round(-0.5 + (bin_idx + 1) * 0.1, 4) AS upper_bound, coalesce(count, 0) AS count FROM (SELECT DISTINCT feature_id FROM acts) CROSS JOIN (SELECT unnest(range(10)) AS bin_idx) LEFT JOIN b USING (feature_id, bin_idx)")
def f3(spark, d):
    return A.fixed_histogram(X.acts(spark, d), -0.5, 0.5, 10)


_RANGE = "b AS (SELECT feature_id, example_id, activation, least(CAST(floor((activation - lo) / ((hi - lo) / 10)) AS INT), 9) AS bin_idx FROM (SELECT *, min(activation) OVER (PARTITION BY feature_id) AS lo, max(activation) OVER (PARTITION BY feature_id) AS hi FROM acts WHERE activation > 0))"


@query("f4_range_histogram", f"WITH {X.ACTS_SQL}, {_RANGE} SELECT feature_id, bin_idx, count(*) AS count FROM b GROUP BY ALL")
def f4(spark, d):
    return A.range_histogram(X.acts(spark, d).where("activation > 0"), 10)


@query("f5_samples_per_bin", f"WITH {X.ACTS_SQL}, {_RANGE}, s AS (SELECT *, row_number() OVER (PARTITION BY feature_id, bin_idx ORDER BY md5(example_id || ':5'), example_id) AS r, count(*) OVER (PARTITION BY feature_id, bin_idx) AS n FROM b) SELECT feature_id, bin_idx, example_id, n FROM s WHERE r <= 5")
def f5(spark, d):
    from setweave.operators.sampling import sample_n_per_group

    a = X.acts(spark, d).where("activation > 0")
    bounds = a.groupBy("feature_id").agg(F.min("activation").alias("lo"), F.max("activation").alias("hi"))
    b = a.join(bounds, "feature_id").withColumn("bin_idx", A.bin_index(F.col("activation"), F.col("lo"), F.col("hi"), 10)).withColumn("g", F.concat_ws("|", "feature_id", "bin_idx"))
    n = b.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return sample_n_per_group(b, 5, "g", "example_id", "5").join(n, "g").select("feature_id", "bin_idx", "example_id", "n")


@query("f6_top_examples_per_bin", f"WITH {X.ACTS_SQL}, {_RANGE} SELECT feature_id, bin_idx, rank, example_id, round(activation, 4) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, bin_idx ORDER BY activation DESC, example_id) AS rank FROM b) WHERE rank <= 3")
def f6(spark, d):
    return A.top_per_bin(X.acts(spark, d).where("activation > 0"), 10, 3)


@query("f7_most_active", f"WITH {X.ACTS_SQL} SELECT feature_id, count(*) FILTER (activation > 0) AS n, round(count(*) FILTER (activation > 0) / count(*), 4) AS rate FROM acts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def f7(spark, d):
    on = F.count_if(F.col("activation") > 0)
    return X.acts(spark, d).groupBy("feature_id").agg(on.alias("n"), (on / F.count(F.lit(1))).alias("rate")).orderBy(F.desc("n"), "feature_id").limit(10)


@query("f8_sparsity_distribution", f"WITH {X.ACTS_SQL}, s AS (SELECT 1 - count(*) FILTER (activation > 0) / (SELECT count(*) FROM embeddings) AS s FROM acts GROUP BY feature_id) SELECT round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS std, round(min(s), 4) AS min, round(max(s), 4) AS max, count(*) FILTER (s > 0.999) AS n_ultra_sparse, count(*) FILTER (s >= 1) AS n_dead, "
       + ", ".join(f"round(quantile_cont(s, {p}), 4) AS p{int(100 * p)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM s")
def f8(spark, d):
    return A.sparsity_distribution(X.acts(spark, d), n_vectors(spark, d))


@query("f9_sparsity_ranking", f"WITH {X.ACTS_SQL}, g AS (SELECT feature_id, count(*) FILTER (abs(activation) > 0.2) / (SELECT count(*) FROM embeddings) AS f, avg(activation) FILTER (abs(activation) > 0.2) AS m FROM acts GROUP BY 1) SELECT feature_id, round(f, 4) AS frac_active, round(m, 4) AS mean_when_active, round(m / sqrt(f), 4) AS score FROM g WHERE f > 0.01 AND f < 0.3 ORDER BY m / sqrt(f) DESC, 1 LIMIT 20")
def f9(spark, d):
    return A.sparsity_ranking(X.acts(spark, d), n_vectors(spark, d), 0.2)


@query("f10_context_profile", f"WITH {X.ACTS_SQL} SELECT feature_id, round(avg(activation), 4) AS mean, round(avg(CASE WHEN activation > 0 THEN 0.0 ELSE 1.0 END), 4) AS sparsity FROM acts WHERE example_id IN (SELECT vec_id FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 30) GROUP BY 1 ORDER BY avg(activation) DESC, 1 LIMIT 10")
def f10(spark, d):
    some = table(spark, d, "embeddings").where("label = 2").orderBy("vec_id").limit(30).select(F.col("vec_id").alias("example_id"))
    g = X.acts(spark, d).join(F.broadcast(some), "example_id").groupBy("feature_id").agg(F.avg("activation").alias("mean"), F.avg((F.col("activation") <= 0).cast("double")).alias("sparsity"))
    return g.orderBy(F.desc("mean"), "feature_id").limit(10)


@query("f11_feature_summary", f"WITH {X.ACTS_SQL}, t AS (SELECT feature_id, label, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, example_id) AS r FROM acts), c AS (SELECT feature_id, label, count(*) AS n FROM t WHERE r <= 100 GROUP BY ALL) SELECT feature_id, label, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY n DESC, label) AS rank FROM c) WHERE rank <= 5")
def f11(spark, d):
    c = K.top_per_group(X.acts(spark, d), "feature_id", 100).groupBy("feature_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return K.top_per_group(c, "feature_id", 5, "n", "label")


@query("f12_shares", "WITH g AS (SELECT 'ctx' AS kind, c_mktsegment AS value, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL SELECT 'tier', o_orderpriority, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL SELECT 'ctx+tier', c_mktsegment || '|' || o_orderpriority, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2) "
       "SELECT kind, value, n, round(n / sum(n) OVER (PARTITION BY kind), 4) AS share, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= 5")
def f12(spark, d):
    return A.shares(X.examples(spark, d), [["ctx"], ["tier"], ["ctx", "tier"]], 5)


_DOSE = """f AS (SELECT DISTINCT family FROM toks), g AS (SELECT f.family, coalesce(t.level, 0) AS level, avg(e.activation) AS m, stddev_samp(e.activation) AS sd, count(*) AS n
  FROM f CROSS JOIN examples e LEFT JOIN toks t ON t.example_id = e.example_id AND t.family = f.family GROUP BY ALL),
dose AS (SELECT *, m - max(m) FILTER (level = 0) OVER (PARTITION BY family) AS delta FROM g)"""


@query("f13_dose_response", f"WITH {X.TOKS_SQL}, {X.EXAMPLES_SQL}, {_DOSE} SELECT family, level, round(m, 2) AS mean, round(sd, 2) AS std, round(sd / sqrt(n), 2) AS stderr, n, round(delta, 2) AS delta FROM dose", mean=2, std=2, stderr=2, delta=2)
def f13(spark, d):
    t = X.toks(spark, d)
    return A.dose_response(X.examples(spark, d), t, [r[0] for r in t.select("family").distinct().collect()])


@query("f13b_sweep_summary", f"WITH {X.TOKS_SQL}, {X.EXAMPLES_SQL}, {_DOSE} SELECT family, round(sum(delta * n) / sum(n), 2) AS mean_delta, round(min(delta), 2) AS min_delta, round(max(delta), 2) AS max_delta, min(level) FILTER (abs(delta) > 5000) AS threshold_level FROM dose WHERE level > 0 GROUP BY 1", mean_delta=2, min_delta=2, max_delta=2)
def f13b(spark, d):
    return A.sweep_summary(f13(spark, d), 5000.0)


@query("f14_dose_grid", f"WITH {X.TOKS_SQL}, {X.EXAMPLES_SQL}, g AS (SELECT coalesce(x.level, 0) AS level_x, coalesce(y.level, 0) AS level_y, avg(e.activation) AS m, stddev_samp(e.activation) AS sd, count(*) AS n FROM examples e LEFT JOIN toks x ON x.example_id = e.example_id AND x.family = 'promo' LEFT JOIN toks y ON y.example_id = e.example_id AND y.family = 'large' GROUP BY ALL) "
       "SELECT level_x, level_y, round(m, 2) AS mean, round(sd, 2) AS std, n, round(sd / sqrt(n), 2) AS stderr, round(m - (SELECT m FROM g WHERE level_x = 0 AND level_y = 0), 2) AS delta FROM g", mean=2, std=2, stderr=2, delta=2)
def f14(spark, d):
    return A.dose_grid(X.examples(spark, d), X.toks(spark, d), "promo", "large")


@query("f15_context_sweep", f"WITH {X.EXAMPLES_SQL}, g AS (SELECT ctx, avg(activation) AS m, stddev_samp(activation) AS sd, count(*) AS n FROM examples GROUP BY 1 HAVING count(*) >= 10), x AS (SELECT *, m - (SELECT avg(activation) FROM examples) AS delta FROM g), r AS (SELECT *, row_number() OVER (ORDER BY delta DESC, ctx) AS r FROM x) "
       "SELECT ctx, round(m, 2) AS mean, round(sd, 2) AS std, n, round(delta, 2) AS delta, abs((SELECT delta FROM r WHERE r = 1)) > 2 * abs((SELECT delta FROM r WHERE r = 2)) AS dominant FROM r WHERE r <= 20", mean=2, std=2, delta=2)
def f15(spark, d):
    return A.context_sweep(X.examples(spark, d), "ctx")


@query("f16_kit_sweep", f"WITH {X.EXAMPLES_SQL} SELECT ctx, tier, round(avg(activation), 2) AS mean, count(*) AS n, grouping(ctx) AS no_ctx, grouping(tier) AS no_tier FROM examples GROUP BY GROUPING SETS ((ctx), (tier), (ctx, tier))", mean=2)
def f16(spark, d):
    sets = [[F.col("ctx")], [F.col("tier")], [F.col("ctx"), F.col("tier")]]
    return X.examples(spark, d).groupingSets(sets, F.col("ctx"), F.col("tier")).agg(F.avg("activation").alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping("ctx").cast("int").alias("no_ctx"), F.grouping("tier").cast("int").alias("no_tier"))


@query("f17_high_low_enrichment", f"WITH {X.EXAMPLES_SQL}, r AS (SELECT tier, row_number() OVER (ORDER BY activation, example_id) - 1 AS r, count(*) OVER () AS n FROM examples), g AS (SELECT tier, count(*) FILTER (r >= floor(n * 0.9)) AS n_high, count(*) FILTER (r < floor(n * 0.1)) AS n_low FROM r GROUP BY 1) "
       "SELECT tier, n_high, n_low, round(n_high / sum(n_high) OVER (), 4) AS pct_high, round(n_low / sum(n_low) OVER (), 4) AS pct_low, round(CASE WHEN n_low > 0 THEN (n_high / sum(n_high) OVER ()) / (n_low / sum(n_low) OVER ()) END, 4) AS ratio FROM g")
def f17(spark, d):
    return A.high_low_enrichment(X.examples(spark, d), "tier", 10)


@query("f18_token_influence", f"WITH {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, c AS (SELECT min(activation) AS cut FROM (SELECT activation FROM examples ORDER BY activation DESC LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1 + 1e-9) AS INT)) FROM examples))), m AS (SELECT example_id, activation AS a, CAST(activation >= cut AS INT) AS h FROM examples, c), "
       "x AS (SELECT t.token, a, h, b.token IS NOT NULL AS has FROM m CROSS JOIN (SELECT DISTINCT token FROM brands) t LEFT JOIN brands b ON b.example_id = m.example_id AND b.token = t.token), "
       "g AS (SELECT token, count(*) FILTER (has) AS n_present, count(*) FILTER (NOT has) AS n_absent, avg(h) FILTER (has) AS hp, avg(h) FILTER (NOT has) AS ha, avg(a) FILTER (has) AS mp, avg(a) FILTER (NOT has) AS ma, var_samp(a) FILTER (has) AS vp, var_pop(a) FILTER (NOT has) AS va FROM x GROUP BY 1), "
       "y AS (SELECT *, CASE WHEN ha > 0 THEN hp / ha WHEN hp > 0 THEN 10 ELSE 1 END AS q, sqrt(((n_present - 1) * vp + n_absent * va) / (n_present + n_absent - 2)) AS s FROM g WHERE n_present >= 50 AND n_absent >= 50) "
       "SELECT token, n_present, n_absent, round(hp, 4) AS rate_present, round(ha, 4) AS rate_absent, round(q, 4) AS ratio, round(mp, 2) AS mean_present, round(ma, 2) AS mean_absent, round(CASE WHEN s > 0 THEN (mp - ma) / s ELSE 0 END, 4) AS cohens_d, CASE WHEN q < 0.8 THEN 'suppressor' WHEN q > 1.2 THEN 'enhancer' ELSE 'neutral' END AS kind FROM y", mean_present=2, mean_absent=2)
def f18(spark, d):
    return A.token_influence(X.examples(spark, d), X.brands(spark, d))


@query("f19_token_enrichment", f"WITH {X.TOKS_SQL}, {X.EXAMPLES_SQL}, c AS (SELECT max(activation) AS cut FROM (SELECT activation FROM examples ORDER BY activation LIMIT (SELECT CAST(floor(0.9 * (count(*) - 1) + 0.5) AS INT) + 1 FROM examples))), g AS (SELECT token, count(*) AS n, count(*) FILTER (activation >= cut) AS n_high FROM toks, c GROUP BY 1), "
       "y AS (SELECT *, n / sum(n) OVER () AS rate, n_high / sum(n_high) OVER () AS rate_high FROM g) SELECT token, n, n_high, round(rate, 4) AS rate, round(rate_high, 4) AS rate_high, round(rate_high / rate, 4) AS ratio, CASE WHEN rate_high / rate > 1.2 THEN 'enhancer' WHEN rate_high / rate < 0.8 THEN 'suppressor' ELSE 'neutral' END AS kind FROM y WHERE rate >= 0.01")
def f19(spark, d):
    return A.token_enrichment(X.examples(spark, d), X.toks(spark, d).select("example_id", "token"))


_HIGH_CUT = "rk AS (SELECT *, row_number() OVER (ORDER BY activation DESC, example_id) - 1 AS r, count(*) OVER () AS n FROM examples), cut AS (SELECT activation AS cut FROM rk WHERE r = least(greatest(1, CAST(floor(n * (1 - CAST(0.9 AS DOUBLE))) AS BIGINT)), n - 1))"


@query("f20_presence_effect", f"WITH {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, {_HIGH_CUT}, h AS (SELECT e.*, activation >= cut AS high FROM examples e, cut), t AS (SELECT count(*) AS tn, sum(activation) AS ts, sum(activation * activation) AS tq, count(*) FILTER (high) AS th FROM h), "
       "g AS (SELECT token, count(*) AS n_with, sum(h.activation) AS s, sum(h.activation * h.activation) AS q, var_samp(h.activation) AS v, count(*) FILTER (high) AS n_high_with FROM brands JOIN h USING (example_id) GROUP BY 1 HAVING count(*) >= 30), "
       "m AS (SELECT *, tn - n_with AS n_without, s / n_with AS mw, (ts - s) / (tn - n_with) AS mo FROM g, t) SELECT token, n_with, n_without, round(mw, 2) AS mean_with, round(mo, 2) AS mean_without, round(mw - mo, 2) AS delta, round((mw - mo) / sqrt((v * n_with + ((tq - q) / n_without - mo * mo) * n_without) / tn), 4) AS effect, "
       "round(n_with / tn, 4) AS baseline_rate, round(n_high_with / th, 4) AS high_rate, round((n_high_with / th) / (n_with / tn), 4) AS enrichment, n_high_with FROM m", mean_with=2, mean_without=2, delta=2)
def f20(spark, d):
    return A.presence_effect(X.examples(spark, d), X.brands(spark, d))


@query("f20b_conditional_presence", f"WITH {X.TOKS_SQL.replace('WITH ', '')}, {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, l AS (SELECT example_id, level FROM toks WHERE family = 'economy'), e AS (SELECT example_id, activation, coalesce(level, 0) AS level FROM examples LEFT JOIN l USING (example_id)), t AS (SELECT level, count(*) AS n_at_level, sum(activation) AS t FROM e WHERE level IN (0, 12, 29, 38) GROUP BY 1), "
       "g AS (SELECT token, e.level AS level, count(*) AS n_with, sum(e.activation) AS s, sum(count(*)) OVER (PARTITION BY token) AS c FROM brands JOIN e USING (example_id) GROUP BY token, e.level) SELECT token, level, round(s / n_with, 2) AS mean_with, round((t - s) / (n_at_level - n_with), 2) AS mean_without, round(s / n_with - (t - s) / (n_at_level - n_with), 2) AS delta, n_with, n_at_level - n_with AS n_without, n_at_level FROM g JOIN t USING (level) WHERE c >= 30 AND n_with >= 5 AND n_at_level - n_with >= 5", mean_with=2, mean_without=2, delta=2)
def f20b(spark, d):
    """Brands among the orders of one level of economy parts."""
    return A.conditional_presence(X.examples(spark, d), X.brands(spark, d), X.toks(spark, d).where("family = 'economy'").select("example_id", "level"), rungs=(0, 12, 29, 38))


_M = "m AS (SELECT quantile_cont(activation, 0.995) AS m FROM examples WHERE activation > 0)"
_BAND = "CASE WHEN activation > 0.90 * m THEN 5 WHEN activation > 0.75 * m THEN 4 WHEN activation > 0.25 * m THEN 3 WHEN activation > 0.10 * m THEN 2 WHEN activation > 0.01 * m THEN 1 WHEN activation > 0 THEN 0 END"


def banded(spark, d):
    from setweave.operators.sampling import band_of

    e = X.examples(spark, d)
    m = K.exact_quantile(e.where("activation > 0"), "activation", "example_id", 0.995, "m")
    return e.join(F.broadcast(m)).withColumn("band", band_of(F.col("activation"), F.col("m")))


@query("f21_region_breakdown", f"WITH {X.TOKS_SQL}, {X.EXAMPLES_SQL}, {_M}, b AS (SELECT example_id, ctx, {_BAND} AS band FROM examples, m), z AS (SELECT band, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM b GROUP BY 1), c AS (SELECT band, 'context' AS kind, ctx AS item, count(*) AS count FROM b WHERE band IS NOT NULL GROUP BY ALL "
       "UNION ALL SELECT band, 'family', family, count(*) FROM toks JOIN b USING (example_id) WHERE band IS NOT NULL GROUP BY ALL) SELECT c.band, n, round(pct, 4) AS pct_of_total, kind, item, count, round(count / sum(count) OVER (PARTITION BY c.band, kind), 4) AS share, row_number() OVER (PARTITION BY c.band, kind ORDER BY count DESC, item) AS rank FROM c JOIN z USING (band) QUALIFY row_number() OVER (PARTITION BY c.band, kind ORDER BY count DESC, item) <= 5")
def f21(spark, d):
    return A.region_breakdown(banded(spark, d), X.toks(spark, d))


@query("f22_region_kit", f"WITH {X.EXAMPLES_SQL}, {_M}, b AS (SELECT ctx, tier FROM examples, m WHERE {_BAND} = 3), c AS (SELECT 'tier' AS kit, tier AS item FROM b UNION ALL SELECT 'ctx', ctx FROM b) SELECT kit, item, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 4) AS pct, row_number() OVER (PARTITION BY kit ORDER BY count(*) DESC, item) AS rank FROM c GROUP BY 1, 2")
def f22(spark, d):
    return A.region_kits(banded(spark, d).where("band = 3"), ["tier", "ctx"])


@query("f23_core_tail_coverage", f"WITH {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, {_M}, f AS (SELECT example_id, CAST(activation > 0.25 * m AND activation <= 0.75 * m AS INT) AS c, CAST(activation > 0.75 * m AS INT) AS t FROM examples, m), g AS (SELECT token, sum(c) / (SELECT sum(c) FROM f) AS pc, sum(t) / (SELECT sum(t) FROM f) AS pt FROM brands JOIN f USING (example_id) GROUP BY 1) "
       "SELECT token, round(pc, 4) AS core_share, round(pt, 4) AS tail_share, round(CASE WHEN pc > 0 THEN least(pt / pc, 10) WHEN pt > 0 THEN 10 ELSE 1 END, 4) AS tail_enrichment, pc < 0.30 AS tail_marker FROM g")
def f23(spark, d):
    return A.core_tail(X.examples(spark, d), X.brands(spark, d), "token")


@query("f23b_context_coverage", f"WITH {X.EXAMPLES_SQL}, x AS (SELECT example_id, 'n' || c_nationkey AS ctx, o_totalprice AS activation FROM orders JOIN customer ON o_custkey = c_custkey JOIN examples ON o_orderkey = example_id), {_M}, f AS (SELECT ctx, CAST(activation > 0.25 * m AND activation <= 0.75 * m AS INT) AS c, CAST(activation > 0.75 * m AS INT) AS t FROM x, m), "
       "g AS (SELECT ctx, sum(c) / (SELECT sum(c) FROM f) AS pc, sum(t) / (SELECT sum(t) FROM f) AS pt FROM f GROUP BY 1), e AS (SELECT *, CASE WHEN pc > 0 THEN least(pt / pc, 10) WHEN pt > 0 THEN 10 ELSE 1 END AS te FROM g) SELECT ctx, round(pc, 4) AS core_share, round(pt, 4) AS tail_share, round(te, 4) AS tail_enrichment, te > 2 AND pt > 0.1 AS flanderized FROM e")
def f23b(spark, d):
    """Nations of the customers as contexts."""
    from setweave.functions.session import table

    nation = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("example_id"), F.concat(F.lit("n"), "c_nationkey").alias("ctx"))
    return A.context_coverage(X.examples(spark, d).drop("ctx").join(nation, "example_id"))


@query("f24_weighted_popularity", f"WITH {X.LINES_SQL} SELECT family, CAST(sum(CAST(floor(greatest(1, activation / 10000)) AS BIGINT)) AS BIGINT) AS weight FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def f24(spark, d):
    w = F.floor(F.greatest(F.lit(1.0), F.col("activation") / 10000))
    return X.lines(spark, d).groupBy("family").agg(F.sum(w).alias("weight")).orderBy(F.desc("weight"), "family").limit(4)


_LEVELS = "lv AS (SELECT DISTINCT l_orderkey AS example_id, lower(p_type) AS family, " + f"CASE {X._STEPS.replace('ap', 'CAST(l_quantity AS INTEGER)')} END AS level FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 3)"
_INTER = "x AS (SELECT {by} h.family, lo, hi, e.activation, l.level IS NOT NULL AS bth FROM lv h JOIN examples e USING (example_id) JOIN (VALUES {pairs}) p(lo, hi) ON h.level = hi LEFT JOIN lv l ON l.example_id = h.example_id AND l.family = h.family AND l.level = lo), g AS (SELECT {by} family, lo, hi, avg(activation) FILTER (NOT bth) AS a, avg(activation) FILTER (bth) AS b, count(*) FILTER (NOT bth) AS n_alone, count(*) FILTER (bth) AS n_both FROM x GROUP BY ALL) " \
    "SELECT {by} family, lo, hi, round(a, 2) AS mean_alone, round(b, 2) AS mean_both, n_alone, n_both, round(b - a, 2) AS delta, CASE WHEN b - a < -0.01 THEN 'reduction' WHEN b - a > 0.01 THEN 'enhancement' ELSE 'neutral' END AS kind FROM g WHERE n_alone >= {least} AND n_both >= {least}"


def line_levels(spark, d):
    """(example_id, family, level): the levels that an order's lines reach, one by one; a family may hold several."""
    from setweave.functions.tokens import level_of

    return X._parts(spark, d, F.lower("p_type").alias("family"), F.col("l_quantity").cast("int").alias("ap")).where("ap >= 3").select("example_id", "family", level_of(F.col("ap")).alias("level")).distinct()


@query("f25_interference", f"WITH {X.EXAMPLES_SQL}, {_LEVELS}, {_INTER.format(by='', pairs='(6, 29), (12, 29), (15, 29), (3, 15)', least=5)}", mean_alone=2, mean_both=2, delta=2)
def f25(spark, d):
    return A.interference(X.examples(spark, d), line_levels(spark, d), [(6, 29), (12, 29), (15, 29), (3, 15)])


@query("f25b_interference_by_context", f"WITH {X.EXAMPLES_SQL}, {_LEVELS}, {_INTER.format(by='ctx,', pairs='(3, 15), (3, 29), (6, 29)', least=3)}", mean_alone=2, mean_both=2, delta=2)
def f25b(spark, d):
    return A.interference(X.examples(spark, d), line_levels(spark, d), [(3, 15), (3, 29), (6, 29)], least=3, by=("ctx",), least_rows=20)


@query("f26_frequent_core_tokens", f"WITH {X.BRANDS_SQL}, top AS (SELECT DISTINCT example_id, activation FROM brands ORDER BY activation DESC, example_id LIMIT 100), f AS (SELECT DISTINCT example_id, substr(token, 1, 7) AS family FROM brands JOIN top USING (example_id)) SELECT family, count(*) / 100 AS frequency FROM f WHERE family <> 'Brand#5' GROUP BY 1 HAVING count(*) >= 50")
def f26(spark, d):
    t = X.brands(spark, d)
    top = t.select("example_id", "activation").distinct().orderBy(F.desc("activation"), "example_id").limit(100).select("example_id")
    families = t.join(F.broadcast(top), "example_id").select("example_id", F.substring("token", 1, 7).alias("family")).distinct()
    return families.where("family <> 'Brand#5'").groupBy("family").agg((F.count(F.lit(1)) / 100).alias("frequency")).where("frequency >= 0.5")


@query("f27_token_stats", f"WITH {X.TOKS_SQL} SELECT family, level, count(DISTINCT example_id) AS n_builds FROM toks GROUP BY ROLLUP (family, level)")
def f27(spark, d):
    return X.toks(spark, d).rollup("family", "level").agg(F.count_distinct("example_id").alias("n_builds"))


@query("f28_aggregate_sweeps", f"WITH {X.TOKS_SQL}, s AS (SELECT ctx, family, level, avg(activation) AS m FROM toks GROUP BY ALL) SELECT family, level, round(avg(m), 2) AS mean, round(quantile_cont(m, 0.5), 2) AS median FROM s GROUP BY ALL", mean=2, median=2)
def f28(spark, d):
    s = X.toks(spark, d).groupBy("ctx", "family", "level").agg(F.avg("activation").alias("m"))
    return s.groupBy("family", "level").agg(F.avg("m").alias("mean"), F.expr("percentile(m, 0.5)").alias("median"))


@query("f29_grouped_deltas", f"WITH {X.EXAMPLES_SQL}, s AS (SELECT ctx, tier, avg(activation) AS m FROM examples GROUP BY ALL) SELECT a.tier, round(avg(a.m - b.m), 2) AS delta FROM s a JOIN s b ON a.ctx = b.ctx AND b.tier = '5-LOW' GROUP BY 1", delta=2)
def f29(spark, d):
    s = X.examples(spark, d).groupBy("ctx", "tier").agg(F.avg("activation").alias("m"))
    base = s.where("tier = '5-LOW'").select("ctx", F.col("m").alias("b"))
    return s.join(base, "ctx").groupBy("tier").agg(F.avg(F.col("m") - F.col("b")).alias("delta"))


@query("f30_family_level_summary", f"WITH {X.TOKS_SQL} SELECT family, CAST(NULL AS INT) AS level, round(avg(activation), 2) AS mean, max(activation) AS max, min(activation) AS min, count(*) AS n FROM toks GROUP BY 1 UNION ALL SELECT NULL, level, round(avg(activation), 2), NULL, NULL, count(*) FROM toks GROUP BY 2", mean=2)
def f30(spark, d):
    t = X.toks(spark, d)
    a = t.groupBy("family").agg(F.avg("activation").alias("mean"), F.max("activation").alias("max"), F.min("activation").alias("min"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(t.groupBy("level").agg(F.avg("activation").alias("mean"), F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


@query("f31_label_statistics", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 1 AND toxic = 1) AS n_both FROM labels")
def f31(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, d, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(q).alias("n_good"), F.count_if(t).alias("n_toxic"), F.count_if(q & t).alias("n_both"))


@query("f32_token_means", f"WITH {X.BRANDS_SQL}, g AS (SELECT token, avg(activation) AS m FROM brands GROUP BY 1) SELECT token, round(m, 2) AS mean, CASE WHEN row_number() OVER (ORDER BY m DESC, token) <= 5 THEN 'top' ELSE 'bottom' END AS side FROM g QUALIFY row_number() OVER (ORDER BY m DESC, token) <= 5 OR row_number() OVER (ORDER BY m, token) <= 5", mean=2)
def f32(spark, d):
    g = X.brands(spark, d).groupBy("token").agg(F.avg("activation").alias("mean"))
    return g.orderBy(F.desc("mean"), "token").limit(5).withColumn("side", F.lit("top")).unionByName(g.orderBy("mean", "token").limit(5).withColumn("side", F.lit("bottom")))


@query("f33_range_summary", f"WITH {X.EXAMPLES_SQL}, x AS (SELECT * FROM examples WHERE activation BETWEEN 100000 AND 200000), r AS (SELECT *, row_number() OVER (ORDER BY activation, example_id) AS r, count(*) OVER () AS n FROM x) SELECT example_id, activation, round((SELECT quantile_cont(activation, 0.5) FROM x), 4) AS median FROM r WHERE r IN (1, 1 + n // 4, 1 + n // 2, 1 + 3 * n // 4, n)")
def f33(spark, d):
    x = X.examples(spark, d).where("activation between 100000 and 200000")
    n = x.count()
    picks = sorted({1, 1 + n // 4, 1 + n // 2, 1 + 3 * n // 4, n})
    m = K.exact_quantile(x, "activation", "example_id", 0.5, "median")
    return K.global_rank(x, "activation", "example_id").where(F.col("rank").isin(picks)).join(F.broadcast(m)).select("example_id", "activation", "median")


@query("f33b_range_shares", f"WITH {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, m AS (SELECT min(activation) AS lo, max(activation) AS hi FROM examples), i AS (SELECT example_id, ctx FROM examples, m WHERE activation BETWEEN lo + 0.5 * (hi - lo) AND lo + 0.75 * (hi - lo)), c AS (SELECT 'token' AS kind, token AS item, count(*) AS count FROM brands WHERE example_id IN (SELECT example_id FROM i) GROUP BY 2 UNION ALL SELECT 'context', ctx, count(*) FROM i GROUP BY 2), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, item) AS rank FROM c) SELECT kind, rank, item, count, round(100.0 * count / (SELECT count(*) FROM i), 4) AS pct FROM r WHERE rank <= CASE kind WHEN 'token' THEN 15 ELSE 10 END")
def f33b(spark, d):
    return A.range_shares(X.examples(spark, d), X.brands(spark, d), 0.5, 0.75)


@query("f35_slots_to_maps", "SELECT o_orderkey, sum(CASE WHEN l_linenumber = 1 THEN 10 ELSE 3 END) AS ap, count(DISTINCT lower(p_type)) AS n_families FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def f35(spark, d):
    from setweave.operators.reshape import long_to_map

    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", F.lower("p_type").alias("family"), F.when(F.col("l_linenumber") == 1, T.MAIN).otherwise(T.SUB).alias("ap"))
    m = long_to_map(rows, ["o_orderkey"])
    return m.select("o_orderkey", F.aggregate(F.map_values("points"), F.lit(0).cast("long"), lambda a, x: a + x).alias("ap"), F.size("points").cast("long").alias("n_families"))


@query("f36_context_priors", f"WITH {X.LINES_SQL}, n AS (SELECT ctx, count(DISTINCT example_id) AS n FROM lines GROUP BY 1), c AS (SELECT ctx, family, count(*) AS c FROM lines GROUP BY ALL), g AS (SELECT family, count(*) AS g FROM lines GROUP BY 1) SELECT ctx, family, round(0.7 * c / n + 0.3 * g / (SELECT count(DISTINCT example_id) FROM lines), 4) AS prior FROM c JOIN n USING (ctx) JOIN g USING (family)")
def f36(spark, d):
    from setweave.operators.baskets import priors

    return priors(X.lines(spark, d), "ctx", "family", 0.7)


@query("f37_summary_stats", "SELECT round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.5), 4) AS median, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer")
def f37(spark, d):
    return table(spark, d, "customer").agg(F.avg("c_acctbal").alias("mean"), F.expr("percentile(c_acctbal, 0.5)").alias("median"), F.min("c_acctbal").alias("min"), F.max("c_acctbal").alias("max"))


@query("f40_active_counts", f"WITH {X.ACTS_SQL}, c AS (SELECT example_id, count(*) FILTER (abs(activation) > 0.1) AS n FROM acts GROUP BY 1) SELECT n, count(*) AS examples FROM c GROUP BY 1")
def f40(spark, d):
    return X.acts(spark, d).groupBy("example_id").agg(F.count_if(F.abs("activation") > 0.1).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("examples"))


@query("g1_top_per_feature", f"WITH {X.ACTS_SQL} SELECT feature_id, example_id, round(activation, 4) AS activation, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, example_id) AS rank FROM acts WHERE activation > 0.1) WHERE rank <= 10")
def g1(spark, d):
    return K.top_per_group(X.acts(spark, d), "feature_id", 10, least=0.1).select("feature_id", "example_id", "activation", "rank")


@query("g2_top_of_feature", f"WITH {X.ACTS_SQL} SELECT example_id, round(activation, 4) AS activation FROM acts WHERE feature_id = 7 ORDER BY acts.activation DESC, example_id LIMIT 25")
def g2(spark, d):
    return X.acts(spark, d).where("feature_id = 7").orderBy(F.desc("activation"), "example_id").limit(25).select("example_id", "activation")


@query("g3_top_of_example", f"WITH {X.ACTS_SQL} SELECT example_id, feature_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY activation DESC, feature_id) AS rank FROM acts) WHERE rank <= 5")
def g3(spark, d):
    return K.top_per_group(X.acts(spark, d), "example_id", 5, "activation", "feature_id").select("example_id", "feature_id", "rank")


@query("g4_top_both_signs", f"WITH {X.ACTS_SQL} SELECT feature_id, sign, rank, example_id, round(activation, 4) AS activation FROM (SELECT *, CASE WHEN activation > 0 THEN '+' ELSE '-' END AS sign, row_number() OVER (PARTITION BY feature_id, activation > 0 ORDER BY abs(activation) DESC, example_id) AS rank FROM acts WHERE activation <> 0) WHERE rank <= 5")
def g4(spark, d):
    return K.top_and_bottom(X.acts(spark, d), "feature_id", 5, "activation", "example_id")


@query("g5_suppressed_top", f"WITH {X.ACTS_SQL} SELECT example_id, round(activation, 4) AS activation FROM acts WHERE feature_id = 3 AND activation < 0 ORDER BY acts.activation, example_id LIMIT 10")
def g5(spark, d):
    return X.acts(spark, d).where("feature_id = 3 and activation < 0").orderBy("activation", "example_id").limit(10).select("example_id", "activation")


@query("g6_percentile_rank", f"WITH {X.ACTS_SQL} SELECT feature_id, example_id, round(100.0 * (rank() OVER (PARTITION BY feature_id ORDER BY abs(activation)) - 1) / count(*) OVER (PARTITION BY feature_id), 4) AS pct FROM acts")
def g6(spark, d):
    return K.percentile_rank(X.acts(spark, d), "feature_id", "activation").select("feature_id", "example_id", "pct")


@query("g7_spearman", f"WITH {X.EXAMPLES_SQL}, l AS (SELECT l_orderkey AS example_id, sum(l_quantity) AS q FROM lineitem GROUP BY 1), x AS (SELECT ctx, activation, q, row_number() OVER (PARTITION BY ctx ORDER BY activation, example_id) AS ra, row_number() OVER (PARTITION BY ctx ORDER BY q, example_id) AS rq FROM examples JOIN l USING (example_id)) SELECT ctx, round(corr(activation, q), 4) AS pearson, round(corr(ra, rq), 4) AS spearman, count(*) AS n FROM x GROUP BY 1")
def g7(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("example_id")).agg(F.sum("l_quantity").alias("q"))
    return K.spearman(X.examples(spark, d).join(q, "example_id"), ["ctx"], "activation", "q", "example_id")


@query("g8_extreme_slices", "WITH c AS (SELECT c_nationkey AS k, count(*) AS n, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, k) AS r, count(*) OVER () AS t FROM c), s AS (SELECT *, CASE WHEN r <= ceil(t * 0.2) THEN 'bottom' WHEN r > t - ceil(t * 0.2) THEN 'top' END AS side FROM r) "
       "SELECT side, count(*) AS n, round(avg(m), 2) AS mean, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS members FROM s WHERE side IS NOT NULL GROUP BY 1", mean=2)
def g8(spark, d):
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.avg("o_totalprice").alias("m"))
    return K.extreme_slices(c, "c", "m", "k", 0.2)


@query("g9_top_share", f"WITH {X.EXAMPLES_SQL} SELECT ctx, example_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY activation DESC, example_id) AS rank, count(*) OVER (PARTITION BY ctx) AS n FROM examples) WHERE rank <= ceil(n * 0.02)")
def g9(spark, d):
    return K.top_share_or_count(X.examples(spark, d), "ctx", "2pct").select("ctx", "example_id", "rank")


@query("g10_priority", "WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, n / max(n) OVER () AS priority FROM g) SELECT l_suppkey, n, round(priority, 4) AS priority FROM p WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) ORDER BY p.priority DESC, 1 LIMIT 15")
def g10(spark, d):
    done = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return K.priority(table(spark, d, "lineitem"), done, "l_suppkey", 15)


@query("g11_cluster_sizes", "SELECT label, n, rank() OVER (ORDER BY n DESC) AS rank FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def g11(spark, d):
    from pyspark.sql import Window

    g = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))))


@query("h1_union_by_name", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def h1(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("extra"))
    return a.unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), allowMissingColumns=True)


_MEMBERS = "m AS (SELECT DISTINCT example_id, feature_id FROM acts WHERE activation > 0.1 AND feature_id < 4)"


@query("h2_n_way_overlap", f"WITH {X.ACTS_SQL}, {_MEMBERS}, g AS (SELECT example_id, count(*) AS c, min(feature_id) AS lone FROM m GROUP BY 1) SELECT CASE WHEN c = 4 THEN 'shared' ELSE 'unique:' || lone END AS kind, count(*) AS n FROM g WHERE c IN (1, 4) GROUP BY 1")
def h2(spark, d):
    return M.n_way_overlap(X.acts(spark, d).where("activation > 0.1 and feature_id < 4"), "example_id", "feature_id")


@query("h3_pairwise_overlap", f"WITH {X.ACTS_SQL}, m AS (SELECT DISTINCT example_id, feature_id FROM acts WHERE activation > 0.1) SELECT x.feature_id AS a, y.feature_id AS b, count(*) AS n FROM m x JOIN m y USING (example_id) GROUP BY ALL")
def h3(spark, d):
    return M.overlap_counts(X.acts(spark, d).where("activation > 0.1"), "example_id", "feature_id")


@query("h4_multiset_difference", "SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1")
def h4(spark, d):
    t = table(spark, d, "lineitem")
    return t.where("l_returnflag = 'R'").select("l_partkey").exceptAll(t.where("l_returnflag = 'A'").select("l_partkey")).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("h4b_multiset_intersection", "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1")
def h4b(spark, d):
    t = table(spark, d, "lineitem")
    return t.where("l_returnflag = 'R'").select("l_suppkey").intersectAll(t.where("l_returnflag = 'A'").select("l_suppkey")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


_TOP10 = "t AS (SELECT feature_id, example_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, example_id) AS r FROM acts) WHERE r <= 30)"


@query("h5_compare_top_sets", f"WITH {X.ACTS_SQL}, {_TOP10} SELECT a.feature_id AS a, b.feature_id AS b, count(*) AS n_both, 60 - 2 * count(*) AS n_only, round(count(*) / (60 - count(*)), 4) AS jaccard FROM t a JOIN t b USING (example_id) WHERE a.feature_id < b.feature_id GROUP BY ALL")
def h5(spark, d):
    t = K.top_per_group(X.acts(spark, d), "feature_id", 30)
    both = M.overlap_counts(t, "example_id", "feature_id").where("a < b")
    n = F.col("n")
    return both.select("a", "b", n.alias("n_both"), (60 - 2 * n).alias("n_only"), (n / (60 - n)).alias("jaccard"))


@query("h6_membership_counts", f"WITH {X.ACTS_SQL}, {_TOP10}, a AS (SELECT example_id FROM t WHERE feature_id = 1), b AS (SELECT example_id FROM t WHERE feature_id = 2) SELECT count(*) FILTER (a.example_id IS NOT NULL AND b.example_id IS NOT NULL) AS both, count(*) FILTER (b.example_id IS NULL) AS only_a, count(*) FILTER (a.example_id IS NULL) AS only_b FROM a FULL JOIN b USING (example_id)")
def h6(spark, d):
    t = K.top_per_group(X.acts(spark, d).where("feature_id in (1, 2)"), "feature_id", 30)
    side = lambda f, c: t.where(F.col("feature_id") == f).select("example_id", F.lit(True).alias(c))
    x = side(1, "a").join(side(2, "b"), "example_id", "full_outer")
    return x.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


@query("h7_distinct", f"WITH {X.TOKS_SQL} SELECT DISTINCT ctx, token FROM toks")
def h7(spark, d):
    return X.toks(spark, d).select("ctx", "token").distinct()
