"""Queries of reshaping, tokenization, filters, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from setweave.functions import tokens as T
from setweave.functions.session import table
from setweave.operators import matching as J
from setweave.operators import reshape as R
from setweave.operators import sampling as S
from setweave.operators.ranking import exact_quantile
from setweave.plans import relations as X

FAMILIES = ["economy", "large", "medium", "promo", "small", "standard"]
BINARY = ["promo", "small"]
Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CUM = " || ".join(
    (f"CASE WHEN coalesce(max(ap) FILTER (family = '{f}'), 0) > 0 THEN ' {f}' ELSE '' END" if f in BINARY else
     " || ".join(f"CASE WHEN coalesce(max(ap) FILTER (family = '{f}'), 0) >= {t} THEN ' {f}_{t}' ELSE '' END" for t in T.LADDER)) for f in FAMILIES)


@query("b1_melt_wide_log", f"WITH {X.LINES_SQL} SELECT example_id, ctx, family, coalesce(ap, 0) AS ap, substr(family, 1, 1) AS team FROM "
       f"(SELECT DISTINCT example_id, ctx FROM lines) CROSS JOIN (SELECT unnest({FAMILIES!r}) AS family) LEFT JOIN (SELECT example_id, family, ap FROM lines) USING (example_id, family)")
def b1(spark, d):
    wide = X.lines(spark, d).groupBy("example_id", "ctx").pivot("family", FAMILIES).agg(F.max("ap")).na.fill(0)
    wide = wide.withColumnsRenamed({f: f"{f}-ap" for f in FAMILIES})
    return R.melt_groups(wide, {f: [f, f[0]] for f in FAMILIES}, ["family", "team"], ["ap"], ["example_id", "ctx"])


@query("b2_derive_columns", "SELECT o_orderkey, n_nationkey AS weapon_id, md5(o_orderpriority) || n_nationkey AS ability_hash, (substr(o_orderstatus, 1, 1) = CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END) AS win "
       "FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority IS NOT NULL")
def b2(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "o_orderkey", F.col("n_name").alias("weapon"), F.col("o_orderpriority").alias("abilities"), F.lower("o_orderstatus").alias("win"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("O").alias("team"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("weapon"), F.col("n_nationkey").alias("weapon_id"))
    return R.derive_player_columns(rows, names).select("o_orderkey", "weapon_id", "ability_hash", "win")


@query("b3_map_chain", "SELECT c_custkey, coalesce(CAST(n_regionkey AS VARCHAR), '') AS n_regionkey, coalesce(r_name, '') AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def b3(spark, d):
    start = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("n_regionkey"), "r_name")
    return R.map_chain(start, (table(spark, d, "nation").where("n_nationkey < 20"), "n_nationkey", "n_regionkey"), (regions, "n_regionkey", "r_name")).select("c_custkey", "n_regionkey", "r_name")


@query("b4_canonical_ids", "SELECT CASE WHEN l_suppkey % 5 = 0 AND l_suppkey > 0 THEN l_suppkey - 5 ELSE l_suppkey END AS supplier, count(*) AS n FROM lineitem GROUP BY 1")
def b4(spark, d):
    aliases = table(spark, d, "supplier").where("s_suppkey % 5 = 0 and s_suppkey > 0").select(F.col("s_suppkey").alias("alias"), (F.col("s_suppkey") - 5).alias("reference"))
    return R.canonical_ids(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier")), "supplier", aliases).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"))


@query("b5_map_to_threshold_tags", f"WITH {X.LINES_SQL} SELECT example_id, trim({_CUM} || ' weapon_id_' || ctx) AS tags FROM lines GROUP BY example_id, ctx HAVING sum(ap) >= {T.TOTAL}")
def b5(spark, d):
    m = R.long_to_map(X.lines(spark, d), ["example_id", "ctx"]).withColumn("json", F.to_json("points"))
    m = m.withColumn("points", F.from_json("json", "map<string,int>")).where(F.aggregate(F.map_values("points"), F.lit(0), lambda a, x: a + x) >= T.TOTAL)
    return m.select("example_id", F.concat_ws(" ", T.cumulative_tags(F.col("points"), FAMILIES, BINARY), F.concat(F.lit("weapon_id_"), "ctx")).alias("tags"))


@query("b6_cumulative_tokens", f"WITH {X.LINES_SQL} SELECT example_id, CASE WHEN sum(ap) > {T.TOTAL} THEN 'over' WHEN trim({_CUM}) = '' THEN '<NULL>' ELSE trim({_CUM}) END AS tokens FROM lines GROUP BY example_id")
def b6(spark, d):
    m = R.long_to_map(X.lines(spark, d), ["example_id"])
    tags = T.cumulative_tags(F.col("points"), FAMILIES, BINARY, keep_zero_binary=True)
    total = F.aggregate(F.map_values("points"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("example_id", F.when(total > T.TOTAL, "over").when(F.size(tags) == 0, T.NULL).otherwise(F.array_join(tags, " ")).alias("tokens"))


@query("b7_capstone_tokens", f"WITH {X.TOKS_SQL} SELECT example_id, coalesce(string_agg(CASE WHEN family IN ('promo', 'small') THEN family ELSE token END, ' ' ORDER BY CASE WHEN family IN ('promo', 'small') THEN family ELSE token END), '<NULL>') AS tokens "
       "FROM (SELECT DISTINCT example_id FROM lines) LEFT JOIN (SELECT example_id, family, token FROM toks WHERE family NOT IN ('promo', 'small') UNION ALL SELECT example_id, family, family FROM lines WHERE family IN ('promo', 'small') AND ap > 0) USING (example_id) GROUP BY example_id")
def b7(spark, d):
    return R.long_to_map(X.lines(spark, d), ["example_id"]).select("example_id", F.array_join(T.capstone_tags(F.col("points"), BINARY), " ").alias("tokens"))


@query("b8_expand_capstones", f"WITH {X.TOKS_SQL} SELECT example_id, family || '_' || t AS token FROM toks, (SELECT unnest({list(T.LADDER)!r}) AS t) WHERE t <= level")
def b8(spark, d):
    t = X.toks(spark, d)
    return t.select("example_id", F.explode(F.transform(F.filter(T.ladder(), lambda x: x <= F.col("level")), lambda x: F.concat_ws("_", F.col("family"), x))).alias("token"))


@query("b9_capstones_of_sets", f"WITH {X.TOKS_SQL} SELECT example_id, family, level FROM toks")
def b9(spark, d):
    return R.capstones(b8(spark, d).withColumnRenamed("token", "token"))


@query("b10_parse_tokens", f"WITH {X.TOKS_SQL} SELECT token, family, level, count(*) AS n FROM toks GROUP BY ALL")
def b10(spark, d):
    t = X.toks(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.select("token", T.family_of(F.col("token")).alias("family"), T.level_in(F.col("token")).alias("level"), "n")


@query("b11_compound_tokens", f"WITH {X.TOKS_SQL} SELECT lower(ctx) || '_' || token AS token, count(*) AS n FROM toks GROUP BY 1")
def b11(spark, d):
    names = table(spark, d, "customer").select(F.col("c_mktsegment").alias("ctx"), F.lower("c_mktsegment").alias("name")).distinct()
    return R.compound_tokens(X.toks(spark, d), names).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("b12_longest_prefix", f"WITH {X.TOKS_SQL} SELECT lower(ctx) || '_' || family AS category, count(*) AS n FROM toks GROUP BY 1")
def b12(spark, d):
    t = b11(spark, d)
    ctx = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("c")).distinct()
    names = ctx.select(F.explode(F.array(F.col("c"), *[F.concat(F.col("c"), F.lit("_" + f)) for f in FAMILIES])).alias("name"))
    return J.longest_prefix(t, names).groupBy("category").agg(F.sum("n").alias("n"))


@query("b13_parse_lists", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS total FROM events")
def b13(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "not a list").otherwise(F.concat(F.lit("[1, "), F.col("user_id"), F.lit("]")))
    e = table(spark, d, "events").select("event_id", R.int_list(text).alias("x"))
    return e.select("event_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0), lambda a, b: a + b).cast("long").alias("total"))


@query("b14_decode_ids", "SELECT o_orderkey AS example_id, string_agg(n, ' ' ORDER BY n) AS names FROM (SELECT DISTINCT o_orderkey, coalesce(n_name, '?') AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20) GROUP BY 1")
def b14(spark, d):
    ids = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", F.col("s_nationkey").alias("n_nationkey")).distinct()
    n = ids.join(F.broadcast(table(spark, d, "nation").where("n_nationkey < 20")), "n_nationkey", "left").select(F.col("o_orderkey").alias("example_id"), F.coalesce("n_name", F.lit("?")).alias("name")).distinct()
    return n.groupBy("example_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


@query("b15_validate_tokens", f"WITH {X.TOKS_SQL} SELECT coalesce(CASE WHEN level >= 51 THEN 'unknown' END, 'ok') AS reason, count(*) AS n FROM toks GROUP BY 1")
def b15(spark, d):
    t = X.toks(spark, d)
    known = t.where("level < 51").select("token").distinct()
    return R.validated(t, known).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("b16_drop_columns", "SELECT o_orderkey, o_custkey FROM orders")
def b16(spark, d):
    return table(spark, d, "orders").drop("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "not_there")


@query("b17_slots", f"WITH {X.LINES_SQL} SELECT ap, (ap - 3 * ((ap * 7) % 10)) // 10 AS mains, (ap * 7) % 10 AS subs, count(*) AS n FROM lines WHERE ap >= 3 * ((ap * 7) % 10) GROUP BY ALL")
def b17(spark, d):
    return X.lines(spark, d).withColumn("s", T.slots(F.col("ap"))).where("s is not null").groupBy("ap", "s.mains", "s.subs").agg(F.count(F.lit(1)).alias("n"))


@query("b18_violations", f"WITH {X.LINES_SQL}, b AS (SELECT example_id, sum(ap) AS total, sum((ap * 7) % 10) AS subs FROM lines GROUP BY 1) "
       f"SELECT example_id AS build_id, 'total' AS rule FROM b WHERE total > {T.TOTAL} UNION ALL SELECT example_id, 'sub slots' FROM b WHERE subs > 9 "
       "UNION ALL SELECT DISTINCT example_id, 'wrong slot' FROM lines WHERE family = 'promo' AND ctx <> 'BUILDING'")
def b18(spark, d):
    b = X.lines(spark, d).select(F.col("example_id").alias("build_id"), "family", "ap", F.pmod(F.col("ap") * 7, F.lit(10)).alias("subs"), F.col("ctx").alias("slot"))
    return R.violations(b, spark.createDataFrame([("promo", "BUILDING")], "family string, slot string"))


@query("b19_absent_families", f"WITH {X.LINES_SQL} SELECT DISTINCT b.example_id AS build_id, f.family FROM (SELECT DISTINCT example_id FROM lines) b CROSS JOIN (SELECT DISTINCT family FROM lines) f WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.example_id = b.example_id AND l.family = f.family)")
def b19(spark, d):
    t = X.lines(spark, d).withColumnRenamed("example_id", "build_id")
    return R.absent_families(t, t)


@query("b20_dictionary_encode", f"WITH {X.BRANDS_SQL}, base AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT token FROM brands WHERE token < 'Brand#15')), "
       "new AS (SELECT token, row_number() OVER (ORDER BY first_seen, token) - 1 + (SELECT max(token_id) + 1 FROM base) AS token_id FROM (SELECT token, min(example_id) AS first_seen FROM brands WHERE token NOT IN (SELECT token FROM base) GROUP BY 1)), "
       "v AS (SELECT * FROM base UNION ALL SELECT * FROM new) SELECT example_id, string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY token) AS ids FROM brands JOIN v USING (token) GROUP BY 1")
def b20(spark, d):
    b = X.brands(spark, d).withColumn("first_seen", F.col("example_id"))
    old = b.where("token < 'Brand#15'").select("token").distinct()
    start = R.extend_vocabulary(old.withColumn("first_seen", F.lit(0)), spark.createDataFrame([], "token string, token_id int"))
    vocab = R.extend_vocabulary(b, start)
    return R.encode(b, vocab, "example_id", "token").select("example_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("b21_multi_hot", f"WITH {X.LINES_SQL} SELECT example_id, " + " || ".join(f"max(CASE WHEN family = '{f}' THEN '1' ELSE '0' END)" for f in FAMILIES[:5]) + " || '0' AS hot FROM lines GROUP BY 1")
def b21(spark, d):
    code = F.element_at(F.create_map(*[x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(i))]), F.col("family"))
    ids = X.lines(spark, d).groupBy("example_id").agg(F.collect_set(code).alias("ids"))
    return ids.select("example_id", F.array_join(F.transform(R.multi_hot(F.col("ids"), 6, 5), lambda x: x.cast("string")), "").alias("hot"))


@query("b22_pad_and_mask", f"WITH {X.BRANDS_SQL}, c AS (SELECT example_id, ctx, list(CAST(substr(token, 7) AS INT) ORDER BY CAST(substr(token, 7) AS INT)) AS i FROM brands GROUP BY ALL), m AS (SELECT *, max(len(i)) OVER (PARTITION BY ctx) AS most FROM c) "
       "SELECT example_id, array_to_string(list_concat(i, list_transform(range(len(i), most), lambda x: 99)), ' ') AS ids, array_to_string(list_transform(range(most), lambda x: CASE WHEN x >= len(i) THEN 1 ELSE 0 END), '') AS mask FROM m")
def b22(spark, d):
    c = X.brands(spark, d).groupBy("example_id", "ctx").agg(F.array_sort(F.collect_list(F.regexp_extract("token", "([0-9]+)", 1).cast("int"))).alias("ids"))
    p = R.padded(c, "ctx", "ids", 99)
    text = lambda c: F.transform(c, lambda x: x.cast("int").cast("string"))
    return p.select("example_id", F.array_join(text("ids"), " ").alias("ids"), F.array_join(text("mask"), "").alias("mask"))


@query("b23_category_by_substring", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'jewel' WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'colour' END AS category FROM part")
def b23(spark, d):
    rules = spark.createDataFrame([("RING", "jewel", 1), ("red", "colour", 2), ("Blue", "colour", 3)], "rule_name string, category string, rule_order int")
    return J.category_by_substring(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), rules).select("p_partkey", "category")


@query("b12b_longest_of_many_prefixes", "WITH n AS (SELECT DISTINCT substr(url, 1, 9 + page_id % 9) AS name FROM pages), t AS (SELECT DISTINCT replace(replace(url, '/', '_'), '.', '_') AS token FROM pages), m AS (SELECT DISTINCT replace(replace(name, '/', '_'), '.', '_') AS name FROM n) "
       "SELECT token, arg_max(name, len(name)) AS category, substr(token, max(len(name)) + 2) AS rest FROM t LEFT JOIN m ON starts_with(token, name || '_') GROUP BY token")
def b12b(spark, d):
    """As many names as pages: the beginnings of addresses."""
    plain = lambda c: F.translate(c, "/.", "__")
    p = table(spark, d, "pages")
    names = p.select(plain(F.expr("substring(url, 1, cast(9 + page_id % 9 as int))")).alias("name")).distinct()
    return J.longest_prefix(p.select(plain(F.col("url")).alias("token")).distinct(), names).select("token", "category", "rest")


@query("b23b_category_by_many_rules", "WITH r AS (SELECT item_id AS o, lower(substr(text, 1, CAST(3 + item_id % 9 AS INT))) AS rule, 'item ' || item_id AS category FROM benchmark), n AS (SELECT doc_id, lower(text) AS name FROM documents) SELECT doc_id, arg_min(category, o) AS category FROM n LEFT JOIN r ON contains(name, rule) OR contains(rule, name) GROUP BY 1")
def b23b(spark, d):
    """Documents by the first benchmark item whose beginning they hold."""
    rules = table(spark, d, "benchmark").select(F.expr("substring(text, 1, cast(3 + item_id % 9 as int))").alias("rule_name"), F.concat(F.lit("item "), "item_id").alias("category"), F.col("item_id").alias("rule_order"))
    return J.category_by_substring(table(spark, d, "documents").select("doc_id", F.col("text").alias("name")), rules).select("doc_id", "category")


@query("b25_property_join", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Promotional' WHEN 'SMALL' THEN 'Little' ELSE p_type END AS kind, n_name FROM part LEFT JOIN nation ON p_size = n_nationkey")
def b25(spark, d):
    shown = F.create_map(*map(F.lit, ("PROMO", "Promotional", "SMALL", "Little")))
    return table(spark, d, "part").join(F.broadcast(table(spark, d, "nation")), F.col("p_size") == F.col("n_nationkey"), "left").select(
        "p_partkey", F.coalesce(F.try_element_at(shown, F.col("p_type")), F.col("p_type")).alias("kind"), "n_name")


@query("b26_wide_ranks_to_long", f"WITH {X.ACTS_SQL}, r AS (SELECT example_id, feature_id, activation, CASE WHEN activation > 0 THEN '+' ELSE '-' END AS sign, row_number() OVER (PARTITION BY example_id, activation > 0 ORDER BY abs(activation) DESC, feature_id) AS rank FROM acts WHERE activation <> 0) "
       "SELECT example_id, sign, rank, 'f' || feature_id AS token, round(activation, 6) AS value FROM r WHERE rank <= 3")
def b26(spark, d):
    from setweave.operators.ranking import top_and_bottom

    r = top_and_bottom(X.acts(spark, d), "example_id", 3, "activation", "feature_id")
    names = [f"{s}{i}" for s in "+-" for i in (1, 2, 3)]
    wide = r.withColumn("c", F.concat("sign", "rank")).groupBy("example_id").pivot("c", names).agg(F.first(F.concat(F.lit("f"), "feature_id")).alias("tok"), F.first("activation").alias("val"))
    return R.wide_ranks_to_long(wide, "example_id", 3).withColumn("value", F.round("value", 6))


@query("c1_percentile_slice", f"WITH {X.EXAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY activation, example_id) - 1 AS r, count(*) OVER (PARTITION BY ctx) AS n FROM examples), "
       "s AS (SELECT example_id, ctx, activation FROM r WHERE r >= floor(n * 0.25) AND r < floor(n * 0.75)) SELECT * FROM s ORDER BY md5(example_id || ':7'), example_id LIMIT 500")
def c1(spark, d):
    return S.sample_n(S.percentile_slice(X.examples(spark, d), 25, 75, ["ctx"]), 500, "example_id", "7").select("example_id", "ctx", "activation")


@query("c2_slice_predicates", f"WITH {X.TOKS_SQL} SELECT example_id, ctx, activation FROM toks WHERE activation > 100000 AND ctx IN ('BUILDING', 'MACHINERY') GROUP BY ALL HAVING max(CASE WHEN family IN ('promo', 'large') THEN 1 ELSE 0 END) = 1")
def c2(spark, d):
    t = X.toks(spark, d).where((F.col("activation") > 100000) & F.col("ctx").isin("BUILDING", "MACHINERY")).groupBy("example_id", "ctx", "activation").agg(F.collect_set("family").alias("f"))
    return t.where(F.arrays_overlap("f", F.array(F.lit("promo"), F.lit("large")))).drop("f")


@query("c3_sign_filter", f"WITH {X.ACTS_SQL} SELECT feature_id, count(*) FILTER (activation > 0) AS n_positive, count(*) FILTER (activation <> 0) AS n_nonzero FROM acts GROUP BY 1")
def c3(spark, d):
    return X.acts(spark, d).groupBy("feature_id").agg(F.count_if(F.col("activation") > 0).alias("n_positive"), F.count_if(F.col("activation") != 0).alias("n_nonzero"))


@query("c4_cardinality_filter", f"WITH {X.BRANDS_SQL}, s AS (SELECT example_id, activation, string_agg(token, ' ' ORDER BY token) AS tokens FROM brands GROUP BY ALL HAVING count(*) = 3) SELECT * FROM s ORDER BY activation DESC, example_id LIMIT 50")
def c4(spark, d):
    s = X.brands(spark, d).groupBy("example_id", "activation").agg(F.array_sort(F.collect_list("token")).alias("t")).where(F.size("t") == 3)
    return s.select("example_id", "activation", F.array_join("t", " ").alias("tokens")).orderBy(F.desc("activation"), "example_id").limit(50)


@query("c5_outside_windows", "WITH e AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_suppkey = 7 AND l_quantity > 45) SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM e WHERE CAST(o_orderdate AS DATE) BETWEEN day AND day + 7)")
def c5(spark, d):
    e = table(spark, d, "lineitem").where("l_suppkey = 7 and l_quantity > 45").select(F.to_date("l_shipdate").alias("event_day"), F.lit(7).alias("days")).distinct()
    return S.outside_windows(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), e).select("o_orderkey")


_BANDS = "CASE WHEN a > 0.90 * m THEN 5 WHEN a > 0.75 * m THEN 4 WHEN a > 0.25 * m THEN 3 WHEN a > 0.10 * m THEN 2 WHEN a > 0.01 * m THEN 1 WHEN a > 0 THEN 0 END"


@query("c6_effective_max_bands", f"WITH {X.ACTS_SQL}, m AS (SELECT feature_id, quantile_cont(activation, 0.995) AS m FROM acts WHERE activation > 0 GROUP BY 1), b AS (SELECT feature_id, {_BANDS} AS band FROM (SELECT feature_id, activation AS a, m FROM acts JOIN m USING (feature_id))) "
       "SELECT feature_id, band, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY ALL")
def c6(spark, d):
    a = X.acts(spark, d)
    m = a.where("activation > 0").groupBy("feature_id").agg(F.expr("percentile(activation, 0.995)").alias("m"))
    return a.join(F.broadcast(m), "feature_id").withColumn("band", S.band_of(F.col("activation"), F.col("m"))).where("band is not null").groupBy("feature_id", "band").agg(F.count(F.lit(1)).alias("n"))


@query("c7_range_slice", f"WITH {X.EXAMPLES_SQL}, b AS (SELECT min(activation) AS lo, max(activation) AS hi FROM examples) SELECT example_id, activation FROM examples, b WHERE activation BETWEEN lo + 0.4 * (hi - lo) AND lo + 0.6 * (hi - lo)")
def c7(spark, d):
    e = X.examples(spark, d)
    b = e.agg(F.min("activation").alias("lo"), F.max("activation").alias("hi"))
    at = lambda p: F.col("lo") + p * (F.col("hi") - F.col("lo"))
    return e.join(F.broadcast(b)).where(F.col("activation").between(at(0.4), at(0.6))).select("example_id", "activation")


@query("c8_group_split", f"WITH {X.EXAMPLES_SQL} SELECT ctx, count(*) FILTER (tier IN ('1-URGENT', '2-HIGH')) AS n_train, count(*) FILTER (tier NOT IN ('1-URGENT', '2-HIGH')) AS n_eval FROM examples GROUP BY 1")
def c8(spark, d):
    train = F.col("tier").isin("1-URGENT", "2-HIGH")
    return X.examples(spark, d).groupBy("ctx").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_eval"))


@query("c9_label_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), '#17') OR CAST(p_partkey AS VARCHAR) = '42'")
def c9(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").contains("ring") | F.lower("p_brand").contains("#17") | (F.col("p_partkey").cast("string") == "42")).select("p_partkey", "p_name")


@query("c10_features_by_context", f"WITH {X.ACTS_SQL} SELECT feature_id, max(activation) AS max_activation FROM acts WHERE label = 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def c10(spark, d):
    return X.acts(spark, d).where("label = 3").groupBy("feature_id").agg(F.max("activation").alias("max_activation")).orderBy(F.desc("max_activation"), "feature_id").limit(20)


@query("c11_contains_token", f"WITH {X.BRANDS_SQL} SELECT ctx, count(*) FILTER (has) AS n_with, count(*) FILTER (NOT has) AS n_without FROM (SELECT example_id, ctx, bool_or(token = 'Brand#3') AS has FROM brands GROUP BY ALL) GROUP BY 1")
def c11(spark, d):
    s = X.brands(spark, d).groupBy("example_id", "ctx").agg(F.collect_set("token").alias("t"))
    has = F.array_contains("t", "Brand#3")
    return s.groupBy("ctx").agg(F.count_if(has).alias("n_with"), F.count_if(~has).alias("n_without"))


@query("c12_regions", f"WITH {X.EXAMPLES_SQL}, m AS (SELECT quantile_cont(activation, 0.995) AS m FROM examples WHERE activation > 0) SELECT CASE WHEN activation > 0.75 * m THEN 'high' WHEN activation > 0.25 * m THEN 'core' ELSE 'rest' END AS region, count(*) AS n FROM examples, m GROUP BY 1")
def c12(spark, d):
    e = X.examples(spark, d)
    m = exact_quantile(e.where("activation > 0"), "activation", "example_id", 0.995, "m")
    a = F.col("activation")
    return e.join(F.broadcast(m)).groupBy(F.when(a > 0.75 * F.col("m"), "high").when(a > 0.25 * F.col("m"), "core").otherwise("rest").alias("region")).agg(F.count(F.lit(1)).alias("n"))


def _h(key: str, seed: str) -> str:
    return f"md5({key} || ':{seed}')"


@query("d1_seeded_order", f"WITH {X.EXAMPLES_SQL} SELECT example_id, {_h('example_id', '1')} AS h FROM examples ORDER BY h LIMIT 1000")
def d1(spark, d):
    return S.sample_n(X.examples(spark, d), 1000, "example_id", "1").select("example_id", T.hashed(F.col("example_id"), "1").alias("h"))


@query("d2_cap_per_group", f"WITH {X.EXAMPLES_SQL} SELECT example_id, ctx, tier FROM (SELECT *, row_number() OVER (PARTITION BY ctx, tier ORDER BY {_h('example_id', '2')}, example_id) AS r FROM examples) WHERE r <= 100")
def d2(spark, d):
    e = X.examples(spark, d).withColumn("g", F.concat_ws("|", "ctx", "tier"))
    return S.sample_n_per_group(e, 100, "g", "example_id", "2").select("example_id", "ctx", "tier")


@query("d3_rebalance", f"WITH {X.EXAMPLES_SQL}, w AS (SELECT *, tier IN ('1-URGENT', '2-HIGH') AS won FROM examples), c AS (SELECT *, sum(won::INT) OVER (PARTITION BY ctx) AS w, sum((NOT won)::INT) OVER (PARTITION BY ctx) AS l, row_number() OVER (PARTITION BY ctx, won ORDER BY {_h('example_id', '3')}, example_id) AS r FROM w) "
       "SELECT example_id, ctx, won FROM c WHERE r <= CASE WHEN w / (w + l) < 0.6 THEN CASE WHEN won THEN w ELSE floor(w / 0.6) - w END ELSE CASE WHEN won THEN floor(l / 0.4) - l ELSE l END END")
def d3(spark, d):
    e = X.examples(spark, d).withColumn("won", F.col("tier").isin("1-URGENT", "2-HIGH"))
    return S.rebalance(e, "ctx", "won", "example_id", 0.6, "3").select("example_id", "ctx", "won")


@query("d4_fraction_sample", f"WITH {X.EXAMPLES_SQL} SELECT example_id FROM examples WHERE CAST('0x' || substr({_h('example_id', '4')}, 1, 4) AS INT) < 16384")
def d4(spark, d):
    return S.sample_fraction(X.examples(spark, d), 0.25, "example_id", "4").select("example_id")


@query("d5_split", f"WITH {X.EXAMPLES_SQL}, r AS (SELECT example_id, row_number() OVER (ORDER BY {_h('example_id', '5')}, example_id) AS r, count(*) OVER () AS n FROM examples) "
       "SELECT example_id, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.7 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM r")
def d5(spark, d):
    return S.split(X.examples(spark, d), "example_id", 0.1, 0.2, "5").select("example_id", "split")


@query("d6_stratified_split", f"WITH {X.EXAMPLES_SQL}, r AS (SELECT example_id, ctx, row_number() OVER (PARTITION BY ctx ORDER BY {_h('example_id', '6')}, example_id) AS r, count(*) OVER (PARTITION BY ctx) AS n FROM examples) "
       "SELECT example_id, ctx, r <= CASE WHEN n < 2 THEN 0 ELSE least(n - 1, greatest(1, round(n * 0.2))) END AS is_eval FROM r")
def d6(spark, d):
    return S.stratified_split(X.examples(spark, d), "ctx", "example_id", 0.2, "6").select("example_id", "ctx", "is_eval")


@query("d7_reservoir", f"WITH {X.EXAMPLES_SQL} SELECT ctx, example_id, n FROM (SELECT ctx, example_id, row_number() OVER (PARTITION BY ctx ORDER BY {_h('example_id', '7')}, example_id) AS r, count(*) OVER (PARTITION BY ctx) AS n FROM examples WHERE activation > 50000) WHERE r <= 20")
def d7(spark, d):
    e = X.examples(spark, d).where("activation > 50000")
    n = e.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))
    return S.sample_n_per_group(e, 20, "ctx", "example_id", "7").join(F.broadcast(n), "ctx").select("ctx", "example_id", "n")


@query("d8_masked_instances", f"WITH {X.BRANDS_SQL}, s AS (SELECT example_id, list(token ORDER BY token) AS t, greatest(1, len(list(token)) - 1) AS m FROM brands GROUP BY 1), x AS (SELECT *, unnest(range(4)) AS instance, list_transform(range(1, m + 1), lambda r: pow(r / (m * (m + 1) / 2), 1.2)) AS w FROM s), "
       "u AS (SELECT *, CAST('0x' || substr(md5(example_id || ':' || instance || ':mask'), 1, 6) AS BIGINT) / 16777216 AS u, list_reduce(w, lambda a, b: a + b, 0.0) AS z, list_transform(range(1, m + 1), lambda r: list_reduce(w[1:r], lambda a, b: a + b, 0.0)) AS c FROM x), "
       "r AS (SELECT *, least(m, len(list_filter(c, lambda v: v <= u * z)) + 1) AS removed, list_transform(list_sort(list_transform(t, lambda k: md5(example_id || ':' || instance || ':' || k || ':mask') || k)), lambda v: substr(v, 33)) AS mixed FROM u) "
       "SELECT example_id, CAST(instance AS INT) AS instance, array_to_string(t, ' ') AS target, CASE WHEN instance = 0 THEN '<NULL>' ELSE array_to_string(list_sort(mixed[1:len(t) - removed]), ' ') END AS observed FROM r")
def d8(spark, d):
    sets = X.brands(spark, d).groupBy("example_id").agg(F.collect_list("token").alias("tokens"))
    m = S.masked_instances(sets, 3, null_token="<NULL>")
    return m.select("example_id", "instance", F.array_join("target", " ").alias("target"), F.array_join("observed", " ").alias("observed"))


@query("d9_slot_masking", f"WITH {X.LINES_SQL}, i AS (SELECT example_id, family, least((ap + 9) // 10, 4) AS n FROM lines), u AS (SELECT mask, example_id, family, unnest(range(1, n + 1)) AS u FROM i, (SELECT unnest([1, 3]) AS mask)), "
       "r AS (SELECT mask, example_id, family, row_number() OVER (PARTITION BY mask, example_id ORDER BY md5(example_id || ':' || mask || ':' || family || ':' || u || ':9'), family, u) AS r FROM u) "
       "SELECT mask, example_id, family, CAST(count(*) AS INT) AS observed FROM r WHERE r > mask GROUP BY ALL")
def d9(spark, d):
    items = X.lines(spark, d).select("example_id", "family", F.least(F.floor((F.col("ap") + 9) / 10), F.lit(4)).cast("int").alias("n"))
    return S.mask_items(items, [1, 3], "example_id", "family", "n", "9")


@query("d10_random_baseline", f"WITH {X.LINES_SQL} SELECT DISTINCT example_id, list_extract({FAMILIES!r}, CAST('0x' || substr({_h('example_id', '10')}, 1, 4) AS INT) % 6 + 1) AS family FROM lines")
def d10(spark, d):
    slot = F.conv(F.substring(T.hashed(F.col("example_id"), "10"), 1, 4), 16, 10).cast("int") % 6
    return X.lines(spark, d).select("example_id").distinct().withColumn("family", F.get(F.array(*map(F.lit, FAMILIES)), slot))


@query("d11_scaled_histogram", f"WITH {X.ACTS_SQL} SELECT feature_id, least(floor((activation + 0.6) / 0.12), 9) AS bin, 2 * count(*) AS approx FROM acts WHERE example_id % 2 = 0 AND activation BETWEEN -0.6 AND 0.6 GROUP BY ALL")
def d11(spark, d):
    from setweave.operators.aggregates import bin_index

    half = X.acts(spark, d).where("example_id % 2 = 0").withColumn("bin", bin_index(F.col("activation"), F.lit(-0.6), F.lit(0.6), 10)).where("bin is not null")
    return half.groupBy("feature_id", F.col("bin").cast("double").alias("bin")).agg((2 * F.count(F.lit(1))).alias("approx"))
