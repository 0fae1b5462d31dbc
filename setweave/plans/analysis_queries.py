"""Queries of token-set analytics, graphs, similarity, information and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from setweave.functions import tokens as T
from setweave.functions.session import forget, table, written
from setweave.operators import baskets as B
from setweave.operators import evaluation as V
from setweave.operators import graph as G
from setweave.operators import information as I
from setweave.operators import matrices as N
from setweave.operators import neighbours as H
from setweave.operators import overview as O
from setweave.operators import patterns as P
from setweave.operators import ranking as K
from setweave.operators import similarity as M
from setweave.plans import relations as X
from setweave.plans.aggregate_queries import D

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, **rounded: int):
    """As in aggregate_queries: double columns are rounded on both sides."""

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


def words(spark, d):
    """(doc_id, lang, word) of every document, split at single spaces."""
    return table(spark, d, "documents").select("doc_id", "lang", F.explode(F.split(F.lower("text"), " ")).alias("word"))


_WORDS = "w AS (SELECT doc_id, lang, unnest(string_split(lower(text), ' ')) AS word FROM documents)"


@query("i1_idf", f"WITH {_WORDS}, g AS (SELECT word, count(DISTINCT doc_id) AS df FROM w GROUP BY 1) SELECT word, df, round(ln((SELECT count(*) FROM documents) + 1) - ln(df + 1), 4) AS idf FROM g")
def i1(spark, d):
    return B.idf(words(spark, d), "doc_id", "word", table(spark, d, "documents").count())


@query("i2_tf_idf", f"WITH {X.BRANDS_SQL}, n AS (SELECT count(*) AS n FROM orders), i AS (SELECT token, ln(n + 1) - ln(count(*) + 1) AS idf FROM brands, n GROUP BY token, n), top AS (SELECT DISTINCT example_id, activation FROM brands ORDER BY activation DESC, example_id LIMIT 200) SELECT token, count(*) AS tf, round(idf, 4) AS idf, round(count(*) * idf, 4) AS tf_idf FROM brands JOIN top USING (example_id) LEFT JOIN i USING (token) GROUP BY token, idf")
def i2(spark, d):
    b = X.brands(spark, d)
    top = b.select("example_id", "activation").distinct().orderBy(F.desc("activation"), "example_id").limit(200).select("example_id")
    return B.tf_idf(b.join(F.broadcast(top), "example_id"), B.idf(b, "example_id", "token", table(spark, d, "orders").count()), "token")


@query("e2_tf_with_idf", f"WITH {X.BRANDS_SQL}, n AS (SELECT count(*) AS n FROM orders), i AS (SELECT token, ln(n + 1) - ln(count(*) + 1) AS idf FROM brands, n WHERE ctx = 'BUILDING' GROUP BY token, n), t AS (SELECT token, count(*) AS tf FROM brands GROUP BY 1) SELECT token, tf, round(idf, 4) AS idf, round(tf * coalesce(idf, 0), 4) AS tf_idf FROM t LEFT JOIN i USING (token)")
def e2(spark, d):
    b = X.brands(spark, d)
    return B.tf_idf(b, B.idf(b.where("ctx = 'BUILDING'"), "example_id", "token", table(spark, d, "orders").count()), "token")


@query("i3_within_sample_tf_idf", f"WITH {X.BRANDS_SQL}, g AS (SELECT ctx, token, c, sum(c) OVER (PARTITION BY ctx) AS t FROM (SELECT ctx, token, count(*) AS c FROM brands GROUP BY ALL)) SELECT ctx, token, c, round(c / t, 4) AS tf, round(ln(t / c), 4) AS idf, round(c / t * ln(t / c), 4) AS tf_idf FROM g")
def i3(spark, d):
    return B.within_tf_idf(X.brands(spark, d), "ctx", "token")


_NORM = """c AS (SELECT doc_id, lang, word, count(*) AS c FROM w GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT doc_id, lang, word, c * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN f USING (word), n WHERE df BETWEEN 2 AND floor(0.95 * n)),
s AS (SELECT doc_id, lang, word, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS score FROM v)"""


@query("i4_document_terms", f"WITH {_WORDS}, {_NORM} SELECT doc_id, count(*) AS n_terms, round(max(score), 4) AS best, round(sum(score), 2) AS total FROM s GROUP BY 1", total=2)
def i4(spark, d):
    s = B.normalised_tf_idf(words(spark, d), "doc_id", "word", table(spark, d, "documents").count())
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.max("score").alias("best"), F.sum("score").alias("total"))


_PROF = f"{_WORDS}, {_NORM}, z AS (SELECT lang, count(*) AS z FROM documents GROUP BY 1), p AS (SELECT lang, word, t / z AS mean FROM (SELECT lang, word, sum(score) AS t FROM s GROUP BY ALL) JOIN z USING (lang)), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(mean, 9) DESC, word) AS rank FROM p)"


@query("i5_cluster_profile", f"WITH {_PROF} SELECT lang, word, round(mean, 4) AS mean, rank FROM k WHERE rank <= 10")
def i5(spark, d):
    docs = table(spark, d, "documents")
    s = B.normalised_tf_idf(words(spark, d), "doc_id", "word", docs.count())
    return B.cluster_profile(s, docs.select("doc_id", "lang"), "doc_id", "lang", "word", 10)


@query("i6_cluster_names", f"WITH {_PROF} SELECT lang, string_agg(word, ', ' ORDER BY rank) AS name FROM k WHERE rank <= 10 AND mean > 0.05 GROUP BY 1")
def i6(spark, d):
    return B.cluster_names(i5(spark, d), "lang", "word", 0.05)


_COVER = "n AS (SELECT ctx, count(DISTINCT example_id) AS n FROM toks GROUP BY 1), v AS (SELECT ctx, token, family, level, round(count(*) / any_value(n), 9) AS score FROM toks JOIN n USING (ctx) GROUP BY ALL), kp AS (SELECT ctx, list_reduce(list({'s': score, 'n': level, 't': token} ORDER BY score DESC, level DESC), lambda a, x: CASE WHEN x.s >= a.s - 0.02 AND x.n > a.n THEN x ELSE a END) AS k FROM v GROUP BY ctx, family)"


@query("i6b_collapsed_names", f"WITH {X.TOKS_SQL}, {_COVER} SELECT ctx, coalesce(string_agg(k.t, ', ' ORDER BY k.s DESC, k.t) FILTER (k.s > 0.05), ctx) AS name FROM kp GROUP BY 1")
def i6b(spark, d):
    """Contexts named by the share of their orders that hold a token, one level a family."""
    t = X.toks(spark, d)
    n = t.groupBy("ctx").agg(F.count_distinct("example_id").alias("n"))
    scores = t.groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), "ctx").select("ctx", "token", F.round(F.col("c") / F.col("n"), 9).alias("score"))
    return B.names_of_clusters(B.collapsed_variants(scores, "ctx", "token", "score"), "ctx", "token", "score", 0.05)


@query("i7_comparison_matrix", f"WITH {X.TOKS_SQL} SELECT family, count(*) FILTER (ctx = 'BUILDING') AS BUILDING, count(*) FILTER (ctx = 'MACHINERY') AS MACHINERY, count(*) FILTER (ctx = 'FURNITURE') AS FURNITURE FROM toks WHERE level > 12 GROUP BY 1")
def i7(spark, d):
    return X.toks(spark, d).where("level > 12").groupBy("family").pivot("ctx", ["BUILDING", "MACHINERY", "FURNITURE"]).agg(F.count(F.lit(1))).na.fill(0)


@query("i8_cluster_summary", f"WITH {X.ACTS_SQL}, c AS (SELECT label, feature_id, avg(activation) AS m FROM acts GROUP BY ALL), dist AS (SELECT a.label, example_id, sum(pow(activation - m, 2)) AS q FROM acts a JOIN c ON a.label = c.label AND a.feature_id = c.feature_id GROUP BY ALL) SELECT label, count(*) AS size, min_by(example_id, round(q, 9) * 1000000000 + example_id / 1000000) AS medoid, round(count(*) / (SELECT count(*) FROM embeddings), 4) AS share FROM dist GROUP BY 1")
def i8(spark, d):
    a = X.acts(spark, d)
    c = a.groupBy("label", "feature_id").agg(F.avg("activation").alias("m"))
    dist = a.join(c, ["label", "feature_id"]).groupBy("label", "example_id").agg(F.sum(F.pow(F.col("activation") - F.col("m"), 2)).alias("q"))
    n = dist.agg(F.count(F.lit(1)).alias("_n"))
    g = dist.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.round("q", 9).alias("q"), "example_id")).alias("b"))
    return g.join(F.broadcast(n)).select("label", "size", F.col("b.example_id").alias("medoid"), (F.col("size") / F.col("_n")).alias("share"))


@query("i8b_cluster_overview", "WITH p AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), t AS (SELECT doc_id AS id, unnest(string_split(lower(text), ' ')) AS token FROM documents WHERE doc_id IN (SELECT id FROM p)), "
       "c AS (SELECT cluster, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1), r AS (SELECT cluster, arg_min(id, (round((x - mx) * (x - mx) + (y - my) * (y - my), 12), id)) AS rep FROM p JOIN c USING (cluster) GROUP BY 1), k AS (SELECT cluster, token, count(*) AS k FROM t JOIN p USING (id) GROUP BY ALL), "
       "tp AS (SELECT cluster, string_agg(token || ':' || k, ' ' ORDER BY k DESC, token) AS top_tokens FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, token) AS r FROM k) WHERE r <= 12 GROUP BY 1), o AS (SELECT cluster, string_agg(DISTINCT token, ' ' ORDER BY token) AS own FROM r JOIN t ON t.id = rep GROUP BY 1) "
       "SELECT cluster, CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster ' || cluster END AS name, n, round(100.0 * n / (SELECT count(*) FROM p), 4) AS pct, round(mx, 4) AS x, round(my, 4) AS y, rep AS representative, coalesce(own, '') AS representative_tokens, coalesce(top_tokens, '') AS top_tokens, "
       "(SELECT count(*) FROM c WHERE cluster <> -1) AS n_clusters, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE cluster = -1), 0) AS n_noise FROM c JOIN r USING (cluster) LEFT JOIN tp USING (cluster) LEFT JOIN o USING (cluster)")
def i8b(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"), F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    t = words(spark, d).select(F.col("doc_id").alias("id"), F.col("word").alias("token"))
    return B.cluster_summary(p, t, p.select("cluster").distinct().withColumn("name", F.concat(F.lit("cluster "), "cluster")), "id", "cluster", ["x", "y"])


def high_sets(spark, d, cut=0.9):
    b = X.brands(spark, d).groupBy("example_id", "activation").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    q = K.exact_quantile(X.examples(spark, d), "activation", "example_id", cut, "q")
    return b.join(F.broadcast(q)).select("example_id", "tokens", (F.col("activation") >= F.col("q")).alias("high"))


_HIGH = "q AS (SELECT quantile_cont(activation, 0.9) AS q FROM examples), h AS (SELECT example_id, token, activation >= q AS high FROM brands, q), z AS (SELECT count(DISTINCT example_id) FILTER (high) AS nh, count(DISTINCT example_id) FILTER (NOT high) AS nb FROM h)"


@query("i9_itemset_lift", f"WITH {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, {_HIGH}, p AS (SELECT a.token || '|' || b.token AS itemset, count(*) FILTER (a.high) AS n_high, count(*) FILTER (NOT a.high) AS n_base FROM h a JOIN h b USING (example_id) WHERE a.token < b.token GROUP BY 1) "
       "SELECT itemset, n_high, n_base, round(n_high / nh, 4) AS support_high, round(n_base / nb, 4) AS support_base, round(CASE WHEN n_base > 0 THEN (n_high / nh) / (n_base / nb) ELSE 999 END, 4) AS lift FROM p, z WHERE n_high >= greatest(1, floor(nh * 0.02)) ORDER BY round(CASE WHEN n_base > 0 THEN (n_high / nh) / (n_base / nb) ELSE 999 END, 9) DESC, itemset LIMIT 100")
def i9(spark, d):
    return B.itemset_lift(high_sets(spark, d), 2, 0.02, 100)


_KIN = "k AS (SELECT DISTINCT example_id, substr(token, 1, 7) AS f, high FROM h WHERE token <> 'Brand#13' AND example_id IN (SELECT example_id FROM h WHERE token = 'Brand#13')), zk AS (SELECT count(DISTINCT example_id) FILTER (high) AS nh, count(DISTINCT example_id) FILTER (NOT high) AS nb FROM k)"
_SETS = {2: "k a JOIN k b USING (example_id) WHERE a.f < b.f", 3: "k a JOIN k b USING (example_id) JOIN k c USING (example_id) WHERE a.f < b.f AND b.f < c.f", 4: "k a JOIN k b USING (example_id) JOIN k c USING (example_id) JOIN k d USING (example_id) WHERE a.f < b.f AND b.f < c.f AND c.f < d.f"}


@query("i9b_conditioned_family_itemsets", f"WITH {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, {_HIGH}, {_KIN}, p AS (" + " UNION ALL ".join(
    f"SELECT concat_ws('|', {', '.join(f'{c}.f' for c in 'abcd'[:n])}) AS itemset, count(*) FILTER (a.high) AS n_high, count(*) FILTER (NOT a.high) AS n_base FROM {j} GROUP BY 1" for n, j in _SETS.items())
    + ") SELECT itemset, n_high, n_base, round(n_high / nh, 4) AS support_high, round(n_base / nb, 4) AS support_base, round(CASE WHEN n_base > 0 THEN (n_high / nh) / (n_base / nb) ELSE 999 END, 4) AS lift FROM p, zk WHERE n_high >= greatest(1, floor(nh * 0.05)) ORDER BY round(CASE WHEN n_base > 0 THEN (n_high / nh) / (n_base / nb) ELSE 999 END, 9) DESC, itemset LIMIT 100")
def i9b(spark, d):
    """Sets that hold one brand, without it and by family, in itemsets of 2 to 4."""
    sets = B.collapsed(B.conditioned(high_sets(spark, d), "Brand#13"), lambda t: F.substring(t, 1, 7))
    return B.itemset_lift(sets, (2, 3, 4), 0.05, 100)


_BANDS = """e AS (SELECT *, row_number() OVER (ORDER BY activation, example_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT example_id, activation, list(token ORDER BY token) AS s FROM brands GROUP BY ALL)),
h AS (SELECT example_id, unnest(s) AS t, high FROM (SELECT *, CASE WHEN r >= floor(n * CAST(0.95 AS DOUBLE)) THEN true WHEN r >= floor(n * 0.25) AND r < floor(n * 0.75) THEN false END AS high FROM e) WHERE high IS NOT NULL AND len(s) > 1),
z AS (SELECT count(DISTINCT example_id) FILTER (high) AS nh, count(DISTINCT example_id) FILTER (NOT high) AS nb FROM h)"""
_COMBOS = {n: " JOIN ".join(f"h {c}" + (" USING (example_id)" if c != "a" else "") for c in "abcd"[:n]) + " WHERE " + " AND ".join(f"{x}.t < {y}.t" for x, y in zip("abc"[: n - 1], "bcd")) for n in (2, 3, 4)}


@query("i10_contrastive_triples", f"WITH {X.BRANDS_SQL}, {_BANDS}, p AS (" + " UNION ALL ".join(
    f"SELECT {n} AS size, concat_ws('|', {', '.join(f'{c}.t' for c in 'abcd'[:n])}) AS itemset, count(*) FILTER (a.high) AS count_high, count(*) FILTER (NOT a.high) AS n_base FROM {j} GROUP BY 2" for n, j in _COMBOS.items())
    + "), c AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY count_high DESC, itemset) AS k FROM p), l AS (SELECT size, itemset, count_high, count_high / nh AS support_high, greatest(n_base / nb, 0.001) AS support_base FROM c, z WHERE k <= 200 AND count_high >= greatest(2, floor(nh * CAST(0.01 AS DOUBLE)))), "
    "b AS (SELECT *, support_high / support_base AS lift, row_number() OVER (PARTITION BY size ORDER BY round(support_high / support_base, 9) DESC, itemset) AS k FROM l WHERE support_high / support_base > 1.5) "
    "SELECT size, itemset, count_high, round(support_high, 4) AS support_high, round(support_base, 4) AS support_base, round(lift, 4) AS lift FROM b WHERE k <= 50")
def i10(spark, d):
    """Itemsets of 2 to 4 brands of the top 5 % of orders against the middle half."""
    b = X.brands(spark, d).groupBy("example_id", "activation").agg(F.collect_list("token").alias("tokens"))
    return P.contrastive_itemsets(b)


@query("i11_interactions", f"WITH {X.BRANDS_SQL}, n AS (SELECT count(DISTINCT example_id) AS n FROM brands), top AS (SELECT token, count(*) AS c FROM brands GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), p AS (SELECT a.token AS a, b.token AS b, count(*) AS n_both FROM brands a JOIN brands b USING (example_id) WHERE a.token < b.token GROUP BY ALL HAVING count(*) >= 5) "
       "SELECT a, b, n_both, round(x.c * y.c / n, 4) AS expected, round((n_both - x.c * y.c / n) / greatest(x.c * y.c / n, 1), 4) AS interaction FROM p JOIN top x ON x.token = a JOIN top y ON y.token = b, n")
def i11(spark, d):
    b = X.brands(spark, d)
    return B.interactions(b, b.select("example_id").distinct().count(), 20)


@query("i12_contrasts", f"WITH {X.EXAMPLES_SQL}, s AS (SELECT ctx, tier, avg(activation) AS m FROM examples GROUP BY ALL), p AS (SELECT ctx, max(m) FILTER (tier = '1-URGENT') AS f0, max(m) FILTER (tier = '2-HIGH') AS fa, max(m) FILTER (tier = '3-MEDIUM') AS fb, max(m) FILTER (tier = '5-LOW') AS fab FROM s GROUP BY 1) SELECT 'a' AS a, 'b' AS b, round(avg(fab - fa - fb + f0), 2) AS mean, round(stddev_samp(fab - fa - fb + f0) / sqrt(count(*)), 2) AS stderr, count(*) AS n FROM p", mean=2, stderr=2)
def i12(spark, d):
    variant = F.element_at(F.create_map(*map(F.lit, ("1-URGENT", "", "2-HIGH", "a", "3-MEDIUM", "b", "5-LOW", "a|b", "4-NOT SPECIFIED", "x"))), F.col("tier"))
    s = X.examples(spark, d).groupBy(F.col("ctx").alias("base"), variant.alias("variant")).agg(F.avg("activation").alias("score"))
    return B.contrasts(s)


@query("i13_common_cores", f"WITH {X.LINES_SQL}, s AS (SELECT example_id, family FROM lines WHERE example_id IN (SELECT example_id FROM lines GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6)), c AS (SELECT example_id, string_agg(family, '|' ORDER BY family) AS core FROM s GROUP BY 1 UNION SELECT a.example_id, a.family || '|' || b.family FROM s a JOIN s b USING (example_id) WHERE a.family < b.family "
       "UNION SELECT a.example_id, a.family || '|' || b.family || '|' || c.family FROM s a JOIN s b USING (example_id) JOIN s c USING (example_id) WHERE a.family < b.family AND b.family < c.family) SELECT core, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20")
def i13(spark, d):
    return B.common_cores(X.lines(spark, d).groupBy("example_id").agg(F.array_sort(F.collect_list("family")).alias("tokens")), 2, 20)


@query("i14_pmi_penalty", f"WITH {X.LINES_SQL}, tr AS (SELECT * FROM lines WHERE tier < '3'), n AS (SELECT ctx, count(DISTINCT example_id) AS n FROM tr GROUP BY 1), one AS (SELECT ctx, family, count(*) AS c FROM tr GROUP BY ALL), two AS (SELECT a.ctx, a.family AS a, b.family AS b, count(*) AS c FROM tr a JOIN tr b USING (example_id) WHERE a.family < b.family GROUP BY ALL), "
       "own AS (SELECT a.example_id, a.ctx, a.family AS a, b.family AS b FROM lines a JOIN lines b USING (example_id) WHERE a.tier >= '3' AND a.family < b.family), "
       "s AS (SELECT example_id, sum(greatest(0, -ln((coalesce(two.c, 0) / n + 1e-12) / ((coalesce(x.c, 0) / n + 1e-12) * (coalesce(y.c, 0) / n + 1e-12))))) AS p FROM own JOIN n USING (ctx) LEFT JOIN two ON two.ctx = own.ctx AND two.a = own.a AND two.b = own.b LEFT JOIN one x ON x.ctx = own.ctx AND x.family = own.a LEFT JOIN one y ON y.ctx = own.ctx AND y.family = own.b GROUP BY 1) "
       "SELECT e.example_id, round(coalesce(p, 0), 4) AS pmi_penalty FROM (SELECT DISTINCT example_id FROM lines WHERE tier >= '3') e LEFT JOIN s USING (example_id)")
def i14(spark, d):
    t = X.lines(spark, d)
    return B.pmi_penalty(t.where("tier >= '3'"), t.where("tier < '3'"))


@query("i15_nearest_jaccard", f"WITH {X.LINES_SQL}, s AS (SELECT example_id, ctx, tier, list(family ORDER BY family) AS f FROM lines GROUP BY ALL), r AS (SELECT DISTINCT ctx, f FROM s WHERE tier = '1-URGENT') SELECT s.example_id, round(max(len(list_intersect(s.f, r.f)) / len(list_distinct(list_concat(s.f, r.f)))), 4) AS nearest FROM s JOIN r USING (ctx) WHERE tier = '5-LOW' GROUP BY 1")
def i15(spark, d):
    t = X.lines(spark, d)
    return B.nearest_jaccard(t.where("tier = '5-LOW'"), t.where("tier = '1-URGENT'"))


@query("i15b_nearest_brand_sets", f"WITH {X.BRANDS_SQL}, s AS (SELECT example_id, ctx, list(token ORDER BY token) AS f FROM brands GROUP BY ALL), q AS (SELECT s.*, o_orderpriority AS tier FROM s JOIN orders ON o_orderkey = example_id), r AS (SELECT DISTINCT ctx, f FROM q WHERE tier = '1-URGENT') SELECT q.example_id, round(max(len(list_intersect(q.f, r.f)) / len(list_distinct(list_concat(q.f, r.f)))), 4) AS nearest FROM q JOIN r USING (ctx) WHERE tier = '5-LOW' GROUP BY 1")
def i15b(spark, d):
    """Sets of few of 25 brands: most are settled at a high likeness, on their rarer brands."""
    t = X.brands(spark, d).join(X.examples(spark, d).select("example_id", "tier"), "example_id")
    return B.nearest_jaccard(t.where("tier = '5-LOW'"), t.where("tier = '1-URGENT'"), item="token")


_UNITS = "i AS (SELECT example_id, ctx, tier, family, unnest(range(1, least((ap + 9) // 10, 4) + 1)) AS u FROM lines), m AS (SELECT example_id, ctx, tier, list(family || '#' || u ORDER BY family, u) AS f FROM i GROUP BY ALL)"


@query("i16_mode_completion", f"WITH {X.LINES_SQL}, {_UNITS}, r AS (SELECT ctx, f AS full_, count(*) AS n FROM m WHERE tier = '1-URGENT' GROUP BY ALL), o AS (SELECT example_id, ctx, f[1:2] AS o FROM m WHERE tier = '5-LOW'), "
       "x AS (SELECT example_id, o, full_, row_number() OVER (PARTITION BY example_id ORDER BY (len(list_intersect(o, full_)) = len(o)) DESC, n DESC, array_to_string(full_, '|')) AS r FROM o JOIN r USING (ctx)), "
       "y AS (SELECT example_id, o, full_, 8 - len(o) AS lack, list_filter(full_, lambda v: NOT list_contains(o, v))[1:8 - len(o)] AS more FROM x WHERE r = 1), "
       "w AS (SELECT example_id, list_concat(list_concat(o, more), list_transform(range(len(more), lack), lambda k: full_[k % len(full_) + 1])) AS a FROM y) SELECT example_id, array_to_string(list_sort(list_transform(a, lambda v: split_part(v, '#', 1))), '|') AS completed FROM w")
def i16(spark, d):
    units = X.lines(spark, d).select("example_id", "ctx", "tier", F.explode(F.array_repeat("family", F.least(F.floor((F.col("ap") + 9) / 10).cast("int"), F.lit(4)))).alias("family"))
    s = units.groupBy("example_id", "ctx", "tier").agg(F.array_sort(F.collect_list("family")).alias("f"))
    cases = s.where("tier = '5-LOW'").select("example_id", "ctx", F.slice("f", 1, 2).alias("observed"))
    return B.mode_completion(cases, s.where("tier = '1-URGENT'").select("ctx", F.col("f").alias("full")), 8)


@query("i17_concept_hints", f"WITH {X.LINES_SQL}, z AS (SELECT ctx, count(DISTINCT example_id) AS z FROM lines GROUP BY 1), g AS (SELECT ctx, family, k / z AS c FROM (SELECT ctx, family, count(*) AS k FROM lines GROUP BY ALL) JOIN z USING (ctx)) SELECT ctx, family, round(c, 4) AS coverage, CASE WHEN c > 0.5 THEN 'common' WHEN c > 0.4 THEN 'frequent' ELSE 'rare' END AS hint FROM g")
def i17(spark, d):
    t = X.lines(spark, d)
    n = t.groupBy("ctx").agg(F.count_distinct("example_id").alias("n"))
    g = t.groupBy("ctx", "family").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), "ctx").withColumn("coverage", F.col("k") / F.col("n"))
    return g.select("ctx", "family", "coverage", F.when(F.col("coverage") > 0.5, "common").when(F.col("coverage") > 0.4, "frequent").otherwise("rare").alias("hint"))


_OVER = X.TOKS_SQL + """, t AS (SELECT ctx AS f, example_id, token, family, tier, greatest(activation - 50000, 0) AS a FROM toks), x AS (SELECT DISTINCT f, example_id, tier, a FROM t),
st AS (SELECT f, count(*) AS n, avg(a) AS mean, stddev_samp(a) AS std, median(a) AS median, avg(CASE WHEN a = 0 THEN 100.0 ELSE 0 END) AS sparsity, avg(CASE WHEN a <= 0.001 THEN 1.0 ELSE 0 END) AS floor_rate FROM x GROUP BY 1),
e AS (SELECT p.f, p.token AS src, q.token AS dst, sum(q.a) AS w FROM t p JOIN t q ON p.f = q.f AND p.example_id = q.example_id WHERE p.token <> q.token GROUP BY ALL), w AS (SELECT f, src, dst, w / sum(w) OVER (PARTITION BY f, src) AS p FROM e),
n AS (SELECT f, token AS node, count(*) OVER (PARTITION BY f) AS k FROM (SELECT DISTINCT f, token FROM t)), r0 AS (SELECT f, node, k, 1.0 / k AS s FROM n)""" + "".join(
    f", r{i} AS (SELECT n.f, n.node, n.k, 0.15 / any_value(n.k) + 0.85 * coalesce(sum(w.p * r{i - 1}.s), 0) AS s FROM n LEFT JOIN w ON w.f = n.f AND w.dst = n.node LEFT JOIN r{i - 1} ON r{i - 1}.f = n.f AND r{i - 1}.node = w.src GROUP BY ALL)" for i in range(1, 4)) + """,
tp AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(s, 12) DESC, node) AS r FROM r3 QUALIFY r <= 15), sh AS (SELECT f, regexp_replace(node, '_[0-9]+$', '') AS fam, sum(s) / any_value(z) AS share FROM (SELECT *, sum(s) OVER (PARTITION BY f) AS z FROM tp) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY a DESC, example_id) - 1 AS r, count(*) OVER (PARTITION BY f) AS z FROM x), c AS (SELECT f, a AS cut FROM rk WHERE r = least(greatest(1, CAST(floor(z * (1 - CAST(0.9 AS DOUBLE))) AS BIGINT)), z - 1)),
h AS (SELECT x.*, a >= cut AS high FROM x JOIN c USING (f)), z AS (SELECT f, count(*) AS z, count(*) FILTER (high) AS nh FROM h GROUP BY 1), b AS (SELECT f, family, count(*) AS k, count(*) FILTER (high) AS kh FROM (SELECT DISTINCT t.f, t.example_id, family, high FROM t JOIN h ON t.f = h.f AND t.example_id = h.example_id) GROUP BY 1, 2),
i AS (SELECT f, family, CASE WHEN lo > 0.001 THEN hi / lo WHEN hi > 0 THEN 10 ELSE 1 END AS ratio FROM (SELECT f, family, kh / nh AS hi, (k - kh) / (z - nh) AS lo FROM b JOIN z USING (f) WHERE k >= 50 AND z - k >= 50)),
lw AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(ratio, 9), family) AS r FROM i WHERE ratio < 0.8), cx AS (SELECT f, tier, count(*) AS c FROM x GROUP BY 1, 2)"""
_LIST = lambda item, frm, order: f"coalesce((SELECT string_agg(CAST({item} AS VARCHAR), ' ' ORDER BY {order}) FROM {frm} q WHERE q.f = st.f), '')"


@query("i18_feature_overview", f"WITH {_OVER} SELECT f AS feature, n, round(mean, 2) AS mean, round(std, 2) AS std, round(median, 2) AS median, round(sparsity, 4) AS sparsity, round(floor_rate, 4) AS floor_rate, {_LIST('node', 'tp', 'r')} AS top_tokens, {_LIST('fam', 'sh', 'round(share, 9) DESC, fam')} AS families, "
       f"{_LIST('family', '(SELECT * FROM lw WHERE r <= 10)', 'r')} AS bottom_tokens, {_LIST('tier', 'cx', 'c DESC, tier')} AS top_contexts, {_LIST('example_id', '(SELECT * FROM rk WHERE r < 5)', 'r')} AS samples, round((SELECT max(share) FROM sh WHERE sh.f = st.f), 4) AS top_family_share FROM st", mean=2, std=2, median=2)
def i18(spark, d):
    """Features are the five contexts, what an order is worth over a bound its activation, family levels the tokens; high are the top tenth."""
    t = X.toks(spark, d).select(F.col("ctx").alias("feature"), "example_id", "token", F.col("tier").alias("ctx"), F.greatest(F.col("activation") - 50000, F.lit(0.0)).alias("activation"))
    x = t.select("feature", "example_id", "ctx", "activation").distinct()
    return O.feature_overview(x, t.drop("ctx"), "feature", F.regexp_replace("token", "_[0-9]+$", ""), rounds=3, tolerance=0.0, high_percentile=0.9)


@query("i19_one_shot_selection", f"WITH {X.TOKS_SQL}, p AS (SELECT ctx, family, level, c / sum(c) OVER (PARTITION BY ctx) AS p FROM (SELECT ctx, family, level, count(*) AS c FROM toks GROUP BY ALL)) SELECT ctx, family, max(level) AS level, round(max_by(p, level), 4) AS p FROM p WHERE p >= 0.02 AND level > CASE WHEN family = 'promo' THEN 15 ELSE 0 END GROUP BY ALL")
def i19(spark, d):
    from pyspark.sql import Window

    p = X.toks(spark, d).groupBy("ctx", "family", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ctx"))).drop("n")
    now = table(spark, d, "customer").select(F.col("c_mktsegment").alias("ctx"), F.lit("promo").alias("family"), F.lit(15).alias("level")).distinct()
    return B.one_shot(p, now, 0.02)


_EDGES = "e AS (SELECT a.token AS src, b.token AS dst, sum(a.activation) AS w FROM brands a JOIN brands b USING (example_id) WHERE a.token <> b.token GROUP BY ALL)"


@query("j1_cooccurrence_edges", f"WITH {X.BRANDS_SQL}, {_EDGES} SELECT src, dst, round(w, 2) AS w FROM e", w=2)
def j1(spark, d):
    return G.cooccurrence_edges(X.brands(spark, d))


_RANK = """p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), n AS (SELECT DISTINCT p_brand AS node FROM part), c AS (SELECT count(*) AS n FROM n),
r0 AS (SELECT node, 1.0 / n AS s FROM n, c)""" + "".join(
    f", r{i} AS (SELECT n.node, 0.15 / max(c.n) + 0.85 * coalesce(sum(p.p * r{i - 1}.s), 0) AS s FROM n CROSS JOIN c LEFT JOIN p ON p.dst = n.node LEFT JOIN r{i - 1} ON r{i - 1}.node = p.src GROUP BY n.node)" for i in range(1, 6))


def brand_rank(spark, d, rounds):
    nodes = table(spark, d, "part").select(F.col("p_brand").alias("node")).distinct()
    return G.pagerank(G.cooccurrence_edges(X.brands(spark, d)), nodes, rounds=rounds, tolerance=0)


@query("j2_pagerank", f"WITH {X.BRANDS_SQL}, {_EDGES}, {_RANK} SELECT node, round(s, 6) AS score FROM r5", score=6)
def j2(spark, d):
    return brand_rank(spark, d, 5)


_EACH = """u AS (SELECT ctx AS g, example_id, token, activation FROM brands), ee AS (SELECT a.g, a.token AS src, b.token AS dst, sum(b.activation) AS w FROM u a JOIN u b USING (g, example_id) WHERE a.token <> b.token GROUP BY ALL), pp AS (SELECT g, src, dst, w / sum(w) OVER (PARTITION BY g, src) AS p FROM ee),
nn AS (SELECT g, token AS node, count(*) OVER (PARTITION BY g) AS k FROM (SELECT DISTINCT g, token FROM u)), q0 AS (SELECT g, node, k, 1.0 / k AS s FROM nn)""" + "".join(
    f", q{i} AS (SELECT nn.g, nn.node, nn.k, 0.15 / any_value(nn.k) + 0.85 * coalesce(sum(pp.p * q{i - 1}.s), 0) AS s FROM nn LEFT JOIN pp ON pp.g = nn.g AND pp.dst = nn.node LEFT JOIN q{i - 1} ON q{i - 1}.g = nn.g AND q{i - 1}.node = pp.src GROUP BY ALL)" for i in range(1, 7)) + ", al AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, * FROM q{i}" for i in range(7)) + """), mv AS (SELECT b.g, b.i, sum(abs(b.s - a.s)) AS moved FROM al a JOIN al b ON a.g = b.g AND a.node = b.node AND b.i = a.i + 1 GROUP BY ALL),
sp AS (SELECT g, coalesce(min(i) FILTER (moved < 0.002), 7) AS i FROM mv GROUP BY 1), pr AS (SELECT g, node, s, least(sp.i, 6) AS rounds FROM al JOIN sp USING (g) WHERE al.i = sp.i - 1)"""


def brand_ranks(spark, d):
    b = X.brands(spark, d)
    return G.pagerank_of_each(G.edges_of_each(b, "ctx"), b.select("ctx", F.col("token").alias("node")), "ctx", rounds=6, tolerance=0.002)


@query("j2b_pagerank_of_each", f"WITH {X.BRANDS_SQL}, {_EACH} SELECT g AS ctx, node, round(s, 6) AS score, rounds FROM pr", score=6)
def j2b(spark, d):
    return brand_ranks(spark, d)


@query("k3c_rank_mass_cosine", f"WITH {X.BRANDS_SQL}, {_EACH}, tt AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(s, 12) DESC, node) AS r FROM pr QUALIFY r <= 8), ms AS (SELECT g, node, s / sum(s) OVER (PARTITION BY g) AS v FROM tt), no AS (SELECT g, sqrt(sum(v * v)) AS n FROM ms GROUP BY 1) "
       "SELECT a, b, round(c, 4) AS cosine FROM (SELECT x.g AS a, y.g AS b, sum(x.v * y.v) / any_value(m.n * o.n) AS c FROM ms x JOIN ms y USING (node) JOIN no m ON m.g = x.g JOIN no o ON o.g = y.g WHERE x.g < y.g GROUP BY ALL) WHERE c > 0.1")
def k3c(spark, d):
    """Contexts alike in where the mass of their eight highest-ranked brands lies."""
    return M.cosine_pairs(G.top_mass(brand_ranks(spark, d), 8, "ctx"), "ctx", "node", "share", 0.1)


@query("j3_top_ranked", f"WITH {X.BRANDS_SQL}, {_EDGES}, {_RANK} SELECT node, round(s, 6) AS score FROM r5 ORDER BY s DESC, node LIMIT 5", score=6)
def j3(spark, d):
    return brand_rank(spark, d, 5).orderBy(F.desc("score"), "node").limit(5)


@query("j4_category_rollup", f"WITH {X.BRANDS_SQL}, {_EDGES}, {_RANK} SELECT category, round(sum(s / k), 6) AS score FROM (SELECT *, substr(node, 1, 7) AS category, count(*) OVER (PARTITION BY substr(node, 1, 7)) AS k FROM r5) GROUP BY 1 ORDER BY sum(s / k) DESC, 1 LIMIT 30", score=6)
def j4(spark, d):
    r = brand_rank(spark, d, 5).withColumn("category", F.substring("node", 1, 7))
    return G.category_rollup(r, "category", r.groupBy("category").agg(F.count(F.lit(1)).alias("n_contexts")), 30)


@query("j5_components", f"WITH RECURSIVE {X.ACTS_SQL}, c AS (SELECT a.feature_id AS a, b.feature_id AS b FROM acts a JOIN acts b USING (example_id) WHERE a.feature_id < b.feature_id GROUP BY ALL HAVING count(*) >= 10 AND corr(a.activation, b.activation) >= 0.08), s AS (SELECT a, b FROM c UNION SELECT b, a FROM c), "
       "r AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.node), m AS (SELECT node, min(c) AS component FROM r GROUP BY 1) SELECT component, count(*) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM m GROUP BY 1")
def j5(spark, d):
    return M.correlation_clusters(M.correlations(X.acts(spark, d), 10), 0.08)


_V0 = "v AS (SELECT feature_id, activation AS y FROM acts WHERE example_id = 0)"


@query("k1_cosine_neighbours", f"WITH {X.ACTS_SQL}, {_V0}, g AS (SELECT example_id, sum(activation * y) / ((sqrt(sum(activation * activation)) + 1e-8) * (sqrt(sum(y * y)) + 1e-8)) AS c FROM acts JOIN v USING (feature_id) WHERE example_id <> 0 GROUP BY 1) SELECT example_id AS vec_id, round(c, 4) AS cosine FROM g ORDER BY c DESC, 1 LIMIT 20")
def k1(spark, d):
    return M.cosine_neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 0, 20)


@query("k1b_indexed_neighbours", "SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def k1b(spark, d):
    """Every 50th vector against an index of all in buckets of 60; reached tells whether nine tenths of the exact ten nearest are found."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = H.build_index(v, "vec_id", "embedding", 10, 60)
    asked = v.where("vec_id % 50 = 0")
    plain = H._usable(v, "vec_id", "embedding", index.size)
    exact = H.exact_neighbours(plain, plain.where("key % 50 = 0"), 10)
    found = H.recall(H.neighbours(index, asked, "vec_id", "embedding", 10), exact)
    return asked.agg(F.count(F.lit(1)).alias("n_queries")).withColumn("reached", F.lit(found >= 0.9))


@query("k2_vector_cosine", f"WITH {X.ACTS_SQL}, c AS (SELECT label, feature_id, avg(activation) AS y FROM acts GROUP BY ALL), g AS (SELECT a.label AS label, sum(a.y * b.y) / ((sqrt(sum(a.y * a.y)) + 1e-8) * (sqrt(sum(b.y * b.y)) + 1e-8)) AS c FROM c a JOIN c b USING (feature_id) WHERE b.label = 0 AND a.label <> 0 GROUP BY 1) SELECT label, round(c, 4) AS cosine FROM g ORDER BY c DESC, 1 LIMIT 5")
def k2(spark, d):
    c = X.acts(spark, d).groupBy("label", "feature_id").agg(F.avg("activation").alias("y")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "y"))), lambda x: x["y"]).alias("v"))
    return M.cosine_neighbours(c, "label", "v", 0, 5)


@query("k3_sparse_cosine", f"WITH {X.TOKS_SQL}, t AS (SELECT ctx || ':' || tier AS k, token, count(*) AS v FROM toks GROUP BY ALL), n AS (SELECT k, sqrt(sum(v * v)) AS n FROM t GROUP BY 1) SELECT a, b, cosine FROM (SELECT x.k AS a, y.k AS b, round(sum(x.v * y.v) / (max(nx.n) * max(ny.n)), 4) AS cosine FROM t x JOIN t y USING (token) JOIN n nx ON nx.k = x.k JOIN n ny ON ny.k = y.k WHERE x.k < y.k GROUP BY ALL) WHERE cosine > 0.1")
def k3(spark, d):
    t = X.toks(spark, d).groupBy(F.concat_ws(":", "ctx", "tier").alias("k"), "token").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return M.cosine_pairs(t, "k", "token", "v", 0.1)


@query("k3b_document_cosine", "WITH w AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY ALL), z AS (SELECT count(DISTINCT doc_id) AS z FROM w), f AS (SELECT word, ln((z + 1) / (count(*) + 1)) AS idf FROM w, z GROUP BY word, z), "
       "x AS (SELECT doc_id, word, c * idf AS v FROM w JOIN f USING (word) WHERE c * idf <> 0), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1), u AS (SELECT doc_id, word, v / n AS v FROM x JOIN n USING (doc_id)) "
       "SELECT a, b, round(c, 4) AS cosine FROM (SELECT p.doc_id AS a, q.doc_id AS b, sum(p.v * q.v) AS c FROM u p JOIN u q USING (word) WHERE p.doc_id < q.doc_id GROUP BY ALL) WHERE c > 0.7")
def k3b(spark, d):
    """Documents of like words: the commonest words of all texts are in no index, so only texts that can be alike meet."""
    w = written(words(spark, d).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c")))
    n = w.select("doc_id").distinct().count()
    idf = w.groupBy("word").agg(F.log((n + 1) / (F.count(F.lit(1)) + 1)).alias("idf"))
    out = M.cosine_pairs(w.join(idf, "word").select("doc_id", "word", (F.col("c") * F.col("idf")).alias("v")), "doc_id", "word", "v", 0.7)
    forget(w)
    return out


@query("k4_coactivation", f"WITH {X.ACTS_SQL}, c AS (SELECT a.feature_id AS a, b.feature_id AS b, corr(a.activation, b.activation) AS r FROM acts a JOIN acts b USING (example_id) WHERE a.feature_id < b.feature_id GROUP BY ALL HAVING count(*) >= 10) SELECT round(avg(r), 3) AS mean_r, count(*) FILTER (r > 0.1) AS n_strong, count(*) AS n FROM c", mean_r=3)
def k4(spark, d):
    c = M.correlations(X.acts(spark, d), 10)
    return c.agg(F.avg("r").alias("mean_r"), F.count_if(F.col("r") > 0.1).alias("n_strong"), F.count(F.lit(1)).alias("n"))


@query("k5_shared_drivers", f"WITH {X.ACTS_SQL}, t AS (SELECT feature_id, example_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, example_id) AS r FROM acts) WHERE r <= 20) SELECT b.token, count(DISTINCT feature_id) AS n_features, count(*) AS total FROM t JOIN (SELECT vec_id AS example_id, 'L' || label AS token FROM embeddings) b USING (example_id) GROUP BY 1 HAVING count(DISTINCT feature_id) >= 2")
def k5(spark, d):
    tops = K.top_per_group(X.acts(spark, d), "feature_id", 20)
    return M.shared_drivers(tops, table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id"), F.concat(F.lit("L"), "label").alias("token")))


@query("k6_coactive_features", f"WITH {X.ACTS_SQL}, s AS (SELECT vec_id AS example_id FROM embeddings WHERE label = 4), t AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY activation DESC, feature_id) AS r FROM acts WHERE example_id IN (SELECT example_id FROM s)) SELECT feature_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 4) AS share, round(avg(activation), 4) AS mean FROM t WHERE r <= 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def k6(spark, d):
    return M.coactive_features(X.acts(spark, d), table(spark, d, "embeddings").where("label = 4").select(F.col("vec_id").alias("example_id")), 10, 20)


@query("k7_feature_matching", f"WITH {X.ACTS_SQL}, t AS (SELECT feature_id, example_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, example_id) AS r FROM acts) WHERE r <= 30), j AS (SELECT a.feature_id AS a, b.feature_id AS b, count(*) / (60 - count(*)) AS j FROM t a JOIN t b USING (example_id) WHERE a.feature_id < b.feature_id GROUP BY ALL HAVING count(*) / (60 - count(*)) > 0.05), "
       "c AS (SELECT a.feature_id AS a, b.feature_id AS b, corr(a.activation, b.activation) AS r FROM acts a JOIN acts b USING (example_id) WHERE a.feature_id < b.feature_id GROUP BY ALL), s AS (SELECT a, b, CASE WHEN r > 0 THEN 0.4 * j + 0.6 * r ELSE j END AS s FROM j JOIN c USING (a, b)) SELECT a, b, round(s, 4) AS score, CASE WHEN s > 0.5 THEN 'same' WHEN s > 0.3 THEN 'close' WHEN s > 0.1 THEN 'weak' ELSE 'none' END AS verdict FROM s")
def k7(spark, d):
    a = X.acts(spark, d)
    t = K.top_per_group(a, "feature_id", 30)
    j = M.overlap_counts(t, "example_id", "feature_id").where("a < b").select("a", "b", (F.col("n") / (60 - F.col("n"))).alias("j")).where("j > 0.05")
    s = j.join(M.correlations(a, 1), ["a", "b"]).withColumn("score", F.when(F.col("r") > 0, 0.4 * F.col("j") + 0.6 * F.col("r")).otherwise(F.col("j")))
    v = F.col("score")
    return s.select("a", "b", "score", F.when(v > 0.5, "same").when(v > 0.3, "close").when(v > 0.1, "weak").otherwise("none").alias("verdict"))


@query("k8_feature_relationship", f"WITH {X.ACTS_SQL}, x AS (SELECT label, sum(activation) FILTER (feature_id = 1) AS a, sum(activation) FILTER (feature_id = 2) AS b, count(*) / 2 AS n FROM acts WHERE feature_id IN (1, 2) GROUP BY 1) SELECT label, round(a, 4) AS a, round(b, 4) AS b, CASE WHEN abs(a) < 0.01 * n OR abs(b) < 0.01 * n THEN 'neutral' WHEN a * b > 0 THEN 'agree' ELSE 'conflict' END AS kind FROM x")
def k8(spark, d):
    a = X.acts(spark, d).where("feature_id in (1, 2)")
    of = lambda f: F.sum(F.when(F.col("feature_id") == f, F.col("activation")))
    x = a.groupBy("label").agg(of(1).alias("a"), of(2).alias("b"), (F.count(F.lit(1)) / 2).alias("n"))
    small = (F.abs("a") < 0.01 * F.col("n")) | (F.abs("b") < 0.01 * F.col("n"))
    return x.select("label", "a", "b", F.when(small, "neutral").when(F.col("a") * F.col("b") > 0, "agree").otherwise("conflict").alias("kind"))


@query("k8b_influences_of_two", f"WITH {X.ACTS_SQL}, u AS (SELECT feature_id, 'L' || label AS token, avg(activation) AS value FROM acts GROUP BY ALL HAVING avg(activation) > -0.02 * (label % 3)), s AS (SELECT a.activation AS x, b.activation AS y FROM acts a JOIN acts b USING (example_id) WHERE a.feature_id = 4 AND b.feature_id = 9 AND a.activation > 0 AND b.activation > 0), z AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, corr(x, y) AS c FROM s), "
       "r AS (SELECT token, max(value) FILTER (feature_id = 4) AS a, max(value) FILTER (feature_id = 9) AS b FROM u WHERE feature_id IN (4, 9) GROUP BY 1), t AS (SELECT *, coalesce(a, 0) * sx AS na, coalesce(b, 0) * sy AS nb FROM r, z) SELECT token, CASE WHEN b IS NULL THEN 'a' WHEN a IS NULL THEN 'b' ELSE 'both' END AS held_by, round(coalesce(a, 0), 4) AS raw_a, round(coalesce(b, 0), 4) AS raw_b, round(na, 4) AS net_a, round(nb, 4) AS net_b, "
       "CASE WHEN abs(na) < 0.01 * n OR abs(nb) < 0.01 * n THEN 'neutral' WHEN na * nb > 0 THEN 'agree' ELSE 'conflict' END AS kind, n AS n_shared, round(c, 4) AS correlation FROM t")
def k8b(spark, d):
    a = X.acts(spark, d)
    label = F.regexp_extract("token", "[0-9]+", 0).cast("int")
    u = a.groupBy("feature_id", F.concat(F.lit("L"), "label").alias("token")).agg(F.avg("activation").alias("value")).where(F.col("value") > -0.02 * (label % 3))
    return M.feature_relationship(a, u, 4, 9)


@query("k9_matrix_product", f"WITH {X.ACTS_SQL}, c AS (SELECT label, feature_id, avg(activation) AS m FROM acts GROUP BY ALL) SELECT x.label AS row_label, y.label AS col_label, round(sum(x.m * y.m), 6) AS value FROM c x JOIN c y USING (feature_id) GROUP BY ALL", value=6)
def k9(spark, d):
    c = X.acts(spark, d).groupBy("label", "feature_id").agg(F.avg("activation").alias("m"))
    return N.matrix_product(c.select(F.col("label").alias("row_label"), "feature_id", F.col("m").alias("x")), c.select(F.col("label").alias("col_label"), "feature_id", F.col("m").alias("y")), "row_label", "feature_id", "col_label")


_CODE = """w AS (SELECT label AS unit, feature_id, avg(activation) AS w FROM acts GROUP BY ALL), b AS (SELECT feature_id, avg(activation) AS b FROM acts GROUP BY 1), c AS (SELECT unit, avg(w) AS c FROM w GROUP BY 1),
h AS (SELECT example_id, unit, least(6, greatest(0, s + c)) AS h FROM (SELECT example_id, unit, sum((activation - b) * w) AS s FROM acts JOIN b USING (feature_id) JOIN w USING (feature_id) GROUP BY ALL) JOIN c USING (unit)),
m AS (SELECT unit, feature_id, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY unit)), 1e-12) AS d FROM w),
r AS (SELECT example_id, feature_id, v + b AS value FROM (SELECT example_id, feature_id, sum(h * d) AS v FROM h JOIN m USING (unit) GROUP BY ALL) JOIN b USING (feature_id))"""


def _code(spark, d):
    """(cells, weights, shift, bias): a code of ten units, the means of the labels, tied for both ways."""
    a = X.acts(spark, d)
    w = a.groupBy(F.col("label").alias("unit"), "feature_id").agg(F.avg("activation").alias("w"))
    return a.select("example_id", "feature_id", F.col("activation").alias("x")), w, a.groupBy("feature_id").agg(F.avg("activation").alias("b")), w.groupBy("unit").agg(F.avg("w").alias("c"))


@query("k10_linear_encode", f"WITH {X.ACTS_SQL}, {_CODE} SELECT example_id, unit, round(h, 4) AS h FROM h")
def k10(spark, d):
    return N.linear_encode(*_code(spark, d), "example_id", "feature_id", "unit")


@query("k10b_linear_decode", f"WITH {X.ACTS_SQL}, {_CODE} SELECT example_id, feature_id, round(value, 4) AS value FROM r")
def k10b(spark, d):
    _, w, b, _ = _code(spark, d)
    return N.linear_decode(k10(spark, d), w, b, "example_id", "feature_id", "unit")


@query("f39_representation_metrics", f"WITH {X.ACTS_SQL}, {_CODE}, g AS (SELECT vec_id AS example_id, label FROM embeddings), "
       "e AS (SELECT example_id, sum(pow(activation - value, 2)) AS se, count(*) AS cells FROM acts JOIN r USING (example_id, feature_id) GROUP BY 1), u AS (SELECT example_id, sum(h) AS l1, count(*) FILTER (h > 0.01) AS live, count(*) AS units FROM h GROUP BY 1), "
       "t AS (SELECT label, count(*) AS n, sum(se) / sum(cells) AS mse, avg(l1) AS l1, sum(live) / sum(units) AS l0, sum(l1) / sum(units) AS magnitude FROM g JOIN e USING (example_id) JOIN u USING (example_id) GROUP BY ROLLUP (label)), d AS (SELECT *, (1 - l0) * 100 AS dead_percent FROM t) "
       "SELECT label, n, round(mse, 6) AS mse, round(l1, 4) AS l1, round(l0, 4) AS l0, round(magnitude, 4) AS magnitude, round(dead_percent, 4) AS dead_percent, "
       "round(sqrt(pow(ln(greatest(mse / 0.1, 0.1)), 2) + pow(ln(greatest(l0 / 0.1, 0.1)), 2) + pow(ln(greatest(dead_percent / 50, 0.1)), 2)), 4) AS distance FROM d", mse=6)
def f39(spark, d):
    cells, w, b, _ = _code(spark, d)
    h, groups = k10(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id"), "label")
    return N.representation_metrics(cells, N.linear_decode(h, w, b, "example_id", "feature_id", "unit"), h, groups, "example_id", "feature_id", "label", 0.01)


@query("k11_principal_components")
def k11(spark, d):
    """Embeddings on their first two principal axes, made positive in the largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("x"))
    x = PCA(k=2, inputCol="x", outputCol="y").fit(v).transform(v).select("vec_id", vector_to_array("y").alias("y"))
    return x.select("vec_id", F.abs(F.get("y", 0)).alias("axis1"), F.abs(F.get("y", 1)).alias("axis2"))


@query("k11b_document_vectors")
def k11b(spark, d):
    """Documents as the mean of word vectors trained on all of them."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    w = table(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "").alias("words"))
    parts = max(1, w.count() // 50_000)
    model = Word2Vec(vectorSize=16, minCount=5, maxIter=1, numPartitions=parts, seed=3, inputCol="words", outputCol="v").fit(w)
    return model.transform(w).select("doc_id", vector_to_array("v").alias("vector"))


_PTS = "pts AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query("k12_dense_clusters", f"WITH RECURSIVE {_PTS}, pr AS (SELECT a.vec_id AS a, b.vec_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03 * 0.03), core AS (SELECT a FROM pr GROUP BY 1 HAVING count(*) >= 5), "
       "l AS (SELECT a, b FROM pr WHERE a IN (FROM core) AND b IN (FROM core)), r AS (SELECT a AS node, a AS c FROM core UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node AND r.c <= l.b), cc AS (SELECT node, min(c) AS c FROM r GROUP BY 1), nr AS (SELECT a, arg_min(b, (d, b)) AS b FROM pr WHERE b IN (FROM core) GROUP BY 1) SELECT vec_id, coalesce(cc.c, -1) AS cluster FROM pts LEFT JOIN nr ON nr.a = vec_id LEFT JOIN cc ON cc.node = nr.b")
def k12(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return M.dense_clusters(p, "vec_id", ["x", "y"], 0.03, 5)


@query("k13_verify_columns", "SELECT count(*) AS n, round(max(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 2) AS max_abs, round(avg(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 2) AS mean_abs FROM lineitem", max_abs=2, mean_abs=2)
def k13(spark, d):
    t = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return M.verify_columns(t, "net", "l_extendedprice")


def base_and_given(spark, d):
    """p0 of families in a context's sets, and the shares of the other families of sets that hold a given one."""
    t = X.lines(spark, d).select("example_id", "ctx", "family")
    base = I.normalised(t.groupBy("ctx", F.col("family").alias("token")).agg(F.count(F.lit(1)).alias("c")), ["ctx"], "c", "p0").drop("c")
    pairs = t.withColumnRenamed("family", "given").join(t.select("example_id", F.col("family").alias("token")), "example_id").where("given <> token")
    given = I.normalised(pairs.groupBy("ctx", "given", "token").agg(F.count(F.lit(1)).alias("c")), ["ctx", "given"], "c", "p").drop("c")
    return base, given


_BASE = X.LINES_SQL + """, base AS (SELECT ctx, token, c / sum(c) OVER (PARTITION BY ctx) AS p0 FROM (SELECT ctx, family AS token, count(*) AS c FROM lines GROUP BY ALL)),
given AS (SELECT ctx, given, token, c / sum(c) OVER (PARTITION BY ctx, given) AS p FROM (SELECT a.ctx, a.family AS given, b.family AS token, count(*) AS c FROM lines a JOIN lines b USING (example_id) WHERE a.family <> b.family GROUP BY ALL)),
h0 AS (SELECT ctx, -sum(p0 * log2(p0)) AS h0 FROM base GROUP BY 1), h1 AS (SELECT ctx, given AS token, -sum(p * log2(p)) AS h1 FROM given GROUP BY ALL)"""


@query("l1_normalise", f"WITH {_BASE} SELECT ctx, token, round(p0, 6) AS p0 FROM base", p0=6)
def l1(spark, d):
    return base_and_given(spark, d)[0]


@query("l2_entropy", f"WITH {_BASE} SELECT ctx, round(h0, 6) AS entropy FROM h0", entropy=6)
def l2(spark, d):
    return I.entropy(base_and_given(spark, d)[0], ["ctx"], "p0")


@query("l3_normalised_entropy", f"WITH {_BASE} SELECT ctx, round(-sum(p0 * log2(p0 + 1e-10)) / log2(count(*)), 6) AS entropy FROM base GROUP BY 1", entropy=6)
def l3(spark, d):
    return I.normalised_entropy(base_and_given(spark, d)[0], ["ctx"], "p0")


@query("l4_jensen_shannon", f"WITH {X.TOKS_SQL}, p AS (SELECT ctx, token, c / sum(c) OVER (PARTITION BY ctx) AS p FROM (SELECT ctx, token, count(*) AS c FROM toks GROUP BY ALL)), k AS (SELECT a.ctx AS a, b.ctx AS b, t.token FROM (SELECT DISTINCT ctx FROM p) a, (SELECT DISTINCT ctx FROM p) b, (SELECT DISTINCT token FROM p) t WHERE a.ctx < b.ctx), "
       "v AS (SELECT k.a, k.b, coalesce(x.p, 0) AS x, coalesce(y.p, 0) AS y FROM k LEFT JOIN p x ON x.ctx = k.a AND x.token = k.token LEFT JOIN p y ON y.ctx = k.b AND y.token = k.token) "
       "SELECT a, b, round(sum(CASE WHEN x + y > 0 THEN -(x + y) / 2 * log2((x + y) / 2) ELSE 0 END + CASE WHEN x > 0 THEN x * log2(x) / 2 ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y) / 2 ELSE 0 END), 6) AS js FROM v GROUP BY ALL", js=6)
def l4(spark, d):
    t = X.toks(spark, d).groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("c"))
    return I.jensen_shannon(I.normalised(t, ["ctx"], "c"), "ctx", "token")


@query("l5_information_gain", f"WITH {_BASE}, r AS (SELECT ctx, sum(p0 * h1) AS rest FROM base JOIN h1 USING (ctx, token) GROUP BY 1) SELECT ctx, round(h0, 6) AS h0, round(h0 - rest, 6) AS gain, round((h0 - rest) / h0, 6) AS ratio FROM h0 JOIN r USING (ctx)", h0=6, gain=6, ratio=6)
def l5(spark, d):
    return I.information_gain(*base_and_given(spark, d))


@query("l5b_token_gain", f"WITH {_BASE} SELECT ctx, token, round(p0, 6) AS p0, round(h1, 6) AS h1, round(p0 * (h0 - h1), 6) AS share FROM base JOIN h1 USING (ctx, token) JOIN h0 USING (ctx)", p0=6, h1=6, share=6)
def l5b(spark, d):
    return I.token_gain(*base_and_given(spark, d))


@query("l6_branchiness", f"WITH {_BASE}, x AS (SELECT b.ctx, b.token, b.p0, o.p0 / (1 - b.p0) AS q, coalesce(g.p, 0) AS p FROM base b JOIN base o ON o.ctx = b.ctx AND o.token <> b.token LEFT JOIN given g ON g.ctx = b.ctx AND g.given = b.token AND g.token = o.token), "
       "j AS (SELECT ctx, token, max(p0) AS p0, sum((CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END + q * log2(q)) / 2 - (p + q) / 2 * log2((p + q) / 2)) AS js FROM x GROUP BY ALL) SELECT ctx, round(sum(p0 * js) / sum(p0), 6) AS branchiness FROM j GROUP BY 1", branchiness=6)
def l6(spark, d):
    return I.branchiness(*base_and_given(spark, d))


@query("l7_suppression", f"WITH {_BASE}, t AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY p0 DESC, token) <= 4) SELECT a.ctx, round(sum(a.p0 * greatest(0, b.p0 - coalesce(g.p, 0))), 6) AS suppression FROM t a JOIN t b ON a.ctx = b.ctx AND a.token <> b.token LEFT JOIN given g ON g.ctx = a.ctx AND g.given = a.token AND g.token = b.token GROUP BY 1", suppression=6)
def l7(spark, d):
    return I.suppression(*base_and_given(spark, d), m=4)


@query("l8_next_tier", f"WITH {X.TOKS_SQL} SELECT ctx, family, min(level) AS level FROM toks WHERE level > CASE WHEN family = 'small' THEN 12 ELSE 0 END GROUP BY ALL")
def l8(spark, d):
    now = table(spark, d, "customer").select(F.col("c_mktsegment").alias("ctx"), F.lit("small").alias("family"), F.lit(12).alias("level")).distinct()
    return I.next_tier(X.toks(spark, d).select("ctx", "family", "level"), now)


@query("l9_depth_delta", f"WITH {_BASE}, dp AS (SELECT ctx, family AS token, avg(ap) AS a FROM lines GROUP BY ALL), r AS (SELECT ctx, sum(p0 * (a - 20)) AS delta, max(h0) AS g, sum(p0 * a) AS depth FROM base JOIN dp USING (ctx, token) JOIN h0 USING (ctx) GROUP BY 1) SELECT ctx, round(delta, 4) AS delta, round(g / delta, 4) AS gain_per_delta, round(g * pow(0.9, ln(greatest(depth, 1))), 4) AS discounted FROM r")
def l9(spark, d):
    base, _ = base_and_given(spark, d)
    depth = X.lines(spark, d).groupBy("ctx", F.col("family").alias("token")).agg(F.avg("ap").alias("after"))
    h = I.entropy(base, ["ctx"], "p0").withColumnRenamed("entropy", "gain")
    return I.depth_delta(base.join(depth, ["ctx", "token"]).join(h, "ctx").select("ctx", F.col("p0").alias("p"), F.lit(20.0).alias("before"), "after", "gain"), "ctx")


@query("l10_multimodality", f"WITH {_BASE} SELECT ctx, round(sum(2 * p0 * (1 - p0)), 6) AS spread, round(sum(p0), 6) AS mass, round(pow(2, -sum(p0 * log2(p0))), 6) AS branches FROM base GROUP BY 1", spread=6, mass=6, branches=6)
def l10(spark, d):
    return I.multimodality(base_and_given(spark, d)[0])


def cases(spark, d):
    """(truth, observed, pred) multisets: an order's families, those without its first, and the next order's, as counts of ten points."""
    t = X.lines(spark, d).select("example_id", "tier", "family", F.floor((F.col("ap") + 9) / 10).cast("int").alias("n"))
    truth = t.select("example_id", "tier", "family", "n")
    first = truth.groupBy("example_id").agg(F.min("family").alias("_f"))
    observed = truth.join(first, "example_id").where("family <> _f").drop("_f")
    pred = t.select((F.col("example_id") - 1).alias("example_id"), "family", "n").join(truth.select("example_id").distinct(), "example_id", "left_semi")
    return truth, observed, pred


_CASES = X.LINES_SQL + """, t AS (SELECT example_id, tier, family, CAST((ap + 9) // 10 AS INT) AS n FROM lines), o AS (SELECT * FROM t WHERE family <> (SELECT min(family) FROM t x WHERE x.example_id = t.example_id)),
p AS (SELECT example_id - 1 AS example_id, family, n FROM t WHERE example_id - 1 IN (SELECT example_id FROM t)),
c AS (SELECT coalesce(t.example_id, p.example_id) AS example_id, coalesce(t.n, 0) AS t, coalesce(p.n, 0) AS p FROM t FULL JOIN p ON t.example_id = p.example_id AND t.family = p.family),
cmp AS (SELECT example_id, sum(least(t, p)) AS both, sum(greatest(t - p, 0)) AS missing, sum(greatest(p - t, 0)) AS extra, sum(t) AS truth_n, sum(p) AS pred_n FROM c GROUP BY 1)"""


@query("m1_compare_builds", f"WITH {_CASES} SELECT *, round(1 - (missing + extra) / 114.0, 4) AS accuracy, CAST(missing + extra = 0 AS INT) AS exact_hit FROM cmp")
def m1(spark, d):
    t, _, p = cases(spark, d)
    return V.compare(t, p, "example_id", "family", "n")


@query("m2_top_k_evaluation", f"WITH {_CASES}, r AS (SELECT example_id // 5 AS k, example_id % 5 AS rank, CAST(missing + extra <= 1 AS INT) AS h, 1 - (missing + extra) / 114.0 AS a FROM cmp), f AS (SELECT *, min(CASE WHEN h = 1 THEN rank END) OVER (PARTITION BY k) AS f FROM r) SELECT k, max(h) AS exact_hit, round(max(a), 4) AS best_accuracy, round(arg_min(a, rank), 4) AS first_accuracy, arg_max(rank, (a, -rank)) AS best_rank FROM f WHERE f IS NULL OR rank <= f GROUP BY 1")
def m2(spark, d):
    t, _, p = cases(spark, d)
    c = V.compare(t, p, "example_id", "family", "n").select(F.floor(F.col("example_id") / 5).alias("k"), (F.col("example_id") % 5).alias("rank"), (F.col("missing") + F.col("extra") <= 1).cast("int").alias("exact_hit"), "accuracy")
    return V.top_k_eval(c, "k")


_COMPLETION = _CASES + """, f AS (SELECT example_id, family FROM t UNION SELECT example_id, family FROM p), x AS (SELECT f.example_id, coalesce(t.n, 0) AS t, coalesce(o.n, 0) AS o, coalesce(p.n, 0) AS p FROM f LEFT JOIN t USING (example_id, family) LEFT JOIN o USING (example_id, family) LEFT JOIN p USING (example_id, family)),
g AS (SELECT example_id, sum(greatest(t - o, 0)) AS need, sum(least(greatest(t - o, 0), greatest(p - o, 0))) AS hit, sum(o) AS obs, sum(least(p, o)) AS kept, sum(p) AS pn FROM x GROUP BY 1),
s AS (SELECT example_id, CASE WHEN pn = 0 THEN 0.0 WHEN need = 0 THEN 1.0 ELSE hit / need END AS slot_accuracy, CASE WHEN obs > 0 THEN kept / obs ELSE 1.0 END AS observed_recall, CAST(kept < obs AS INT) AS violation FROM g)"""


def completion(spark, d):
    return V.completion(*cases(spark, d), "example_id", "family")


@query("m3_completion_accuracy", f"WITH {_COMPLETION} SELECT example_id, round(slot_accuracy, 4) AS slot_accuracy FROM s")
def m3(spark, d):
    return completion(spark, d).select("example_id", "slot_accuracy")


@query("m4_observed_recall", f"WITH {_COMPLETION} SELECT example_id, round(observed_recall, 4) AS observed_recall, violation FROM s")
def m4(spark, d):
    return completion(spark, d).select("example_id", "observed_recall", "violation")


_STEP = " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(T.LADDER))


@query("m5_edit_cost", f"WITH {X.TOKS_SQL}, s AS (SELECT example_id, family, CASE level {_STEP} END AS step FROM toks), p AS (SELECT example_id - 1 AS example_id, family, step FROM s), x AS (SELECT coalesce(s.example_id, p.example_id) AS example_id, s.step AS t, p.step AS p FROM s FULL JOIN p ON s.example_id = p.example_id AND s.family = p.family), "
       "g AS (SELECT example_id, count(*) FILTER (p IS NULL) AS lack, count(*) FILTER (t IS NULL) AS over_, coalesce(sum(abs(t - p)), 0) AS steps FROM x GROUP BY 1) SELECT example_id, 3 * least(lack, over_) + 5 * (greatest(lack, over_) - least(lack, over_)) + 2 * steps AS cost, least(lack, over_) > 0 AS cross_family FROM g")
def m5(spark, d):
    step = F.array_position(T.ladder(), F.col("level")) - 1
    s = X.toks(spark, d).select("example_id", "family", step.alias("step"))
    return V.edit_cost(s, s.withColumn("example_id", F.col("example_id") - 1), "example_id")


@query("m6_token_violations", f"WITH {X.TOKS_SQL} SELECT example_id, string_agg(token, ' ' ORDER BY family) <> string_agg(family || '_' || (CASE WHEN level > 51 THEN 51 ELSE level END), ' ' ORDER BY family) AS violation FROM toks GROUP BY 1")
def m6(spark, d):
    t = X.toks(spark, d)
    both = lambda c: F.array_sort(F.collect_list(c))
    canonical = F.concat_ws("_", "family", F.least("level", F.lit(51)))
    return t.groupBy("example_id").agg((both("token") != both(canonical)).alias("violation"))


@query("m7_multi_reference", f"WITH {X.LINES_SQL}, s AS (SELECT example_id, ctx, tier, list(family ORDER BY family) AS f FROM lines GROUP BY ALL), r AS (SELECT DISTINCT ctx, f FROM s WHERE tier = '1-URGENT') SELECT s.example_id, round(coalesce(max(CASE WHEN len(list_intersect(s.f[1:2], r.f)) = len(s.f[1:2]) THEN len(list_intersect(s.f, r.f)) / len(r.f) END), 0), 4) AS best FROM s LEFT JOIN r USING (ctx) WHERE tier = '5-LOW' GROUP BY 1")
def m7(spark, d):
    s = X.lines(spark, d).groupBy("example_id", "ctx", "tier").agg(F.array_sort(F.collect_list("family")).alias("f"))
    r = s.where("tier = '1-URGENT'").select("ctx", F.col("f").alias("r")).distinct()
    own = s.where("tier = '5-LOW'")
    hit = own.select("ctx", "f").distinct().join(r, "ctx").where(F.size(F.array_except(F.slice("f", 1, 2), "r")) == 0)
    best = hit.groupBy("ctx", "f").agg(F.max(F.size(F.array_intersect("f", "r")) / F.size("r")).alias("best"))
    return own.join(best, ["ctx", "f"], "left").select("example_id", F.coalesce("best", F.lit(0.0)).alias("best"))


@query("m8_divergence", f"WITH {_CASES} SELECT CASE WHEN missing + extra = 0 THEN 'same' ELSE 'diverged' END AS slice, count(*) AS n FROM cmp GROUP BY 1")
def m8(spark, d):
    t, _, p = cases(spark, d)
    c = V.multiset_counts(t, p, "example_id", "family", "n")
    return c.groupBy(F.when(F.col("missing") + F.col("extra") == 0, "same").otherwise("diverged").alias("slice")).agg(F.count(F.lit(1)).alias("n"))


def _boot_sql(rows: str, value: str, key: str, seed: str) -> str:
    """Poisson(1) weights by hash, eight of a hash, as in the operator."""
    weight = " + ".join(f"CAST(u >= {c} AS INT)" for c in V.POISSON_CUTS)
    return (f"v AS (SELECT {key} AS k, CAST({value} AS DOUBLE) AS v FROM {rows} WHERE {value} IS NOT NULL), hb AS (SELECT v, b, md5(k || ':' || b || ':{seed}') AS h FROM v, (SELECT unnest(range(25)) AS b)), "
            f"l AS (SELECT v, b * 8 + l AS r, CAST('0x' || substr(h, l * 4 + 1, 4) AS INT) AS u FROM hb, (SELECT unnest(range(8)) AS l)), m AS (SELECT r, sum(v * ({weight})) / sum({weight}) AS m FROM l GROUP BY 1) "
            "SELECT round((SELECT avg(v) FROM v), 2) AS mean, round(quantile_cont(m, 0.025), 2) AS ci_low, round(quantile_cont(m, 0.975), 2) AS ci_high FROM m")


@query("m9_bootstrap_mean", f"WITH {X.EXAMPLES_SQL}, " + _boot_sql("examples", "activation", "example_id", "boot"), mean=2, ci_low=2, ci_high=2)
def m9(spark, d):
    return V.bootstrap_mean(X.examples(spark, d), "activation", "example_id", 200, "boot")


@query("m9b_bootstrap_difference", "WITH df AS (SELECT doc_id, n_chars - (length(text) - doc_id % 7) AS d FROM documents), " + _boot_sql("df", "d", "doc_id", "diff"), mean=2, ci_low=2, ci_high=2)
def m9b(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("a"), (F.length("text") - F.col("doc_id") % 7).alias("b"))
    return V.bootstrap_mean_diff(rows, "a", "b", "doc_id", 200, "diff")


_PAIRS = "pr AS (SELECT doc_id % 4 AS g, n_chars AS a, length(text) - doc_id % 7 AS b FROM documents), pl AS (SELECT l_linenumber % 3 AS g, CAST(l_quantity AS DOUBLE) AS a, CAST((l_orderkey * 7 + l_partkey) % 50 + 1 AS DOUBLE) AS b FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT 9, 1.0, 1.0 FROM region)"
#: Two-sided tail areas by Simpson's rule on 4000 steps from 0 to |x|.
_TAIL = "greatest(0, 1 - 2 * x / 12000 * list_reduce(list_transform(range(4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density}), lambda p, q: p + q, 0.0))"
_NORMAL = _TAIL.format(density="exp(-pow(x * i / 4000, 2) / 2) / sqrt(2 * pi())")
_STUDENT = _TAIL.format(density="exp(lgamma((n) / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * pow(1 + pow(x * i / 4000, 2) / (n - 1), -n / 2)")
_RANKED = "r AS (SELECT g, a - b AS df, rank() OVER (PARTITION BY g ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY g, abs(a - b)) - 1) / 2 AS r FROM {rows}), tc AS (SELECT g, sum(c * c * c - c) AS ties FROM (SELECT g, count(*) AS c FROM r GROUP BY g, abs(df)) GROUP BY 1), s AS (SELECT g, count(*) AS n, sum(CASE WHEN df > 0 THEN r WHEN df = 0 THEN r / 2 ELSE 0 END) AS w, max(abs(df)) AS most FROM r GROUP BY 1), zz AS (SELECT g, n, w, CASE WHEN most > 0 THEN (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) END AS z FROM s JOIN tc USING (g))"


def doc_pairs(spark, d):
    return table(spark, d, "documents").select((F.col("doc_id") % 4).alias("g"), F.col("n_chars").alias("a"), (F.length("text") - F.col("doc_id") % 7).alias("b"))


def line_pairs(spark, d):
    """Few pairs in a group, and a group without any difference."""
    some = table(spark, d, "lineitem").where("l_suppkey = 3").select((F.col("l_linenumber") % 3).cast("long").alias("g"), F.col("l_quantity").cast("double").alias("a"), ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 50 + 1).cast("double").alias("b"))
    return some.unionByName(table(spark, d, "region").select(F.lit(9).cast("long").alias("g"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b")))


@query("m10_paired_t", f"WITH {_PAIRS}, s AS (SELECT g, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM pl GROUP BY 1), t AS (SELECT *, CASE WHEN sd > 0 THEN m / sd ELSE 0 END AS e FROM s), x AS (SELECT *, abs(e * sqrt(n)) AS x FROM t) SELECT g, n, round(m, 4) AS mean_diff, round(e * sqrt(n), 4) AS t, round(e, 4) AS effect, round(CASE WHEN x = 0 THEN 1 ELSE {_STUDENT} END, 4) AS t_p FROM x")
def m10(spark, d):
    return V.t_p_values(V.paired_stats(line_pairs(spark, d), ["g"], "a", "b"))


@query("m10b_wilcoxon", f"WITH {_PAIRS}, {_RANKED.format(rows='pr')} SELECT g, n, round(w, 4) AS w_plus, round(z, 4) AS z FROM zz")
def m10b(spark, d):
    return V.wilcoxon(doc_pairs(spark, d), ["g"], "a", "b")


@query("m10c_p_values", f"WITH {_PAIRS}, {_RANKED.format(rows='pl')}, x AS (SELECT g, z, abs(z) AS x FROM zz) SELECT g, round(CASE WHEN z IS NULL THEN 1 ELSE {_NORMAL} END, 4) AS p FROM x")
def m10c(spark, d):
    return V.p_values(V.wilcoxon(line_pairs(spark, d), ["g"], "a", "b")).select("g", "p")


@query("m11_metric_report", f"WITH {_COMPLETION}, t2 AS (SELECT DISTINCT example_id, tier FROM lines), u AS (SELECT tier, 'slot_accuracy' AS metric, slot_accuracy AS v FROM s JOIN t2 USING (example_id) UNION ALL SELECT tier, 'observed_recall', observed_recall FROM s JOIN t2 USING (example_id)) SELECT tier, metric, round(avg(v), 4) AS mean, count(*) AS n FROM u GROUP BY ALL")
def m11(spark, d):
    c = completion(spark, d).join(X.lines(spark, d).select("example_id", "tier").distinct(), "example_id")
    long = c.unpivot(["tier"], ["slot_accuracy", "observed_recall"], "metric", "v")
    return long.groupBy("tier", "metric").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("m12_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem GROUP BY 1")
def m12(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))


@query("m13_split_half", f"WITH {X.BRANDS_SQL}, x AS (SELECT split, token, activation, CAST('0x' || substr(md5(example_id || ':' || split || ':half'), 1, 2) AS INT) % 2 AS h FROM brands, (SELECT unnest(range(5)) AS split)), g AS (SELECT split, token, sum(CASE WHEN h = 0 THEN activation ELSE 0 END) AS a, sum(CASE WHEN h = 1 THEN activation ELSE 0 END) AS b FROM x GROUP BY ALL) SELECT split, round(CASE WHEN count(*) >= 5 THEN corr(a, b) ELSE 0 END, 4) AS r, count(*) AS n FROM g WHERE a > 0 AND b > 0 GROUP BY 1")
def m13(spark, d):
    return V.split_half(X.brands(spark, d), "example_id", "token", "activation", 5, "half")


@query("m14_shuffle_null", f"WITH {X.BRANDS_SQL}, {X.EXAMPLES_SQL}, k AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.1 + 1e-9) AS INT)) AS m FROM examples), d AS (SELECT example_id, r AS round, row_number() OVER (PARTITION BY r ORDER BY md5(example_id || ':' || r || ':null'), example_id) AS place FROM examples, (SELECT unnest(range(100)) AS r)), "
       "t AS (SELECT example_id, -1 AS round FROM (SELECT example_id FROM examples ORDER BY activation DESC, example_id DESC LIMIT (SELECT m FROM k)) UNION ALL SELECT example_id, round FROM d, k WHERE place <= m), "
       "c AS (SELECT round, token, count(*) AS c FROM t JOIN brands USING (example_id) GROUP BY ALL), s AS (SELECT round, max(c) / sum(c) AS s FROM c GROUP BY 1) SELECT round((SELECT s FROM s WHERE round = -1), 4) AS observed, round(avg(s), 4) AS null_mean, round(avg(CAST(s >= (SELECT s FROM s WHERE round = -1) AS INT)), 4) AS p FROM s WHERE round >= 0")
def m14(spark, d):
    return V.shuffle_null(X.examples(spark, d), X.brands(spark, d), 100, 0.1, "null")


@query("m15_floor_detection", f"WITH {X.ACTS_SQL} SELECT feature_id, round(avg(CASE WHEN activation < 0.1 THEN 1.0 ELSE 0.0 END), 4) AS floor_rate, avg(CASE WHEN activation < 0.1 THEN 1.0 ELSE 0.0 END) > 0.5 AS floored FROM acts GROUP BY 1")
def m15(spark, d):
    from setweave.operators.aggregates import floor_share

    return floor_share(X.acts(spark, d), "feature_id")


_NEXT = """b AS (SELECT example_id - 1 AS example_id, feature_id, activation AS y FROM acts), x AS (SELECT example_id, feature_id, label, activation AS x, y FROM acts JOIN b USING (example_id, feature_id)),
s AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY example_id) AS p, exp(y) / sum(exp(y)) OVER (PARTITION BY example_id) AS q FROM x), c AS (SELECT example_id, avg(pow(x - y, 2)) AS mse, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine, sum(p * ln(p / q)) AS kl, CAST(arg_max(feature_id, x) = arg_max(feature_id, y) AS INT) AS agree,
max(-ln(p)) FILTER (feature_id = label AND label <> 3) AS loss_a, max(-ln(q)) FILTER (feature_id = label AND label <> 3) AS loss_b, CASE WHEN any_value(label) <> 3 THEN CAST(arg_max(feature_id, x) = any_value(label) AS INT) END AS hit_a, CASE WHEN any_value(label) <> 3 THEN CAST(arg_max(feature_id, y) = any_value(label) AS INT) END AS hit_b FROM s GROUP BY 1)"""


@query("m16_vector_comparison", f"WITH {X.ACTS_SQL}, {_NEXT} SELECT example_id, round(mse, 4) AS mse, round(cosine, 4) AS cosine, round(kl, 4) AS kl, agree, round(loss_a, 4) AS loss_a, round(loss_b, 4) AS loss_b, hit_a, hit_b FROM c")
def m16(spark, d):
    return next_compared(spark, d)


def next_compared(spark, d):
    """Each vector against the next one, its label the target; label 3 stands for padding."""
    v = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") != 3, F.col("label")).alias("target"), F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(nxt, "vec_id").select(F.col("vec_id").alias("example_id"), *V.vector_comparison(v, "a", "b", "target"))


@query("m16b_vector_summary", f"WITH {X.ACTS_SQL}, {_NEXT} SELECT count(*) AS n, count(loss_a) AS n_valid, round(avg(mse), 4) AS mse, round(avg(cosine), 4) AS cosine, round(avg(kl), 4) AS kl, round(avg(loss_a), 4) AS loss_a, round(avg(loss_b), 4) AS loss_b, round(avg(hit_a), 4) AS top1_a, round(avg(hit_b), 4) AS top1_b, "
       "round(avg(agree) FILTER (loss_a IS NOT NULL), 4) AS top1_match, round(avg(loss_b) - avg(loss_a), 4) AS loss_increase, round(avg(hit_b) - avg(hit_a), 4) AS top1_change FROM c")
def m16b(spark, d):
    return V.vector_summary(next_compared(spark, d))


@query("m17_metric_vs_outcome", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 10), b AS (SELECT c_nationkey AS k, avg(c_acctbal) AS o FROM customer GROUP BY 1), x AS (SELECT m, o, row_number() OVER (ORDER BY m, k) AS rm, row_number() OVER (ORDER BY o, k) AS ro FROM a JOIN b USING (k)) SELECT round(corr(m, o), 4) AS pearson, round(corr(rm, ro), 4) AS spearman, count(*) AS n FROM x")
def m17(spark, d):
    c = table(spark, d, "customer")
    a = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m")).where("n >= 10").drop("n")
    b = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("o"))
    return K.spearman(a.join(b, "k").withColumn("all", F.lit(1)), ["all"], "m", "o", "k").drop("all")


@query("m17b_outcome_slices", "WITH a AS (SELECT c_nationkey AS k, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 10), b AS (SELECT c_nationkey AS k, avg(c_acctbal) AS o FROM customer GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY m, k) AS r, count(*) OVER () AS n FROM a JOIN b USING (k)), "
       "s AS (SELECT *, CASE WHEN r <= ceil(0.1 * n) THEN 'bottom' WHEN r > n - ceil(0.1 * n) THEN 'top' END AS side FROM x) SELECT side, count(*) AS n, round(avg(o), 2) AS mean, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS members FROM s WHERE side IS NOT NULL GROUP BY 1", mean=2)
def m17b(spark, d):
    """Balances in the tenth of nations with the highest and the lowest mean order."""
    c = table(spark, d, "customer")
    a = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m")).where("n >= 10").drop("n")
    return K.extreme_slices(a.join(c.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("o")), "k"), "m", "o", "k", 0.1)


@query("f34_metric_means", f"WITH {_CASES}, t2 AS (SELECT DISTINCT example_id, tier FROM lines) SELECT tier, round(avg(1 - (missing + extra) / 114.0), 4) AS accuracy, round(avg(CAST(missing + extra = 0 AS INT)), 4) AS exact_hit FROM cmp JOIN t2 USING (example_id) GROUP BY 1")
def f34(spark, d):
    t, _, p = cases(spark, d)
    c = V.compare(t, p, "example_id", "family", "n").join(t.select("example_id", "tier").distinct(), "example_id")
    return c.groupBy("tier").agg(F.avg("accuracy").alias("accuracy"), F.avg(F.col("exact_hit").cast("double")).alias("exact_hit"))


@query("f38_micro_f1", f"WITH {_CASES}, f AS (SELECT example_id, CAST(t > 0 AS INT) AS t, CAST(p > 0 AS INT) AS p FROM c), s AS (SELECT sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM f) SELECT round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM s")
def f38(spark, d):
    t, _, p = cases(spark, d)
    x = t.select("example_id", "family", F.lit(1).alias("t")).join(p.select("example_id", "family", F.lit(1).alias("p")), ["example_id", "family"], "full_outer").na.fill(0)
    return V.micro_f1(x, "t", "p", "family", ["example_id"])
