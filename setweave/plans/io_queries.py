"""Queries of sources, sinks and streams. What they write goes to the session's shared folder, each call to a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.session import shared_dir, table
from setweave.operators import aggregates as A
from setweave.plans import relations as X
from setweave.plans.aggregate_queries import D
from setweave.sources import database as T
from setweave.sources import files as S
from setweave.streaming import keyed as Y
from setweave.streaming import streams as W

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, **rounded: int):
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


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/io-{name}-{uuid.uuid4().hex}"


def event_files(spark: SparkSession, d: str, n: int = 3) -> tuple[str, str]:
    """(path, schema) of the events as n or more files for the file stream, which arrive in order of time."""
    path = folder(spark, "events")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    second = F.unix_micros("ts")
    cuts = e.agg(F.percentile_approx(second, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    ends = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(ends, ends[1:]):
        part = F.lit(True) if lo is None else second > lo
        e.where(part & (F.lit(True) if hi is None else second <= hi)).coalesce(1).write.mode("append").parquet(path)
    return path, ", ".join(f"{c} {t}" for c, t in e.dtypes)


@query("a1_csv_union", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_acctbal AS balance, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def a1(spark, d):
    a, b = folder(spark, "a1"), folder(spark, "a1")
    table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).write.option("header", True).csv(a)
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).write.option("header", True).csv(b)
    return S.read_csv_union(spark, a, b, schemas=["id long, name string, balance double", "id long, name string, nation int"])


@query("a2_incremental_load", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')")
def a2(spark, d):
    e = table(spark, d, "events")
    return S.newer_than(e, "ts", S.high_water_mark(e.where("ts < timestamp '2024-01-20'"), "ts")).select("event_id")


@query("a3_append_and_mark", "SELECT count(*) AS n, max(event_id) AS mark FROM events")
def a3(spark, d):
    path, e = folder(spark, "a3"), table(spark, d, "events")
    e.where("event_id % 2 = 0").write.mode("append").parquet(path)
    e.where("event_id % 2 = 1").write.mode("append").parquet(path)
    return spark.read.schema(e.schema).parquet(path).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("mark"))


@query("a4_csv_append", "SELECT o_orderkey, o_orderstatus FROM orders")
def a4(spark, d):
    path, o = folder(spark, "a4"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("o_orderstatus = 'O'", "o_orderstatus <> 'O'"):
        S.append_csv(o.where(status), path)
    return spark.read.csv(path, header=True, schema="o_orderkey long, o_orderstatus string")


@query("a5_partitioned_parquet", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1", balance=2)
def a5(spark, d):
    path = folder(spark, "a5")
    S.write_partitioned(table(spark, d, "customer"), path, "c_mktsegment")
    # the key comes back from the folders' names, and the filter reads only the folders it needs
    return spark.read.parquet(path).where("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"))


@query("a6_partition_recovery", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def a6(spark, d):
    path = folder(spark, "a6")
    S.write_partitioned(table(spark, d, "events"), path, "event_type", compression="zstd")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("a7_token_list_tsv", "SELECT user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS weapon_id, user_id || ' 7' AS ability_tags FROM (SELECT DISTINCT user_id FROM events)")
def a7(spark, d):
    path = folder(spark, "a7")
    u = table(spark, d, "events").select("user_id").distinct()
    u.select("user_id", F.concat(F.lit("["), "user_id", F.lit(", 7]")).alias("ability_tags"), F.when(F.col("user_id") % 10 == 0, "none").otherwise(F.col("user_id").cast("string")).alias("weapon_id")).write.option("header", True).option("sep", "\t").option("quote", "\u0000").csv(path)
    r = S.read_token_lists(spark, path)
    return r.select(F.col("user_id").cast("long").alias("user_id"), F.col("weapon_id").cast("long").alias("weapon_id"), F.array_join(F.transform("ability_tags", lambda x: x.cast("string")), " ").alias("ability_tags"))


@query("a8_limited_scan", "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 100")
def a8(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand").orderBy("p_partkey").limit(100)


@query("a8b_database_scan", "SELECT p_partkey, p_brand FROM part WHERE p_size > 10 AND p_type LIKE 'S%' ORDER BY p_partkey LIMIT 200")
def a8b(spark, d):
    path = folder(spark, "a8b")
    T.write_table(table(spark, d, "part"), path, "part")
    return T.scan_table(spark, path, "part", "p_partkey long, p_brand string, p_size long, p_type string", "p_size > 10 and p_type like 'S%'", 200, "p_partkey").select("p_partkey", "p_brand")


@query("a9_json_dictionary", "SELECT p_brand AS token, CAST(count(*) AS INT) AS token_id FROM part GROUP BY 1")
def a9(spark, d):
    path = folder(spark, "a9")
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).cast("int").alias("n"))
    g.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "n")))).alias("value")).write.text(path)  # a vocabulary, one object
    return S.read_dictionary(spark, path)


@query("a10_dense_to_long", f"WITH {X.ACTS_SQL}, g AS (SELECT label, vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS global_index FROM embeddings) SELECT global_index, count(*) AS n, round(sum(activation), 4) AS total FROM acts JOIN g ON example_id = vec_id WHERE activation <> 0 GROUP BY 1")
def a10(spark, d):
    e = S.global_index(table(spark, d, "embeddings"), "label", "vec_id")
    return S.matrix_to_long(e, "global_index", "embedding").groupBy("global_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("activation").cast("double")).alias("total"))


@query("a11_feature_major", f"WITH {X.ACTS_SQL} SELECT example_id, round(activation, 4) AS activation FROM acts WHERE feature_id = 5")
def a11(spark, d):
    path = folder(spark, "a11")
    S.write_clustered(X.acts(spark, d), path, "feature_id", "example_id")
    return spark.read.parquet(path).where("feature_id = 5").select("example_id", "activation")


@query("a12_batch_summary", "SELECT count(*) AS num_batches, CAST(sum(n) AS BIGINT) AS total_examples, max(n) AS largest_batch FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def a12(spark, d):
    return S.batch_summary(table(spark, d, "embeddings"), "label")


@query("a15_example_store", f"WITH {X.ACTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, example_id) AS r FROM acts) SELECT feature_id, count(*) AS n_examples, round(max(activation), 4) AS max_activation, round(avg(activation), 4) AS mean_activation FROM t WHERE r <= 20 GROUP BY 1")
def a15(spark, d):
    from setweave.operators.ranking import top_per_group

    path = folder(spark, "a15")
    S.write_clustered(top_per_group(X.acts(spark, d), "feature_id", 20), path, "feature_id", "rank")
    return spark.read.parquet(path).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_examples"), F.max("activation").alias("max_activation"), F.avg("activation").alias("mean_activation"))


@query("a16_feature_fetch", f"WITH {X.ACTS_SQL} SELECT example_id, round(activation, 4) AS activation, label AS ctx FROM acts WHERE feature_id = 9 AND activation > 0 ORDER BY example_id LIMIT 100")
def a16(spark, d):
    return S.dense_feature_fetch(table(spark, d, "embeddings").withColumnRenamed("label", "ctx"), 9, "vec_id", "embedding", False, limit=100).select("example_id", "activation", "ctx")


@query("a17_label_export", "SELECT doc_id AS feature_id, CASE WHEN quality = 1 THEN 'good' END AS display_name FROM labels")
def a17(spark, d):
    path = folder(spark, "a17")
    S.export_labels(table(spark, d, "labels").select(F.col("doc_id").alias("feature_id"), F.when(F.col("quality") == 1, "good").alias("display_name")), path)
    return spark.read.csv(path, header=True, schema="feature_id long, display_name string")


@query("a18_report_metrics", "SELECT o_orderstatus AS method, o_orderpriority AS metric, 1 AS mask, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ALL", mean=2)
def a18(spark, d):
    path = folder(spark, "a18")
    g = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    s = g.groupBy(F.col("o_orderstatus").alias("method")).agg(F.struct(F.collect_list(F.struct(F.col("o_orderpriority").alias("metric"), F.lit("1").alias("mask"), "mean")).alias("summaries")).alias("all"))
    s.agg(F.collect_list(F.struct("method", "all")).alias("reports")).write.json(path)
    return S.report_metrics(spark.read.json(path))


@query("n1_stream_ingest", "SELECT count(*) AS n, max(event_id) AS mark FROM events")
def n1(spark, d):
    path, schema = event_files(spark, d)
    out, check = folder(spark, "n1"), folder(spark, "n1c")
    # every event arrives twice; the stream keeps one
    src = W.file_stream(spark, path, schema, 10)
    W.ingest(src.unionByName(src), "event_id", "ts", out, check, "60 days")
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("mark"))


@query("n2_running_stats", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def n2(spark, d):
    return _merged(spark, d, lambda p, b: W.stats_merge(p, b, "event_type", "value"))


@query("n2b_running_histogram", "SELECT event_type, least(CAST(floor(value / 5) AS INT), 9) AS bin_idx, count(*) AS count FROM events WHERE value BETWEEN 0 AND 50 GROUP BY ALL")
def n2b(spark, d):
    return _merged(spark, d, lambda p, b: W.histogram_merge(p, b, "event_type", "value", 0.0, 50.0, 10))


@query("n2c_running_quantiles", "SELECT event_type, share, count(*) AS n, true AS within FROM events, (VALUES (0.05), (0.5), (0.95)) q(share) WHERE value IS NOT NULL GROUP BY ALL", share=2)
def n2c(spark, d):
    """Quantiles from sketches merged batch by batch; within tells whether the share of values on either side is that asked for, but for the sketch's error."""
    kept = _merged(spark, d, lambda p, b: W.sketch_merge(p, b, "event_type", "value"))
    q = A.sketch_quantiles(kept, "event_type", (0.05, 0.5, 0.95))
    return A.rank_error(q, table(spark, d, "events"), "event_type", "value").select("event_type", "share", "n", (F.col("error") <= A.SKETCH_ERROR).alias("within"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    path, schema = event_files(spark, d)
    return W.file_stream(spark, path, schema)


def _merged(spark: SparkSession, d: str, merge) -> DataFrame:
    """The state that merge(previous, batch) leaves after all batches, one written table a batch, named by its number: a batch that is run again finds what it found before."""
    path, schema = event_files(spark, d)
    root, last = folder(spark, "state"), []

    def step(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.parquet(f"{root}/{batch_id - 1}") if batch_id else None
        merge(before, batch).write.mode("overwrite").parquet(f"{root}/{batch_id}")
        last[:] = [batch_id]

    W.run_batches(W.file_stream(spark, path, schema), folder(spark, "check"), step)
    return spark.read.parquet(f"{root}/{last[0]}")


@query("n3_running_top_k", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10")
def n3(spark, d):
    return _merged(spark, d, lambda p, b: W.top_k_merge(p, b, "event_type", "value", "event_id", 10)).select("event_type", "event_id", "value")


@query("n4_running_document_frequency", "SELECT user_id, count(*) AS df FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def n4(spark, d):
    return Y.document_frequency(_events(spark, d), "user_id", "event_type", folder(spark, "check"))


@query("n5_running_reservoir", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':5'), event_id) AS r FROM events) WHERE r <= 10")
def n5(spark, d):
    return _merged(spark, d, lambda p, b: W.reservoir_merge(p, b, "event_type", "event_id", "5", 10)).select("event_type", "event_id")


@query("n6_moving_usage", "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.99 * a + 0.01 * x, 0.0), 4) AS usage, count(*) AS n FROM events GROUP BY 1")
def n6(spark, d):
    return Y.moving_usage(_events(spark, d), "user_id", "ts", "event_id", "value", folder(spark, "check"))


@query("n7_last_values", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, count(*) AS held, max(value) FILTER (r = 1) AS newest, round(sum(value), 4) AS total FROM r WHERE r <= 16 GROUP BY 1")
def n7(spark, d):
    t = Y.last_values(_events(spark, d), "user_id", "ts", "event_id", "value", 16, folder(spark, "check"))
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"), F.max_by("value", F.struct("ts", "event_id")).alias("newest"), F.sum("value").alias("total"))
