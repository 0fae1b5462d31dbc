"""The canonical relations that the registered queries run on, built from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.session import table
from setweave.functions.tokens import LADDER, level_of

_STEPS = " ".join(f"WHEN ap >= {t} THEN {t}" for t in reversed(LADDER))
LINES_SQL = """lines AS (
  SELECT o_orderkey AS example_id, c_mktsegment AS ctx, o_totalprice AS activation, o_orderpriority AS tier,
         lower(p_type) AS family, CAST(sum(l_quantity) AS INTEGER) AS ap
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL)"""
TOKS_SQL = LINES_SQL + f""", toks AS (
  SELECT *, family || '_' || level AS token FROM (SELECT *, CASE {_STEPS} END AS level FROM lines WHERE ap >= 3))"""
BRANDS_SQL = """brands AS (
  SELECT DISTINCT o_orderkey AS example_id, c_mktsegment AS ctx, o_totalprice AS activation, p_brand AS token
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
ACTS_SQL = """acts AS (
  SELECT unnest(range(len(embedding))) AS feature_id, vec_id AS example_id, CAST(unnest(embedding) AS DOUBLE) AS activation, label FROM embeddings)"""
EXAMPLES_SQL = """examples AS (
  SELECT o_orderkey AS example_id, c_mktsegment AS ctx, o_totalprice AS activation, o_orderpriority AS tier FROM orders JOIN customer ON o_custkey = c_custkey)"""


def examples(spark: SparkSession, d: str) -> DataFrame:
    """(example_id, ctx, activation, tier), one row per order."""
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("example_id"), F.col("c_mktsegment").alias("ctx"), F.col("o_totalprice").alias("activation"), F.col("o_orderpriority").alias("tier"))


def _parts(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("example_id"), *columns)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(example_id, ctx, activation, tier, family, ap): points by family, the families being part types."""
    points = _parts(spark, d, F.lower("p_type").alias("family"), F.col("l_quantity")).groupBy("example_id", "family").agg(F.sum("l_quantity").cast("int").alias("ap"))
    return points.join(examples(spark, d), "example_id").select("example_id", "ctx", "activation", "tier", "family", "ap")


def toks(spark: SparkSession, d: str) -> DataFrame:
    """lines of three points or more, with the level reached and its token."""
    return lines(spark, d).where("ap >= 3").withColumn("level", level_of(F.col("ap"))).withColumn("token", F.concat_ws("_", "family", "level"))


def brands(spark: SparkSession, d: str) -> DataFrame:
    """(example_id, ctx, activation, token): the different brands of an order."""
    return _parts(spark, d, F.col("p_brand").alias("token")).distinct().join(examples(spark, d), "example_id").select("example_id", "ctx", "activation", "token")


def acts(spark: SparkSession, d: str) -> DataFrame:
    """(feature_id, example_id, activation, label): the embedding matrix in long form."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id"), "label", F.posexplode("embedding").alias("feature_id", "a")).select(
        "feature_id", "example_id", F.col("a").cast("double").alias("activation"), "label")
