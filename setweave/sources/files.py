"""Readers and writers: logs, lists in text, dictionaries, matrices and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv_union(spark: SparkSession, *paths: str, schemas: list[str]) -> DataFrame:
    """All CSV files of each path with its schema, united by name; columns that one lacks are null."""
    out = None
    for path, schema in zip(paths, schemas):
        df = spark.read.csv(path, header=True, schema=schema)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def high_water_mark(df: DataFrame, column: str):
    """The greatest value, or None of an empty table."""
    return df.agg(F.max(column)).first()[0]


def newer_than(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows past the mark; all of them without one."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))


def write_partitioned(df: DataFrame, path: str, *by: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").partitionBy(*by).option("compression", compression).parquet(path)


def write_clustered(df: DataFrame, path: str, by: str, *then: str, files: int = 8) -> None:
    """Parquet in ranges of one key, sorted within each file, so that a read of one key opens the row groups that hold it."""
    df.repartitionByRange(files, by).sortWithinPartitions(by, *then).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_token_lists(spark: SparkSession, path: str, ids: str = "ability_tags", ctx: str = "weapon_id") -> DataFrame:
    """Tab-separated rows with a JSON list column; contexts that are no integers become null."""
    df = spark.read.csv(path, sep="\t", header=True, quote="\u0000")
    missing = {ids, ctx} - set(df.columns)
    if missing:
        raise ValueError(f"columns not found: {sorted(missing)}")
    return df.withColumn(ids, F.from_json(ids, "array<int>")).withColumn(ctx, F.expr(f"try_cast(`{ctx}` as int)"))


def read_dictionary(spark: SparkSession, path: str, key: str = "token", value: str = "token_id") -> DataFrame:
    """A JSON object of names to numbers as a two-column dimension."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias(key, value))


def matrix_to_long(rows: DataFrame, key: str, vector: str, feature: str = "feature_id", value: str = "activation", nonzero: bool = True) -> DataFrame:
    long = rows.select(key, F.posexplode(vector).alias(feature, value))
    return long.where(F.col(value) != 0) if nonzero else long


def global_index(rows: DataFrame, batch: str, sample: str) -> DataFrame:
    """rows with global_index: the batch's offset and the row's place in it; only batch sizes pass a single window."""
    sizes = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_o", F.sum("_n").over(Window.orderBy(batch)) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(batch).orderBy(sample)) - 1
    return rows.join(offsets, batch).withColumn("global_index", F.col("_o") + place).drop("_o")


def batch_summary(rows: DataFrame, batch: str) -> DataFrame:
    """(num_batches, total_examples, largest_batch)."""
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("num_batches"), F.sum("n").alias("total_examples"), F.max("n").alias("largest_batch"))


def feature_fetch(acts: DataFrame, examples: DataFrame, feature: int, include_negative: bool = True, columns: tuple[str, ...] = ("ctx",), limit: int | None = None) -> DataFrame:
    """One feature's activations with the examples' columns asked for; over a table of write_clustered() the filter on the feature reaches the scan."""
    a = acts.where(F.col("feature_id") == feature)
    a = a if include_negative else a.where("activation > 0")
    out = a.join(examples.select("example_id", *columns), "example_id")
    return out.orderBy("example_id").limit(limit) if limit else out


def dense_feature_fetch(rows: DataFrame, feature: int, example: str, activations: str, include_negative: bool = True, columns: tuple[str, ...] = ("ctx",), limit: int | None = None) -> DataFrame:
    """The same out of a dense matrix with a row for each example: the array's element is taken in the scan, nothing is exploded or joined."""
    a = rows.select(F.col(example).alias("example_id"), F.get(activations, feature).cast("double").alias("activation"), *columns).where("activation is not null")
    a = a if include_negative else a.where("activation > 0")
    return a.orderBy("example_id").limit(limit) if limit else a


def report_metrics(reports: DataFrame) -> DataFrame:
    """(method, metric, mask, mean) out of nested reports: reports[].all.summaries[]."""
    return reports.select(F.explode("reports").alias("r")).select("r.method", F.explode("r.all.summaries").alias("s")).select(
        "method", "s.metric", F.col("s.mask").cast("int").alias("mask"), F.col("s.mean").cast("double").alias("mean"))


def export_labels(labels: DataFrame, path: str) -> None:
    """CSV by feature_id, nulls blank."""
    strings = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in labels.columns]
    labels.orderBy("feature_id").select(*strings).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
