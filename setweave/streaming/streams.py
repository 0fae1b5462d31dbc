"""Incremental forms of the operators as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setweave.functions.tokens import hashed
from setweave.operators.aggregates import bin_index, merged_sketches, quantile_sketches


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, merge) -> None:
    """merge(batch, batch_id) for every micro-batch that has arrived."""
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest(stream: DataFrame, key: str, time: str, path: str, checkpoint: str, delay: str = "1 day") -> None:
    """Append new rows to a Parquet table, each key once within the watermark."""
    q = (stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]).writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stats_merge(previous: DataFrame | None, batch: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total, min, max) of all batches so far."""
    v = F.col(value)
    new = batch.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"))
    both = new if previous is None else previous.unionByName(new)
    return both.groupBy(by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"))


def histogram_merge(previous: DataFrame | None, batch: DataFrame, by: str, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin_idx, count) over fixed bins of all batches so far."""
    new = batch.withColumn("bin_idx", bin_index(F.col(value), F.lit(lo), F.lit(hi), bins)).where("bin_idx is not null").groupBy(by, "bin_idx").agg(F.count(F.lit(1)).alias("count"))
    both = new if previous is None else previous.unionByName(new)
    return both.groupBy(by, "bin_idx").agg(F.sum("count").alias("count"))


def sketch_merge(previous: DataFrame | None, batch: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, sketch) of all batches so far: quantile sketches of bounded size, merged; what is kept does not grow with the rows."""
    new = quantile_sketches(batch, by, value)
    return new if previous is None else merged_sketches(previous.unionByName(new), by)


def top_k_merge(previous: DataFrame | None, batch: DataFrame, by: str, value: str, tie: str, k: int) -> DataFrame:
    both = batch if previous is None else previous.unionByName(batch)
    w = Window.partitionBy(by).orderBy(F.desc(value), tie)
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def reservoir_merge(previous: DataFrame | None, batch: DataFrame, by: str, key: str, seed: str, k: int) -> DataFrame:
    """The k rows of least hash per group so far: a uniform sample that does not depend on the batches."""
    both = batch if previous is None else previous.unionByName(batch)
    w = Window.partitionBy(by).orderBy(hashed(F.col(key), seed), key)
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def usage_merge(previous: DataFrame | None, batch: DataFrame, by: str, time: str, tie: str, value: str, alpha: float = 0.99) -> DataFrame:
    """(by, usage, n): exponential moving average of each key from 0, values of a batch in order of time.

    A batch of k values comes to one factor alpha ** k for what was before and one weighted sum, so the
    average is a fold of batches.
    """
    late = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time), F.desc(tie))) - 1
    new = batch.withColumn("_late", late).groupBy(by).agg(F.count(F.lit(1)).alias("_k"), F.sum(F.pow(F.lit(alpha), "_late") * (1 - alpha) * F.col(value)).alias("_s"))
    before = new.sparkSession.createDataFrame([], f"{by} {batch.schema[by].dataType.simpleString()}, usage double, n long") if previous is None else previous
    usage = F.coalesce("usage", F.lit(0.0)) * F.pow(F.lit(alpha), F.coalesce("_k", F.lit(0))) + F.coalesce("_s", F.lit(0.0))
    return before.join(new, by, "full_outer").select(by, usage.alias("usage"), (F.coalesce("n", F.lit(0)) + F.coalesce("_k", F.lit(0))).cast("long").alias("n"))
