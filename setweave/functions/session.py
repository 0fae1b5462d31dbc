"""Session helpers: reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch to delete a query's shuffle files when it ends; files that are written and read again need them no longer.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Frames made by written() and bucketed() and not forgotten yet, by folder.
MADE: dict[str, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh temporary one where a local session names none.

    On a cluster a local folder would be seen by one machine only, so a session without the setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="setweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Every later use reads the files, so nothing is computed twice and a lost
    executor costs only the tasks it was running. The query's shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/setweave-{uuid.uuid4().hex}"
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    MADE[path.rpartition("/")[2]] = made = spark.read.schema(df.schema).parquet(path)
    return made


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like written(), as a table in `buckets` buckets of key: joins on the key leave its rows where they are. forget() drops it."""
    spark = df.sparkSession
    name = f"setweave_{uuid.uuid4().hex}"
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    MADE[name] = spark.table(name)
    return MADE[name]


def forget(*frames: DataFrame) -> None:
    """Delete the files (and the table) behind frames made by written() or bucketed(), once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
            MADE.pop(folder.getName(), None)
            if folder.getName().startswith("setweave_"):
                spark.sql(f"DROP TABLE IF EXISTS {folder.getName()}")
            folder.getFileSystem(conf).delete(folder, True)
