"""Running state by key in Spark's state store.

A batch reads and writes the state of the keys it holds and of no others, each version is written with the batch's number, and
a batch that is run again starts from the version before it. What the store holds is read back as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from setweave.functions.session import setting

#: Spark's store on RocksDB, which keeps states on disk and writes the changes of a batch; arbitrary state needs it.
PROVIDER_KEY, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_state(updates: DataFrame, checkpoint: str) -> StreamingQuery:
    """Work off what has arrived; only the state is kept."""
    with setting(updates.sparkSession, PROVIDER_KEY, PROVIDER):
        q = updates.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_state(stream: DataFrame, checkpoint: str, **options: object) -> DataFrame:
    return stream.sparkSession.read.format("statestore").options(**options).load(checkpoint)


class MovingUsage(StatefulProcessor):
    """usage and n of a key: values of a batch are folded in order of (time, tie)."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("usage", "usage double, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        values = pd.concat(list(rows)).sort_values(["moment", "tie"])["value"].fillna(0.0)
        usage, n = self.state.get() if self.state.exists() else (0.0, 0)
        for v in values:
            usage = self.alpha * usage + (1 - self.alpha) * v
        self.state.update((usage, n + len(values)))
        yield pd.DataFrame({"n": [n + len(values)]})

    def close(self) -> None:
        pass


class LastValues(StatefulProcessor):
    """The last `size` rows of a key by (time, tie)."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "time long, tie long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.ring.get()]
        for piece in rows:  # a key with many rows comes in pieces; no more than the ring is kept of them
            held += [(int(t), int(i), None if pd.isna(v) else float(v)) for t, i, v in zip(piece["moment"], piece["tie"], piece["value"])]
            held = sorted(held, key=lambda r: r[:2])[-self.size :]
        self.ring.put(held)
        yield pd.DataFrame({"n": [len(held)]})

    def close(self) -> None:
        pass


def _rows(stream: DataFrame, by: str, time: str, tie: str, value: str) -> DataFrame:
    rows = stream.select(F.col(by), F.unix_micros(F.col(time).cast("timestamp")).alias("moment"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    return rows.where("moment is not null and tie is not null")


def _latest(size: int, by: str):
    """Within each piece of a task, a key's last rows: what a hot key sends to its state does not grow with the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(["moment", "tie"]).groupby(by, dropna=False, sort=False).tail(size)

    return run


def moving_usage(stream: DataFrame, by: str, time: str, tie: str, value: str, checkpoint: str, alpha: float = 0.99) -> DataFrame:
    """(by, usage, n) once the stream's files are worked off: exponential moving average of each key from 0.

    Batches follow one another and a batch's rows are in order of (time, tie); a null value counts as 0, rows without time or tie take no part. The
    order makes a key's rows of a batch one task's work, so batches bound it (files_per_batch).
    """
    rows = _rows(stream, by, time, tie, value)
    run_state(rows.groupBy(by).transformWithStateInPandas(MovingUsage(alpha), "n long", "Update", "None"), checkpoint)
    return read_state(stream, checkpoint, stateVarName="usage").select(f"key.{by}", "value.usage", "value.n")


def last_values(stream: DataFrame, by: str, time: str, tie: str, value: str, size: int, checkpoint: str) -> DataFrame:
    """(by, time, tie, value) once the stream's files are worked off: the last `size` rows of each key, rows without time or tie left out."""
    rows = _rows(stream, by, time, tie, value)
    latest = rows.mapInPandas(_latest(size, by), rows.schema)
    run_state(latest.groupBy(by).transformWithStateInPandas(LastValues(size), "n long", "Update", "None"), checkpoint)
    held = read_state(stream, checkpoint, stateVarName="ring")
    return held.select(f"key.{by}", F.timestamp_micros("list_element.time").alias(time), F.col("list_element.tie").alias(tie), F.col("list_element.value").alias(value))


def document_frequency(stream: DataFrame, token: str, doc: str, checkpoint: str) -> DataFrame:
    """(token, df) once the stream's files are worked off: in how many different docs each token lies.

    One state for each pair says that it is known, one for each token counts: a token in very many documents has no large state. Rows without token or doc take no part.
    """
    pairs = stream.select(token, doc).where(F.col(token).isNotNull() & F.col(doc).isNotNull()).dropDuplicates([token, doc])
    run_state(pairs.groupBy(token).agg(F.count(F.lit(1)).alias("df")), checkpoint)
    return read_state(stream, checkpoint, operatorId=0).select(f"key.{token}", F.col("value.count").alias("df"))  # the state holds the running count
