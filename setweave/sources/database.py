"""Tables in database files as a Spark source: rows are read in ranges, with filters, columns and a limit passed on to the database.

A table is a folder of SQLite files that the driver and the executors mount at the same path; a writing task makes one file, a
reading task takes a range of row ids of one.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, Row, StringType, StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows of a range that one task reads.
RANGE_ROWS = 1_000_000


def local_path(path: str) -> str:
    """The mounted folder behind a path or file: URL; SQLite opens no other."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"database files have to lie in a mounted folder, not in {url.scheme}:")
    return unquote(url.path) if url.scheme else path


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _kind(data_type) -> str:
    if isinstance(data_type, (IntegralType, BooleanType)):
        return "INTEGER"
    if isinstance(data_type, (DoubleType, FloatType)):
        return "REAL"
    if isinstance(data_type, StringType):
        return "TEXT"
    raise ValueError(f"no column type for {data_type.simpleString()}")


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as SQL with its values, or None where the database would answer otherwise than Spark or not at all."""
    if isinstance(f, Not):
        inner = condition(f.child)
        return (f"NOT ({inner[0]})", inner[1]) if inner and not isinstance(f.child, (IsNull, IsNotNull)) else None
    if len(f.attribute) != 1:
        return None
    c = _name(f.attribute[0])
    if isinstance(f, IsNull):
        return f"{c} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{c} IS NOT NULL", []
    if isinstance(f, StringStartsWith):
        return f"substr({c}, 1, {len(f.value)}) = ?", [f.value]
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
    if not all(type(v) in (int, float, str, bool) and v == v for v in values):
        return None
    if isinstance(f, In):
        return f"{c} IN ({', '.join('?' * len(values))})", values
    return (f"{c} {_COMPARED[type(f)]} ?", values) if type(f) in _COMPARED else None


@dataclass
class RowRange(InputPartition):
    path: str
    first: int
    last: int


class TableReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.table = schema, options["table"]
        self.folder, self.limit, self.order = local_path(options["path"]), options.get("limit"), options.get("orderby")
        self.range_rows = int(options.get("rangerows", RANGE_ROWS))
        self.where, self.values = [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        left = []
        for f in filters:
            found = condition(f)
            if found is None:
                left.append(f)
            else:
                self.where.append(found[0])
                self.values += found[1]
        if left:
            self.limit = None  # the limit counts rows that all filters keep; filters that Spark cannot offer are the caller's to watch
        return left

    def partitions(self) -> list[RowRange]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            if name.endswith(".db"):
                path = os.path.join(self.folder, name)
                with _opened(path) as db:
                    most = db.execute(f"SELECT max(rowid) FROM {_name(self.table)}").fetchone()[0] or 0
                out += [RowRange(path, a, a + self.range_rows - 1) for a in range(1, most + 1, self.range_rows)]
        return out

    def statement(self) -> str:
        columns = ", ".join(_name(f.name) for f in self.schema) or "1"
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        order = f" ORDER BY {_name(self.order)}" if self.order else ""
        return f"SELECT {columns} FROM {_name(self.table)} WHERE {where}{order}" + (f" LIMIT {int(self.limit)}" if self.limit is not None else "")

    def read(self, partition: RowRange) -> Iterator[tuple]:
        flags = [i for i, f in enumerate(self.schema) if isinstance(f.dataType, BooleanType)]
        with _opened(partition.path) as db:
            for row in db.execute(self.statement(), [partition.first, partition.last, *self.values]):
                if flags:
                    row = tuple(bool(v) if i in flags and v is not None else v for i, v in enumerate(row))
                yield row if len(self.schema) else ()


class _opened:
    """A database file, read only."""

    def __init__(self, path: str) -> None:
        self.db = sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)

    def __enter__(self) -> sqlite3.Connection:
        return self.db

    def __exit__(self, *error: object) -> None:
        self.db.close()


@dataclass
class Written(WriterCommitMessage):
    path: str


class TableWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.table, self.folder = schema, options["table"], local_path(options["path"])

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{uuid.uuid4().hex}.part")  # seen by readers once the job commits it
        db = sqlite3.connect(path)
        db.execute(f"CREATE TABLE {_name(self.table)} ({', '.join(f'{_name(f.name)} {_kind(f.dataType)}' for f in self.schema)})")
        db.executemany(f"INSERT INTO {_name(self.table)} VALUES ({', '.join('?' * len(self.schema))})", (tuple(r) for r in rows))
        db.commit()
        db.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                os.rename(m.path, m.path.removesuffix(".part") + ".db")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class TableSource(DataSource):
    """Options: path, table; for reading also limit and orderBy, which each range applies by itself, and rangeRows."""

    @classmethod
    def name(cls) -> str:
        return "setweave_table"

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(schema, self._options())

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(schema, self._options())

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}


def write_table(rows: DataFrame, path: str, table: str) -> None:
    """Append rows to a table, one database file a task."""
    rows.sparkSession.dataSource.register(TableSource)
    rows.write.format(TableSource.name()).option("path", path).option("table", table).mode("append").save()


def scan_table(spark: SparkSession, path: str, table: str, columns: str, where: str | None = None, limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """`SELECT columns FROM table WHERE where ORDER BY order_by LIMIT limit`.

    columns is a schema in DDL of the columns wanted, those of where and order_by included, and only these are asked for. Filters that the database answers as Spark
    would are passed on; where all are, each range returns no more than limit rows, the first by order_by, and Spark takes the first of these.
    """
    spark.dataSource.register(TableSource)
    spark.conf.set(PUSHDOWN, "true")

    def rows(**options: object) -> DataFrame:
        found = spark.read.format(TableSource.name()).schema(columns).options(path=path, table=table, **options).load()
        return found.where(where) if where else found

    if limit is None:
        found = rows()
    elif where and "Filter" in rows()._jdf.queryExecution().optimizedPlan().toString():  # Spark has filters left, and a range's limit would come before them
        found = rows()
    else:
        found = rows(limit=limit, **({"orderBy": order_by} if order_by else {}))
    found = found.orderBy(F.col(order_by).asc_nulls_first()) if order_by else found
    return found.limit(limit) if limit is not None else found
