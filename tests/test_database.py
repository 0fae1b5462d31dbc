"""Tables in database files: what is written is read back, and filters and limits reach the database."""

import os

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringContains, StringStartsWith
from pyspark.sql.types import StructType

from setweave.sources import database

KIND = "id long, name string, x double, ok boolean"
ROWS = [(i, None if i % 7 == 3 else f"n{i % 5} é'\"", i / 4, i % 2 == 0) for i in range(100)] + [(None, "", None, None)]


@pytest.fixture()
def folder(spark, tmp_path):
    path = f"file://{tmp_path}/a folder"
    database.write_table(spark.createDataFrame(ROWS, KIND).repartition(3), path, 'my "table"')
    assert len([f for f in os.listdir(f"{tmp_path}/a folder")]) == len([f for f in os.listdir(f"{tmp_path}/a folder") if f.endswith(".db")]) >= 1
    return path


def test_round_trip(spark, folder):
    rows = database.scan_table(spark, folder, 'my "table"', KIND).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, ROWS))
    assert database.scan_table(spark, folder, 'my "table"', "x double").count() == 101


@pytest.mark.parametrize("where", ["id > 90", "id between 10 and 12 or id = 40", "name is null", "name like 'n3%' and id < 50", "x in (1.5, 2.0, 9)", "not id = 5 and id <= 8", "ok", "name = ''", "name like '%é%' and not ok", "upper(name) like 'N1%'", "id is null"])
def test_filters_equal_sparks_own(spark, folder, where):
    got = database.scan_table(spark, folder, 'my "table"', KIND, where)
    want = spark.createDataFrame(ROWS, KIND).where(where)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_limit(spark, folder):
    got = database.scan_table(spark, folder, 'my "table"', "id long, ok boolean", "id > 20 and ok", 5, "id").collect()
    assert [r.id for r in got] == [22, 24, 26, 28, 30]
    # a filter that stays with Spark keeps the limit from being applied before it
    got = database.scan_table(spark, folder, 'my "table"', "id long, name string", "upper(name) like 'N4%'", 4, "id").collect()
    assert [r.id for r in got] == [4, 9, 14, 19]


def test_what_is_passed_on(tmp_path):
    schema = StructType().add("id", "long").add("name", "string")
    reader = database.TableReader(schema, {"path": str(tmp_path), "table": "t", "limit": "9", "rangerows": "10"})
    assert reader.pushFilters([GreaterThan(("id",), 4), Not(EqualTo(("name",), "a'b")), IsNotNull(("name",)), IsNull(("id",)), In(("id",), (1, 2)), StringStartsWith(("name",), "n%")]) == []
    assert reader.statement() == 'SELECT "id", "name" FROM "t" WHERE rowid BETWEEN ? AND ? AND "id" > ? AND NOT ("name" = ?) AND "name" IS NOT NULL AND "id" IS NULL AND "id" IN (?, ?) AND substr("name", 1, 2) = ? LIMIT 9'
    assert reader.values == [4, "a'b", 1, 2, "n%"]
    odd = [StringContains(("name",), "x"), EqualTo(("s", "t"), 1), GreaterThan(("id",), float("nan")), Not(IsNull(("id",)))]
    assert reader.pushFilters(odd) == odd and "LIMIT" not in reader.statement()
    with pytest.raises(ValueError):
        database.local_path("hdfs://x/y")


def test_ranges_cover_a_file_once(spark, tmp_path):
    database.write_table(spark.range(95).coalesce(1), str(tmp_path), "t")
    reader = database.TableReader(StructType().add("id", "long"), {"path": str(tmp_path), "table": "t", "rangerows": "10"})
    parts = reader.partitions()
    assert len(parts) == 10 and sorted(r[0] for p in parts for r in reader.read(p)) == list(range(95))
