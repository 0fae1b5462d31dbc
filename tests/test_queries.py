"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REFERENCE = {n: f for m in __spark_entry__.PLANS for n, f in m.Q.items()}
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(([plain(v) for v in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(REFERENCE))
def test_query(spark, small, duck, name):
    got = __spark_entry__.queries()[name](spark, small).toPandas()
    assert len(got)
    if name not in SQL:
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-5 * max(1.0, abs(q))), (x, y)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(__spark_entry__.queries())
