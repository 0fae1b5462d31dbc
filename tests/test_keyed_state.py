"""Running state by key: results, touched keys and batches that are run again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from setweave.streaming import keyed, streams

KIND = "k string, ts timestamp, i long, v double"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "k string, s long, i long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "i", "v").coalesce(1).write.mode("append").parquet(folder)


def batches(n_batches=3, n=40):
    """Keys a to g and a null one; the later batches hold fewer keys; values and ties repeat."""
    out, i = [], 0
    for b in range(n_batches):
        rows = []
        for j in range(n):
            i += 1
            rows.append((["a", "b", None, "c", "d", "e", "f", "g"][j % (8 - 3 * b)], b * 1000 + j * 7 % 13, i, None if j % 11 == 5 else float(i * 37 % 101)))
        out.append(rows)
    return out


def usage_of(all_rows):
    state = {}
    for rows in all_rows:
        for k, _, _, v in sorted(rows, key=lambda r: (r[1], r[2])):
            u, n = state.get(k, (0.0, 0))
            state[k] = (0.99 * u + 0.01 * (v or 0.0), n + 1)
    return state


def ring_of(all_rows, size):
    by = {}
    for r in sorted((r for rows in all_rows for r in rows), key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append((r[2], r[3]))
    return {k: sorted(x[-size:]) for k, x in by.items()}


def run_again(checkpoint):
    """Forget that the last batch was committed."""
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{checkpoint}/commits/[0-9]*"))
    os.remove(f"{checkpoint}/commits/{last}")
    crc = f"{checkpoint}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def got_usage(df):
    return {r.k: (pytest.approx(r.usage), r.n) for r in df.collect()}


def test_moving_usage(spark, tmp_path):
    files, check = f"{tmp_path}/in", f"{tmp_path}/check"
    work = lambda: keyed.moving_usage(streams.file_stream(spark, files, KIND), "k", "ts", "i", "v", check)
    for b, rows in enumerate(batches()):
        arrive(spark, files, rows)
        assert got_usage(work()) == usage_of(batches()[: b + 1])
    run_again(check)
    assert got_usage(work()) == usage_of(batches())  # the last batch, run again, starts from the version before it
    assert got_usage(work()) == usage_of(batches())  # nothing new has arrived


def test_last_values(spark, tmp_path):
    files, check = f"{tmp_path}/in", f"{tmp_path}/check"
    for rows in batches():
        arrive(spark, files, rows)
    got = lambda: _ring(keyed.last_values(streams.file_stream(spark, files, KIND), "k", "ts", "i", "v", 4, check))
    assert got() == ring_of(batches(), 4)
    run_again(check)
    assert got() == ring_of(batches(), 4)


def _ring(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.k, []).append((r.i, r.v))
    return {k: sorted(x) for k, x in by.items()}


def test_document_frequency_touches_the_keys_of_a_batch(spark, tmp_path):
    files, check = f"{tmp_path}/in", f"{tmp_path}/check"
    seen = []
    for rows in ([(f"t{i % 50}", 0, i % 20, 0.0) for i in range(400)], [("t1", 1, 999, 0.0), ("t2", 1, 2, 0.0), (None, 1, 2, 0.0), ("t1", 1, 999, 0.0)]):
        arrive(spark, files, rows)
        seen += [(r[0], r[2]) for r in rows if r[0] is not None]
        stream = streams.file_stream(spark, files, KIND)
        got = {r.k: r.df for r in keyed.document_frequency(stream, "k", "i", check).collect()}
        assert got == {k: len({d for t, d in seen if t == k}) for k, _ in seen}
    # a third batch of two tokens, one pair of them new: of 51 states one count is written
    arrive(spark, files, [("t1", 2, 777, 0.0), ("t3", 2, 3, 0.0)])
    stream = streams.file_stream(spark, files, KIND)
    pairs = stream.select("k", "i").where("k is not null").dropDuplicates(["k", "i"])
    q = keyed.run_state(pairs.groupBy("k").agg(F.count(F.lit(1)).alias("df")), f"{tmp_path}/other")
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]) == 50
    q = keyed.run_state(stream.select("k", "i").where("k is not null and i is not null").dropDuplicates(["k", "i"]).groupBy("k").agg(F.count(F.lit(1)).alias("df")), check)
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]] == [1]


def test_empty_stream(spark, tmp_path):
    arrive(spark, f"{tmp_path}/in", [])
    assert keyed.moving_usage(streams.file_stream(spark, f"{tmp_path}/in", KIND), "k", "ts", "i", "v", f"{tmp_path}/check").count() == 0
