"""Products of matrices in long form, block by block, and the linear codes and quality measures built on them."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, columns and inner keys of a block: two dense blocks and their product take a few dozen MB.
SIDE = 1024


def _multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The product of two blocks of cells, for the pairs of rows and columns that share an inner key."""
    empty = pd.DataFrame([], columns=["r", "c", "value"])
    inner = pd.Index(left["k"].unique()).intersection(pd.Index(right["k"].unique()))
    if not len(inner):
        return empty

    def dense(cells: pd.DataFrame, side: str) -> tuple[np.ndarray, np.ndarray, pd.Index]:
        cells = cells[cells["k"].isin(inner)]
        at, names = pd.factorize(cells[side])
        values, held = np.zeros((len(names), len(inner))), np.zeros((len(names), len(inner)), np.float32)
        k = inner.get_indexer(cells["k"])
        values[at, k], held[at, k] = cells["v"], 1
        return values, held, names

    a, a_held, rows = dense(left, "r")
    b, b_held, cols = dense(right, "c")
    value = a @ b.T
    i, j = np.nonzero(a_held @ b_held.T)
    return pd.DataFrame({"r": rows.take(i), "c": cols.take(j), "value": value[i, j]})


def matrix_product(left: DataFrame, right: DataFrame, row: str, inner: str, col: str) -> DataFrame:
    """(row, col, value) of two long-form matrices (row, inner, x) and (inner, col, y), for pairs that share an inner key.

    Both are cut into blocks of about SIDE keys by hash; a block meets those of the other matrix with its inner keys, which are
    multiplied as dense matrices, and the products over all inner blocks are added up. So what moves is each cell once for every block across from it and each sum once an inner block,
    and no row, column or key is handled by one task alone. Cells given several times add up; null keys and values take no part.
    """
    l = left.select(F.col(row).alias("r"), F.col(inner).alias("k"), F.col("x").cast("double").alias("v")).dropna().groupBy("r", "k").agg(F.sum("v").alias("v"))
    r = right.select(F.col(col).alias("c"), F.col(inner).alias("k"), F.col("y").cast("double").alias("v")).dropna().groupBy("c", "k").agg(F.sum("v").alias("v"))
    size = [*l.agg(F.approx_count_distinct("r"), F.approx_count_distinct("k")).first(), *r.agg(F.approx_count_distinct("c")).first()]
    n_rows, n_inner, n_cols = (max(1, math.ceil(n / SIDE)) for n in size)
    block: functools.partial[Column] = functools.partial(lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    l = l.withColumn("bi", block("r", n_rows)).withColumn("bk", block("k", n_inner))
    r = r.withColumn("bj", block("c", n_cols)).withColumn("bk", block("k", n_inner))
    by = ["bi", "bj", "bk"]
    across = lambda x, b: x.select(F.col("bk").alias("bk"), F.col(b).alias(b)).distinct()  # noqa: E731  columns of their own, so that the two sides share none
    met = l.join(across(r, "bj"), "bk").groupBy(*by).cogroup(r.join(across(l, "bi"), "bk").groupBy(*by))
    kind = f"r {l.schema['r'].dataType.simpleString()}, c {r.schema['c'].dataType.simpleString()}, value double"
    return met.applyInPandas(_multiply, kind).groupBy(F.col("r").alias(row), F.col("c").alias(col)).agg(F.sum("value").alias("value"))


def _with_bias(cells: DataFrame, keys: DataFrame, key: str, inner: str, value: str, bias: Column) -> DataFrame:
    """cells with inner as text, and one cell more for each of keys under the inner key '', which no other has."""
    own = cells.select(key, F.concat(F.lit("="), F.col(inner).cast("string")).alias(inner), F.col(value).alias(value))
    return own.unionByName(keys.select(key, F.lit("").alias(inner), bias.alias(value)))


def linear_encode(cells: DataFrame, weights: DataFrame, shift: DataFrame, bias: DataFrame, row: str, inner: str, unit: str, top: float = 6.0) -> DataFrame:
    """(row, unit, h): clamp(relu(W (x - b) + c), 0, top) for every row and unit.

    cells (row, inner, x), weights (inner, unit, w), shift (inner, b), bias (unit, c); cells, shifts and biases not given are 0. W x is one blocked
    product; c - W b is a constant of the unit, carried as one more inner key that every row holds.
    """
    moved = weights.join(shift.select(inner, "b"), inner, "left").groupBy(unit).agg(F.sum(F.col("w") * F.coalesce("b", F.lit(0.0))).alias("_wb"))
    constant = moved.join(bias.select(unit, "c"), unit, "left").select(unit, (F.coalesce("c", F.lit(0.0)) - F.col("_wb")).alias("_y"))
    x = _with_bias(cells, cells.select(row).distinct(), row, inner, "x", F.lit(1.0))
    w = _with_bias(weights.withColumnRenamed("w", "y"), constant, unit, inner, "y", F.col("_y"))
    h = matrix_product(x, w, row, inner, unit)
    return h.select(row, unit, F.least(F.lit(top), F.greatest(F.lit(0.0), "value")).alias("h"))


def linear_decode(hidden: DataFrame, weights: DataFrame, shift: DataFrame, row: str, inner: str, unit: str) -> DataFrame:
    """(row, inner, value): D h + b for every row and inner key, each unit's column of D scaled to length 1 (a column of zeros stays).

    hidden (row, unit, h), weights (inner, unit, w), shift (inner, b). Units that are 0 are not multiplied.
    """
    norm = weights.groupBy(unit).agg(F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-12)).alias("_n"))
    scaled = weights.join(norm, unit).select(inner, unit, (F.col("w") / F.col("_n")).alias("y"))
    back = weights.select(inner).distinct().join(shift.select(inner, "b"), inner, "left").select(inner, F.coalesce("b", F.lit(0.0)).alias("_b"))
    h = _with_bias(hidden.where("h <> 0").withColumnRenamed("h", "x"), hidden.select(row).distinct(), row, unit, "x", F.lit(1.0))
    d = _with_bias(scaled, back, inner, unit, "y", F.col("_b"))
    return matrix_product(h, d, row, unit, inner)


def representation_metrics(cells: DataFrame, decoded: DataFrame, hidden: DataFrame, groups: DataFrame, row: str, inner: str, by: str, threshold: float = 1e-6,
                           targets: tuple[float, float, float] = (0.1, 0.1, 50.0), weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(by, n, mse, l1, l0, magnitude, dead_percent, distance): how well the hidden units stand for the rows of each group; one more row, by null, for all of them.

    cells (row, inner, x) against decoded (row, inner, value), a cell missing on either side being 0; hidden (row, unit, h); groups (row, by). mse is
    the mean over cells; l1 the mean over rows of the sum of |h|, magnitude the mean of |h|, l0 the share of |h| over threshold, dead_percent the rest in
    percent. distance is the root of the weighted squared logarithms of mse, l0 and dead_percent over their targets, ratios under 0.1 counted as 0.1.
    """
    both = cells.select(row, inner, "x").join(decoded.select(row, inner, "value"), [row, inner], "full_outer")
    error = F.pow(F.coalesce("x", F.lit(0.0)) - F.coalesce("value", F.lit(0.0)), 2)
    errors = both.groupBy(row).agg(F.sum(error).alias("_se"), F.count(F.lit(1)).alias("_cells"))
    h = F.abs("h")
    units = hidden.groupBy(row).agg(F.sum(h).alias("_l1"), F.count_if(h > threshold).alias("_on"), F.count(F.lit(1)).alias("_units"))
    told = groups.select(row, by).join(errors, row).join(units, row).rollup(by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("_se") / F.sum("_cells")).alias("mse"), F.avg("_l1").alias("l1"), (F.sum("_on") / F.sum("_units")).alias("l0"),
        (F.sum("_l1") / F.sum("_units")).alias("magnitude"), F.grouping(by).alias("_all"))
    told = told.where((F.col("_all") == 1) | F.col(by).isNotNull()).withColumn("dead_percent", (1 - F.col("l0")) * 100)
    parts = [w * F.pow(F.log(F.greatest(F.col(c) / t, F.lit(0.1))), 2) for c, t, w in zip(("mse", "l0", "dead_percent"), targets, weights)]
    return told.select(by, "n", "mse", "l1", "l0", "magnitude", "dead_percent", F.sqrt(sum(parts[1:], parts[0])).alias("distance"))
