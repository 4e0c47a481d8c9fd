"""Whitening of embeddings by column aggregates of the upper triangle (op13).

Entries become integers, so sums and deviations are exact. One aggregation has
the sum of every dimension; a second one, generated as Spark SQL, has the sum of
the centred products of every pair of dimensions in the upper triangle: a column
for each second dimension, a group for each first one. The driver gets these
numbers alone, assembles the covariance and has LAPACK decompose it.
Projections are array functions of literals, so no row leaves the JVM. The
covariance of what comes out is summed in the same way and held against the
identity.

The fit list is all rows that are kept; nothing is sampled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables

#: Fixed values of the integer scale: factor and shift.
FACTOR, SHIFT = 64, 1_000_000
#: Second entries of one row of the aggregation.
BLOCK = 64
#: Components whose eigenvalue is a smaller share of the trace have no whitening in doubles.
LEAST_SHARE = 1e-12
#: Components of a row, at most.
COMPONENTS = 32


class Fit(NamedTuple):
    n: int
    sums: list[int]  # of each dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # (components, dimensions)
    trace: float


def scaled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): integers of the vectors without null, NaN or infinite entries."""
    vector, entry = F.col("_v"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    good = vector.isNotNull() & ~F.exists(vector, entry)
    # guarded, as Spark may move conditions on x before the one on the vector
    x = F.when(good, F.transform(vector, lambda c: F.floor(FACTOR * c) + F.lit(SHIFT).cast("long")))
    return rows.select("vec_id", x.alias("x")).where("x is not null")


def _literal(values) -> str:
    """SQL of an array of doubles."""
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def _centred(n: int, sums: list[int]) -> str:
    """SQL of n (x - mean), exact, of all dimensions."""
    return f"zip_with(x, array({', '.join(f'{s}L' for s in sums)}), (v, s) -> {n}L * v - s)"


def pair_sums(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """The symmetric matrix of sums of products of every two entries of an array column.

    One aggregation: a row is taken once for each first entry i and block of
    second entries; generated SQL sums the products of i with each j of the
    block from i on, the upper triangle. Blocks keep the number of generated
    sums the same in any dimension, and small enough for compiled code.
    """
    blocks = [b for b in range(-(-size // BLOCK))]
    flat = rows.selectExpr(column, f"posexplode({column}) AS (i, c)").selectExpr("i", "c", column, f"explode(array({', '.join(map(str, blocks))})) AS b").where(f"i < {BLOCK} * (b + 1)")
    each = [f"sum(CASE WHEN {BLOCK} * b + {k} >= i THEN c * get({column}, {BLOCK} * b + {k}) END) AS s{k}" for k in range(min(size, BLOCK))]
    out = np.zeros((size, size))
    for row in flat.groupBy("i", "b").agg(*map(F.expr, each)).collect():
        for k in range(min(size, BLOCK)):
            j = BLOCK * row["b"] + k
            if row["i"] <= j < size:
                out[row["i"], j] = out[j, row["i"]] = row[f"s{k}"]
    return out


def fit(x: DataFrame, dimensions: int, components: int = COMPONENTS) -> Fit:
    """Sums, and the leading eigenvectors of the covariance (divisor n) of the rows of `x`."""
    row = x.selectExpr("count(*)", *[f"sum(x[{i}])" for i in range(dimensions)]).first()
    n, sums = row[0], [int(v or 0) for v in row[1:]]
    if not n or not dimensions:
        return Fit(n, sums, np.zeros(0), np.zeros((0, dimensions)), 0.0)
    centred = x.selectExpr(f"transform({_centred(n, sums)}, v -> cast(v AS double) / {n}D) AS d")
    covariance = pair_sums(centred, "d", dimensions) / n
    values, vectors = np.linalg.eigh(covariance)
    order, trace = np.argsort(-values, kind="stable"), float(np.trace(covariance))
    order = [k for k in order if values[k] > LEAST_SHARE * trace][:components]
    return Fit(n, sums, values[order], vectors[:, order].T, trace)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows without a vector, or whose vector has an entry that is null, NaN or
    infinite, are dropped, and so are those whose length is not the commonest (of
    equally common ones the largest). Each row counts, copies and null ids too. A
    row has as many components as there are directions of variance, `components`
    at most: none if all vectors are equal, or if there is none. Integers are of
    64 bits; one that doesn't fit is an error. Between equal eigenvalues, and of
    either sign, any choice is the same for all rows.
    """
    spark = rows.sparkSession
    tables = Tables(spark, "whitening")
    x = scaled(rows, id_col, vector_col)
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimensions = lengths[0]["d"] if lengths else 0
    x = x.where(F.size("x") == dimensions)
    f = fit(x, dimensions, components)
    k = len(f.values)
    kind = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], kind)
    exact = x.selectExpr("vec_id", f"{_centred(f.n, f.sums)} AS d")
    weights = f"array({', '.join(_literal(v) for v in f.vectors / (f.n * np.sqrt(f.values))[:, None])})"
    done = tables.cut(exact.selectExpr("vec_id", "aggregate(d, 0L, (s, v) -> s + v * v) AS deviation", f"transform({weights}, v -> aggregate(zip_with(d, v, (a, b) -> a * b), 0D, (s, p) -> s + p)) AS w"))
    means = {r["i"]: r["m"] for r in done.selectExpr("posexplode(w) AS (i, c)").groupBy("i").agg((F.sum("c") / f.n).alias("m")).collect()}
    centred = done.selectExpr(f"zip_with(w, {_literal(means[i] for i in range(k))}, (c, m) -> c - m) AS w")
    error = float(np.abs(pair_sums(centred, "w", k) / f.n - np.eye(k)).max())
    shares = _literal(v / f.trace for v in f.values)
    out = done.selectExpr("vec_id", "deviation", "posexplode(w) AS (i, whitened)")
    return out.selectExpr("vec_id", "i + 1 AS component", f"{f.n}L AS n", "deviation", "whitened", f"get({shares}, i) AS explained", f"{error!r}D AS identity_error")
