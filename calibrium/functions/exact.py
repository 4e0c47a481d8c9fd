"""Sums of doubles that are exact whatever the order, and rounded once.

A finite double is an integer of 53 bits times a power of two. Values are added
by exponent, as two long integers each, which is exact in any order; a group has
a few dozen exponents, 2,098 at most. Only these go to the last step, which adds
them as whole numbers and rounds to the nearest double. So a sum is the same at
any partitioning, and equals that of a correctly rounded sum of all values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Bits of the low half of the integer; both halves of 2**35 values fit a long.
HALF = 27
#: Most rows, by weight, whose halves are sure to fit; rows that a task splits at once.
MOST, AT_ONCE = 2.0**35, 1 << 18
#: Least exponent of a 53-bit integer (the smallest doubles end in zeros), and codes of values that are not finite.
LAST_BIT, PLUS, MINUS, NOT = -1126, 10_001, 10_002, 10_003


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(e, high, low) of doubles: (high * 2**27 + low) * 2**e, sign included; infinite ones and NaN have codes as exponents."""
    odd = ~np.isfinite(x)
    part, e = np.frexp(np.where(odd, 0.0, np.abs(x)))
    whole, sign = np.ldexp(part, 53).astype(np.int64), np.where(x < 0, -1, 1)
    e = np.where(part == 0, 0, e - 53).astype(np.int32)
    if odd.any():
        e[odd] = np.where(np.isnan(x[odd]), NOT, np.where(x[odd] > 0, PLUS, MINUS))
    return e, sign * (whole >> HALF), sign * (whole & ((1 << HALF) - 1))


def _round(parts: list) -> float:
    """The nearest double of a sum given by exponent; infinite beyond the range, NaN of opposite infinities."""
    codes, total = set(), 0
    for p in parts:
        if p["e"] >= PLUS:
            codes.add(p["e"])
        else:
            total += ((int(p["high"]) << HALF) + int(p["low"])) << (p["e"] - LAST_BIT)
    if codes:
        return math.nan if NOT in codes or len(codes) > 1 else math.inf if PLUS in codes else -math.inf
    try:
        return total / (1 << -LAST_BIT)  # a quotient of integers is rounded once
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def _codes(keys: list[pa.ChunkedArray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each row's keys, a row of each number)."""
    code = np.zeros(n, np.int64)
    for k in keys:
        told = k.combine_chunks().dictionary_encode(null_encoding="encode")
        told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
        code = np.unique(code * (len(told.dictionary) + 1) + told.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return code, first


def _partial(keys: list[str], names: list[str], out: pa.Schema):
    """Rows (keys, _w, values) to their sums by keys, value and exponent, of AT_ONCE rows at a time."""

    def told(rows: pa.Table) -> pa.RecordBatch:
        code, first = _codes([rows.column(k) for k in keys], rows.num_rows)
        w = rows.column("_w").fill_null(0).to_numpy()
        if np.abs(w).sum(dtype=float) > MOST:
            raise OverflowError("the halves of more than 2**35 rows may not fit their sums")
        parts = []
        for i, c in enumerate(names, -1):
            if i < 0:
                e, high, low, of, weight = np.zeros(len(w), np.int32), np.zeros(len(w), np.int64), np.ones(len(w), np.int64), code, w
            else:
                there = rows.column(c).is_valid().to_numpy()
                x, of, weight = rows.column(c).fill_null(0.0).to_numpy()[there], code[there], w[there]
                e, high, low = split(x)
            if not len(of):
                continue
            least = int(e.min())
            group, at = np.unique(of * (int(e.max()) - least + 1) + (e - least), return_inverse=True)
            sums = np.zeros((2, len(group)), np.int64)
            np.add.at(sums[0], at, high * weight)
            np.add.at(sums[1], at, low * weight)
            width = int(e.max()) - least + 1
            parts.append((group // width, np.full(len(group), i, np.int32), (group % width + least).astype(np.int32), *sums))
        of, i, e, high, low = (np.concatenate(c) for c in zip(*parts))
        own = [rows.column(k).combine_chunks().take(pa.array(first[of])).cast(out.field(k).type) for k in keys]
        return pa.RecordBatch.from_arrays([*own, *map(pa.array, (i, e, high, low))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if n >= AT_ONCE:
                yield told(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield told(pa.Table.from_batches(held))

    return run


def partial_sums(rows: DataFrame, by: list[str], values: Mapping[str, Column], weight: Column | None = None) -> DataFrame:
    """(_k0, ..., i, e, high, low): each group's sums of value i by exponent; value -1 counts the rows.

    A task splits and adds its own rows in numpy, so no row is made for a value.
    """
    keys, names = [f"_k{i}" for i in range(len(by))], ["_w", *[f"_v{i}" for i in range(len(values))]]
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    plain = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], w.alias("_w"), *[v.cast("double").alias(c) for c, v in zip(names[1:], values.values())])
    kind = StructType([*[StructField(k, plain.schema[k].dataType) for k in keys], StructField("i", IntegerType()), StructField("e", IntegerType()), StructField("high", LongType()), StructField("low", LongType())])
    made = plain.mapInArrow(_partial(keys, names, to_arrow_schema(kind)), kind)
    return made.groupBy(*keys, "i", "e").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def collected_means(rows: DataFrame, by: list[str], values: Mapping[str, Column], weight: Column | None = None) -> dict[tuple, list[float]]:
    """As `exact_means`, of few groups, on the driver: a list of means for each key. Groups without rows are not there."""
    n: dict[tuple, int] = {}
    parts: dict[tuple, list[list]] = {}
    for r in partial_sums(rows, by, values, weight).toArrow().to_pylist():
        key = tuple(r[f"_k{i}"] for i in range(len(by)))
        if r["i"] < 0:
            n[key] = r["low"]
        else:
            parts.setdefault(key, [[] for _ in values])[r["i"]].append(r)
    return {k: [_round(g) / n[k] for g in own] for k, own in parts.items() if n[k]}


def exact_sums(rows: DataFrame, by: list[str], values: Mapping[str, Column], weight: Column | None = None, mean: bool = False) -> DataFrame:
    """(by, n, values): the exact sum of each value, rounded once, by group.

    `weight`: how many equal rows a row stands for, a whole number of 0 or more;
    n counts them, and null values add nothing. `mean`: the sum over n, null where
    n is 0. Keys may be null. Without `by`, no rows give one row of n = 0 and
    sums 0. 2**35 rows of a group are the most that is sure to fit the integers;
    beyond, an overflow is an error.
    """
    names, keys = list(values), [f"_k{i}" for i in range(len(by))]
    sums = partial_sums(rows, by, values, weight)
    one = sums.groupBy(*keys).agg(F.expr("coalesce(sum(CASE WHEN i < 0 THEN low END), 0L)").alias("n"), F.expr("collect_list(CASE WHEN i >= 0 THEN struct(i, e, high, low) END)").alias("parts"))

    @F.arrow_udf("array<double>")
    def rounded(parts: pa.Array) -> pa.Array:
        out = []
        for p in parts.to_pylist():
            groups: list[list] = [[] for _ in names]
            for x in p:
                groups[x["i"]].append(x)
            out.append([_round(g) for g in groups])
        return pa.array(out, pa.list_(pa.float64()))

    out = one.withColumn("_r", rounded("parts"))
    value = lambda i: F.try_divide(F.get("_r", F.lit(i)), F.when(F.col("n") > 0, F.col("n"))) if mean else F.get("_r", F.lit(i))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", *[value(i).alias(c) for i, c in enumerate(names)])


def exact_means(rows: DataFrame, by: list[str], values: Mapping[str, Column], weight: Column | None = None) -> DataFrame:
    """(by, n, values): exact sums, rounded once, over the number of rows; null values count as 0."""
    return exact_sums(rows, by, values, weight, mean=True)
