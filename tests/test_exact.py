"""Exact sums against math.fsum, bit for bit, at several partitionings."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from calibrium.functions.exact import exact_means, exact_sums


def doubles(n, seed):
    r = random.Random(seed)
    kinds = [lambda: r.random(), lambda: r.uniform(-1, 1) * 10.0 ** r.randint(-300, 290), lambda: r.choice([1e16, -1e16, 1.0, 1e-16, 3e-17, -1.0]), lambda: math.ldexp(r.randint(-(2**52), 2**52), -1074), lambda: math.ldexp(1.0, r.randint(-1074, 1000)) * r.choice([1, -1]), lambda: 0.0, lambda: -0.0]
    return [r.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_sums_equal_fsum_bit_for_bit(spark, parts):
    rows = [(i % 3, v, random.Random(i).random()) for i, v in enumerate(doubles(3000, 7))]
    frame = spark.createDataFrame(rows, "g int, v double, p double").repartition(parts)
    got = {r.g: r for r in exact_sums(frame, ["g"], {"v": F.col("v"), "p": F.col("p")}).collect()}
    for g in range(3):
        assert got[g].n == 1000
        assert got[g].v.hex() == math.fsum(v for k, v, _ in rows if k == g).hex()
        assert got[g].p.hex() == math.fsum(p for k, _, p in rows if k == g).hex()
    means = {r.g: r.p for r in exact_means(frame, ["g"], {"p": F.col("p")}).collect()}
    assert all(means[g] == math.fsum(p for k, _, p in rows if k == g) / 1000 for g in range(3))


def test_every_exponent_is_split_exactly(spark):
    values = [math.ldexp(m, e) for e in range(-1074, 972) for m in (1.0, 3.0)] + [math.ldexp(2**53 - 1, e) for e in range(-1074, 971, 7)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1000, 1000, 13)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.v for r in exact_sums(frame, ["i"], {"v": F.col("v")}).collect()}
    assert [got[i] for i in range(len(values))] == values


def test_weights_stand_for_rows(spark):
    rows = [(0.1, 3), (0.7, 0), (1e-20, 10**6), (None, 2), (-0.3, 1)]
    got = exact_sums(spark.createDataFrame(rows, "v double, w long"), [], {"v": F.col("v")}, F.col("w")).first()
    exact = sum(Fraction(v) * w for v, w in rows if v is not None)
    assert got.n == 10**6 + 6 and got.v == exact.numerator / exact.denominator


def test_what_is_not_finite(spark):
    inf, nan = math.inf, math.nan
    rows = [("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", nan), ("c", 1.0), ("d", -inf), ("e", None), (None, 2.5), ("f", 1.7e308), ("f", 1.7e308), ("g", 1.7e308), ("g", 1.7e308), ("g", -1.7e308)]
    got = {r.g: r.v for r in exact_sums(spark.createDataFrame(rows, "g string, v double"), ["g"], {"v": F.col("v")}).collect()}
    assert got["a"] == inf and math.isnan(got["b"]) and math.isnan(got["c"]) and got["d"] == -inf
    assert got["e"] == 0.0 and got[None] == 2.5 and got["f"] == inf and got["g"] == 1.7e308
    none = exact_sums(spark.createDataFrame([], "g string, v double"), [], {"v": F.col("v")}).first()
    assert (none.n, none.v) == (0, 0.0)
    assert exact_means(spark.createDataFrame([], "g string, v double"), [], {"v": F.col("v")}).first().v is None


def test_no_row_is_made_for_a_value_and_too_many_are_an_error(spark):
    """Each value of a row was a row of its own, eleven of them in a step of a fit."""
    frame = spark.createDataFrame([(None, 0.1, 2.0, 1), ("a", 0.2, 3.0, 2**36)], "g string, v double, u double, w long")
    made = exact_sums(frame, ["g"], {"v": F.col("v"), "u": F.col("u")})
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.g, r.n, r.v, r.u) for r in made.collect()} == {(None, 1, 0.1, 2.0), ("a", 1, 0.2, 3.0)}
    with pytest.raises(Exception, match="2\\*\\*35"):
        exact_sums(frame, ["g"], {"v": F.col("v")}, F.col("w")).collect()
