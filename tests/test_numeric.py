"""Column functions against exact arithmetic and hand-computed numbers."""

from __future__ import annotations

import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrium.functions import identity as I
from calibrium.functions import numeric as N


@pytest.mark.parametrize("bins", [3, 7, 10, 15, 49])
def test_bins_equal_exact_rationals(spark, bins):
    points = sorted({x for k in range(bins + 1) for x in (k / bins, math.nextafter(k / bins, 0), math.nextafter(k / bins, 1)) if 0 <= x <= 1} | {i / 997 for i in range(998)})
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", N.equal_width_bin(F.col("p"), bins).alias("b")).collect()
    assert all(r.b == min(math.floor(Fraction(r.p) * bins), bins - 1) for r in rows)


def test_softmax_survives_large_logits(spark):
    row = spark.range(1).select(N.softmax(F.array(F.lit(1000.0), F.lit(-1000.0), F.lit(1000.0))).alias("p")).first()
    assert row.p == [0.5, 0.0, 0.5]


def test_log_loss_ends(spark):
    rows = spark.createDataFrame([(0.0, True), (0.0, False), (1.0, True), (1.0, False), (0.5, True)], "p double, y boolean")
    got = [r[0] for r in rows.select(N.log_loss(F.col("p"), F.col("y"))).collect()]
    assert got[:4] == [math.inf, 0.0, 0.0, math.inf] and abs(got[4] - math.log(2)) < 1e-15


def test_ties_go_to_the_first_candidate(spark):
    row = spark.range(1).select(N.first_argmax(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("w")).first()
    assert row.w == "b"


def test_entropy_and_margin_of_one_outcome(spark):
    row = spark.range(1).select(N.normalized_entropy(F.array(F.lit(1.0))).alias("h"), N.margin(F.array(F.lit(1.0))).alias("m")).first()
    assert (row.h, row.m) == (0.0, 1.0)


def test_correlation_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, b double")
    assert rows.agg(N.safe_correlation(F.col("a"), F.col("b"))).first()[0] is None


def test_indices_equal_integer_arithmetic(spark):
    import hashlib

    rows = spark.range(200).select("id", I.digest(F.col("id").cast("string")).alias("h"), (F.col("id") * 7919 + 3).alias("n"))
    for r in rows.select("id", "h", "n", I.index64(F.col("h"), F.col("n")).alias("a"), I.index256(F.col("h"), F.col("n")).alias("b")).collect():
        h = hashlib.sha256(str(r.id).encode()).hexdigest()
        assert (r.h, r.a, r.b) == (h, int(h[:16], 16) % r.n, int(h, 16) % r.n)


def test_canonical_text():
    assert I.canonical_json({"b": None, "a": [1, -0.0, 1e-05, True, "é"]}) == '{"a":[1,0.0,1e-05,true,"é"],"b":null}'
    with pytest.raises(ValueError):
        I.canonical_json(float("nan"))
    with pytest.raises(TypeError):
        I.canonical_json({1: 2})


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=5)), max_size=4))
def test_canonical_text_ignores_order(d):
    assert I.canonical_json(d) == I.canonical_json(dict(reversed(list(d.items()))))


def test_record_text_equals_canonical_json(spark):
    row = spark.range(1).select(I.record_text({"b": F.lit(2), "a": I.quoted(F.lit('x"\\y')), "c": F.lit(None)}).alias("t")).first()
    assert row.t == I.canonical_json({"a": 'x"\\y', "b": 2, "c": None})
