"""Fits against their optimality conditions and simple formulas."""

from __future__ import annotations

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrium.operators import calibration as C

PAIRS = st.lists(st.tuples(st.integers(1, 19), st.integers(0, 1)), min_size=1, max_size=40)


@settings(max_examples=60, deadline=None)
@given(PAIRS)
def test_isotonic_is_the_max_min_formula(pairs):
    s, y = np.array([a / 20 for a, _ in pairs]), np.array([float(b) for _, b in pairs])
    knots, fitted = C.solve_isotonic(s, y)
    means = lambda j, k: y[(s >= knots[j]) & (s <= knots[k])].mean()
    for i in range(len(knots)):
        assert abs(fitted[i] - max(min(means(j, k) for k in range(i, len(knots))) for j in range(i + 1))) < 1e-12
    assert (np.diff(fitted) >= -1e-15).all()


@settings(max_examples=40, deadline=None)
@given(PAIRS, st.sampled_from([1e-4, 1e-2, 1.0]))
@example([(1, 0), (1, 0), (1, 0), (16, 0), (19, 0)], 1.0)
def test_logistic_reaches_its_certificate(pairs, strength):
    x, y = np.array([a / 20 for a, _ in pairs]), np.array([b for _, b in pairs])
    a, b, certified = C.solve_logistic(x, y, strength)
    q = 1 / (1 + np.exp(-(a * x + b)))
    g = np.array([((q - y) * x).mean() + strength * a, (q - y).mean() + strength * b])
    assert certified and np.linalg.norm(g) <= C.certificate(strength) * (1 + 1e-6)


def test_weights_stand_for_repeated_rows():
    rng = np.random.default_rng(3)
    x, y, w = rng.random(50), rng.integers(0, 2, 50), rng.integers(1, 5, 50)
    one, two = C.solve_logistic(x, y, 1e-2, w.astype(float)), C.solve_logistic(np.repeat(x, w), np.repeat(y, w), 1e-2)
    assert np.allclose(one[:2], two[:2], atol=1e-9) and one[2] and two[2]


def test_certificate_of_tiny_strengths():
    assert C.certificate(1e-310) > 0 and np.isclose(C.certificate(0.5), 1e-7)


def test_a_pair_is_certified_or_no_fit(monkeypatch):
    monkeypatch.setattr(C, "ITERATIONS", 1)
    x, y = np.array([0.1, 0.2, 0.9]), np.array([0, 1, 1])
    a, b, certified = C.solve_logistic(x, y, 1e-4)
    assert not certified


def test_distributed_fit_equals_the_local_one(spark):
    rng = np.random.default_rng(1)
    x = rng.random(300)
    y = (rng.random(300) < x).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    far = C.fit_logistic(rows, F.col("x"), F.col("y"), 1e-2)
    a, b, _ = C.solve_logistic(x, y, 1e-2)
    assert far["certified"] and abs(far["slope"] - a) < 1e-6 and abs(far["intercept"] - b) < 1e-6


def test_beta_is_no_worse_than_its_faces():
    rng = np.random.default_rng(2)
    s = rng.uniform(0.05, 0.95, 200)
    y = (rng.random(200) < s).astype(float)
    fit = C.solve_beta(s, y)
    assert fit["face"] == "INTERIOR" and fit["kkt"] <= C.KKT and fit["a"] > 0 and fit["b"] > 0
    assert C.solve_beta(s, 1 - y)["face"] == "A0_B0"


def test_isotonic_application(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.3, 0.4, 0.95)], "s double")
    got = [r.fitted for r in C.apply_isotonic(rows, "s", [(0.2, 0.1), (0.4, 0.3)]).orderBy("s").collect()]
    assert np.allclose(got, [0.1, 0.1, 0.2, 0.3, 0.3])


def test_beta_fits_of_all_groups_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    data = []
    for g, (a, b, c) in enumerate([(1.0, 1.0, 0.0), (0.1, 2.0, -0.3), (2.0, 0.0, 0.2), (-1.0, -0.8, 0.0)]):
        s = np.round(rng.random(400) * 0.98 + 0.01, 4)
        y = rng.random(400) < 1 / (1 + np.exp(-(a * np.log(s) - b * np.log1p(-s) + c)))
        data += [(g, float(u), int(v), int(w)) for u, v, w in zip(s, y, rng.integers(1, 4, 400))]
    fits = {(r.g, r.start): r for r in C.fit_beta_many(spark.createDataFrame(data, "g int, s double, y int, w long"), ["g"], starts=((0.0, 0.0, 0.0), (1.0, 0.5, 0.2))).collect()}
    for g in range(4):
        own = [(s, y) for k, s, y, w in data if k == g for _ in range(w)]
        want = C.solve_beta(np.array([s for s, _ in own]), np.array([y for _, y in own]))
        for start in (0, 1):
            r = fits[g, start]
            assert r.face == want["face"] and r.kkt <= C.KKT
            assert max(abs(r.a - want["a"]), abs(r.b - want["b"]), abs(r.c - want["c"])) < 1e-7
    assert len({fits[g, 0].face for g in range(4)}) > 1


def test_a_step_has_as_few_tasks_as_its_rows_need(spark, monkeypatch):
    """Every step had a task for each shuffle partition, most of them of a few rows."""
    seen, means = [], C._means
    monkeypatch.setattr(C, "_means", lambda rows, *more: (seen.append(rows.rdd.getNumPartitions()), means(rows, *more))[1])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(400).select(F.lit(0.01).alias("strength"), (F.col("id") % 200 / 200 + 0.001).alias("x"), (F.hash("id") % 2 == 0).cast("int").alias("y"), F.lit(1).cast("long").alias("w"))
        C.fit_many(rows, [])
        C.fit_beta_many(rows.withColumnRenamed("x", "s"), [])
        assert set(seen) == {1}
        monkeypatch.setattr(C, "STEP_ROWS", 100)
        seen.clear()
        C.fit_many(rows, [])
        assert 1 < max(seen) <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
