"""Batched refits against single fits of the drawn rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from calibrium.operators import calibration as C
from calibrium.operators import refits as R
from calibrium.operators import resampling as B


def rows(n, seed, end=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.random() * 0.98 + 0.01
        out.append((i, f"s{i % 2}", int(r.random() < s), 1.0 if end and i == 5 else s, min(0.99, s / 2 + 0.2)))
    return out


SCHEMA = "unit long, stratum string, label int, cat double, ovr double"


@pytest.mark.parametrize("draws", [None, 10])
@pytest.mark.parametrize("feature", ["p", "logit"])
def test_refits_equal_single_fits(spark, monkeypatch, feature, draws):
    data, held = rows(60, 1, True), rows(40, 2)
    train, test = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(held, SCHEMA)
    run = lambda: {r.replicate: r for r in R.refit(train, test, "unit", "stratum", {"cat": "cat", "ovr": "ovr"}, "label", 1e-2, 8, "q", feature, draws, {"budget_identity": "N1"}).collect()}
    got = run()
    f = (lambda s: s) if feature == "p" else (lambda s: np.log(s / (1 - s)))
    states = set()
    for r in range(8):
        drawn = []
        for s in ("s0", "s1"):
            own = sorted(x for x in data if x[1] == s)
            drawn += [own[k] for k in B.places_drawn("q", r, s, 30, draws or 30, False, {"budget_identity": "N1"})]
        y, cat, ovr = (np.array([x[k] for x in drawn], float) for k in (2, 3, 4))
        ends = feature == "logit" and (cat >= 1).any()
        states.add(got[r].status)
        assert (got[r].status, got[r].reason) == (("FAILED", "cat: endpoint") if ends else ("AVAILABLE", None))
        if ends:
            assert got[r].cat_slope is None and got[r].ovr_slope is None and got[r].ovr_on_cat is None
            continue
        for m, x in (("cat", cat), ("ovr", ovr)):
            a, b, sure = C.solve_logistic(f(x), y, 1e-2)
            assert sure and abs(got[r][f"{m}_slope"] - a) < 1e-7 and abs(got[r][f"{m}_intercept"] - b) < 1e-7
            for k, t in ((3, "cat"), (4, "ovr")):
                q = 1 / (1 + np.exp(-(a * f(np.array([x[k] for x in held])) + b)))
                assert abs(got[r][f"{m}_on_{t}"] - ((q - np.array([x[2] for x in held])) ** 2).mean()) < 1e-7
    assert feature == "p" or draws or states == {"FAILED", "AVAILABLE"}
    if draws is None:
        monkeypatch.setattr(B, "MOST_BYTES", 0)
        for r, other in run().items():
            assert (other.status, other.reason) == (got[r].status, got[r].reason)
            for c in ("cat_slope", "ovr_intercept", "cat_on_ovr", "ovr_on_ovr"):
                assert (other[c] is None) == (got[r][c] is None) and (other[c] is None or abs(other[c] - got[r][c]) < 1e-7)


def test_no_training_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.refit(none, none, "unit", "stratum", {"cat": "cat"}, "label", 1e-2, 5).count() == 0


def test_equal_test_scores_are_one_point(spark, monkeypatch):
    """The rows of the test set were counted against the limit, and met every replicate, though only their distinct scores matter."""
    train, test = spark.createDataFrame(rows(60, 1), SCHEMA), spark.createDataFrame(rows(4, 2), SCHEMA)
    run = lambda held: {r.replicate: r for r in R.refit(train, held, "unit", "stratum", {"cat": "cat", "ovr": "ovr"}, "label", 1e-2, 5, "q").collect()}
    want = run(test)
    monkeypatch.setattr(B, "MOST_BYTES", 60 * 8 * 4 // R.SENT)
    monkeypatch.setattr(R, "_refit_rows", None)
    got = run(test.crossJoin(spark.range(100)).drop("id"))
    for r, one in want.items():
        assert got[r].status == one.status == "AVAILABLE" and got[r].cat_slope == one.cat_slope and abs(got[r].cat_on_ovr - one.cat_on_ovr) < 1e-12


def test_stability_refits_training_sets_of_full_size(spark, monkeypatch):
    """each stratum was cut to ten draws, in code and in SQL."""
    from calibrium import catalog
    from calibrium.queries import resampling as Q

    asked = []
    refit = Q.RF.refit
    monkeypatch.setattr(Q.RF, "refit", lambda *a, **k: asked.append(k.get("draws")) or refit(*a, **k))
    assert catalog.queries()["cp15_refit_stability"](spark, "/root/testdata/sf0.001").count() == 3
    assert asked == [None] and "range(0, n)" in catalog.oracle_sql()["cp15_refit_stability"]
