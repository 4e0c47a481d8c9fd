"""Whitening against numpy and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from calibrium.llm import whitening as W


def vectors(n, d, seed):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.linspace(0.2, 6, d)
    return [[float(c) for c in v] for v in r.normal(size=(n, d)) @ mix + r.normal(size=d)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, component string, n int")


@pytest.mark.parametrize(("n", "d", "most", "block"), [(200, 6, 32, 64), (300, 40, 32, 7), (50, 8, 3, 64)])
def test_whitening_equals_numpy(spark, monkeypatch, n, d, most, block):
    monkeypatch.setattr(W, "BLOCK", block)
    good = list(enumerate(vectors(n, d, n)))
    good += [(7, good[7][1]), (None, good[3][1])]
    bad = [(900, None), (901, [None] * d), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("inf")] + [0.0] * (d - 1)), (904, [1.0]), (905, [])]
    got = W.whiten(frame(spark, good + bad).repartition(3), most).collect()
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in good], dtype=object)
    sums, m = x.sum(axis=0), len(x)
    exact = m * x - sums
    centred = exact.astype(float) / m
    v = centred.T @ centred / m
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(d, most)
    assert len(got) == m * k and {r.n for r in got} == {m}
    want = sorted((i is None, i or 0, int((e * e).sum())) for (i, _), e in zip(good, exact))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1) == want
    e = {r.component: r.explained for r in got}
    assert np.allclose([e[c + 1] for c in range(k)], values[:k] / np.trace(v), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    # whitened: each component is an eigenvector's projection, whatever its sign
    one = {(r.vec_id, r.component): r.whitened for r in got if r.vec_id is not None}
    z = np.array([[one[i, c + 1] for c in range(k)] for i, _ in good[:n]])
    back = np.linalg.lstsq(centred[:n], z, rcond=None)[0]  # projection matrix over sqrt(e)
    assert np.allclose(v @ back, back * values[:k], rtol=1e-6, atol=1e-6 * values[0] * np.abs(back).max())
    assert np.allclose((back * back).sum(axis=0) * values[:k], 1, rtol=1e-8)


def test_whitening_without_variance(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # one direction of variance: one component
    got = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert [r.component for r in got] == [1, 1, 1] and abs(sum(r.whitened**2 for r in got) / 3 - 1) < 1e-12
