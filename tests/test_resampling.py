"""Bootstraps by counts against draws as rows, at any size."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrium.operators import resampling as B


def pool(spark):
    rows = [(f"s{i % 3}", f"u{i // 2}", i, float(i % 7) / 8, float(i * i % 11)) for i in range(60)] + [(None, "u1", 1, 1.0, 1.0), ("s1", None, 1, 1.0, 1.0)]
    return spark.createDataFrame(rows, "stratum string, unit string, i int, a double, b double")


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("by_stratum", [False, True])
def test_counts_and_rows_agree(spark, monkeypatch, wide, by_stratum):
    run = lambda: {(r.replicate, r.stratum if by_stratum else None): r for r in B.bootstrap_means(pool(spark), "unit", "stratum", ["a", "b"], 12, "q", wide, by_stratum).collect()}
    few = run()
    monkeypatch.setattr(B, "MOST_BYTES", 0)
    many = run()
    assert len(few) == 12 * (3 if by_stratum else 1) and few.keys() == many.keys()
    for k, r in few.items():
        assert r.n == many[k].n and abs(r.a - many[k].a) < 1e-12 and abs(r.b - many[k].b) < 1e-12


def test_the_first_replicates_do_not_depend_on_their_number(spark):
    a = B.bootstrap_means(pool(spark), "unit", "stratum", ["a"], 300).where("replicate < 9")
    b = B.bootstrap_means(pool(spark), "unit", "stratum", ["a"], 9)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_an_infinite_loss_counts_only_where_it_is_drawn(spark):
    p = pool(spark).where("stratum is not null and unit is not null").withColumn("a", F.when(F.col("i") == 4, F.lit(math.inf)).otherwise(F.col("a")))
    got = {r.replicate: r.a for r in B.bootstrap_means(p, "i", "stratum", ["a"], 40).collect()}
    names = {s: sorted(r.i for r in p.where(F.col("stratum") == s).collect()) for s in ("s0", "s1", "s2")}
    hit = {r: any(names["s1"][k] == 4 for k in B.places_drawn("p", r, "s1", 20, 20)) for r in range(40)}
    assert {r for r, v in got.items() if math.isinf(v)} == {r for r, h in hit.items() if h} and not any(map(math.isnan, got.values()))
    assert 0 < sum(hit.values()) < 40


def test_no_rows(spark):
    assert B.bootstrap_means(pool(spark).where("false"), "unit", "stratum", ["a"], 5).count() == 0


@pytest.mark.parametrize("draws", [None, 7, 90])
def test_weights_are_counts_of_the_places_drawn_in_any_chunks(spark, monkeypatch, draws):
    p = pool(spark).where("stratum is not null and unit is not null")
    run = lambda: sorted(map(tuple, B.weights(p, "unit", "stratum", 6, "q", draws, {"budget_identity": "N1"}).collect()))
    whole = run()
    want = []
    for s in ("s0", "s1", "s2"):
        units = sorted({r.unit for r in p.where(F.col("stratum") == s).collect()})
        for r in range(6):
            places = B.places_drawn("q", r, s, len(units), draws or len(units), False, {"budget_identity": "N1"}).tolist()
            want += [(r, s, units[k], places.count(k)) for k in set(places)]
    assert whole == sorted(want)
    for name, value in (("CHUNK", 4), ("RUN", 5), ("PIECE", 2)):
        monkeypatch.setattr(B, name, value)
    assert run() == whole


def test_sums_meet_draws_in_chunks_without_rows_of_draws(spark, monkeypatch):
    """Draws were rows, each with a digest in hexadecimal, that were joined with the sums."""
    few = {r.replicate: r for r in B.bootstrap_means(pool(spark), "unit", "stratum", ["a", "b"], 12, "q").collect()}
    for name, value in (("MOST_BYTES", 0), ("CHUNK", 4), ("RUN", 5)):
        monkeypatch.setattr(B, name, value)
    many = B.bootstrap_means(pool(spark), "unit", "stratum", ["a", "b"], 12, "q")
    assert "sha2" not in many._jdf.queryExecution().optimizedPlan().toString()
    for r in many.collect():
        assert r.n == few[r.replicate].n and abs(r.a - few[r.replicate].a) < 1e-12 and abs(r.b - few[r.replicate].b) < 1e-12


def test_a_unit_has_its_columns_with_its_weight(spark):
    p = pool(spark).where("stratum is not null and unit is not null")
    got = B.weights(p, "i", "stratum", 3, "q", carry=["a", "unit"]).collect()
    assert got and all(r.a == r.i % 7 / 8 and r.unit == f"u{r.i // 2}" and r.stratum == f"s{r.i % 3}" for r in got)


def test_sums_and_ranks_of_units_drawn_without_a_row_for_each(spark, monkeypatch):
    """Both were aggregates of `weights`, whose rows were two thirds of the draws; a rank met them in two more shuffles."""
    p = pool(spark).where("stratum is not null and unit is not null").withColumn("v", F.when(F.col("i") % 5 > 0, F.col("b")))
    w = B.weights(p, "i", "stratum", 6, "q", carry=["v"]).collect()
    sums = {"n": lambda c, i: c.sum(), "ids": lambda c, i: B.whole_dot(c * c, i)}
    ranks = lambda: {(r.replicate, r.stratum): (r.n, r.lo, r.mid) for r in B.bootstrap_ranks(p, "i", "stratum", "v", 6, "q", {"lo": 0.0, "mid": 0.5}).collect()}
    got, told = {(r.replicate, r.stratum): (r.n, r.ids) for r in B.drawn_sums(p, "i", "stratum", 6, "q", ["i"], sums).collect()}, ranks()
    assert len(got) == 18 and got.keys() == told.keys()
    for (k, s), (n, ids) in got.items():
        own = [r for r in w if (r.replicate, r.stratum) == (k, s)]
        drawn = sorted(v for r in own if r.v is not None for v in [r.v] * r.w)
        assert (n, ids) == (20, sum(r.w * r.w * r.i for r in own))
        assert told[k, s] == (len(drawn), drawn[0], drawn[math.ceil(len(drawn) / 2) - 1])
    for name, value in (("CHUNK", 4), ("RUN", 5), ("PIECE", 2)):
        monkeypatch.setattr(B, name, value)
    assert ranks() == told
    monkeypatch.setattr(B, "MOST_BYTES", 0)
    assert ranks() == told


def test_products_beyond_64_bits_are_whole():
    assert B.whole_dot(np.array([3, 1]), np.array([2**62, -5])) == 3 * 2**62 - 5


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("first, last", [(0, 114_000), (93_000, 108_000), (5, 9), (2_000, 99_000)])
def test_draws_side_by_side_are_those_of_hashlib(monkeypatch, wide, first, last):
    """each draw was hashed from its first byte, as an object of its own."""
    for extra in (None, {"budget_identity": "N500"}):
        want = {r: B.places_drawn("p", r, "purchase", 114_000, last - first, wide, extra, first) for r in (98, 99, 100, 101)}
        asked = []
        with monkeypatch.context() as m:
            m.setattr(B, "places_drawn", lambda *a, one=B.places_drawn: asked.append(a[4]) or one(*a))
            got = dict(B.places_of("p", range(98, 102), "purchase", 114_000, first, last, wide, extra))
        assert got.keys() == want.keys() and all((got[r] == want[r]).all() for r in want)
        assert last - first < 10 or sum(asked) < 4 * (last - first) / 4


def test_counts_beyond_a_byte_are_whole():
    got = B.counts_of("p", range(3, 5), "s", 2, 1000)
    assert got.sum(axis=1).tolist() == [1000, 1000] and (got[0] == np.bincount(B.places_drawn("p", 3, "s", 2, 1000), minlength=2)).all()


@pytest.mark.parametrize("most", [0, 1, 15, 16, 255, 256, 70_000])
def test_packed_counts_are_unpacked(most):
    for n in (1, 2, 7):
        counts = np.arange(n, dtype=np.uint32) % (most + 1)
        counts[-1] = most
        bits, packed = B._packed(counts)
        assert (B._unpacked(bits, packed, n) == counts).all() and len(packed) == -(-bits * n // 8)


def test_counts_of_a_stratum_meet_its_units_and_few_draws_as_places(spark, monkeypatch):
    p = pool(spark).where("stratum is not null and unit is not null")
    run = lambda draws: sorted(map(tuple, B.weights(p, "i", "stratum", 6, "q", draws).collect()))
    counted = {d: run(d) for d in (None, 3, 400)}
    monkeypatch.setattr(B, "DENSE", 0)
    monkeypatch.setattr(B, "RUN", 5)
    assert {d: run(d) for d in counted} == counted


def test_the_paired_bootstrap_has_all_replicates_of_its_protocol(spark):
    """it had 200, in code and in SQL; the reference's has 2,000."""
    from calibrium import catalog

    rows = catalog.queries()["bs05_paired_test_bootstrap"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.replicate for r in rows) == list(range(2_000)) and "range(0, 2000)" in catalog.oracle_sql()["bs05_paired_test_bootstrap"]
