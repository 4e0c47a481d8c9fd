"""Aggregations (AG*) and the composites over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import identity as I
from ..functions import numeric as N
from ..functions.exact import exact_sums
from ..operators import metrics as M
from ..operators.panel import risk_matrix
from . import query
from .scalars import r9
from .scoring import observed

O2 = f"WITH {X.F2}"
_EL = "FROM o2 WHERE bucket = 'eligible'"


def eligible(spark, d):
    return X.bool_observations(spark, d).where("bucket = 'eligible'")


def calibrated(spark, d):
    """Eligible rows under one fixed profile: 2.5 p - 0.75 through a sigmoid."""
    return eligible(spark, d).withColumn("selected_p", N.sigmoid(2.5 * F.col("selected_p") - 0.75))


_CAL = "FROM (SELECT item_id, correct, 1 / (1 + exp(-(2.5 * selected_p - 0.75))) AS selected_p FROM o2 WHERE bucket = 'eligible')"
_METRICS = {
    "brier": ("round(avg((selected_p - correct::INTEGER) * (selected_p - correct::INTEGER)), 9) AS v", lambda r: [r9("brier", "v")]),
    "log_loss": ("round(avg(-ln(CASE WHEN correct THEN selected_p ELSE 1 - selected_p END)), 9) AS v", lambda r: [r9("log_loss", "v")]),
    "diagnostics": ("count(*) AS n, sum(correct::INTEGER)::BIGINT AS n_correct, round(avg(selected_p), 9) AS mean_p, round(avg(correct::INTEGER) * (1 - avg(correct::INTEGER)), 9) AS constant_brier", lambda r: ["n", "n_correct", r9("mean_p", "mean_p"), r9("constant_brier", "constant_brier")]),
}
for _i, (_m, (_sql, _cols)) in enumerate(_METRICS.items(), 1):

    @query(f"ag0{_i}_uncalibrated_{_m}", f"{O2} SELECT {_sql} {_EL}")
    def _u(spark, d, cols=_cols):
        return M.summary(eligible(spark, d), "selected_p", "correct", []).select(*cols(None))

    @query(f"ag06_post_calibration_{_m}", f"{O2} SELECT {_sql} {_CAL}")
    def _c(spark, d, cols=_cols):
        return M.summary(calibrated(spark, d), "selected_p", "correct", []).select(*cols(None))


def _bins(source, b=10):
    k = f"(SELECT *, floor(selected_p * {b}) AS k, (selected_p * 134217729.0) - ((selected_p * 134217729.0) - selected_p) AS hi {source})"
    return f"(SELECT *, CAST(least(k - CAST((hi * {b} - k) + (selected_p - hi) * {b} < 0 AS INTEGER) + CAST((hi * {b} - k) + (selected_p - hi) * {b} >= 1 AS INTEGER), {b - 1}) AS BIGINT) AS bin FROM {k})"


def _rel(source):
    return f"""{O2}, r AS (SELECT bin, count(*) AS n, count(*) FILTER (correct) AS n_correct, avg(selected_p) AS mean_p, avg(correct::INTEGER) AS rate, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS members_fp FROM {_bins(source)} GROUP BY bin),
b AS (SELECT CAST(unnest(range(0, 10)) AS BIGINT) AS bin)"""


_REL_OUT = " SELECT b.bin, coalesce(n, 0) AS n, coalesce(n_correct, 0) AS n_correct, round(mean_p, 9) AS mean_p, round(rate, 9) AS rate, members_fp FROM b LEFT JOIN r USING (bin)"
_GAP_OUT = " SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 9) AS gap FROM r"


def _rel_cols(df):
    return df.select("bin", "n", "n_correct", r9("mean_p", "mean_p"), r9("rate", "rate"), "members_fp")


for _name, _src, _rows in [("ag04_uncalibrated", _EL, eligible), ("ag06_post_calibration", _CAL, calibrated)]:

    @query(f"{_name}_reliability", _rel(_src) + _REL_OUT)
    def _r(spark, d, rows=_rows):
        return _rel_cols(M.reliability(rows(spark, d), "selected_p", "correct", 10, "item_id"))

    @query(f"{_name}_gap" if "06" in _name else "ag05_binned_gap", _rel(_src) + _GAP_OUT)
    def _g(spark, d, rows=_rows):
        return M.binned_gap(M.reliability(rows(spark, d), "selected_p", "correct", 10, "item_id")).select(r9("gap", "gap"))


@query("ag07_dataset_fingerprint", f"{O2} SELECT bucket, sha256(string_agg(sha256('row' || item_id), ',' ORDER BY sha256('row' || item_id))) AS fp, count(*) AS n FROM o2 GROUP BY bucket")
def ag07(spark, d):
    o = X.bool_observations(spark, d).withColumn("f", I.digest(F.concat(F.lit("row"), F.col("item_id").cast("string"))))
    return o.groupBy("bucket").agg(I.multiset_digest(F.col("f")).alias("fp"), F.count("*").alias("n"))


def exact_sql(source: str, key: str, value: str) -> str:
    """SQL of (key, n, total): sums of values from 0 to 1 whose last bit is 2**-100 or more, exact, rounded once.

    Values are whole numbers of two limbs of 50 bits; their sum, in 128 bits,
    is rounded to 53 bits by hand, half to even.
    """
    return f"""(SELECT {key}, n, CASE WHEN p = 1 THEN t ELSE t // p + CAST(t % p > p // 2 OR (t % p = p // 2 AND (t // p) % 2 = 1) AS INTEGER) END::DOUBLE * p::DOUBLE / pow(2.0::DOUBLE, 100) AS total
  FROM (SELECT {key}, n, t, CAST(pow(2.0::DOUBLE, greatest(0, CAST(floor(log2(greatest(t, 1)::DOUBLE)) AS INTEGER) - 52)) AS HUGEINT) AS p
    FROM (SELECT {key}, count(*) AS n, sum(a) * 1125899906842624::HUGEINT + sum(CAST(floor((v - a::DOUBLE / 1125899906842624) * pow(2.0::DOUBLE, 100)) AS HUGEINT)) AS t
      FROM (SELECT {key}, v, CAST(floor(v * 1125899906842624) AS HUGEINT) AS a FROM (SELECT {key}, {value} AS v FROM {source})) GROUP BY {key})))"""


_BRIER3 = lambda c: exact_sql("f3", "stratum", f"({c} - label) * ({c} - label)")


@query("ag01_exact_brier", f"WITH {X.F3} SELECT c.stratum, c.n, c.total AS cat_sum, o.total AS ovr_sum, c.total / c.n AS cat_mean, o.total / o.n AS ovr_mean FROM {_BRIER3('cat_score')} c JOIN {_BRIER3('ovr_score')} o ON c.stratum = o.stratum")
def ag01_exact(spark, d):
    """Not rounded: every bit of the sums and means is the SQL's."""
    y = F.col("label")
    sums = exact_sums(X.paired_rows(spark, d), ["stratum"], {"cat_sum": N.brier(F.col("cat_score"), y), "ovr_sum": N.brier(F.col("ovr_score"), y)})
    return sums.select("*", (F.col("cat_sum") / F.col("n")).alias("cat_mean"), (F.col("ovr_sum") / F.col("n")).alias("ovr_mean"))


#: Fixed maps that stand for fits: cross and native, of either direction.
CROSS, NATIVE = (3.0, -1.5), (4.0, -2.0)
_B = lambda p: f"({p} - label) * ({p} - label)"
_S = lambda ab, s: f"(1 / (1 + exp(-({ab[0]} * {s} + ({ab[1]})))))"
P3 = f"WITH {X.F3}, t AS (SELECT stratum, cluster_id, item_id, label, {_B('ovr_score')} AS raw, {_B(_S(CROSS, 'ovr_score'))} AS crossed, {_B(_S(NATIVE, 'ovr_score'))} AS native FROM f3 WHERE split = 'TEST')"


def losses(spark, d):
    return risk_matrix(X.paired_rows(spark, d).where("split = 'TEST'"), "ovr_score", CROSS, NATIVE)


def _agg(name, sql, build):
    @query(name, sql)
    def run(spark, d, build=build):
        return build(spark, d)


_agg("ag08_risks", P3 + " SELECT round(avg(raw), 9) AS raw, round(avg(crossed), 9) AS crossed, round(avg(native), 9) AS native FROM t", lambda s, d: losses(s, d).agg(*[r9(F.avg(c), c) for c in ("raw", "crossed", "native")]))
_agg("ag09_deltas", P3 + " SELECT round(avg(crossed - raw), 9) AS deploy, round(avg(native - raw), 9) AS native_delta, round(avg(crossed - native), 9) AS transport FROM t", lambda s, d: losses(s, d).agg(r9(F.avg(F.col("crossed") - F.col("raw")), "deploy"), r9(F.avg(F.col("native") - F.col("raw")), "native_delta"), r9(F.avg(F.col("crossed") - F.col("native")), "transport")))
_agg("ag10_risk_matrix", P3 + " SELECT stratum, round(avg(raw), 9) AS raw, round(avg(crossed), 9) AS crossed, round(avg(native), 9) AS native, round(avg(crossed - raw), 9) AS deploy, round(avg(native - raw), 9) AS native_delta, round(avg(crossed - native), 9) AS transport FROM t GROUP BY stratum", lambda s, d: losses(s, d).groupBy("stratum").agg(*[r9(F.avg(c), c) for c in ("raw", "crossed", "native")], r9(F.avg(F.col("crossed") - F.col("raw")), "deploy"), r9(F.avg(F.col("native") - F.col("raw")), "native_delta"), r9(F.avg(F.col("crossed") - F.col("native")), "transport")))
_agg("ag11_extended_mean", P3 + " SELECT stratum, CASE WHEN min(item_id) % 2 = 0 THEN 'POSITIVE_INFINITY' ELSE 'FINITE' END AS state FROM t GROUP BY stratum", lambda s, d: losses(s, d).withColumn("first", F.min("item_id").over(Window.partitionBy("stratum"))).groupBy("stratum").agg(N.state(F.avg(N.log_loss(F.when((F.col("item_id") == F.col("first")) & (F.col("item_id") % 2 == 0), F.lit(0.0)).otherwise(F.lit(0.5)), F.lit(True)))).alias("state")))
_agg("ag12_equal_stratum_mean", P3 + " SELECT round(avg(m), 9) AS mean, count(*) AS strata FROM (SELECT stratum, avg(raw) AS m FROM t GROUP BY stratum)", lambda s, d: M.mean_of_means(losses(s, d), F.col("raw"), "stratum", []).select(r9("mean", "mean"), "strata"))
_agg("ag13_weighted_population_mean", P3 + ", c AS (SELECT stratum, cluster_id, avg(raw) AS m FROM t GROUP BY ALL) SELECT stratum, round(CASE WHEN stratum < 'l' THEN (SELECT avg(raw) FROM t WHERE t.stratum = c.stratum) ELSE avg(m) END, 9) AS mean FROM c GROUP BY stratum", lambda s, d: losses(s, d).groupBy("stratum", "cluster_id").agg(F.sum("raw").alias("s"), F.count("*").alias("n")).groupBy("stratum").agg(r9(F.when(F.col("stratum") < "l", F.sum("s") / F.sum("n")).otherwise(F.avg(F.col("s") / F.col("n"))), "mean")))
_agg("ag14_panel_mean", P3 + " SELECT round(avg(m), 9) AS panel, count(*) = 5 AS complete FROM (SELECT stratum, avg(m) AS m FROM (SELECT stratum, cluster_id, avg(transport) AS m FROM (SELECT *, crossed - native AS transport FROM t) GROUP BY ALL) GROUP BY stratum)", lambda s, d: losses(s, d).groupBy("stratum", "cluster_id").agg(F.avg(F.col("crossed") - F.col("native")).alias("m")).groupBy("stratum").agg(F.avg("m").alias("m")).agg(r9(F.avg("m"), "panel"), (F.count("*") == 5).alias("complete")))
_agg("ag16_brier_log_loss_matrix", P3 + ", m AS (SELECT 'brier' AS metric, avg(raw) AS raw, avg(crossed) AS crossed FROM t UNION ALL SELECT 'log_loss', avg(-ln(CASE WHEN label = 1 THEN ovr_score ELSE 1 - ovr_score END)), avg(-ln(CASE WHEN label = 1 THEN q ELSE 1 - q END)) FROM (SELECT *, " + _S(CROSS, "ovr_score") + " AS q FROM f3 WHERE split = 'TEST')) SELECT metric, round(raw, 9) AS raw, round(crossed, 9) AS crossed FROM m", lambda s, d: _matrix(s, d))
_agg("ag17_relative_change", P3 + " SELECT round(avg(crossed) - avg(raw), 9) AS crossed, round(avg(native) - avg(raw), 9) AS native FROM t", lambda s, d: losses(s, d).agg(r9(F.avg("crossed") - F.avg("raw"), "crossed"), r9(F.avg("native") - F.avg("raw"), "native")))


def _matrix(spark, d):
    t = X.paired_rows(spark, d).where("split = 'TEST'")
    q = N.sigmoid(CROSS[0] * F.col("ovr_score") + CROSS[1])
    y = F.col("label") == 1
    one = t.agg(F.avg(N.brier(F.col("ovr_score"), F.col("label"))).alias("a"), F.avg(N.brier(q, F.col("label"))).alias("b"), F.avg(N.log_loss(F.col("ovr_score"), y)).alias("c"), F.avg(N.log_loss(q, y)).alias("e"))
    return one.select(F.explode(F.array(F.struct(F.lit("brier").alias("metric"), F.col("a").alias("raw"), F.col("b").alias("crossed")), F.struct(F.lit("log_loss").alias("metric"), F.col("c").alias("raw"), F.col("e").alias("crossed")))).alias("x")).select("x.metric", r9("x.raw", "raw"), r9("x.crossed", "crossed"))


_RANGE = f"WITH {X.F3}, b AS (SELECT min(cat_score) AS lo, max(cat_score) AS hi FROM f3 WHERE split = 'TRAIN')"


def _with_range(spark, d):
    rows = X.paired_rows(spark, d)
    bounds = rows.where("split = 'TRAIN'").agg(F.min("cat_score").alias("lo"), F.max("cat_score").alias("hi"))
    return rows.where("split = 'TEST'").crossJoin(F.broadcast(bounds)).withColumn("inside", (F.col("cat_score") >= F.col("lo")) & (F.col("cat_score") <= F.col("hi")))


@query("ag18_observed_range", _RANGE + " SELECT count(*) AS n, round(min(cat_score), 9) AS lo, round(quantile_cont(cat_score, 0.25), 9) AS q1, round(median(cat_score), 9) AS median, round(quantile_cont(cat_score, 0.75), 9) AS q3, round(max(cat_score), 9) AS hi, round(avg((cat_score < b.lo OR cat_score > b.hi)::INTEGER), 9) AS outside FROM f3, b WHERE split = 'TEST'")
def ag18(spark, d):
    c = "cat_score"
    return _with_range(spark, d).agg(F.count("*").alias("n"), r9(F.min(c), "lo"), r9(F.percentile(c, F.lit(0.25)), "q1"), r9(F.percentile(c, F.lit(0.5)), "median"), r9(F.percentile(c, F.lit(0.75)), "q3"), r9(F.max(c), "hi"), r9(F.avg((~F.col("inside")).cast("int").cast("double")), "outside"))


@query("ag19_range_decomposition", _RANGE + f", l AS (SELECT {_B('cat_score')} AS l, cat_score BETWEEN lo AND hi AS inside FROM f3, b WHERE split = 'TEST') SELECT round(sum(CASE WHEN inside THEN l ELSE 0 END) / count(*), 9) AS inside, round(sum(CASE WHEN inside THEN 0 ELSE l END) / count(*), 9) AS outside, true AS additive FROM l")
def ag19(spark, d):
    loss = N.brier(F.col("cat_score"), F.col("label"))
    a = _with_range(spark, d).agg((F.sum(F.when(F.col("inside"), loss).otherwise(0.0)) / F.count("*")).alias("i"), (F.sum(F.when(F.col("inside"), 0.0).otherwise(loss)) / F.count("*")).alias("o"), F.avg(loss).alias("all"))
    return a.select(r9("i", "inside"), r9("o", "outside"), (F.abs(F.col("i") + F.col("o") - F.col("all")) < 1e-9).alias("additive"))


@query("ag20_score_geometry", f"WITH {X.F3} SELECT split, round(min(cat_score), 9) AS lo, round(quantile_disc(cat_score, 0.05), 9) AS q05, round(quantile_disc(cat_score, 0.5), 9) AS q50, round(quantile_disc(cat_score, 0.95), 9) AS q95, round(max(cat_score), 9) AS hi FROM f3 GROUP BY split")
def ag20(spark, d):
    q = lambda f: F.round(F.expr(f"percentile_disc({f}) within group (order by cat_score)"), 9)
    return X.paired_rows(spark, d).groupBy("split").agg(r9(F.min("cat_score"), "lo"), q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"), r9(F.max("cat_score"), "hi"))


@query("ag21_end_to_end", f"WITH {X.F4} SELECT round(avg((a.winner = a.truth)::INTEGER), 9) AS a, round(avg((b.winner = b.truth)::INTEGER), 9) AS b, round(avg((a.winner = b.winner)::INTEGER), 9) AS agree FROM f4 a JOIN f4 b ON a.item_id = b.item_id AND a.rotation = 0 AND b.rotation = 1")
def ag21(spark, d):
    f4 = X.perturbed_records(spark, d)
    a, b = f4.where("rotation = 0").select("item_id", "truth", F.col("winner").alias("x")), f4.where("rotation = 1").select("item_id", F.col("winner").alias("y"))
    rate = lambda c: F.round(F.avg(c.cast("int").cast("double")), 9)
    return a.join(b, "item_id").agg(rate(F.col("x") == F.col("truth")).alias("a"), rate(F.col("y") == F.col("truth")).alias("b"), rate(F.col("x") == F.col("y")).alias("agree"))


@query("ag22_non_simplex", f"WITH {X.F1}, s AS (SELECT item_id, list_sum(list_transform(v, lambda x: 1 / (1 + exp(-x)))) AS s, len(list_filter(v, lambda x: x > 0)) AS over FROM f1) SELECT round(min(s), 9) AS lo, round(avg(s), 9) AS mean, round(max(s), 9) AS hi, count(*) FILTER (over > 1) AS multi FROM s")
def ag22(spark, d):
    e = X.choice_evidence(spark, d).select(N.array_sum(F.transform("values", N.sigmoid)).alias("s"), F.size(F.filter("values", lambda x: x > 0)).alias("over"))
    return e.agg(r9(F.min("s"), "lo"), r9(F.avg("s"), "mean"), r9(F.max("s"), "hi"), F.count_if(F.col("over") > 1).alias("multi"))


@query("ag23_strata_summary", f"{O2} SELECT stratum, bucket, count(*) AS n, round(avg(correct::INTEGER), 9) AS accuracy FROM o2 GROUP BY stratum, bucket")
def ag23(spark, d):
    return X.bool_observations(spark, d).groupBy("stratum", "bucket").agg(F.count("*").alias("n"), r9(F.avg(F.col("correct").cast("int").cast("double")), "accuracy"))


@query("ag24_naive_reliability", f"WITH {X.F3}, g AS (SELECT CAST(least(floor(cat_score * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(cat_score) AS m, avg(label) AS r FROM f3 GROUP BY 1), b AS (SELECT CAST(unnest(range(0, 10)) AS BIGINT) AS bin) SELECT bin, coalesce(n, 0) AS n, round(m, 9) AS mean_p, round(r, 9) AS rate FROM b LEFT JOIN g USING (bin)")
def ag24(spark, d):
    rows = X.paired_rows(spark, d).withColumn("correct", F.col("label") == 1)
    return M.reliability(rows, "cat_score", "correct", 10, "item_id", N.naive_bin(F.col("cat_score"))).select("bin", "n", r9("mean_p", "mean_p"), r9("rate", "rate"))


_LAD = f"WITH {X.F5}, l AS (SELECT family, case_id, max(CASE WHEN rung = 1 THEN p END) AS hi, max(CASE WHEN rung = 5 THEN p END) AS lo, count(*) AS n FROM f5 GROUP BY family, case_id)"


def _ends(spark, d):
    return X.ladder_records(spark, d).groupBy("family", "case_id").agg(F.max(F.when(F.col("rung") == 1, F.col("p"))).alias("hi"), F.max(F.when(F.col("rung") == 5, F.col("p"))).alias("lo"), F.count("*").alias("n"))


_share = lambda c: F.round(F.avg(c.cast("int").cast("double")), 9)
_agg("ag25_directional_accuracy", _LAD + " SELECT family, count(*) AS n, round(avg((hi > lo)::INTEGER), 9) AS share FROM l WHERE hi IS NOT NULL AND lo IS NOT NULL GROUP BY family", lambda s, d: _ends(s, d).where("hi is not null and lo is not null").groupBy("family").agg(F.count("*").alias("n"), _share(F.col("hi") > F.col("lo")).alias("share")))
_agg("ag27_polarity_consistency", _LAD + " SELECT family, round(avg((hi > lo)::INTEGER), 9) AS share FROM l WHERE n >= 2 AND hi IS NOT NULL AND lo IS NOT NULL GROUP BY family", lambda s, d: _ends(s, d).where("n >= 2 and hi is not null and lo is not null").groupBy("family").agg(_share(F.col("hi") > F.col("lo")).alias("share")))
_agg("ag29_collapse_rate", _LAD + " SELECT family, round(avg(((hi > 0.5) = (lo > 0.5))::INTEGER), 9) AS share FROM l WHERE hi IS NOT NULL AND lo IS NOT NULL GROUP BY family", lambda s, d: _ends(s, d).where("hi is not null and lo is not null").groupBy("family").agg(_share((F.col("hi") > 0.5) == (F.col("lo") > 0.5)).alias("share")))
_agg("ag30_prior_bias", f"WITH {X.F5} SELECT family, count(*) AS n, round(avg(p), 9) AS mean, round(min(p), 9) AS lo, round(max(p), 9) AS hi, round(avg((p > 0.5)::INTEGER), 9) AS over_half FROM f5 GROUP BY family", lambda s, d: X.ladder_records(s, d).groupBy("family").agg(F.count("*").alias("n"), r9(F.avg("p"), "mean"), r9(F.min("p"), "lo"), r9(F.max("p"), "hi"), _share(F.col("p") > 0.5).alias("over_half")))
_STEPS = f"WITH {X.F5}, s AS (SELECT family, case_id, p, lead(p) OVER (PARTITION BY family, case_id ORDER BY rung) AS q, count(*) OVER (PARTITION BY family, case_id) AS n FROM f5)"


def _steps(spark, d):
    w = Window.partitionBy("family", "case_id")
    return X.ladder_records(spark, d).withColumns({"q": F.lead("p").over(w.orderBy("rung")), "n": F.count("*").over(w)}).where("n = 5 and q is not null")


_agg("ag26_ladder_monotonicity", _STEPS + " SELECT family, count(*) AS pairs, round(avg((p > q)::INTEGER), 9) AS share FROM s WHERE n = 5 AND q IS NOT NULL GROUP BY family", lambda s, d: _steps(s, d).groupBy("family").agg(F.count("*").alias("pairs"), _share(F.col("p") > F.col("q")).alias("share")))
_agg("ag28_contrast_ordering", _STEPS + " SELECT family, case_id, bool_and(p > q) AS holds FROM s WHERE n = 5 AND q IS NOT NULL GROUP BY family, case_id", lambda s, d: _steps(s, d).groupBy("family", "case_id").agg(F.bool_and(F.col("p") > F.col("q")).alias("holds")))
_MASS = f"WITH {X.F2}, m AS (SELECT stratum, exp(l_true) / exp(vocab_lse) * 0.6 AS m FROM s2), g AS (SELECT stratum, CASE WHEN m < 0.01 THEN 'low' WHEN m < 0.5 THEN 'middle' ELSE 'high' END AS band, m FROM m)"
_agg("ag31_mass_bands", _MASS + " SELECT stratum, band, count(*) AS n FROM g GROUP BY stratum, band", lambda s, d: _mass(s, d).groupBy("stratum", "band").agg(F.count("*").alias("n")))
_agg("ag34_mass_summary", _MASS + " SELECT stratum, count(*) AS n, round(min(m), 9) AS lo, round(avg(m), 9) AS mean, round(max(m), 9) AS hi FROM g GROUP BY stratum", lambda s, d: _mass(s, d).groupBy("stratum").agg(F.count("*").alias("n"), r9(F.min("m"), "lo"), r9(F.avg("m"), "mean"), r9(F.max("m"), "hi")))


def _mass(spark, d):
    rows = X.bool_evidence(spark, d).select("stratum", (F.exp(F.col("l_true") - F.col("vocab_lse")) * 0.6).alias("m"))
    return rows.withColumn("band", F.when(F.col("m") < 0.01, "low").when(F.col("m") < 0.5, "middle").otherwise("high"))


@query("ag32_group_summary", f"WITH {X.F5} SELECT family, rung, count(*) AS n, round(avg(p), 9) AS mean, round(avg((p > 0.5)::INTEGER), 9) AS over_half FROM f5 GROUP BY family, rung")
def ag32(spark, d):
    return X.ladder_records(spark, d).groupBy("family", "rung").agg(F.count("*").alias("n"), r9(F.avg("p"), "mean"), _share(F.col("p") > 0.5).alias("over_half"))


@query("ag33_permutation_metrics", f"WITH {X.F4}, j AS (SELECT a.rotation, (a.winner = b.winner)::INTEGER AS same, list_sum(list_transform(range(1, 9), lambda i: abs(a.p[i] - b.p[i]))) / 2 AS tv FROM f4 a JOIN f4 b ON a.item_id = b.item_id AND b.rotation = 0) SELECT rotation::INTEGER AS rotation, round(avg(same), 9) AS preserved, round(avg(tv), 9) AS mean_tv, round(max(tv), 9) AS max_tv FROM j GROUP BY rotation")
def ag33(spark, d):
    f4 = X.perturbed_records(spark, d).withColumn("m", F.map_from_arrays("names", "p"))
    base = f4.where("rotation = 0").select("item_id", F.col("m").alias("b"), F.col("winner").alias("w"))
    j = f4.join(base, "item_id").select("rotation", (F.col("winner") == F.col("w")).alias("same"), N.tv_distance(F.col("m"), F.col("b")).alias("tv"))
    return j.groupBy("rotation").agg(_share(F.col("same")).alias("preserved"), r9(F.avg("tv"), "mean_tv"), r9(F.max("tv"), "max_tv"))


@query("ag35_accuracy_like", f"WITH {X.F4} SELECT rotation::INTEGER AS rotation, count(*) AS n, round(avg((winner = truth)::INTEGER), 9) AS rate FROM f4 WHERE truth IS NOT NULL GROUP BY rotation")
def ag35(spark, d):
    return X.perturbed_records(spark, d).where("truth is not null").groupBy("rotation").agg(F.count("*").alias("n"), _share(F.col("winner") == F.col("truth")).alias("rate"))


@query("ag36_uniqueness_and_latency", "SELECT event_type, count(DISTINCT user_id) AS users, round(min(value), 9) AS lo, round(median(value), 9) AS median, round(avg(value), 9) AS mean, round(max(value), 9) AS hi, min(event_id) AS first_event FROM (SELECT event_type, user_id, event_id, CAST(event_id % 1000 AS DOUBLE) / 7 AS value FROM events) GROUP BY event_type")
def ag36(spark, d):
    e = X.table(spark, d, "events").select("event_type", "user_id", "event_id", ((F.col("event_id") % 1000) / 7).alias("value"))
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), r9(F.min("value"), "lo"), r9(F.percentile("value", F.lit(0.5)), "median"), r9(F.avg("value"), "mean"), r9(F.max("value"), "hi"), F.min("event_id").alias("first_event"))


@query("ag37_structural_counts", f"WITH {X.S1} SELECT count(*) AS n, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'TAXONOMY_MISS') AS missed, count(*) FILTER (adjudicated) AS adjudicated FROM s1")
def ag37(spark, d):
    return observed(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count_if(F.col("status") == "TAXONOMY_MISS").alias("missed"), F.count_if(F.col("adjudicated")).alias("adjudicated"))


@query("ag38_distribution", "SELECT CAST(a AS BIGINT) AS anchor, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM nation), 9) AS share FROM (SELECT unnest(range(0, 6)) AS a) LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON a = n_regionkey")
def ag38(spark, d):
    n = X.table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("anchor")).agg(F.count("*").alias("n"))
    total = X.table(spark, d, "nation").agg(F.count("*").alias("all"))
    rows = spark.range(6).select(F.col("id").alias("anchor")).join(n, "anchor", "left").crossJoin(F.broadcast(total))
    return rows.select("anchor", F.coalesce("n", F.lit(0)).alias("n"), r9(F.coalesce("n", F.lit(0)) / F.col("all"), "share"))


@query("ag39_duplicate_stats", "WITH g AS (SELECT text, count(*) AS k FROM documents GROUP BY text) SELECT count(*) FILTER (k > 1) AS groups, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS rows, max(k) AS largest, round(quantile_cont(k, 0.99), 9) AS q99 FROM g")
def ag39(spark, d):
    g = X.table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("k"))
    return g.agg(F.count_if(F.col("k") > 1).alias("groups"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).cast("bigint").alias("rows"), F.max("k").alias("largest"), r9(F.percentile("k", F.lit(0.99)), "q99"))


@query("ag40_split_overlap", "WITH a AS (SELECT sha256(text) AS content, count(*) AS n_a, min(lang) AS lo, max(lang) AS hi FROM documents WHERE doc_id % 10 = 0 GROUP BY 1), b AS (SELECT sha256(text) AS content, count(*) AS n_b, min(lang) AS lo, max(lang) AS hi FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1) SELECT content, n_a, n_b, least(a.lo, b.lo) <> greatest(a.hi, b.hi) AS conflict FROM a JOIN b USING (content)")
def ag40(spark, d):
    from ..operators.sampling import overlap

    docs = X.table(spark, d, "documents").select("doc_id", "lang", I.digest(F.col("text")).alias("content"))
    return overlap(docs.where("doc_id % 10 = 0"), docs.where("doc_id % 10 <> 0"), "content", "lang")


@query("ag41_coverage", f"WITH {X.F3} SELECT stratum, bool_and(n >= 2) AS available, count(*) AS cells FROM (SELECT stratum, cluster_id, count(*) AS n FROM f3 WHERE split = 'TEST' GROUP BY ALL) GROUP BY stratum")
def ag41(spark, d):
    cells = X.paired_rows(spark, d).where("split = 'TEST'").groupBy("stratum", "cluster_id").agg(F.count("*").alias("n"))
    return cells.groupBy("stratum").agg(F.bool_and(F.col("n") >= 2).alias("available"), F.count("*").alias("cells"))


@query("ag42_equivalence_maxima", f"WITH {X.F4}, c AS (SELECT item_id, rotation, p, list_transform(p, lambda x: ln(x) - list_sum(list_transform(p, lambda y: ln(y))) / 8) AS c FROM f4) SELECT round(max(list_max(list_transform(range(1, 9), lambda i: abs(a.c[i] - b.c[i])))), 9) AS max_centred, round(max(list_sum(list_transform(range(1, 9), lambda i: abs(a.p[i] - b.p[i]))) / 2), 9) AS max_tv FROM c a JOIN c b ON a.item_id = b.item_id AND a.rotation = 1 AND b.rotation = 0")
def ag42(spark, d):
    from ..operators.signal import centred

    f4 = X.perturbed_records(spark, d).withColumn("c", centred(F.col("p")))
    a, b = f4.where("rotation = 1").select("item_id", F.col("c").alias("ca"), F.col("p").alias("pa")), f4.where("rotation = 0").select("item_id", F.col("c").alias("cb"), F.col("p").alias("pb"))
    gap = lambda x, y: F.zip_with(x, y, lambda u, v: F.abs(u - v))
    return a.join(b, "item_id").agg(r9(F.max(F.array_max(gap("ca", "cb"))), "max_centred"), r9(F.max(N.array_sum(gap("pa", "pb")) / 2), "max_tv"))
