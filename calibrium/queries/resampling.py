"""Bootstraps and intervals (BS*); draws are cut down to weights first."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import numeric as N
from ..operators import refits as RF
from ..operators import resampling as B
from ..operators.resampling import REFIT_REPLICATES
from . import query
from .aggregates import _B, CROSS, NATIVE, _S, losses
from .scalars import r9

#: Replicates of queries on TEST rows, of the tails, and of all queries on TRAIN rows. The operators' own defaults are
#: the study's 20,000 and 2,000; on TEST rows SQL takes too long for 20,000, so queries with SQL draw fewer.
TESTS, TAILS, REFITS = 200, 1000, REFIT_REPLICATES
#: Fixed value: replicates of the simple paired bootstrap, which the reference has in another protocol.
PAIRED = 2_000


def _draws(unit, pool, n_sql="n", pop="p", extra="", wide=False, reps=REFITS, draws=None):
    """SQL of draws (replicate, stratum, unit): CTEs u and dr."""
    text = f"""'{{{extra}"draw_index":' || k || ',"pool_size":' || n || ',"population_id":"{pop}","protocol_id":"hash-bootstrap","protocol_version":1,"replicate_index":' || r || ',"stratum":"' || stratum || '"}}'"""
    h = f"sha256({text})"
    index = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: CAST(('0x' || substr({h}, 1 + 8 * i, 8))::UBIGINT AS BIGINT))), lambda a, x: (a * 4294967296 + x) % n)" if wide else f"CAST(('0x' || substr({h}, 1, 16))::UBIGINT % n::UBIGINT AS BIGINT)"
    return f"""u AS (SELECT stratum, {unit}, row_number() OVER (PARTITION BY stratum ORDER BY {unit}) - 1 AS place FROM (SELECT DISTINCT stratum, {unit} FROM {pool})),
z AS (SELECT stratum, count(*) AS n FROM u GROUP BY stratum),
dr AS (SELECT r AS replicate, stratum, {index} AS place FROM (SELECT stratum, n, r, unnest(range(0, {draws or 'n'})) AS k FROM z, (SELECT unnest(range(0, {reps})) AS r))),
w AS (SELECT replicate, stratum, {unit}, count(*) AS w FROM dr JOIN u USING (stratum, place) GROUP BY ALL)"""


def fits_sql(feature="v", sure=None):
    """SQL of all refits: CTEs w of draws and sol (replicate, m, a, b) of both maps.

    sure: SQL of a TRAIN score that is taken for certain; replicates that draw it are in `gone`, not in sol.
    """
    from .fits import newton

    body = T3.removeprefix("WITH ") + ", " + _draws("item_id", "t", reps=REFITS)
    gone = f"SELECT DISTINCT replicate FROM w JOIN f3 USING (item_id) WHERE {sure}" if sure else "SELECT 0 AS replicate WHERE false"
    return "WITH RECURSIVE " + body + f", gone AS ({gone}), src AS (SELECT replicate, m, {feature} AS x, y, 0.01 AS s, w FROM (SELECT replicate, m, CASE m WHEN 'cat' THEN cat_score ELSE ovr_score END AS v, f3.label AS y, w FROM w JOIN f3 USING (item_id), (SELECT unnest(['cat', 'ovr']) AS m) WHERE replicate NOT IN (SELECT replicate FROM gone))), " + newton("src", ["replicate", "m"], 25)


T3 = f"WITH {X.F3}, t AS (SELECT stratum, cluster_id, item_id, label, {_B('ovr_score')} AS raw, {_B(_S(CROSS, 'ovr_score'))} AS crossed, {_B(_S(NATIVE, 'ovr_score'))} AS native FROM f3 WHERE split = 'TRAIN')"


#: The same of the TEST rows.
E3 = T3.replace("split = 'TRAIN'", "split = 'TEST'")


def train(spark, d, split="TRAIN"):
    from ..operators.panel import risk_matrix

    return risk_matrix(X.paired_rows(spark, d).where(F.col("split") == split), "ovr_score", CROSS, NATIVE)


def test(spark, d):
    return train(spark, d, "TEST")


def _deltas(rows):
    return rows.select("item_id", "cluster_id", "stratum", (F.col("crossed") - F.col("raw")).alias("deploy"), (F.col("crossed") - F.col("native")).alias("transport"))


@query("bs01_stratified_draws", T3 + ", " + _draws("item_id", "t") + " SELECT CAST(replicate AS INTEGER) AS replicate, stratum, CAST(sum(w) AS BIGINT) AS n, count(*) AS distinct_rows, CAST(sum(w * item_id) AS BIGINT) AS item_sum, CAST(sum(w * w * item_id) AS BIGINT) AS square_sum FROM w GROUP BY replicate, stratum")
def bs01(spark, d):
    """How often each row is drawn, as sums over the rows of every replicate and stratum."""
    sums = {"n": lambda w, i: w.sum(), "distinct_rows": lambda w, i: len(w), "item_sum": B.whole_dot, "square_sum": lambda w, i: B.whole_dot(w * w, i)}
    return B.drawn_sums(train(spark, d), "item_id", "stratum", REFITS, "p", ["item_id"], sums)


def _tests(unit, pop="p", reps=TESTS, **more):
    return _draws(unit, "t", pop=pop, reps=reps, **more)


@query("bs02_cluster_draws", E3 + ", " + _tests("cluster_id", "c") + " SELECT CAST(replicate AS INTEGER) AS replicate, CAST(sum(w) AS BIGINT) AS rows, round(sum(w * raw) / sum(w), 9) AS raw FROM w JOIN t USING (cluster_id) GROUP BY replicate")
def bs02(spark, d):
    return B.bootstrap_means(test(spark, d), "cluster_id", "stratum", ["raw"], TESTS, "c").select("replicate", F.col("n").alias("rows"), r9("raw", "raw"))


@query("bs03_test_draw_modes", E3 + ", " + _tests("item_id") + ", " + _tests("cluster_id", "c").replace("u AS", "uc AS").replace("FROM u ", "FROM uc ").replace("JOIN u ", "JOIN uc ").replace("z AS", "zc AS").replace("FROM z,", "FROM zc,").replace("dr AS", "drc AS").replace("FROM dr ", "FROM drc ").replace("w AS (SELECT", "wc AS (SELECT") + " SELECT 'row' AS mode, CAST(replicate AS INTEGER) AS replicate, CAST(sum(w) AS BIGINT) AS n, round(sum(w * raw) / sum(w), 9) AS raw FROM w JOIN t USING (item_id) GROUP BY replicate UNION ALL SELECT 'cluster', CAST(replicate AS INTEGER), CAST(sum(w) AS BIGINT), round(sum(w * raw) / sum(w), 9) FROM wc JOIN t USING (cluster_id) GROUP BY replicate")
def bs03(spark, d):
    t = test(spark, d)
    one = lambda unit, pop, mode: B.bootstrap_means(t, unit, "stratum", ["raw"], TESTS, pop).select(F.lit(mode).alias("mode"), "replicate", "n", r9("raw", "raw"))
    return one("item_id", "p", "row").unionByName(one("cluster_id", "c", "cluster"))


@query("bs04_train_refit_draws", T3 + ", " + _draws("item_id", "t", pop="p", extra='"budget_identity":"N500",') + " SELECT CAST(replicate AS INTEGER) AS replicate, stratum, CAST(sum(w) AS BIGINT) AS n, count(*) AS distinct_rows FROM w GROUP BY replicate, stratum")
def bs04(spark, d):
    return B.drawn_sums(train(spark, d), "item_id", "stratum", REFITS, "p", [], {"n": lambda w: w.sum(), "distinct_rows": len}, extra={"budget_identity": "N500"})


_ONE = E3.replace("SELECT stratum, cluster_id, item_id, label", "SELECT 'all' AS stratum, cluster_id, item_id, label")


@query("bs05_paired_test_bootstrap", _ONE + ", " + _tests("item_id", "wide", reps=PAIRED, wide=True) + " SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(w * (crossed - raw)) / sum(w), 9) AS deploy FROM w JOIN t USING (item_id) GROUP BY replicate")
def bs05(spark, d):
    t = _deltas(test(spark, d)).withColumn("stratum", F.lit("all"))
    return B.bootstrap_means(t, "item_id", "stratum", ["deploy"], PAIRED, "wide", wide=True).select("replicate", r9("deploy", "deploy"))


SCORES = {"cat": "cat_score", "ovr": "ovr_score"}


def refits(spark, d, reps=REFITS, feature="p", sure=None):
    """Both maps of every resampled training set, and their losses on the TEST rows."""
    rows = X.paired_rows(spark, d)
    own = rows.where("split = 'TRAIN'")
    if sure is not None:
        own = own.withColumn("cat_score", F.when(sure(own), 1.0).otherwise(F.col("cat_score")))
    return RF.refit(own, rows.where("split = 'TEST'"), "item_id", "stratum", SCORES, "label", 1e-2, reps, feature=feature)


@query("bs06_train_refit_bootstrap", fits_sql() + " SELECT CAST(replicate AS INTEGER) AS replicate, 'AVAILABLE' AS status, round(any_value(a) FILTER (m = 'cat'), 6) AS cat_slope, round(any_value(b) FILTER (m = 'cat'), 6) AS cat_intercept, round(any_value(a) FILTER (m = 'ovr'), 6) AS ovr_slope, round(any_value(b) FILTER (m = 'ovr'), 6) AS ovr_intercept FROM sol GROUP BY replicate")
def bs06(spark, d):
    return refits(spark, d).select("replicate", "status", *[F.round(f"{m}_{p}", 6).alias(f"{m}_{p}") for m in SCORES for p in ("slope", "intercept")])


@query("bs07_subject_statistic", E3 + ", " + _tests("item_id") + " SELECT CAST(replicate AS INTEGER) AS replicate, round(avg(m), 9) AS mean FROM (SELECT replicate, t.stratum, sum(w * raw) / sum(w) AS m FROM w JOIN t USING (item_id) GROUP BY replicate, t.stratum) GROUP BY replicate")
def bs07(spark, d):
    m = B.bootstrap_means(test(spark, d), "item_id", "stratum", ["raw"], TESTS, by_stratum=True)
    return m.groupBy("replicate").agg(r9(F.avg("raw"), "mean"))


@query("bs08_fixed_count_draws", T3 + ", " + _draws("item_id", "t", draws=10) + " SELECT CAST(replicate AS INTEGER) AS replicate, stratum, CAST(sum(w) AS BIGINT) AS n FROM w GROUP BY replicate, stratum")
def bs08(spark, d):
    return B.weights(train(spark, d), "item_id", "stratum", REFITS, "p", draws=10).groupBy("replicate", "stratum").agg(F.sum("w").alias("n"))


#: The configurations of the panel: two scores, four maps of a score (None: itself), two losses.
MAPS = {"raw": None, "crossed": CROSS, "native": NATIVE, "shrunk": (2.0, -1.0)}
CONFIGS = [(s, m, k) for s in ("cat", "ovr") for m in MAPS for k in ("brier", "log")]
PANEL = [f"{s}_{m}_{k}" for s, m, k in CONFIGS]
#: Contrasts of a score and loss: name, terms.
CONTRASTS = {f"{s}_{c}_{k}": (f"{s}_{a}_{k}", f"{s}_{b}_{k}") for s in ("cat", "ovr") for k in ("brier", "log") for c, a, b in (("deploy", "crossed", "raw"), ("gain", "native", "raw"), ("transport", "crossed", "native"))}


def _panel_sql():
    q = lambda s, m: f"{s}_score" if MAPS[m] is None else _S(MAPS[m], f"{s}_score")
    loss = {"brier": lambda p: _B(p), "log": lambda p: f"-ln(CASE WHEN label = 1 THEN {p} ELSE 1 - {p} END)"}
    return f"WITH {X.F3}, t AS (SELECT stratum, cluster_id, item_id, " + ", ".join(f"{loss[k](q(s, m))} AS {n}" for (s, m, k), n in zip(CONFIGS, PANEL)) + " FROM f3 WHERE split = 'TEST')"


def panel_losses(spark, d):
    """Losses of all configurations, a row a TEST item."""
    rows, y = X.paired_rows(spark, d).where("split = 'TEST'"), F.col("label")
    q = lambda s, m: F.col(f"{s}_score") if MAPS[m] is None else N.sigmoid(MAPS[m][0] * F.col(f"{s}_score") + MAPS[m][1])
    loss = {"brier": lambda p: N.brier(p, y), "log": lambda p: N.log_loss(p, y == 1)}
    return rows.select("stratum", "cluster_id", "item_id", *[loss[k](q(s, m)).alias(n) for (s, m, k), n in zip(CONFIGS, PANEL)])


def panel_series(spark, d, replicates=TESTS):
    """(replicate, n, means of all configurations, their contrasts): one draw serves all of them."""
    s = B.bootstrap_means(panel_losses(spark, d), "item_id", "stratum", PANEL, replicates)
    return s.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in CONTRASTS.items()})


_PANEL = _panel_sql() + ", " + _tests("item_id") + ", s0 AS (SELECT replicate, CAST(sum(w) AS BIGINT) AS n, " + ", ".join(f"sum(w * {c}) / sum(w) AS {c}" for c in PANEL) + " FROM w JOIN t USING (item_id) GROUP BY replicate), s AS (SELECT *, " + ", ".join(f"{a} - {b} AS {n}" for n, (a, b) in CONTRASTS.items()) + " FROM s0)"
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {n} AS v FROM s" for n in CONTRASTS) + ")"


def _long(series):
    """(name, v) of all contrasts."""
    return series.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in CONTRASTS])).alias("x")).select("x.*")


def _series(reps):
    return E3 + ", " + _tests("item_id", reps=reps) + ", s AS (SELECT replicate, sum(w * (crossed - raw)) / sum(w) AS deploy, sum(w * (crossed - native)) / sum(w) AS transport FROM w JOIN t USING (item_id) GROUP BY replicate)"


_SERIES = _series(TESTS)


def series(spark, d, replicates=TESTS):
    return B.bootstrap_means(_deltas(test(spark, d)), "item_id", "stratum", ["deploy", "transport"], replicates)


@query("bs09_panel_bootstrap", _PANEL + " SELECT CAST(replicate AS INTEGER) AS replicate, n, " + ", ".join(f"round({c}, 9) AS {c}" for c in [*PANEL, *CONTRASTS]) + " FROM s")
def bs09(spark, d):
    """Sixteen configurations and twelve contrasts of each replicate."""
    return panel_series(spark, d).select("replicate", "n", *[r9(c, c) for c in [*PANEL, *CONTRASTS]])


@query("bs09_panel_intervals")
def bs09_intervals(spark, d):
    """Intervals of the panel's contrasts from all 20,000 replicates; too many draws for the SQL."""
    i = B.percentile_interval(_long(panel_series(spark, d, B.TEST_REPLICATES)), "v", 0.025, 0.975, ["name"])
    return i.select("name", "n", r9("lower", "lower"), r9("median", "median"), r9("upper", "upper"), "excludes_zero")


_LARGEST = "(SELECT max(cat_score) FROM f3 WHERE split = 'TRAIN')"


@query("bs10_refit_block", fits_sql(feature="ln(v / (1 - v))", sure=f"cat_score = {_LARGEST}") + " SELECT CASE WHEN (SELECT count(*) FROM gone) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS state, CAST(2000 AS BIGINT) AS planned, (SELECT count(*) FROM gone) AS failed, count(*) FILTER (m = 'cat') AS available, round(sum(a) FILTER (m = 'cat'), 3) AS cat_slopes, round(sum(a) FILTER (m = 'ovr'), 3) AS ovr_slopes FROM sol")
def bs10(spark, d):
    """Maps on logits, with the largest TRAIN score taken for certain: a replicate that draws it fails, and with it the block."""
    top = X.paired_rows(spark, d).where("split = 'TRAIN'").agg(F.max("cat_score")).first()[0]
    fits = refits(spark, d, feature="logit", sure=lambda rows: F.col("cat_score") == top)
    bad = F.col("status") != "AVAILABLE"
    a = fits.agg(F.count("*").alias("planned"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("available"), F.round(F.sum("cat_slope"), 3).alias("cat_slopes"), F.round(F.sum("ovr_slope"), 3).alias("ovr_slopes"))
    return a.select(F.when(F.col("failed") == 0, "COMPLETE").otherwise("INCOMPLETE").alias("state"), "planned", "failed", "available", "cat_slopes", "ovr_slopes")


@query("bs11_log_loss_intervals", E3 + ", " + _tests("item_id") + ", l AS (SELECT item_id, CASE WHEN label = 1 AND item_id % 3001 = 0 THEN CAST('inf' AS DOUBLE) ELSE -ln(CASE WHEN label = 1 THEN ovr_score ELSE 1 - ovr_score END) END AS loss FROM f3 WHERE split = 'TEST') SELECT CAST(replicate AS INTEGER) AS replicate, CASE WHEN bool_or(isinf(loss)) THEN 'POSITIVE_INFINITY' ELSE 'FINITE' END AS state, CASE WHEN NOT bool_or(isinf(loss)) THEN round(sum(w * CASE WHEN isinf(loss) THEN 0 ELSE loss END) / sum(w), 9) END AS mean FROM w JOIN l USING (item_id) GROUP BY replicate")
def bs11(spark, d):
    t = X.paired_rows(spark, d).where("split = 'TEST'")
    p = F.when((F.col("item_id") % 3001 == 0) & (F.col("label") == 1), F.lit(0.0)).otherwise(F.col("ovr_score"))
    m = B.bootstrap_means(t.withColumn("loss", N.log_loss(p, F.col("label") == 1)), "item_id", "stratum", ["loss"], TESTS)
    state = N.state(F.col("loss"))
    return m.select("replicate", state.alias("state"), F.when(state == "FINITE", F.round("loss", 9)).alias("mean"))


@query("bs12_nearest_rank", _SERIES + " SELECT round(quantile_disc(deploy, 0.05), 9) AS q05, round(quantile_disc(deploy, 0.5), 9) AS q50, round(quantile_disc(deploy, 0.95), 9) AS q95 FROM s")
def bs12(spark, d):
    i = B.percentile_interval(series(spark, d), "deploy", 0.05, 0.95)
    return i.select(r9("lower", "q05"), r9("median", "q50"), r9("upper", "q95"))


@query("bs13_percentile_interval", _SERIES + ", i AS (SELECT count(*) AS n, quantile_disc(transport, 0.025) AS lo, quantile_disc(transport, 0.975) AS hi, quantile_disc(transport, 0.5) AS m FROM s) SELECT n, round(lo, 9) AS lower, round(m, 9) AS median, round(hi, 9) AS upper, lo > 0 OR hi < 0 AS excludes_zero FROM i")
def bs13(spark, d):
    i = B.percentile_interval(series(spark, d), "transport", 0.025, 0.975)
    return i.select("n", r9("lower", "lower"), r9("median", "median"), r9("upper", "upper"), "excludes_zero")


#: Family, hypotheses, tail of each side.
FAMILIES = [("primary", 12, 1 / 480), ("native", 8, 1 / 480), ("extension", 6, 1 / 320), ("direction", 12, 1 / 240)]


@query("bs14_hypothesis_tails", _series(TAILS) + ", f(family, tail) AS (VALUES ('primary', 1 / 480), ('native', 1 / 480), ('extension', 1 / 320), ('direction', 1 / 240)), o AS (SELECT list_sort(list(deploy)) AS v FROM s) SELECT family, round(tail, 12) AS tail, round(v[greatest(1, CAST(ceil(tail * len(v)) AS INTEGER))], 9) AS lower, round(v[CAST(ceil((1 - tail) * len(v)) AS INTEGER)], 9) AS upper FROM f, o")
def bs14(spark, d):
    f = spark.createDataFrame([(a, t) for a, _, t in FAMILIES], "family string, tail double")
    lists = series(spark, d, TAILS).agg(F.array_sort(F.collect_list("deploy")).alias("v"))
    rank = lambda level: F.greatest(F.lit(1), F.least(F.ceil(level * F.size("v")), F.size("v"))).cast("int")
    rows = F.broadcast(f).crossJoin(lists)
    return rows.select("family", F.round("tail", 12).alias("tail"), r9(F.element_at("v", rank(F.col("tail"))), "lower"), r9(F.element_at("v", rank(1 - F.col("tail"))), "upper"))


@query("bs15_contrast_per_replicate", _SERIES + " SELECT CAST(replicate AS INTEGER) AS replicate, round(deploy - transport, 9) AS v FROM s")
def bs15(spark, d):
    return series(spark, d).select("replicate", r9(F.col("deploy") - F.col("transport"), "v"))


#: Rows of the TRAIN set that a smaller budget has: the first half of each stratum by a digest's rank.
HALF_SQL = "half AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY stratum ORDER BY sha256('budget' || item_id)) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM f3 WHERE split = 'TRAIN') WHERE 2 * k <= n)"


def half(rows):
    from pyspark.sql import Window

    from ..functions import identity as I

    w = Window.partitionBy("stratum")
    k = F.row_number().over(w.orderBy(I.digest(F.concat(F.lit("budget"), F.col("item_id").cast("string")))))
    return rows.select("item_id", k.alias("k"), F.count("*").over(w).alias("n")).where("2 * k <= n").select("item_id")


@query("bs16_budget_robustness", T3 + ", " + HALF_SQL + ", " + _draws("item_id", "t") + ", s AS (SELECT replicate, item_id, w * raw AS x, w, item_id IN (SELECT item_id FROM half) AS h FROM w JOIN t USING (item_id)) SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(x) / sum(w) - sum(x) FILTER (h) / sum(w) FILTER (h), 9) AS v FROM s GROUP BY replicate")
def bs16(spark, d):
    """Mean loss of a replicate under the whole budget less that under the half of it."""
    t = train(spark, d)
    t = t.select("item_id", "stratum", "raw").join(half(t).withColumn("h", F.lit(1.0)), "item_id", "left").fillna(0.0, ["h"])
    m = B.bootstrap_means(t.withColumn("raw_h", F.col("raw") * F.col("h")), "item_id", "stratum", ["raw", "raw_h", "h"], REFITS)
    return m.select("replicate", r9(F.col("raw") - F.try_divide("raw_h", "h"), "v"))


@query("bs17_shared_draws", _PANEL + ", " + _LONG + " SELECT name, count(*) FILTER (v < 0) AS negative, count(*) FILTER (v > 0) AS positive, round(avg((v < 0)::INTEGER), 9) AS share FROM l GROUP BY name")
def bs17(spark, d):
    """Signs of each configuration's contrast over the same draws."""
    v = F.col("v")
    return _long(panel_series(spark, d)).groupBy("name").agg(F.count_if(v < 0).alias("negative"), F.count_if(v > 0).alias("positive"), r9(F.avg((v < 0).cast("int").cast("double")), "share"))


@query("cp14_contrast_intervals", _PANEL + ", " + _LONG + ", i AS (SELECT name, quantile_disc(v, 0.05) AS lo, quantile_disc(v, 0.95) AS hi FROM l GROUP BY name) SELECT name, round(lo, 9) AS lower, round(hi, 9) AS upper, CASE WHEN hi < 0 THEN 'improvement' WHEN lo > 0 THEN 'degradation' ELSE 'unresolved' END AS state FROM i")
def cp14(spark, d):
    i = B.percentile_interval(_long(panel_series(spark, d)), "v", 0.05, 0.95, ["name"])
    return i.select("name", r9("lower", "lower"), r9("upper", "upper"), N.direction_state(F.col("lower"), F.col("upper")).alias("state"))


#: Effects of a 2 x 2 design, score by map, on the Brier loss of a replicate.
EFFECTS = {"score": "(ovr_crossed_brier + ovr_native_brier) / 2 - (cat_crossed_brier + cat_native_brier) / 2", "map": "(cat_crossed_brier + ovr_crossed_brier) / 2 - (cat_native_brier + ovr_native_brier) / 2", "interaction": "(ovr_crossed_brier - cat_crossed_brier) - (ovr_native_brier - cat_native_brier)"}


@query("cp14_factorial_intervals", _PANEL + ", l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS effect, {e} AS v FROM s" for n, e in EFFECTS.items()) + ") SELECT effect, round(quantile_disc(v, 0.05), 9) AS lower, round(quantile_disc(v, 0.5), 9) AS median, round(quantile_disc(v, 0.95), 9) AS upper FROM l GROUP BY effect")
def cp14_factorial(spark, d):
    """Main effects and interaction of score and map, by replicate, with their intervals."""
    s = panel_series(spark, d)
    long = s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("effect"), F.expr(e).alias("v")) for n, e in EFFECTS.items()])).alias("x")).select("x.*")
    i = B.percentile_interval(long, "v", 0.05, 0.95, ["effect"])
    return i.select("effect", r9("lower", "lower"), r9("median", "median"), r9("upper", "upper"))


@query("cp16_point_estimates", T3.replace("split = 'TRAIN'", "split = 'TEST'") + " SELECT stratum, round(avg(raw), 9) AS raw, round(avg(crossed - raw), 9) AS deploy, round(avg(crossed - native), 9) AS transport FROM t GROUP BY stratum")
def cp16(spark, d):
    r = losses(spark, d)
    return r.groupBy("stratum").agg(r9(F.avg("raw"), "raw"), r9(F.avg(F.col("crossed") - F.col("raw")), "deploy"), r9(F.avg(F.col("crossed") - F.col("native")), "transport"))
