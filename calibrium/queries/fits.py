"""Fits (FT*), their application (AP*), and the studies built on them (CP*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import numeric as N
from ..functions.exact import exact_means
from ..operators import calibration as C
from ..operators import isotonic as Iso
from ..operators import metrics as M
from ..operators.panel import contrasts
from ..operators import reference as R
from . import query
from .aggregates import eligible
from .scalars import r9
from .scoring import BETA_SQL

W3 = f"WITH {X.F3}"
BY = ["stratum"]


def train(spark, d):
    return X.paired_rows(spark, d).where("split = 'TRAIN'")


def newton(source: str, keys: list[str], steps: int = 30) -> str:
    """SQL of Newton's method from (0, 0), undamped: CTE `sol` (keys, a, b) of rows (keys, x, y, s, w)."""
    k, of_i = ", ".join(keys), ", ".join(f"i.{x}" for x in keys)
    on = " AND ".join(f"i.{x} = r.{x}" for x in keys)
    return f"""it AS (SELECT DISTINCT {k}, 0 AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {source}
UNION ALL SELECT {k}, n + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
  SELECT {k}, n, a, b, sum(w * (q - y) * x) / sum(w) + any_value(s) * a AS ga, sum(w * (q - y)) / sum(w) + any_value(s) * b AS gb, sum(w * q * (1 - q) * x * x) / sum(w) + any_value(s) AS haa, sum(w * q * (1 - q) * x) / sum(w) AS hab, sum(w * q * (1 - q)) / sum(w) + any_value(s) AS hbb
  FROM (SELECT {of_i}, i.n, i.a, i.b, r.x, r.y, r.s, r.w, 1 / (1 + exp(-(i.a * r.x + i.b))) AS q FROM it i JOIN {source} r ON {on} WHERE i.n < {steps}) GROUP BY {k}, n, a, b)),
sol AS (SELECT {k}, a, b FROM it WHERE n = {steps})"""


r6 = lambda c, n: F.round(c, 6).alias(n)
R3 = f"WITH RECURSIVE {X.F3}"
#: Training rows of every score, feature and strength.
PANEL = R3 + """, src AS (SELECT stratum, measurement, feature, s, label AS y, 1.0 AS w, CASE feature WHEN 'p' THEN v ELSE ln(v / (1 - v)) END AS x FROM (SELECT stratum, label, m AS measurement, CASE m WHEN 'cat' THEN cat_score ELSE ovr_score END AS v FROM f3, (SELECT unnest(['cat', 'ovr']) AS m) WHERE split = 'TRAIN'), (SELECT unnest(['p', 'logit']) AS feature), (SELECT unnest([0.0001, 0.01]::DOUBLE[]) AS s)), """ + newton("src", ["stratum", "measurement", "feature", "s"])


@query("ft01_fit_l2_logistic", f"WITH RECURSIVE {X.F2}, src AS (SELECT 1 AS g, selected_p AS x, correct::INTEGER AS y, 0.01 AS s, 1.0 AS w FROM o2 WHERE bucket = 'eligible'), " + newton("src", ["g"]) + " SELECT true AS certified, round(a, 6) AS slope, round(b, 6) AS intercept FROM sol")
def ft01(spark, d):
    """By aggregates of the distributed rows: six numbers a step reach the driver."""
    fit = C.fit_logistic(eligible(spark, d), F.col("selected_p"), F.col("correct").cast("int"), 1e-2)
    return spark.createDataFrame([(fit["certified"], round(fit["slope"], 6), round(fit["intercept"], 6))], "certified boolean, slope double, intercept double")


@query("ft02_objective_terms", W3 + ", t AS (SELECT cat_score AS x, label AS y, 1 / (1 + exp(-(2 * cat_score - 1))) AS q FROM f3 WHERE split = 'TRAIN') SELECT round(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 9) AS nll, round(avg((q - y) * x), 9) AS ga, round(avg(q - y), 9) AS gb, round(avg(q * (1 - q) * x * x), 9) AS haa, round(avg(q * (1 - q) * x), 9) AS hab, round(avg(q * (1 - q)), 9) AS hbb FROM t")
def ft02(spark, d):
    terms = C.objective_values(F.col("cat_score"), F.col("label"), 2.0, -1.0)
    return exact_means(train(spark, d), [], terms).select(*[r9(k, k) for k in terms])


@query("ft03_certificate", "SELECT s AS strength, round(sqrt(2) * sqrt(s) * 1e150, 6) AS bound FROM (SELECT unnest([1e-310, 0.0001, 0.01, 1.0]::DOUBLE[]) AS s) WHERE s < 1e-300 UNION ALL SELECT s, round(sqrt(2 * s * 1e-14) * 1e9, 6) FROM (SELECT unnest([0.0001, 0.01, 1.0]::DOUBLE[]) AS s)")
def ft03(spark, d):
    """A subnormal strength has a bound too, here times 1e157; the others times 1e9."""
    return spark.createDataFrame([(1e-310, round(C.certificate(1e-310) * 1e157, 6)), *[(s, round(C.certificate(s) * 1e9, 6)) for s in (1e-4, 1e-2, 1.0)]], "strength double, bound double")


@query("ft04_ordered_rows", W3 + " SELECT stratum, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS fp FROM f3 WHERE split = 'TRAIN' GROUP BY stratum")
def ft04(spark, d):
    from ..functions.identity import multiset_digest

    return train(spark, d).groupBy("stratum").agg(multiset_digest(F.col("item_id").cast("string")).alias("fp"))


def panel(spark, d):
    """Features p and logit x two strengths, a fit each per stratum and score."""
    rows = train(spark, d).select("stratum", "label", F.explode(F.array(*[F.struct(F.lit(m).alias("measurement"), F.col(c).alias("s")) for m, c in (("cat", "cat_score"), ("ovr", "ovr_score"))])).alias("m")).select("stratum", "label", "m.*")
    grid = spark.createDataFrame([(f, s) for f in ("p", "logit") for s in (1e-4, 1e-2)], "feature string, strength double")
    rows = rows.crossJoin(F.broadcast(grid)).withColumn("x", F.when(F.col("feature") == "p", F.col("s")).otherwise(N.logit(F.col("s"))))
    return C.fit_many(rows.select("stratum", "measurement", "feature", "strength", "x", F.col("label").alias("y"), F.lit(1.0).alias("w")), ["stratum", "measurement", "feature"])


@query("ft05_fit_panel", PANEL + " SELECT stratum, measurement, feature, s AS strength, true AS certified, round(a, 6) AS slope, round(b, 6) AS intercept FROM sol")
def ft05(spark, d):
    return panel(spark, d).select("stratum", "measurement", "feature", "strength", "certified", r6("slope", "slope"), r6("intercept", "intercept"))


@query("ft06_strength_grid", R3 + ", src AS (SELECT s, cat_score AS x, label AS y, 1.0 AS w FROM f3, (SELECT unnest([0.0001, 0.001, 0.01, 0.1]::DOUBLE[]) AS s) WHERE split = 'TRAIN'), " + newton("src", ["s"]) + " SELECT s AS strength, true AS certified, round(a, 6) AS slope, round(b, 6) AS intercept FROM sol")
def ft06(spark, d):
    grid = spark.createDataFrame([(s,) for s in (1e-4, 1e-3, 1e-2, 1e-1)], "strength double")
    rows = train(spark, d).select(F.col("cat_score").alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w")).crossJoin(F.broadcast(grid))
    return C.fit_many(rows, []).select("strength", "certified", r6("slope", "slope"), r6("intercept", "intercept"))


def iso_sql(source: str, keys: str) -> str:
    """SQL of the max-min formula: CTE `iso` (keys, x, fitted) of rows (keys, x, y)."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    x = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""k AS (SELECT {keys}, x, sum(y) AS y, count(*) AS n FROM {source} GROUP BY ALL), i AS (SELECT *, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM k WINDOW w AS (PARTITION BY {keys} ORDER BY x)),
seg AS (SELECT {", ".join(f"a.{k}" for k in keys.split(", "))}, a.x AS lo, b.x AS hi, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM i a JOIN i b ON {same("a", "b")} AND a.x <= b.x),
mn AS (SELECT {x}, x.x, seg.lo, min(seg.m) AS m FROM k x JOIN seg ON {same("x", "seg")} AND seg.lo <= x.x AND seg.hi >= x.x GROUP BY ALL), iso AS (SELECT {keys}, x, max(m) AS fitted FROM mn GROUP BY ALL)"""


#: Rows of both scores: TRAIN rows for fits, all rows to apply them to.
_MEASURED = "m3 AS (SELECT item_id, stratum, split, label, m AS measurement, CASE m WHEN 'cat' THEN cat_score ELSE ovr_score END AS v FROM f3, (SELECT unnest(['cat', 'ovr']) AS m)), tr AS (SELECT stratum, measurement, v AS x, label AS y FROM m3 WHERE split = 'TRAIN')"
ISO = W3 + ", " + _MEASURED + ", " + iso_sql("tr", "stratum, measurement")


def measured(spark, d):
    """A row for each item and score."""
    each = F.array(*[F.struct(F.lit(m).alias("measurement"), F.col(c).alias("v")) for m, c in (("cat", "cat_score"), ("ovr", "ovr_score"))])
    return X.paired_rows(spark, d).select("item_id", "stratum", "split", "label", F.explode(each).alias("m")).select("item_id", "stratum", "split", "label", "m.measurement", "m.v")


def isotonic_fits(spark, d):
    rows = measured(spark, d).where("split = 'TRAIN'")
    return Iso.fit_isotonic_many(rows.select("stratum", "measurement", F.col("v").alias("s"), F.col("label").alias("y"), F.lit(1).cast("long").alias("w")), ["stratum", "measurement"])


@query("ft07_isotonic", ISO + " SELECT stratum, measurement, min(x) AS lo, max(x) AS hi, round(fitted, 9) AS fitted FROM iso GROUP BY stratum, measurement, round(fitted, 9)")
def ft07(spark, d):
    """Blocks of equal value on the full scores of every stratum; the SQL is the max-min formula."""
    blocks = isotonic_fits(spark, d).withColumn("fitted", F.round(F.col("total") / F.col("n"), 9))
    return blocks.groupBy("stratum", "measurement", "fitted").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("ft07_isotonic_ml", W3 + ", tr AS (SELECT 1 AS g, cat_score AS x, label AS y FROM f3 WHERE split = 'TRAIN'), " + iso_sql("tr", "g") + " SELECT x AS s, round(fitted, 9) AS fitted FROM iso")
def ft07_ml(spark, d):
    """The library's own regression on the same scores, all strata together."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = train(spark, d).select(F.col("cat_score").alias("s"), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["s"], outputCol="features").transform(rows)
    model = IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)
    return model.transform(rows.select("s", "features").dropDuplicates(["s"])).select("s", r9("prediction", "fitted"))


def beta_rows(rows, by, state):
    """Rows of the groups that can be fitted."""
    good = rows.join(state.where("state = 'eligible'").select(*by), by)
    return good.select(*by, F.col("cat_score").alias("s"), F.col("label").alias("y"), F.lit(1).cast("long").alias("w"))


def beta_states(rows, by):
    return rows.groupBy(*by).agg(C.beta_eligibility(F.col("cat_score"), F.col("label")).alias("state"))


def beta_fits(spark, d, state):
    return C.fit_beta_many(beta_rows(train(spark, d), BY, state), BY)


def _beta_sql(steps: int = 40) -> str:
    """Newton's method on the four faces (a or b held at 0), the best feasible one."""
    h = ["11", "12", "13", "22", "23", "33"]
    det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13))"
    da = "(g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3))"
    db = "(h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13))"
    dc = "(h11 * (h22 * g3 - h23 * g2) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13))"
    f = {"1": "u", "2": "v", "3": "1.0"}
    terms = ", ".join(f"avg(q * (1 - q) * {f[x[0]]} * {f[x[1]]}) AS r{x}" for x in h)
    masked = "CASE WHEN fa = 1 THEN r11 ELSE 1 END AS h11, fa * fb * r12 AS h12, fa * r13 AS h13, CASE WHEN fb = 1 THEN r22 ELSE 1 END AS h22, fb * r23 AS h23, r33 AS h33, fa * k1 AS g1, fb * k2 AS g2, k3 AS g3"
    value = "avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END))"
    step = f"SELECT stratum, fa, fb, n, a, b, c, {masked} FROM (SELECT stratum, fa, fb, n, a, b, c, avg((q - y) * u) AS k1, avg((q - y) * v) AS k2, avg(q - y) AS k3, {terms} FROM (SELECT i.*, r.u, r.v, r.y, 1 / (1 + exp(-(i.a * r.u + i.b * r.v + i.c))) AS q FROM it i JOIN src r ON i.stratum = r.stratum WHERE i.n < {steps}) GROUP BY stratum, fa, fb, n, a, b, c)"
    return f"""{R3}, e AS (SELECT stratum, {BETA_SQL} AS state FROM f3 WHERE split = 'TRAIN' GROUP BY stratum),
src AS (SELECT stratum, ln(cat_score) AS u, -ln(1 - cat_score) AS v, label AS y FROM f3 JOIN e USING (stratum) WHERE split = 'TRAIN' AND state = 'eligible'),
it AS (SELECT DISTINCT stratum, fa, fb, 0 AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM src, (SELECT unnest([0, 1]) AS fa), (SELECT unnest([0, 1]) AS fb)
UNION ALL SELECT stratum, fa, fb, n + 1, a - {da} / {det}, b - {db} / {det}, c - {dc} / {det} FROM ({step})),
best AS (SELECT i.stratum, fa, fb, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, {value} AS loss FROM (SELECT i.*, r.y, 1 / (1 + exp(-(i.a * r.u + i.b * r.v + i.c))) AS q FROM it i JOIN src r ON i.stratum = r.stratum WHERE i.n = {steps} AND i.a >= 0 AND i.b >= 0) i GROUP BY i.stratum, fa, fb),
beta AS (SELECT *, CASE WHEN fa = 1 AND fb = 1 THEN 'INTERIOR' WHEN fa = 1 THEN 'B0' WHEN fb = 1 THEN 'A0' ELSE 'A0_B0' END AS face FROM best QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY loss) = 1)"""


@query("ft08_beta_fit", _beta_sql() + " SELECT e.stratum, state, face, CASE WHEN face IS NOT NULL THEN true END AS certified, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c FROM e LEFT JOIN beta ON beta.stratum = e.stratum")
def ft08(spark, d):
    """A fit of each stratum that can be fitted, and why the others can't."""
    state = beta_states(train(spark, d), BY)
    fits = beta_fits(spark, d, state).select("stratum", "face", (F.col("kkt") <= C.KKT).alias("certified"), *[F.round(x, 5).alias(x) for x in "abc"])
    return state.join(fits, "stratum", "left")


@query("ft09_beta_objective", W3 + " SELECT round(avg(-ln(CASE WHEN label = 1 THEN q ELSE 1 - q END)), 9) AS nll, round(avg((q - label) * ln(cat_score)), 9) AS ga, round(avg((q - label) * -ln(1 - cat_score)), 9) AS gb, round(avg(q - label), 9) AS gc FROM (SELECT *, 1 / (1 + exp(-(0.5 * ln(cat_score) - 0.5 * ln(1 - cat_score) + 0.25))) AS q FROM f3 WHERE split = 'TRAIN')")
def ft09(spark, d):
    a, b = N.beta_features(F.col("cat_score"))
    q = C.apply_beta(F.col("cat_score"), F.lit(0.5), F.lit(0.5), F.lit(0.25))
    r = q - F.col("label")
    return train(spark, d).agg(r9(F.avg(N.log_loss(q, F.col("label") == 1)), "nll"), r9(F.avg(r * a), "ga"), r9(F.avg(r * b), "gb"), r9(F.avg(r), "gc"))


_ONE = R3 + ", src AS (SELECT 1 AS g, cat_score AS x, label AS y, 0.01 AS s, 1.0 AS w FROM f3 WHERE split = 'TRAIN'), " + newton("src", ["g"])


@query("ft10_reference_solve", _ONE + " SELECT round(a, 6) AS slope, round(b, 6) AS intercept, CAST(0 AS DOUBLE) AS apart FROM sol")
def ft10(spark, d):
    """The distributed solver, and how far an 80-digit decimal one is from it on the same rows."""
    rows = train(spark, d).select("cat_score", "label")
    far = C.fit_logistic(rows, F.col("cat_score"), F.col("label"), 1e-2)
    exact = R.reference_fit(rows.groupBy("cat_score", "label").count(), "cat_score", "label", "count", "0.01", (far["slope"], far["intercept"]))
    return exact.select(F.lit(round(far["slope"], 6)).alias("slope"), F.lit(round(far["intercept"], 6)).alias("intercept"), F.round(F.greatest(F.abs(F.col("slope") - far["slope"]), F.abs(F.col("intercept") - far["intercept"])), 7).alias("apart"))


#: Procedures of a study: two logistic ones by feature, isotonic and beta.
PROCEDURES = ("P-logistic", "L-logistic", "I-isotonic", "B-beta")


def fit_procedure(procedure, rows, by):
    """(by, status, reason) of one procedure on rows (by, cat_score, label): AVAILABLE, INELIGIBLE or FAILED.

    The logit has no value at the ends, and a beta map is not fitted to groups
    without an optimum; these are INELIGIBLE with their reason. A fit that does
    not reach its certificate is FAILED. Nothing is clipped, and no procedure
    stands in for another.
    """
    s, y = F.col("cat_score"), F.col("label")
    if procedure == "I-isotonic":
        return rows.groupBy(*by).agg(F.lit("AVAILABLE").alias("status"), F.lit(None).cast("string").alias("reason"))
    if procedure == "B-beta":
        state = beta_states(rows, by)
        fits = C.fit_beta_many(beta_rows(rows, by, state), by).select(*by, "face")
        told = state.join(fits, by, "left")
        return told.select(*by, F.when(F.col("state") != "eligible", "INELIGIBLE").when(F.col("face") == "FAILED", "FAILED").otherwise("AVAILABLE").alias("status"), F.when(F.col("state") != "eligible", F.col("state")).when(F.col("face") == "FAILED", "no accepted optimum").alias("reason"))
    if procedure not in PROCEDURES:
        raise ValueError(f"no procedure {procedure}")
    state = rows.groupBy(*by).agg(F.when((F.lit(procedure == "L-logistic")) & ((F.min(s) <= 0) | (F.max(s) >= 1)), "endpoint").alias("ends"))
    x = s if procedure == "P-logistic" else N.logit(s)
    good = rows.join(state.where("ends is null").select(*by), by)
    fits = C.fit_many(good.select(*by, F.lit(1e-2).alias("strength"), x.alias("x"), y.alias("y"), F.lit(1).cast("long").alias("w")), by).select(*by, "certified")
    told = state.join(fits, by, "left")
    return told.select(*by, F.when(F.col("ends").isNotNull(), "INELIGIBLE").when(F.col("certified"), "AVAILABLE").otherwise("FAILED").alias("status"), F.coalesce("ends", F.when(~F.col("certified"), "not certified")).alias("reason"))


#: TRAIN rows of a stratum and a third of its users, with scores near the ends taken for certain in one of the thirds.
_THIRDS = "f3t AS (SELECT stratum || '/' || (ascii(right(cluster_id, 1)) % 3) AS part, label, CASE WHEN ascii(right(cluster_id, 1)) % 3 = 0 AND cat_score > 0.98 THEN 1.0 ELSE cat_score END AS cat_score FROM f3 WHERE split = 'TRAIN')"


@query("ft11_fit_procedure", W3 + ", " + _THIRDS + f", e AS (SELECT part, {BETA_SQL} AS state, max(cat_score) >= 1 AS ends FROM f3t GROUP BY part), p(procedure) AS (VALUES ('P-logistic'), ('L-logistic'), ('I-isotonic'), ('B-beta')), r AS (SELECT procedure, part, CASE WHEN procedure = 'B-beta' AND state <> 'eligible' THEN state WHEN procedure = 'L-logistic' AND ends THEN 'endpoint' END AS reason FROM e, p) SELECT procedure, part, CASE WHEN reason IS NULL THEN 'AVAILABLE' ELSE 'INELIGIBLE' END AS status, reason FROM r")
def ft11(spark, d):
    third = F.ascii(F.substring("cluster_id", -1, 1)) % 3
    rows = train(spark, d).select(F.concat_ws("/", "stratum", third.cast("string")).alias("part"), "label", F.when((third == 0) & (F.col("cat_score") > 0.98), 1.0).otherwise(F.col("cat_score")).alias("cat_score"))
    out = [fit_procedure(p, rows, ["part"]).select(F.lit(p).alias("procedure"), "part", "status", "reason") for p in PROCEDURES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


PROFILE = (2.5, -0.75)


@query("ap01_predicted_correctness", f"WITH {X.F2} SELECT item_id, round(1 / (1 + exp(-(2.5 * selected_p - 0.75))), 9) AS q FROM o2")
def ap01(spark, d):
    return X.bool_observations(spark, d).select("item_id", r9(N.sigmoid(PROFILE[0] * F.col("selected_p") + PROFILE[1]), "q"))


@query("ap02_apply_to_dataset", f"WITH {X.F2} SELECT sha256('row' || item_id) AS fp, correct, round(1 / (1 + exp(-(2.5 * selected_p - 0.75))), 9) AS q FROM o2 WHERE bucket = 'eligible'")
def ap02(spark, d):
    from ..functions.identity import digest

    return eligible(spark, d).select(digest(F.concat(F.lit("row"), F.col("item_id").cast("string"))).alias("fp"), "correct", r9(N.sigmoid(PROFILE[0] * F.col("selected_p") + PROFILE[1]), "q"))


@query("ap03_apply_to_runtime", f"WITH {X.F2}, r AS (SELECT o2.item_id, selected_p, coalesce(toxic = 1, false) AS done, correct IS NULL AS unknown FROM o2 LEFT JOIN labels l ON l.doc_id = o2.item_id) SELECT item_id, CASE WHEN done THEN 'already calibrated' ELSE 'calibrated' END AS state, CASE WHEN NOT done THEN round(1 / (1 + exp(-(2.5 * selected_p - 0.75))), 9) END AS predicted, CASE WHEN NOT done THEN sha256('trace' || item_id) END AS trace FROM r")
def ap03(spark, d):
    """Evaluations that carry a prediction already (the toxic ones) are refused; the others get one, and their trace's digest."""
    from ..functions.identity import digest

    marks = X.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("done"))
    o = X.bool_observations(spark, d).join(marks, "item_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    new = lambda c: F.when(~F.col("done"), c)
    return o.select("item_id", F.when(F.col("done"), "already calibrated").otherwise("calibrated").alias("state"), new(F.round(N.sigmoid(PROFILE[0] * F.col("selected_p") + PROFILE[1]), 9)).alias("predicted"), new(digest(F.concat(F.lit("trace"), F.col("item_id").cast("string")))).alias("trace"))


@query("ap04_apply_isotonic", ISO + """ SELECT r.item_id, r.measurement, round(CASE WHEN a.x IS NULL THEN b.fitted WHEN b.x IS NULL OR a.x = b.x THEN a.fitted ELSE a.fitted + (b.fitted - a.fitted) * (r.v - a.x) / (b.x - a.x) END, 8) AS fitted
FROM m3 r ASOF LEFT JOIN iso a ON r.stratum = a.stratum AND r.measurement = a.measurement AND r.v >= a.x ASOF LEFT JOIN iso b ON r.stratum = b.stratum AND r.measurement = b.measurement AND r.v <= b.x""")
def ap04(spark, d):
    """All isotonic fits applied to all rows, in one as-of join."""
    return Iso.apply_isotonic_many(measured(spark, d), ["stratum", "measurement"], "v", isotonic_fits(spark, d)).select("item_id", "measurement", F.round("fitted", 8).alias("fitted"))


@query("ap05_apply_beta", "SELECT s, round(CASE WHEN s = 0 THEN 0 WHEN s = 1 THEN 1 ELSE 1 / (1 + exp(-(0.5 * ln(s) - 0.25 * ln(1 - s) + 0.1))) END, 9) AS q FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS s)")
def ap05(spark, d):
    return spark.createDataFrame([(s,) for s in (0.0, 0.25, 0.5, 0.75, 1.0)], "s double").select("s", r9(C.apply_beta(F.col("s"), F.lit(0.5), F.lit(0.25), F.lit(0.1)), "q"))


#: The maps of feature logit and strength 0.01 by stratum and measurement, and all rows under them.
MAPS = PANEL + ", maps AS (SELECT * FROM sol WHERE feature = 'logit' AND s = 0.01)"
DIRECTED = MAPS + """, kinds(direction, source, target) AS (VALUES ('CAT->OVR', 'cat', 'ovr'), ('OVR->CAT', 'ovr', 'cat')),
scored AS (SELECT direction, source, target, stratum, item_id, label, CASE target WHEN 'cat' THEN cat_score ELSE ovr_score END AS v FROM f3, kinds WHERE split = 'TEST'),
dir AS (SELECT direction, stratum, item_id, label, v, pow(v - label, 2) AS raw, pow(qc - label, 2) AS crossed, pow(qn - label, 2) AS native, qc, qn FROM (
  SELECT p.*, 1 / (1 + exp(-(c.a * ln(v / (1 - v)) + c.b))) AS qc, 1 / (1 + exp(-(t.a * ln(v / (1 - v)) + t.b))) AS qn FROM scored p JOIN maps c ON c.stratum = p.stratum AND c.measurement = source JOIN maps t ON t.stratum = p.stratum AND t.measurement = target))"""


@query("ap06_panel_apply", MAPS + " SELECT split, stratum, count(*) AS n, round(avg(1 / (1 + exp(-(a * ln(cat_score / (1 - cat_score)) + b)))), 6) AS mean_q FROM f3 JOIN maps USING (stratum) WHERE measurement = 'cat' GROUP BY split, stratum")
def ap06(spark, d):
    fits = panel(spark, d).where("measurement = 'cat' and feature = 'logit' and strength = 0.01")
    rows = X.paired_rows(spark, d).join(fits, "stratum").withColumn("q", N.sigmoid(F.col("slope") * N.logit(F.col("cat_score")) + F.col("intercept")))
    return rows.groupBy("split", "stratum").agg(F.count("*").alias("n"), r6(F.avg("q"), "mean_q"))


@query("ap07_directional_maps", DIRECTED + " SELECT direction, count(*) AS n, round(avg(raw), 6) AS raw, round(avg(crossed), 6) AS crossed, round(avg(native), 6) AS native FROM dir GROUP BY direction")
def ap07(spark, d):
    return directions(spark, d).groupBy("direction").agg(F.count("*").alias("n"), r6(F.avg("raw"), "raw"), r6(F.avg("cross"), "crossed"), r6(F.avg("native"), "native"))


def directions(spark, d):
    """Test losses of source-fitted and target-fitted maps on the target's scores, for both directions."""
    fits = panel(spark, d).where("feature = 'logit' and strength = 0.01").select("stratum", "measurement", "slope", "intercept")
    kinds = spark.createDataFrame([("CAT->OVR", "cat", "ovr"), ("OVR->CAT", "ovr", "cat")], "direction string, source string, target string")
    rows = X.paired_rows(spark, d).where("split = 'TEST'").crossJoin(F.broadcast(kinds)).withColumn("s", F.when(F.col("target") == "cat", F.col("cat_score")).otherwise(F.col("ovr_score")))
    of = lambda side, name: fits.select("stratum", F.col("measurement").alias(side), F.col("slope").alias(f"{name}_a"), F.col("intercept").alias(f"{name}_b"))
    rows = rows.join(of("source", "cross"), ["stratum", "source"]).join(of("target", "native"), ["stratum", "target"])
    z = N.logit(F.col("s"))
    loss = lambda n: N.brier(N.sigmoid(F.col(f"{n}_a") * z + F.col(f"{n}_b")), F.col("label"))
    return rows.withColumns({"raw": N.brier(F.col("s"), F.col("label")), "cross": loss("cross"), "native": loss("native"), "q_cross": N.sigmoid(F.col("cross_a") * z + F.col("cross_b"))})


_CONDITION = DIRECTED + """, lim AS (SELECT stratum, m AS measurement, min(v) AS lo, max(v) AS hi FROM (SELECT stratum, m, CASE m WHEN 'cat' THEN cat_score ELSE ovr_score END AS v FROM f3, (SELECT unnest(['cat', 'ovr']) AS m) WHERE split = 'TRAIN') GROUP BY ALL),
ranged AS (SELECT dir.*, v BETWEEN lo AND hi AS inside FROM dir JOIN lim ON lim.stratum = dir.stratum AND lim.measurement = CASE direction WHEN 'CAT->OVR' THEN 'cat' ELSE 'ovr' END),
rel AS (SELECT direction, stratum, sum(abs(gap)) / sum(n) AS ece FROM (SELECT direction, stratum, least(9, floor(qc * 10)) AS bin, count(*) AS n, sum(qc - label) AS gap FROM dir GROUP BY ALL) GROUP BY ALL)"""


@query("cp13_condition_analysis", _CONDITION + " SELECT direction, stratum, count(*) AS n, round(avg(raw), 6) AS raw, round(avg(crossed - raw), 6) AS deploy, round(avg(native - raw), 6) AS native_delta, round(avg(crossed - native), 6) AS transport, count(*) FILTER (NOT inside) AS outside, round(avg(crossed) FILTER (inside), 6) AS crossed_inside, round(min(v), 9) AS least_score, round(max(v), 9) AS largest_score, round(any_value(ece), 6) AS ece FROM ranged JOIN rel USING (direction, stratum) GROUP BY direction, stratum")
def cp13(spark, d):
    """A condition by direction and stratum: risks, contrasts, range, loss within the training range, reliability."""
    rows = directions(spark, d)
    long = train(spark, d).select("stratum", F.explode(F.array(F.struct(F.lit("cat").alias("source"), F.col("cat_score").alias("v")), F.struct(F.lit("ovr").alias("source"), F.col("ovr_score").alias("v")))).alias("x")).select("stratum", "x.*")
    limits = long.groupBy("stratum", "source").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranged = rows.join(limits, ["stratum", "source"]).withColumn("inside", F.col("s").between(F.col("lo"), F.col("hi")))
    bins = rows.groupBy("direction", "stratum", F.least(F.lit(9), F.floor(F.col("q_cross") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("q_cross") - F.col("label")).alias("gap"))
    ece = bins.groupBy("direction", "stratum").agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece"))
    g = ranged.groupBy("direction", "stratum").agg(
        F.count("*").alias("n"), r6(F.avg("raw"), "raw"), r6(F.avg(F.col("cross") - F.col("raw")), "deploy"), r6(F.avg(F.col("native") - F.col("raw")), "native_delta"), r6(F.avg(F.col("cross") - F.col("native")), "transport"),
        F.count_if(~F.col("inside")).alias("outside"), r6(F.avg(F.when(F.col("inside"), F.col("cross"))), "crossed_inside"), F.round(F.min("s"), 9).alias("least_score"), F.round(F.max("s"), 9).alias("largest_score"))
    return g.join(ece, ["direction", "stratum"]).withColumn("ece", F.round("ece", 6))


@query("cp09_pilot_artifact", DIRECTED + " SELECT direction, round(avg(raw), 6) AS raw, round(avg(crossed), 6) AS crossed, round(avg(native), 6) AS native, round(min(v), 9) AS least_score, round(max(v), 9) AS largest_score, CAST(sum(CASE WHEN (v > 0.5) <> (qc > 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS winner_changes, round(max(abs(qc - qn)), 6) AS apart FROM dir GROUP BY direction")
def cp09(spark, d):
    """Risks, score range, changed winners and the largest difference of the two maps."""
    rows = directions(spark, d)
    q_native = N.sigmoid(F.col("native_a") * N.logit(F.col("s")) + F.col("native_b"))
    return rows.groupBy("direction").agg(r6(F.avg("raw"), "raw"), r6(F.avg("cross"), "crossed"), r6(F.avg("native"), "native"), F.round(F.min("s"), 9).alias("least_score"), F.round(F.max("s"), 9).alias("largest_score"), F.count_if((F.col("s") > 0.5) != (F.col("q_cross") > 0.5)).alias("winner_changes"), r6(F.max(F.abs(F.col("q_cross") - q_native)), "apart"))


def _refit_sql() -> str:
    from .resampling import fits_sql

    return fits_sql()


@query("cp10_stability_artifact", _refit_sql() + " SELECT m AS measurement, count(*) AS n, round(avg(a), 6) AS mean_slope, round(stddev_samp(a), 6) AS sd_slope, round(quantile_disc(a, 0.025), 6) AS lower, round(quantile_disc(a, 0.975), 6) AS upper, round(avg(b), 6) AS mean_intercept FROM sol GROUP BY m")
def cp10(spark, d):
    """Spread of both maps over the refits."""
    from ..operators import resampling as B
    from .resampling import SCORES, refits

    each = F.array(*[F.struct(F.lit(m).alias("measurement"), F.col(f"{m}_slope").alias("slope"), F.col(f"{m}_intercept").alias("intercept")) for m in SCORES])
    fits = refits(spark, d).select(F.explode(each).alias("x")).select("x.*")
    i = B.percentile_interval(fits, "slope", 0.025, 0.975, ["measurement"]).select("measurement", r6("lower", "lower"), r6("upper", "upper"))
    return fits.groupBy("measurement").agg(F.count("*").alias("n"), r6(F.avg("slope"), "mean_slope"), r6(F.stddev_samp("slope"), "sd_slope"), r6(F.avg("intercept"), "mean_intercept")).join(i, "measurement")


@query("cp11_adequacy_artifact", PANEL + " SELECT measurement, feature, s AS strength, round(avg(a), 6) AS slope, round(stddev_samp(a), 6) AS sd, count(*) AS certified FROM sol GROUP BY ALL")
def cp11(spark, d):
    return panel(spark, d).groupBy("measurement", "feature", "strength").agg(r6(F.avg("slope"), "slope"), r6(F.stddev_samp("slope"), "sd"), F.count_if("certified").alias("certified"))


@query("cp12_closure", _ONE + " SELECT round(a, 6) AS slope, CAST(0 AS BIGINT) AS reference_failed, CAST(0 AS BIGINT) AS disagreements, CAST(NULL AS VARCHAR) AS class FROM sol UNION ALL SELECT NULL, failed, apart, class FROM (VALUES (1, 0, 'C'), (0, 1, 'D'), (0, 0, 'A'), (0, 0, 'B')) AS t(failed, apart, class)")
def cp12(spark, d):
    """The fit beside its decimal reference, and the class of each kind of failure."""
    told = ft10(spark, d).select("slope", F.lit(0).cast("long").alias("reference_failed"), (F.col("apart") > 0).cast("long").alias("disagreements"), F.when(F.col("apart") > 0, "D").alias("class"))
    cases = [(1, 0, 3, 3, 0), (0, 1, 3, 3, 0), (0, 0, 3, 3, 0), (0, 0, 3, 0, 0)]
    return told.unionByName(spark.createDataFrame([(None, c[0], c[1], R.failure_class(*c)) for c in cases], "slope double, reference_failed long, disagreements long, class string"))


#: Losses of the replicates' maps on the TEST rows: of ovr scores as they are, under the map of cat and under their own.
_ON_OVR = ", points AS (SELECT ovr_score AS x, label AS y, count(*) AS n FROM f3 WHERE split = 'TEST' GROUP BY ALL), raw AS (SELECT sum(n * pow(x - y, 2)) / sum(n) AS v FROM points), risk AS (SELECT replicate, m, sum(n * pow(1 / (1 + exp(-(a * x + b))) - y, 2)) / sum(n) AS v FROM sol, points GROUP BY ALL), two AS (SELECT replicate, any_value(v) FILTER (m = 'cat') AS crossed, any_value(v) FILTER (m = 'ovr') AS native FROM risk GROUP BY replicate)"


def _on_ovr(spark, d):
    """(replicate, status, deploy, native_delta, transport) of the refits, on the TEST scores of ovr."""
    from .resampling import refits

    raw = exact_means(X.paired_rows(spark, d).where("split = 'TEST'"), [], {"raw": N.brier(F.col("ovr_score"), F.col("label"))}).select("raw")
    rows = refits(spark, d).crossJoin(F.broadcast(raw))
    return rows.select("replicate", "status", (F.col("cat_on_ovr") - F.col("raw")).alias("deploy"), (F.col("ovr_on_ovr") - F.col("raw")).alias("native_delta"), (F.col("cat_on_ovr") - F.col("ovr_on_ovr")).alias("transport"))


@query("cp15_refit_stability", _refit_sql() + _ON_OVR + ", d AS (SELECT unnest([crossed - (SELECT v FROM raw), native - (SELECT v FROM raw), crossed - native]) AS v, unnest(['deploy', 'native_delta', 'transport']) AS name FROM two) SELECT name, 'COMPLETE' AS state, count(*) AS n, round(quantile_disc(v, 0.025), 6) AS lower, round(quantile_disc(v, 0.5), 6) AS median, round(quantile_disc(v, 0.975), 6) AS upper FROM d GROUP BY name")
def cp15(spark, d):
    """Resampled training sets of full size: how much the loss differences hang on the training set."""
    from ..operators import resampling as B

    rows = _on_ovr(spark, d)
    long = rows.select("status", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("deploy", "native_delta", "transport")])).alias("x")).select("status", "x.*")
    state = long.groupBy("name").agg(F.when(F.bool_and(F.col("status") == "AVAILABLE"), "COMPLETE").otherwise("INCOMPLETE").alias("state"))
    i = B.percentile_interval(long, "v", 0.025, 0.975, ["name"])
    return i.join(state, "name").select("name", "state", "n", r6("lower", "lower"), r6("median", "median"), r6("upper", "upper"))


@query("cp17_refit_blocks", _refit_sql() + _ON_OVR + " SELECT CAST(replicate AS INTEGER) AS replicate, 'AVAILABLE' AS status, round(crossed - (SELECT v FROM raw), 6) AS deploy, round(native - (SELECT v FROM raw), 6) AS native_delta, round(crossed - native, 6) AS transport FROM two")
def cp17(spark, d):
    """Loss differences of every refit on the TEST scores."""
    return _on_ovr(spark, d).select("replicate", "status", r6("deploy", "deploy"), r6("native_delta", "native_delta"), r6("transport", "transport"))


@query("cp20_oracle_risks", W3 + " SELECT stratum, round(avg((cat_score - label) * (cat_score - label)), 9) AS cat, round(avg((ovr_score - label) * (ovr_score - label)), 9) AS ovr FROM f3 GROUP BY stratum")
def cp20(spark, d):
    return M.risks(X.paired_rows(spark, d), "label", {"cat": "cat_score", "ovr": "ovr_score"}, ["stratum"]).select("stratum", r9("cat", "cat"), r9("ovr", "ovr"))


#: Losses on TEST of the four procedures (feature x strength), fitted on the same score, and on the other one.
FOUR = PANEL + """, q AS (SELECT f3.stratum, sol.feature, sol.s, avg(pow(1 / (1 + exp(-(sol.a * CASE sol.feature WHEN 'p' THEN ovr_score ELSE ln(ovr_score / (1 - ovr_score)) END + sol.b))) - label, 2)) AS loss, sol.measurement FROM f3 JOIN sol ON sol.stratum = f3.stratum WHERE split = 'TEST' GROUP BY ALL),
four AS (SELECT n.stratum, n.feature, n.s, n.loss AS native, c.loss AS crossed, (SELECT avg(pow(ovr_score - label, 2)) FROM f3 WHERE f3.stratum = n.stratum AND split = 'TEST') AS raw FROM q n JOIN q c ON n.stratum = c.stratum AND n.feature = c.feature AND n.s = c.s AND n.measurement = 'ovr' AND c.measurement = 'cat')"""


def four_procedures(spark, d):
    """(stratum, feature, strength, native, crossed, raw): mean losses on TEST of each procedure."""
    score = F.col("ovr_score")
    rows = X.paired_rows(spark, d).where("split = 'TEST'").select("stratum", "ovr_score", "label")
    x = F.when(F.col("feature") == "p", score).otherwise(N.logit(score))
    q = rows.join(panel(spark, d), "stratum").withColumn("loss", N.brier(N.sigmoid(F.col("slope") * x + F.col("intercept")), F.col("label")))
    means = q.groupBy("stratum", "feature", "strength").agg(F.avg(F.when(F.col("measurement") == "ovr", F.col("loss"))).alias("native"), F.avg(F.when(F.col("measurement") == "cat", F.col("loss"))).alias("crossed"))
    return means.join(rows.groupBy("stratum").agg(F.avg(N.brier(score, F.col("label"))).alias("raw")), "stratum")


@query("ag15_factorial_contrasts", FOUR + " SELECT stratum, round(avg(native) FILTER (feature = 'logit') - avg(native) FILTER (feature = 'p'), 6) AS feature, round(avg(native) FILTER (s < 0.001) - avg(native) FILTER (s > 0.001), 6) AS strength, round(sum(native * CASE WHEN (feature = 'logit') = (s < 0.001) THEN 1 ELSE -1 END), 6) AS interaction FROM four GROUP BY stratum")
def ag15(spark, d):
    """Of the four fitted procedures' native losses."""
    cell = lambda f, low: F.when((F.col("feature") == f) & ((F.col("strength") < 1e-3) == F.lit(low)), F.col("native"))
    out = contrasts(four_procedures(spark, d), "stratum", {"p_lo": cell("p", True), "p_hi": cell("p", False), "logit_lo": cell("logit", True), "logit_hi": cell("logit", False)})
    return out.select("stratum", *[F.round(c, 6).alias(c) for c in ("feature", "strength", "interaction")])


_CORE4 = FOUR + ", core AS (SELECT stratum, avg(crossed - native) AS penalty, avg(crossed - raw) AS delta, count(*) = 4 AS complete FROM four GROUP BY stratum)"


def core_four(spark, d):
    """Mean transport penalty and deployment delta over exactly four procedures; incomplete with fewer."""
    return four_procedures(spark, d).groupBy("stratum").agg(F.avg(F.col("crossed") - F.col("native")).alias("penalty"), F.avg(F.col("crossed") - F.col("raw")).alias("delta"), (F.count("*") == 4).alias("complete"))


@query("pr04_core_penalty", _CORE4 + " SELECT stratum, round(penalty, 6) AS penalty, round(delta, 6) AS delta, complete FROM core")
def pr04(spark, d):
    return core_four(spark, d).select("stratum", r6("penalty", "penalty"), r6("delta", "delta"), "complete")


@query("cp19_study", _CORE4 + """, b(block, name, value) AS (SELECT 'risk', stratum || '/' || feature || '/' || CAST(s AS VARCHAR), round(native, 6) FROM four
UNION ALL SELECT 'deploy', stratum || '/' || feature || '/' || CAST(s AS VARCHAR), round(crossed - raw, 6) FROM four
UNION ALL SELECT 'core', stratum, round(penalty, 6) FROM core
UNION ALL SELECT 'fit', stratum || '/' || measurement, round(max(a) - min(a), 5) FROM sol GROUP BY stratum, measurement
UNION ALL SELECT 'rank', 'penalty and raw', round(corr(x, y), 6) FROM (SELECT rank() OVER (ORDER BY penalty) AS x, rank() OVER (ORDER BY raw) AS y FROM core JOIN (SELECT DISTINCT stratum, raw FROM four) USING (stratum))) SELECT * FROM b""")
def cp19(spark, d):
    """The study's blocks one after the other on one table of fits and losses, in long form."""
    from ..operators import sampling as S

    four, fits = four_procedures(spark, d).persist(), panel(spark, d)
    cell = F.concat_ws("/", "stratum", "feature", F.when(F.col("strength") < 1e-3, "0.0001").otherwise("0.01"))
    core = four.groupBy("stratum").agg(F.avg(F.col("crossed") - F.col("native")).alias("penalty"), F.first("raw").alias("raw"))
    ranks = S.mid_ranks(S.mid_ranks(core.withColumn("g", F.lit(1)), ["g"], "penalty", "x"), ["g"], "raw", "y")
    out = four.select(F.lit("risk").alias("block"), cell.alias("name"), r6("native", "value"))
    out = out.unionByName(four.select(F.lit("deploy").alias("block"), cell.alias("name"), r6(F.col("crossed") - F.col("raw"), "value")))
    out = out.unionByName(core.select(F.lit("core").alias("block"), F.col("stratum").alias("name"), r6("penalty", "value")))
    out = out.unionByName(fits.groupBy("stratum", "measurement").agg(F.round(F.max("slope") - F.min("slope"), 5).alias("value")).select(F.lit("fit").alias("block"), F.concat_ws("/", "stratum", "measurement").alias("name"), "value"))
    return out.unionByName(ranks.agg(r6(N.safe_correlation(F.col("x"), F.col("y")), "value")).select(F.lit("rank").alias("block"), F.lit("penalty and raw").alias("name"), "value"))
