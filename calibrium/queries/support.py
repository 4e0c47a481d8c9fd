"""Supporting operators (SU*) and the composites that only combine others."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .. import fixtures as X
from ..functions import identity as I
from ..functions import numeric as N
from ..functions.exact import exact_means, exact_sums
from ..operators import calibration as C
from ..operators import measure
from ..operators import scoring as S
from ..operators.signal import centred
from . import query
from .scalars import E, edges, r9
from .scoring import observed

W1, W3, W4, W5, WS = (f"WITH {x}" for x in (X.F1, X.F3, X.F4, X.F5, X.S1))


#: Scores near the ends are taken for certain, so that some of them are certain and wrong.
_SURE = "CASE WHEN cat_score < 0.02 THEN 0.0 WHEN cat_score > 0.98 THEN 1.0 ELSE cat_score END"
_LOSS = f"l AS (SELECT cluster_id, CASE WHEN q = 0 THEN CAST('inf' AS DOUBLE) ELSE -ln(q) END AS loss FROM (SELECT cluster_id, CASE WHEN label = 1 THEN {_SURE} ELSE 1 - {_SURE} END AS q FROM f3))"


def _sure_losses(spark, d):
    return X.paired_rows(spark, d).select("cluster_id", N.log_loss(F.expr(_SURE), F.col("label") == 1).alias("loss"))


@query("su01_exact_log_loss", W3 + ", " + _LOSS + " SELECT cluster_id, count(*) AS n, CASE WHEN bool_or(isinf(loss)) THEN 'POSITIVE_INFINITY' ELSE 'FINITE' END AS state, CASE WHEN NOT bool_or(isinf(loss)) THEN round(avg(loss), 9) END AS mean FROM l GROUP BY cluster_id")
def su01(spark, d):
    """Exact mean of a cluster's log losses, a value or a state."""
    m = exact_means(_sure_losses(spark, d), ["cluster_id"], {"mean": F.col("loss")})
    state = N.state(F.col("mean"))
    return m.select("cluster_id", "n", state.alias("state"), F.when(state == "FINITE", F.round("mean", 9)).alias("mean"))


@query("su02_log_loss_twin", W3 + ", " + _LOSS + " SELECT cluster_id, count(*) FILTER (isinf(loss)) AS infinite, round(coalesce(sum(loss) FILTER (NOT isinf(loss)), 0), 9) AS finite FROM l GROUP BY cluster_id")
def su02(spark, d):
    """The same losses as a count of infinite ones and the exact sum of the others."""
    loss = F.col("loss")
    sums = exact_sums(_sure_losses(spark, d), ["cluster_id"], {"infinite": (loss == N.INF).cast("int"), "finite": F.when(loss != N.INF, loss)})
    return sums.select("cluster_id", F.col("infinite").cast("long").alias("infinite"), r9("finite", "finite"))


@query("su03_item_differences", W3 + " SELECT item_id, round((cat_score - label) * (cat_score - label) - (ovr_score - label) * (ovr_score - label), 12) AS d FROM f3")
def su03(spark, d):
    y = F.col("label")
    return X.paired_rows(spark, d).select("item_id", F.round(N.brier(F.col("cat_score"), y) - N.brier(F.col("ovr_score"), y), 12).alias("d"))


@query("su04_sign_counts", W3 + ", x AS (SELECT stratum, (cat_score - label) * (cat_score - label) - (ovr_score - label) * (ovr_score - label) AS d FROM f3) SELECT stratum, count(*) FILTER (d < 0) AS negative, round(avg((d < 0)::INTEGER), 9) AS share FROM x GROUP BY stratum")
def su04(spark, d):
    y = F.col("label")
    x = X.paired_rows(spark, d).select("stratum", (N.brier(F.col("cat_score"), y) < N.brier(F.col("ovr_score"), y)).alias("n"))
    return x.groupBy("stratum").agg(F.count_if("n").alias("negative"), r9(F.avg(F.col("n").cast("int").cast("double")), "share"))


def _su05_sql() -> str:
    from .fits import R3, newton

    return R3 + ", src AS (SELECT stratum, cat_score AS x, label AS y, 0.01 AS s, 1.0 AS w FROM f3 WHERE split = 'TRAIN'), " + newton("src", ["stratum"]) + " SELECT stratum, round(a, 6) AS slope, round(b, 6) AS intercept, true AS agrees, true AS neighbours_no_better FROM sol"


@query("su05_agreement_stats", _su05_sql())
def su05(spark, d):
    """Fits in doubles by stratum beside the decimal ones, and the objective at the next doubles around them."""
    import decimal

    import numpy as np

    from ..operators.reference import GAP, objective, solve

    rows = X.paired_rows(spark, d).where("split = 'TRAIN'").select("stratum", "cat_score", "label")

    def run(pdf):
        x, y = pdf["cat_score"].to_numpy(), pdf["label"].to_numpy()
        a, b, _ = C.solve_logistic(x, y, 1e-2)
        counted = [(decimal.Decimal(float(u)), int(v), 1) for u, v in zip(x, y)]
        s = decimal.Decimal("0.01")
        ra, rb, _ = solve(counted, s, (decimal.Decimal(a), decimal.Decimal(b)))
        best = objective(counted, s, ra, rb)
        around = [objective(counted, s, decimal.Decimal(float(np.nextafter(float(ra), u))), decimal.Decimal(float(np.nextafter(float(rb), v)))) for u in (-9e9, 9e9) for v in (-9e9, 9e9)]
        return {"slope": round(float(ra), 6), "intercept": round(float(rb), 6), "agrees": abs(float(ra) - a) < 1e-8 and abs(float(rb) - b) < 1e-8, "neighbours_no_better": all(v >= best - GAP for v in around)}

    return C.fit_groups(rows, ["stratum"], run, "stratum string, slope double, intercept double, agrees boolean, neighbours_no_better boolean")


@query("su06_winner_by_item", WS + " SELECT item_id, winner FROM s1")
def su06(spark, d):
    return observed(spark, d).select("item_id", "winner")


@query("su07_outcome_rows", WS + """ SELECT item_id, CASE WHEN truth IS NULL THEN 'missing' WHEN status = 'TAXONOMY_MISS' THEN 'ineligible' ELSE 'scored' END AS status, CASE WHEN truth IS NOT NULL AND status <> 'TAXONOMY_MISS' THEN round(p[1], 9) END AS anchor_score, sha256('{"item":' || item_id || ',"status":"' || status || '","truth":' || coalesce('"' || truth || '"', 'null') || ',"winner":"' || winner || '"}') AS source FROM s1""")
def su07(spark, d):
    """Outcomes of evidence rows, each with the digest of its whole record."""
    o = observed(spark, d)
    status = F.when(F.col("truth").isNull(), "missing").when(F.col("status") == "TAXONOMY_MISS", "ineligible").otherwise("scored")
    record = I.record_text({"item": F.col("item_id"), "status": I.quoted(F.col("status")), "truth": I.quoted(F.col("truth")), "winner": I.quoted(F.col("winner"))})
    return o.select("item_id", status.alias("status"), F.when(status == "scored", F.round(F.get("p", F.lit(0)), 9)).alias("anchor_score"), I.digest(record).alias("source"))


@query("su08_anchor_score", WS + " SELECT item_id, round(p[1 + item_id % 8], 9) AS anchor FROM s1")
def su08(spark, d):
    o = observed(spark, d)
    m = F.map_from_arrays("names", "p")
    return o.select("item_id", r9(F.element_at(m, F.concat(F.lit("c"), (F.col("item_id") % 8).cast("string"))), "anchor"))


@query("su09_directions", W3 + " SELECT direction, item_id, round(CASE WHEN direction = 'CAT->OVR' THEN cat_score ELSE ovr_score END, 9) AS source, round(CASE WHEN direction = 'CAT->OVR' THEN ovr_score ELSE cat_score END, 9) AS target FROM f3, (SELECT unnest(['CAT->OVR', 'OVR->CAT']) AS direction)")
def su09(spark, d):
    p = X.paired_rows(spark, d)
    both = F.array(F.struct(F.lit("CAT->OVR").alias("direction"), F.col("cat_score").alias("source"), F.col("ovr_score").alias("target")), F.struct(F.lit("OVR->CAT").alias("direction"), F.col("ovr_score").alias("source"), F.col("cat_score").alias("target")))
    return p.select("item_id", F.explode(both).alias("x")).select("x.direction", "item_id", r9("x.source", "source"), r9("x.target", "target"))


@query("su10_flat_facts", W3 + " SELECT item_id, stratum, label, round(cat_score, 9) AS cat FROM f3")
def su10(spark, d):
    nested = X.paired_rows(spark, d).select("item_id", F.struct("stratum", F.struct("label", "cat_score").alias("scores")).alias("evidence"))
    return nested.select("item_id", "evidence.stratum", "evidence.scores.label", r9("evidence.scores.cat_score", "cat"))


@query("su11_partition_contract", W3 + ", c AS (SELECT split, stratum, count(*) AS n FROM f3 GROUP BY ALL), k(split, least, most) AS (VALUES ('TRAIN', 95, 105), ('TEST', 1800, 1920)) SELECT split, stratum, n, CASE WHEN n < least THEN 'short' WHEN n > most THEN 'over' ELSE 'kept' END AS state FROM c JOIN k USING (split)")
def su11(spark, d):
    """Rows of each split and stratum against a contract of least and most."""
    contract = spark.createDataFrame([("TRAIN", 95, 105), ("TEST", 1800, 1920)], "split string, least int, most int")
    c = X.paired_rows(spark, d).groupBy("split", "stratum").agg(F.count("*").alias("n")).join(F.broadcast(contract), "split")
    return c.select("split", "stratum", "n", F.when(F.col("n") < F.col("least"), "short").when(F.col("n") > F.col("most"), "over").otherwise("kept").alias("state"))


@query("su12_test_winners", W4 + " SELECT rotation::INTEGER AS rotation, winner, count(*) AS n, count(*) FILTER (winner = truth) AS hits FROM f4 GROUP BY rotation, winner")
def su12(spark, d):
    """Winners under every condition, and how many of them are right."""
    return X.perturbed_records(spark, d).groupBy("rotation", "winner").agg(F.count("*").alias("n"), F.count_if(F.col("winner") == F.col("truth")).alias("hits"))


_RULES = {
    "repeated line": "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "no customer": "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "wrong length": "SELECT count(*) FROM documents WHERE n_chars <> length(text)",
    "label without document": "SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "repeated text": "SELECT count(*) - count(DISTINCT sha256(text)) FROM documents",
    "price out of order": "SELECT count(*) FROM orders WHERE o_totalprice <= 0",
}


@query("su13_validators", " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(({v}) AS BIGINT) AS violations" for k, v in _RULES.items()))
def su13(spark, d):
    """Counts of what breaks each rule: uniqueness, references, recomputed lengths and digests."""
    t = lambda name: X.table(spark, d, name)
    lost = lambda a, b, key: a.join(b.select(key).distinct(), key, "left_anti")
    docs = t("documents")
    found = {
        "repeated line": t("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "no customer": lost(t("orders").withColumnRenamed("o_custkey", "c_custkey"), t("customer"), "c_custkey"),
        "wrong length": docs.where(F.col("n_chars") != F.length("text")),
        "label without document": lost(t("labels"), docs, "doc_id"),
        "price out of order": t("orders").where("o_totalprice <= 0"),
    }
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(k).alias("rule"), "violations") for k, df in found.items()]
    rows.append(docs.select(I.digest(F.col("text")).alias("c")).agg((F.count("*") - F.countDistinct("c")).alias("violations")).select(F.lit("repeated text").alias("rule"), "violations"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def field_names(t: DataType) -> list[str]:
    """Names of all fields, nested ones too."""
    if isinstance(t, StructType):
        return [n for f in t.fields for n in (f.name, *field_names(f.dataType))]
    if isinstance(t, ArrayType):
        return field_names(t.elementType)
    if isinstance(t, MapType):
        return field_names(t.keyType) + field_names(t.valueType)
    return []


_DENIED, _CHECKED = ("correct", "quality", "toxic", "label", "truth"), ("conversations", "documents", "embeddings", "events", "labels")


@query("su14_no_result_fields", " UNION ALL ".join(f"SELECT '{t}' AS tab, column_name AS field FROM (DESCRIBE {t}) WHERE column_name IN {_DENIED}" for t in _CHECKED) + " UNION ALL SELECT 'nested', 'correct'")
def su14(spark, d):
    """Denied field names in the tables' schemas, and in one that hides one deep inside."""
    inner = observed(spark, d).select("item_id", F.struct(F.array(F.struct("correct")).alias("list")).alias("inner"))
    schemas = {t: X.table(spark, d, t).schema for t in _CHECKED} | {"nested": inner.schema}
    return spark.createDataFrame([(t, f) for t, s in schemas.items() for f in sorted(set(_DENIED) & set(field_names(s)))], "tab string, field string")


@query("su15_evidence_blocks", WS + " SELECT item_id, CASE WHEN truth IS NULL THEN 'unavailable' ELSE 'scored' END AS status, CASE WHEN truth IS NOT NULL THEN winner END AS winner, CASE WHEN truth IS NOT NULL THEN round(selected_p, 9) END AS score, CASE WHEN truth IS NULL THEN 'unresolved truth' END AS reason FROM s1")
def su15(spark, d):
    """A scored block with its values, or an unavailable one with its reason."""
    ok = F.col("truth").isNotNull()
    block = F.struct(F.when(ok, "scored").otherwise("unavailable").alias("status"), F.when(ok, F.col("winner")).alias("winner"), F.when(ok, F.round("selected_p", 9)).alias("score"), F.when(~ok, "unresolved truth").alias("reason"))
    return observed(spark, d).select("item_id", block.alias("b")).select("item_id", "b.*")


@query("su16_manifest_items", "SELECT sha256('documents|' || doc_id) AS item_id, lang AS stratum FROM documents")
def su16(spark, d):
    return X.table(spark, d, "documents").select(I.digest(F.concat_ws("|", F.lit("documents"), F.col("doc_id").cast("string"))).alias("item_id"), F.col("lang").alias("stratum"))


@query("su17_dataset_audit", "SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL) AS nulls, count(DISTINCT text) AS texts, round(quantile_cont(n_chars, 0.5), 9) AS median FROM documents GROUP BY lang")
def su17(spark, d):
    return X.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"), F.countDistinct("text").alias("texts"), r9(F.percentile("n_chars", F.lit(0.5)), "median"))


@query("su18_centred_logits", W4 + " SELECT item_id, rotation::INTEGER AS rotation, round(ln(p[1]) - list_sum(list_transform(p, lambda x: ln(x))) / 8, 9) AS first FROM f4")
def su18(spark, d):
    return X.perturbed_records(spark, d).select("item_id", "rotation", r9(F.get(centred(F.col("p")), F.lit(0)), "first"))


@query("su19_error_records", "SELECT doc_id, CASE WHEN n_chars > 9000 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_chars > 9000 THEN 'UnsupportedCapabilityError: context of ' || n_chars END AS error, CASE WHEN n_chars <= 9000 THEN round(sqrt(n_chars), 9) END AS score FROM documents")
def su19(spark, d):
    """Records of evaluations; one that raises a declared error keeps its row."""
    got = measure.measured(X.table(spark, d, "documents").select("doc_id", "n_chars"), _score_context)
    return got.select("doc_id", F.when(F.col("status") == "SCORED", "ok").otherwise("error").alias("status"), F.col("reason").alias("error"), r9("score", "score"))


def _score_context(row: dict) -> float:
    if row["n_chars"] > 9000:
        raise measure.UnsupportedCapabilityError(f"context of {row['n_chars']}")
    return row["n_chars"] ** 0.5


@query("su20_per_case", W5 + " SELECT family, case_id, count(*) AS n FROM f5 WHERE family <> 'O' GROUP BY family, case_id")
def su20(spark, d):
    return X.ladder_records(spark, d).where("family <> 'O'").groupBy("family", "case_id").agg(F.count("*").alias("n"))


@query("su21_migrate_keys", "SELECT count(*) FILTER (doc_id % 30 = 0) AS changed, count(*) AS n FROM documents")
def su21(spark, d):
    old = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    new = old.withColumnsRenamed({"id": "doc_id", "language": "lang"}).withColumn("now", F.when(F.col("doc_id") % 30 == 0, "zz").otherwise(F.col("lang")))
    both = new.join(X.table(spark, d, "documents").select("doc_id", F.col("lang").alias("was")), "doc_id", "full_outer")
    return both.agg(F.count_if(~F.col("now").eqNullSafe(F.col("was"))).alias("changed"), F.count("*").alias("n"))


@query("su22_format_table", "SELECT '| ' || r_regionkey || ' | ' || rpad(r_name, 12, ' ') || ' |' AS line FROM region")
def su22(spark, d):
    return X.table(spark, d, "region").select(F.concat(F.lit("| "), F.col("r_regionkey").cast("string"), F.lit(" | "), F.rpad("r_name", 12, " "), F.lit(" |")).alias("line"))


@query("su23_synthetic_scorer", "SELECT doc_id, CAST(('0x' || substr(sha256('logit/' || doc_id || '/' || k), 1, 16))::UBIGINT % 1000 AS DOUBLE) / 100 - 5 AS logit, k FROM documents, (SELECT unnest(['no', 'yes']) AS k)")
def su23(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("no"), F.lit("yes"))).alias("k"))
    h = I.digest(F.concat_ws("/", F.lit("logit"), F.col("doc_id").cast("string"), "k"))
    return rows.select("doc_id", (I.index64(h, F.lit(1000)).cast("double") / 100 - 5).alias("logit"), "k")


@query("su24_enumerate_cells", W3 + ", n AS (SELECT stratum, count(*) AS n FROM f3 WHERE split = 'TRAIN' GROUP BY stratum) SELECT stratum, measurement, CASE WHEN measurement = 'ovr' AND n >= (SELECT quantile_disc(n, 0.5) FROM n) THEN 912 ELSE 456 END AS budget FROM n, (SELECT unnest(['cat', 'ovr']) AS measurement)")
def su24(spark, d):
    """Strata x measurements, the larger budget where a stratum has half of the strata's rows behind it."""
    n = X.paired_rows(spark, d).where("split = 'TRAIN'").groupBy("stratum").agg(F.count("*").alias("n"))
    middle = n.agg(F.expr("percentile_disc(0.5) within group (order by n)").alias("middle"))
    kinds = spark.createDataFrame([("cat",), ("ovr",)], "measurement string")
    cells = n.crossJoin(F.broadcast(kinds)).crossJoin(middle)
    return cells.select("stratum", "measurement", F.when((F.col("measurement") == "ovr") & (F.col("n") >= F.col("middle")), 912).otherwise(456).alias("budget"))


@query("su25_units_by_role", W3 + ", u AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (split = 'TRAIN') AS t FROM f3 GROUP BY cluster_id) SELECT cluster_id, CASE WHEN t = 0 THEN 'legacy' WHEN n > 12 THEN 'validation' ELSE 'development' END AS role FROM u")
def su25(spark, d):
    """Units by role: without training rows, with many rows, and the others."""
    u = X.paired_rows(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "TRAIN").alias("t"))
    return u.select("cluster_id", F.when(F.col("t") == 0, "legacy").when(F.col("n") > 12, "validation").otherwise("development").alias("role"))


def _su26_sql() -> str:
    from .fits import _beta_sql

    return _beta_sql() + " SELECT stratum, face, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, CAST(4 AS BIGINT) AS starts, CAST(0 AS DOUBLE) AS apart, CAST(0 AS DOUBLE) AS objective_apart FROM beta"


@query("su26_alternative_starts", _su26_sql())
def su26(spark, d):
    """Beta fits from four other starts beside that from the origin: how far numbers and objectives lie apart, to 6 digits."""
    from .fits import BY, beta_rows, beta_states, train

    rows = train(spark, d)
    starts = ((0.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.2, 2.0, -0.5), (2.0, 0.2, 0.5), (0.0, 0.0, 1.0))
    fits = C.fit_beta_many(beta_rows(rows, BY, beta_states(rows, BY)), BY, starts=starts)
    one = fits.where("start = 0").select("stratum", *[F.col(c).alias(f"{c}0") for c in ("face", "a", "b", "c", "objective")])
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}0")) for c in "abc"])
    far = F.when(F.col("face") == F.col("face0"), far).otherwise(F.lit(N.INF))
    told = fits.where("start > 0").join(one, "stratum").groupBy("stratum", "face0", "a0", "b0", "c0").agg(F.count("*").alias("starts"), F.round(F.max(far), 6).alias("apart"), F.round(F.max(F.abs(F.col("objective") - F.col("objective0"))), 9).alias("objective_apart"))
    return told.select("stratum", F.col("face0").alias("face"), *[F.round(f"{c}0", 5).alias(c) for c in "abc"], "starts", "apart", "objective_apart")


@query("su27_resolve_verbalizers", "SELECT pair, CAST(yes AS BIGINT) AS yes, CAST(no AS BIGINT) AS no, yes IS NOT NULL AS usable FROM (VALUES ('yes/no', 3763, 645), ('true/false', 2081, 3991), ('yes/yes', NULL, NULL), ('yes/undecidable', NULL, NULL)) AS t(pair, yes, no)")
def su27(spark, d):
    """Pairs of verbalizers under the public byte-level tokenizer."""
    import public_tokenizers

    from ..sources.verbalizers import library, resolve_pair

    tokenize = library(public_tokenizers.path("byte_bpe_50k.json"))
    pairs = [("yes", "no"), ("true", "false"), ("yes", "yes"), ("yes", "undecidable")]
    got = [(f"{a}/{b}", resolve_pair(tokenize, "Is it so?", a, b)) for a, b in pairs]
    return spark.createDataFrame([(p, *(t or (None, None)), t is not None) for p, t in got], "pair string, yes long, no long, usable boolean")


@query("su28_result_fields", f"WITH {X.F2}, r AS (SELECT item_id, coalesce(quality = 1, false) AS calibrated, quality IS NOT NULL AND selected_p > 0.5 AS predicted, toxic = 0 AS profile FROM o2 LEFT JOIN labels l ON l.doc_id = o2.item_id) SELECT item_id, calibrated = (predicted AND coalesce(profile, false)) AND predicted = coalesce(profile, false) AS valid FROM r")
def su28(spark, d):
    """Calibrated results have a prediction and a profile, the others neither."""
    marks = X.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")
    o = X.bool_observations(spark, d).select("item_id", "selected_p").join(marks, "item_id", "left")
    calibrated = F.coalesce(F.col("quality") == 1, F.lit(False))
    predicted = F.when(F.col("quality").isNotNull() & (F.col("selected_p") > 0.5), F.col("selected_p"))
    profile = F.when(F.col("toxic") == 0, "p1")
    return o.select("item_id", S.coherent_calibration(calibrated, predicted, profile).alias("valid"))


@query("su29_runtime_preconditions", f"WITH {X.F7} SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'calibrated already' WHEN d.lang NOT IN (SELECT lang FROM f7) THEN 'no binding' WHEN d.text IS NULL OR trim(d.text) = '' THEN 'no selection' ELSE 'ready' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def su29(spark, d):
    """What an evaluation must have before a profile is looked for."""
    langs = X.catalog_profiles(spark).select("lang").distinct().withColumn("bound", F.lit(True))
    marks = X.table(spark, d, "labels").select("doc_id", "toxic")
    e = X.table(spark, d, "documents").select("doc_id", "lang", "text").join(marks, "doc_id", "left").join(F.broadcast(langs), "lang", "left")
    rules = [("calibrated already", "toxic = 1"), ("no binding", "lang is not null and bound is null"), ("no selection", "text is null or trim(text) = ''")]
    return e.select("doc_id", F.when(S.first_violation(rules) == "ok", "ready").otherwise(S.first_violation(rules)).alias("state"))


@query("su30_managed_paths", "SELECT r_regionkey, CASE r_regionkey % 4 WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'PRESENT' ELSE 'DAMAGED' END AS state, CASE WHEN r_regionkey % 4 = 1 THEN r_name END AS text FROM region")
def su30(spark, d):
    """A path per region: nothing there, a file, a folder, or something below a file."""
    from ..sources.store import Files
    from .inputs import _folder

    files, folder, out = Files(spark), _folder(spark), []
    for r in X.table(spark, d, "region").select("r_regionkey", "r_name").collect():
        uri = f"{folder}/{r.r_regionkey}"
        if r.r_regionkey % 4 == 1:
            files.publish(uri, r.r_name)
        elif r.r_regionkey % 4 == 2:
            files.publish(f"{uri}/inside", "x")
        elif r.r_regionkey % 4 == 3:
            files.publish(uri, "x")
            uri += "/below"
        state = files.state(uri)
        out.append((r.r_regionkey, state, files.read(uri) if state == "PRESENT" else None))
    return spark.createDataFrame(out, "r_regionkey long, state string, text string")


_HASH = "CAST(('0x' || substr(sha256({}), 1, 16))::UBIGINT % 1000 AS DOUBLE) / 1000"
_GRID = "g AS (SELECT doctrine || '/' || family || '/' || label_order || '/' || mapping AS formulation, family AS labels FROM (SELECT unnest(['base', 'strict']) AS doctrine), (SELECT unnest(['yes_no', 'true_false', 'a_b']) AS family), (SELECT unnest(['false_true', 'true_false']) AS label_order), (SELECT unnest(['direct', 'inverted']) AS mapping) WHERE family = 'a_b' OR mapping = 'direct')"


@query("cp21_sweep", W5 + ", " + _GRID + ", c AS (SELECT formulation, CASE WHEN labels = 'true_false' AND family = 'O' THEN 'no label tokens' END AS skipped, " + _HASH.format("formulation || '/' || family || '/' || case_id || '/' || rung") + " AS score FROM f5, g) SELECT formulation, count(*) FILTER (skipped IS NULL) AS scored, count(skipped) AS skipped, round(avg(score) FILTER (skipped IS NULL), 9) AS mean, CASE WHEN formulation < 'c' THEN 1 ELSE 2 END AS run FROM c GROUP BY formulation")
def cp21(spark, d):
    """Every formulation on every probe by a scorer, block by block; a first run stops after the base doctrine."""
    from ..plans.compile import formulations
    from ..streaming.blocks import BlockStore
    from .inputs import _folder

    grid = formulations(spark).select(F.concat_ws("/", "doctrine", "family", "label_order", "mapping").alias("formulation"), F.col("family").alias("labels"))
    probes, done, names = X.ladder_records(spark, d).persist(), BlockStore(spark, _folder(spark)), sorted(r.formulation for r in grid.collect())

    def block(name: str, run: int):
        rows = probes.crossJoin(F.broadcast(grid.where(F.col("formulation") == name)))
        skipped = F.when((F.col("labels") == "true_false") & (F.col("family") == "O"), "no label tokens")
        h = I.digest(F.concat_ws("/", "formulation", "family", F.col("case_id").cast("string"), F.col("rung").cast("string")))
        score = I.index64(h, F.lit(1000)).cast("double") / 1000
        return rows.withColumns({"skipped": skipped, "score": score}).groupBy("formulation").agg(F.count_if(F.col("skipped").isNull()).alias("scored"), F.count("skipped").alias("skipped"), r9(F.avg(F.when(F.col("skipped").isNull(), F.col("score"))), "mean"), F.lit(run).alias("run"))

    for run, wanted in ((1, [n for n in names if n < "c"]), (2, names)):
        done.run([n.replace("/", "-") for n in wanted], lambda b, run=run: block(b.replace("-", "/"), run))
    return done.rows()


@query("cp22_group_run", W4 + ", perm AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS permutation, a || b || c AS labels FROM (SELECT unnest(['A', 'B', 'C']) AS a), (SELECT unnest(['A', 'B', 'C']) AS b), (SELECT unnest(['A', 'B', 'C']) AS c) WHERE a <> b AND b <> c AND a <> c), s AS (SELECT permutation, item_id, " + _HASH.format("labels || '/' || item_id") + " AS score, p[1] AS first FROM f4, perm WHERE rotation = 0) SELECT permutation, count(*) AS n, round(avg(score), 9) AS mean, count(*) FILTER (score > first) AS above FROM s GROUP BY permutation")
def cp22(spark, d):
    """Every order of three labels on every case by a scorer."""
    from ..plans.compile import label_permutations

    p = label_permutations(spark, 3).select(F.col("permutation").cast("bigint").alias("permutation"), F.array_join("labels", "").alias("order"))
    rows = X.perturbed_records(spark, d).where("rotation = 0").crossJoin(F.broadcast(p))
    score = I.index64(I.digest(F.concat_ws("/", "order", F.col("item_id").cast("string"))), F.lit(1000)).cast("double") / 1000
    return rows.withColumn("score", score).groupBy("permutation").agg(F.count("*").alias("n"), r9(F.avg("score"), "mean"), F.count_if(F.col("score") > F.get("p", F.lit(0))).alias("above"))
