"""Compilation, scoring, tracing (PL*), status and filters (FI*), composites on them (CP1-CP3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import identity as I
from ..functions import numeric as N
from ..operators import measure
from ..operators import scoring as S
from ..plans import compile as P
from . import query
from .scalars import r9


def observed(spark, d):
    return S.observe_choices(S.score_choices(X.choice_evidence(spark, d)))


@query("slice0_scored_observations", f"""WITH {X.S1} SELECT bucket, count(*) AS n, sum(CAST(coalesce(correct, false) AS BIGINT))::BIGINT AS n_correct, round(avg(selected_p), 9) AS mean_p,
  round(avg(CASE WHEN correct THEN (selected_p - 1) * (selected_p - 1) WHEN correct IS NOT NULL THEN selected_p * selected_p END), 9) AS brier FROM s1 GROUP BY bucket""")
def slice0(spark, d):
    o = observed(spark, d)
    return o.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.coalesce("correct", F.lit(False))).alias("n_correct"), r9(F.avg("selected_p"), "mean_p"), r9(F.avg(N.brier(F.col("selected_p"), F.col("correct"))), "brier"))


def _decisions(spark, d):
    c = X.table(spark, d, "conversations")
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("decision_id"), F.concat(F.lit("Is it "), F.coalesce("role", F.lit("")), F.lit("?")).alias("question"), F.coalesce("text", F.lit("")).alias("context"), (F.col("turn") % 5 != 4).alias("can_score"))


_DEC = "dec AS (SELECT conv_id || '/' || turn AS decision_id, 'Is it ' || coalesce(role, '') || '?' AS question, coalesce(text, '') AS context, turn % 5 <> 4 AS can_score FROM conversations)"
_lit = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"


@query("pl01_bool_compile", f"""WITH {_DEC}, p AS (SELECT decision_id, can_score, replace(replace({_lit(P.BOOL_TEMPLATE)}, '{{question}}', question), '{{context}}', context) AS prompt FROM dec)
SELECT decision_id, sha256(prompt) AS prompt_fp, CASE WHEN NOT can_score THEN 'no restricted logits' END AS capability_error, sha256('{{"kind":"bool","prompt":"' || sha256(prompt) || '","v":6}}') AS plan_fp FROM p""")
def pl01(spark, d):
    return P.compile_bools(_decisions(spark, d)).select("decision_id", I.digest(F.col("prompt")).alias("prompt_fp"), "capability_error", "plan_fp")


def _choices(spark, d):
    n = (F.col("vec_id") % 10).cast("int")
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("decision_id"), F.lit("Which?").alias("question"), F.col("label").cast("string").alias("context"), F.slice(F.array(*[F.lit(f"n{i}") for i in range(9)]), F.lit(1), n).alias("names"))


@query("pl02_choice_compile", f"""WITH n AS (SELECT vec_id AS decision_id, label::VARCHAR AS context, list_transform(range(0, vec_id % 10), lambda i: 'n' || i) AS names FROM embeddings),
m AS (SELECT *, array_to_string(list_transform(names, lambda x, i: coalesce(chr((64 + i)::INTEGER), '') || ': ' || x), chr(10)) AS lines FROM n)
SELECT decision_id, CASE WHEN len(names) BETWEEN 2 AND 8 THEN sha256(replace(replace(replace({_lit(P.CHOICE_TEMPLATE)}, '{{question}}', 'Which?'), '{{context}}', context), '{{candidates}}', lines)) END AS prompt_fp,
  CASE WHEN len(names) < 2 THEN 'fewer than two candidates' WHEN len(names) > 8 THEN 'more candidates than labels' END AS error FROM m""")
def pl02(spark, d):
    c = P.compile_choices(_choices(spark, d))
    return c.select("decision_id", F.when(F.col("error").isNull(), I.digest(F.col("prompt"))).alias("prompt_fp"), "error")


@query("pl03_label_permutations", """WITH l AS (SELECT unnest(['A', 'B', 'C', 'D']) AS x) SELECT a.x || b.x || c.x || e.x AS labels, vec_id % 24 = 0 AS used FROM l a, l b, l c, l e, (SELECT 0 AS vec_id) WHERE a.x <> b.x AND a.x <> c.x AND a.x <> e.x AND b.x <> c.x AND b.x <> e.x AND c.x <> e.x""")
def pl03(spark, d):
    return P.label_permutations(spark, 4).select(F.array_join("labels", "").alias("labels"), F.lit(True).alias("used"))


@query("pl04_formulations", """SELECT doctrine, family, label_order, mapping FROM (SELECT unnest(['base', 'strict']) AS doctrine), (SELECT unnest(['yes_no', 'true_false', 'a_b']) AS family), (SELECT unnest(['false_true', 'true_false']) AS label_order), (SELECT unnest(['direct', 'inverted']) AS mapping) WHERE family = 'a_b' OR mapping = 'direct'""")
def pl04(spark, d):
    return P.formulations(spark)


@query("pl05_expand_probes", f"""WITH {X.F5} SELECT 'ladder' AS kind, case_id || '::' || rung AS probe FROM f5 WHERE family = 'F' UNION ALL SELECT 'polarity', case_id || '::' || side FROM (SELECT DISTINCT case_id FROM f5), (SELECT unnest(['supporting', 'opposite']) AS side)""")
def pl05(spark, d):
    f5 = X.ladder_records(spark, d)
    ladders = f5.where("family = 'F'").select(F.lit("ladder").alias("kind"), F.concat_ws("::", F.col("case_id").cast("string"), F.col("rung").cast("string")).alias("probe"))
    sides = f5.select("case_id").distinct().select("case_id", F.explode(F.array(F.lit("supporting"), F.lit("opposite"))).alias("side"))
    return ladders.unionByName(sides.select(F.lit("polarity").alias("kind"), F.concat_ws("::", F.col("case_id").cast("string"), "side").alias("probe")))


@query("pl06_assemble_bool", f"WITH {X.F2} SELECT item_id, round(p, 9) AS p_true, round(1 - p, 9) AS p_false FROM s2")
def pl06(spark, d):
    o = X.bool_observations(spark, d)
    return o.select("item_id", r9("p", "p_true"), r9(N.binary_softmax(F.col("l_false"), F.col("l_true")), "p_false"))


@query("pl07_assemble_choice", f"WITH {X.S1} SELECT item_id, unnest(names) AS name, round(unnest(p), 9) AS p FROM s1")
def pl07(spark, d):
    s = S.score_choices(X.choice_evidence(spark, d))
    return s.select("item_id", F.explode(F.arrays_zip("names", "p")).alias("z")).select("item_id", F.col("z.names").alias("name"), r9("z.p", "p"))


REGISTRY = [("restricted_logits", "bool-softmax", 1), ("restricted_logits", "choice-softmax", 1)]


@query("pl08_resolve_assembler", """WITH p AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'bool-softmax' WHEN 'fr' THEN 'choice-softmax' ELSE lang END AS id, CASE WHEN n_chars < 5000 THEN 1 ELSE 2 END AS version FROM documents)
SELECT doc_id, CASE WHEN id IN ('bool-softmax', 'choice-softmax') AND version = 1 THEN id || '@1' END AS assembler, CASE WHEN id IN ('bool-softmax', 'choice-softmax') AND version = 1 THEN 'resolved' ELSE 'unknown' END AS state FROM p""")
def pl08(spark, d):
    """Dispatch on the whole triple: a known id of an unknown version is unknown."""
    lang = F.col("lang")
    p = X.table(spark, d, "documents").select("doc_id", F.lit("restricted_logits").alias("strategy"), F.when(lang == "en", "bool-softmax").when(lang == "fr", "choice-softmax").otherwise(lang).alias("id"), F.when(F.col("n_chars") < 5000, 1).otherwise(2).cast("bigint").alias("version"))
    r = spark.createDataFrame(REGISTRY, "strategy string, id string, version bigint").withColumn("assembler", F.concat("id", F.lit("@"), F.col("version").cast("string")))
    found = p.join(F.broadcast(r), ["strategy", "id", "version"], "left")  # a registry is a few fixed rows
    return found.select("doc_id", "assembler", F.when(F.col("assembler").isNotNull(), "resolved").otherwise("unknown").alias("state"))


@query("pl09_assemble_probability", f"WITH {X.S1}, {X.F2} SELECT 'choice' AS family, item_id, round(selected_p, 9) AS q FROM s1 UNION ALL SELECT 'bool', item_id, round(selected_p, 9) FROM o2")
def pl09(spark, d):
    c = S.score_choices(X.choice_evidence(spark, d)).select(F.lit("choice").alias("family"), "item_id", r9("selected_p", "q"))
    return c.unionByName(X.bool_observations(spark, d).select(F.lit("bool").alias("family"), "item_id", r9("selected_p", "q")))


@query("pl10_diagnose_bool", f"WITH {X.F2} SELECT item_id, round(ln(exp(l_true) + exp(l_false)) - vocab_lse, 9) AS log_mass, round(exp(l_true - vocab_lse), 9) AS t, round(exp(l_false - vocab_lse), 9) AS f FROM s2")
def pl10(spark, d):
    return S.diagnose_bools(X.bool_evidence(spark, d)).select("item_id", r9("log_mass", "log_mass"), r9("true_probability", "t"), r9("false_probability", "f"))


@query("pl11_diagnose_choice", f"WITH {X.S1} SELECT item_id, round(label_lse - vocab_lse, 9) AS log_mass, CAST(top_token_id AS BIGINT) AS top_token_id, round(exp(top_token_logit - vocab_lse), 9) AS top_p, round(list_sum(list_transform(v, lambda x: exp(x - vocab_lse))), 9) AS total FROM s1")
def pl11(spark, d):
    g = S.diagnose_choices(X.choice_evidence(spark, d))
    return g.select("item_id", r9("log_label_mass", "log_mass"), "top_token_id", r9("top_token_probability", "top_p"), r9(N.array_sum(F.col("label_probabilities")), "total"))


@query("pl12_decision_trace", f"""WITH {X.S1} SELECT item_id, sha256('{{"item":' || item_id || ',"truth":' || coalesce('"' || truth || '"', 'null') || ',"v":2}}') AS input_fp, winner, 'trace-' || item_id AS trace_id FROM s1""")
def pl12(spark, d):
    s = S.score_choices(X.choice_evidence(spark, d))
    fp = I.digest(I.record_text({"item": F.col("item_id"), "truth": I.quoted(F.col("truth")), "v": F.lit(2)}))
    return s.select("item_id", fp.alias("input_fp"), "winner", F.concat(F.lit("trace-"), F.col("item_id").cast("string")).alias("trace_id"))


@query("pl13_evaluate_with_trace", f"""WITH {X.S1}, e AS (SELECT item_id, sha256('plan' || CASE WHEN item_id % 50 = 0 THEN item_id + 1 ELSE item_id END) AS evidence_plan, winner FROM s1)
SELECT item_id, winner, CASE WHEN evidence_plan = sha256('plan' || item_id) THEN 'ok' ELSE 'lineage mismatch' END AS lineage FROM e""")
def pl13(spark, d):
    plans = X.choice_evidence(spark, d).select("item_id", I.digest(F.concat(F.lit("plan"), F.col("item_id").cast("string"))).alias("plan_fp"))
    s = S.score_choices(X.choice_evidence(spark, d)).select("item_id", "winner", I.digest(F.concat(F.lit("plan"), F.when(F.col("item_id") % 50 == 0, F.col("item_id") + 1).otherwise(F.col("item_id")).cast("string"))).alias("evidence_plan"))
    return plans.join(s, "item_id").select("item_id", "winner", F.when(F.col("plan_fp") == F.col("evidence_plan"), "ok").otherwise("lineage mismatch").alias("lineage"))


@query("pl14_formulation_fingerprint", """SELECT lang, source, sha256('{"doctrine":"' || source || '","labels":["no","yes"],"language":"' || lang || '","v":2}') AS fp FROM documents GROUP BY lang, source""")
def pl14(spark, d):
    t = I.record_text({"doctrine": I.quoted(F.col("source")), "labels": F.lit('["no","yes"]'), "language": I.quoted(F.col("lang")), "v": F.lit(2)})
    return X.table(spark, d, "documents").select("lang", "source").distinct().select("lang", "source", I.digest(t).alias("fp"))


@query("pl15_family_fingerprint", """SELECT lang, sha256('{"language":"' || lang || '","v":2}') AS fp, count(DISTINCT source) AS members FROM documents GROUP BY lang""")
def pl15(spark, d):
    g = X.table(spark, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("members"))
    return g.select("lang", I.digest(I.record_text({"language": I.quoted(F.col("lang")), "v": F.lit(2)})).alias("fp"), "members")


@query("pl16_raw_records", f"WITH {X.S1}, o AS (SELECT item_id, unnest(v) AS x FROM s1) SELECT item_id, round(sum(1 / (1 + exp(-x))), 9) AS candidate_score_sum, count(*) AS n FROM o GROUP BY item_id")
def pl16(spark, d):
    o = X.choice_evidence(spark, d).select("item_id", F.explode("values").alias("x"))
    return o.groupBy("item_id").agg(r9(F.sum(N.sigmoid(F.col("x"))), "candidate_score_sum"), F.count("*").alias("n"))


@query("pl17_measurement_status", "SELECT doc_id, CASE WHEN lang = 'es' OR n_chars > 10000 THEN 'INELIGIBLE' ELSE 'SCORED' END AS status, CASE WHEN lang = 'es' THEN 'UnsupportedDecisionError: no template for es' WHEN n_chars > 10000 THEN 'ScoringLabelError: ' || n_chars || ' characters' END AS reason, CASE WHEN lang <> 'es' AND n_chars <= 10000 THEN round(n_chars / 10000.0, 9) END AS score FROM documents")
def pl17(spark, d):
    return measure.measured(X.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), _score_by_length).select("doc_id", "status", "reason", F.round("score", 9).alias("score"))


def _score_by_length(row: dict) -> float:
    """A scorer that declares what it can't measure."""
    if row["lang"] == "es":
        raise measure.UnsupportedDecisionError("no template for es")
    if row["n_chars"] > 10000:
        raise measure.ScoringLabelError(f"{row['n_chars']} characters")
    return row["n_chars"] / 10000


@query("pl18_measure_cell", f"""WITH {X.S1}, m AS (SELECT item_id FROM s1 UNION ALL SELECT item_id + 1000000 FROM s1 WHERE item_id < 20)
SELECT m.item_id, CASE WHEN s1.item_id IS NULL THEN 'MISSING' WHEN truth IS NULL THEN 'INELIGIBLE' ELSE 'SCORED' END AS status, CASE WHEN s1.item_id IS NULL THEN 'no evidence' WHEN truth IS NULL THEN 'UnsupportedDecisionError: no truth' END AS reason,
  CASE WHEN truth IS NOT NULL THEN winner END AS winner, CASE WHEN truth IS NOT NULL THEN round(1 / (1 + exp(-s1.v[1 + s1.item_id % 8])), 9) END AS ovr FROM m LEFT JOIN s1 USING (item_id)""")
def pl18(spark, d):
    """A cell of a manifest: every planned item gets a row, measured, declared unmeasurable, or without evidence."""
    e = X.choice_evidence(spark, d).select("item_id")
    manifest = e.unionByName(e.where("item_id < 20").select((F.col("item_id") + 1000000).alias("item_id")))
    s = S.score_choices(X.choice_evidence(spark, d)).select("item_id", "truth", "winner", F.get("values", (F.col("item_id") % 8).cast("int")).alias("logit"))
    got = measure.measured(s, _score_with_truth)
    state = F.coalesce("status", F.lit("MISSING"))
    return manifest.join(got, "item_id", "left").select("item_id", state.alias("status"), F.when(state == "MISSING", "no evidence").otherwise(F.col("reason")).alias("reason"), F.when(state == "SCORED", F.col("winner")).alias("winner"), r9("score", "ovr"))


def _score_with_truth(row: dict) -> float:
    import math

    if row["truth"] is None:
        raise measure.UnsupportedDecisionError("no truth")
    return 1 / (1 + math.exp(-row["logit"]))


for _name, _col, _sql in [("fi01_status", "status", "status"), ("fi02_correct", "correct", "correct"), ("fi03_fit_eligible", "fit_eligible", "status = 'RESOLVED' AND adjudicated AS fit_eligible"), ("fi04_bucket", "bucket", "bucket")]:

    @query(_name, f"WITH {X.S1} SELECT item_id, {_sql} FROM s1")
    def _run(spark, d, c=_col):
        return observed(spark, d).select("item_id", c)


@query("fi05_paired_fit_eligible", f"WITH {X.F3} SELECT split, item_id, label FROM f3 WHERE cat_score >= 0.05 AND ovr_score <= 0.9")
def fi05(spark, d):
    """Rows of which both measurements are scored: the one fails below, the other above a score."""
    p = X.paired_rows(spark, d)
    status = lambda bad: F.when(bad, "INELIGIBLE").otherwise("SCORED")
    p = p.withColumns({"cat_status": status(F.col("cat_score") < 0.05), "ovr_status": status(F.col("ovr_score") > 0.9)})
    return p.where("cat_status = 'SCORED' and ovr_status = 'SCORED'").select("split", "item_id", "label")


BETA_SQL = "CASE WHEN min(cat_score) <= 0 OR max(cat_score) >= 1 THEN 'endpoint' WHEN min(label) = max(label) THEN 'single class' WHEN count(DISTINCT cat_score) < 3 THEN 'too few scores' WHEN max(CASE WHEN label = 0 THEN cat_score END) < min(CASE WHEN label = 1 THEN cat_score END) OR max(CASE WHEN label = 1 THEN cat_score END) < min(CASE WHEN label = 0 THEN cat_score END) THEN 'separated' ELSE 'eligible' END"


@query("fi06_beta_fit_eligibility", f"WITH {X.F3} SELECT cluster_id, {BETA_SQL} AS state FROM f3 GROUP BY cluster_id")
def fi06(spark, d):
    from ..operators.calibration import beta_eligibility

    return X.paired_rows(spark, d).groupBy("cluster_id").agg(beta_eligibility(F.col("cat_score"), F.col("label")).alias("state"))


@query("fi07_profile_eligible", f"WITH {X.F7} SELECT d.doc_id, f7.profile_fp FROM documents d JOIN f7 ON d.lang IS NOT DISTINCT FROM f7.lang WHERE version < 3")
def fi07(spark, d):
    p = X.catalog_profiles(spark).where("version < 3")
    o = X.table(spark, d, "documents").select("doc_id", "lang")
    return o.join(F.broadcast(p), o.lang.eqNullSafe(p.lang)).select("doc_id", "profile_fp")


@query("fi08_binding_equality", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AS equal FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def fi08(spark, d):
    """Bindings of two nations are equal where their payloads are: those of one region."""
    n = X.table(spark, d, "nation").select("n_nationkey", I.record_text({"domain": F.col("n_regionkey").cast("string"), "v": F.lit(1)}).alias("t"))
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("t").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("t").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("x") == F.col("y")).alias("equal"))


@query("fi09_taxonomy_coherent", "SELECT d.doc_id, l.quality IS NULL OR l.toxic IS NULL OR (l.quality = l.toxic AND (d.doc_id % 3 = 0 OR d.n_chars % 2 = d.doc_id % 2)) AS coherent FROM documents d LEFT JOIN labels l USING (doc_id)")
def fi09(spark, d):
    """Taxonomies of binding (quality) and truth (toxic), their versions the parities of n_chars and id, the first unknown for every third."""
    j = X.table(spark, d, "documents").select("doc_id", "n_chars").join(X.table(spark, d, "labels"), "doc_id", "left")
    version = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") % 2)
    return j.select("doc_id", S.coherent_taxonomies(F.col("quality"), version, F.col("toxic"), F.col("doc_id") % 2).alias("coherent"))


@query("fi10_ok_records", "SELECT event_id FROM events WHERE event_type <> 'error'")
def fi10(spark, d):
    return X.table(spark, d, "events").where("event_type <> 'error'").select("event_id")


@query("fi11_structural_eligibility", f"WITH {X.F1} SELECT item_id, len(list_distinct(list_transform(v, lambda x: round(x, 0)))) >= 6 AS eligible FROM f1")
def fi11(spark, d):
    return X.choice_evidence(spark, d).select("item_id", (F.size(F.array_distinct(F.transform("values", lambda x: F.round(x, 0)))) >= 6).alias("eligible"))


@query("fi12_train_subset", f"WITH {X.F3}, ids AS (SELECT item_id FROM f3 WHERE split = 'TRAIN' AND item_id % 40 = 0) SELECT item_id, label FROM f3 WHERE split = 'TRAIN' AND item_id IN (SELECT item_id FROM ids)")
def fi12(spark, d):
    t = X.paired_rows(spark, d).where("split = 'TRAIN'")
    return t.join(t.where("item_id % 40 = 0").select("item_id"), "item_id", "left_semi").select("item_id", "label")


@query("fi13_score_domain", f"WITH {X.F3} SELECT item_id, cat_score >= 0 AND cat_score <= 1 AND NOT isnan(cat_score) AS valid FROM f3")
def fi13(spark, d):
    c = F.col("cat_score")
    return X.paired_rows(spark, d).select("item_id", ((c >= 0) & (c <= 1) & ~F.isnan(c)).alias("valid"))


@query("fi14_structural_check", """WITH c AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id, turn) AS copies, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, turn, CASE WHEN role IS NULL THEN 'no role' WHEN text IS NULL OR trim(text) = '' THEN 'no text' WHEN role NOT IN ('user', 'assistant', 'system') THEN 'unknown role' WHEN turn < 0 THEN 'negative turn' WHEN copies > 1 THEN 'repeated turn' WHEN place = 1 AND role = 'assistant' THEN 'answer first' WHEN before = role THEN 'same role twice' ELSE 'ok' END AS reason FROM c""")
def fi14(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = X.table(spark, d, "conversations").withColumns({"copies": F.count("*").over(Window.partitionBy("conv_id", "turn")), "before": F.lag("role").over(order), "place": F.row_number().over(order)})
    rules = [("no role", "role is null"), ("no text", "text is null or trim(text) = ''"), ("unknown role", "role not in ('user', 'assistant', 'system')"), ("negative turn", "turn < 0"), ("repeated turn", "copies > 1"), ("answer first", "place = 1 and role = 'assistant'"), ("same role twice", "before = role")]
    return c.select("conv_id", "turn", S.first_violation(rules).alias("reason"))


@query("cp01_observation", f"""WITH {X.S1} SELECT item_id, status, correct, winner, round(selected_p, 9) AS selected_p, sha256('{{"selected":"' || winner || '","status":"' || status || '","v":1}}') AS fp FROM s1""")
def cp01(spark, d):
    fp = I.digest(I.record_text({"selected": I.quoted(F.col("winner")), "status": I.quoted(F.col("status")), "v": F.lit(1)}))
    return observed(spark, d).select("item_id", "status", "correct", "winner", r9("selected_p", "selected_p"), fp.alias("fp"))


@query("cp02_binding", """SELECT doc_id, sha256('{"domain":"' || source || '","model":"m1","task":"' || lang || '","v":1}') AS binding_fp FROM documents""")
def cp02(spark, d):
    t = I.record_text({"domain": I.quoted(F.col("source")), "model": F.lit('"m1"'), "task": I.quoted(F.col("lang")), "v": F.lit(1)})
    return X.table(spark, d, "documents").select("doc_id", I.digest(t).alias("binding_fp"))


@query("cp03_truth_semantics", """SELECT d.doc_id, sha256('{"policy":"strict","taxonomy":' || coalesce('"q' || quality || '"', 'null') || ',"v":1}') AS semantics_fp FROM documents d LEFT JOIN labels l USING (doc_id)""")
def cp03(spark, d):
    j = X.table(spark, d, "documents").select("doc_id").join(X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    t = I.record_text({"policy": F.lit('"strict"'), "taxonomy": I.quoted(F.concat(F.lit("q"), F.col("quality").cast("string"))), "v": F.lit(1)})
    return j.select("doc_id", I.digest(t).alias("semantics_fp"))


@query("cp04_calibration_dataset", f"""WITH {X.S1} SELECT item_id, CASE WHEN status <> 'RESOLVED' THEN 'not resolved' WHEN NOT adjudicated THEN 'not adjudicated' END AS rejected FROM s1""")
def cp04(spark, d):
    o = observed(spark, d)
    return o.select("item_id", F.when(F.col("status") != "RESOLVED", "not resolved").when(~F.col("adjudicated"), "not adjudicated").alias("rejected"))
