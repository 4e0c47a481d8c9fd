"""Scalar functions (SC*), each on a fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import identity as I
from ..functions import numeric as N
from ..operators import scoring
from . import query


def r9(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 9).alias(name)


def edges(spark):
    """Probabilities at and around the ends, ties and bin edges, with both outcomes."""
    return spark.createDataFrame(EDGES, "id int, p double, y int")


#: Fixed values.
EDGES = [(i, p, y) for i, (p, y) in enumerate((p, y) for p in (0.0, 1e-300, 0.1, 0.3, 0.5, 0.7, 0.9999999999, 1.0) for y in (0, 1))]
E = "e(id, p, y) AS (VALUES " + ", ".join(f"({i}, CAST('{p!r}' AS DOUBLE), {y})" for i, p, y in EDGES) + ")"


@query("sc01_canonical_json", """SELECT item_id, '{"adjudicated":' || CASE WHEN adjudicated THEN 'true' ELSE 'false' END || ',"item":' || item_id || ',"truth":' || coalesce('"' || truth || '"', 'null') || '}' AS text
FROM (SELECT vec_id AS item_id, CASE WHEN vec_id % 13 <> 0 THEN 'c' || label END AS truth, vec_id % 11 <> 0 AS adjudicated FROM embeddings)""")
def sc01(spark, d):
    e = X.choice_evidence(spark, d)
    return e.select("item_id", I.record_text({"item": F.col("item_id"), "truth": I.quoted(F.col("truth")), "adjudicated": F.col("adjudicated")}).alias("text"))


@query("sc01_canonical_json_arrow", """SELECT o_orderkey, '{"inner":{"o_custkey":' || o_custkey || '},"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) || '}' AS text FROM orders""")
def sc01_arrow(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_totalprice", "o_orderstatus", F.struct("o_custkey").alias("inner"))).alias("j"))
    return o.select("o_orderkey", I.canonical_text(F.col("j")).alias("text"))


@query("sc02_fingerprint", "SELECT doc_id, sha256(text) AS fp FROM documents")
def sc02(spark, d):
    return X.table(spark, d, "documents").select("doc_id", I.digest(F.col("text")).alias("fp"))


@query("sc03_deterministic_index", "SELECT event_id, CAST(('0x' || substr(sha256('draw:' || event_id), 1, 16))::UBIGINT % (event_id % 997 + 1)::UBIGINT AS BIGINT) AS i FROM events")
def sc03(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", I.index64(I.digest(F.concat(F.lit("draw:"), F.col("event_id").cast("string"))), F.col("event_id") % 997 + 1).alias("i"))


H256 = "sha256('wide:' || event_id)"


@query("sc04_wide_index", f"SELECT event_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: CAST(('0x' || substr({H256}, 1 + 8 * i, 8))::UBIGINT AS BIGINT))), lambda a, x: (a * 4294967296 + x) % (event_id % 997 + 1)) AS i FROM events")
def sc04(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", I.index256(I.digest(F.concat(F.lit("wide:"), F.col("event_id").cast("string"))), F.col("event_id") % 997 + 1).alias("i"))


@query("sc05_select_anchor", f"""WITH n AS (SELECT event_id, list_sort(['spam', 'billing', 'other']) AS names, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: CAST(('0x' || substr({H256}, 1 + 8 * i, 8))::UBIGINT AS BIGINT))), lambda a, x: (a * 4294967296 + x) % 3) AS i FROM events)
SELECT event_id, names[i + 1] AS anchor FROM n""")
def sc05(spark, d):
    names = F.array_sort(F.array(F.lit("spam"), F.lit("billing"), F.lit("other")))
    e = X.table(spark, d, "events")
    return e.select("event_id", F.element_at(names, (I.index256(I.digest(F.concat(F.lit("wide:"), F.col("event_id").cast("string"))), F.lit(3)) + 1).cast("int")).alias("anchor"))


@query("sc06_anchor_index", "SELECT event_id, CAST(('0x' || substr(sha256('set/rev/test/' || event_id), 1, 16))::UBIGINT % 4 AS BIGINT) AS anchor FROM events")
def sc06(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", I.index64(I.digest(F.concat(F.lit("set/rev/test/"), F.col("event_id").cast("string"))), F.lit(4)).alias("anchor"))


@query("sc07_selection_keys", """SELECT doc_id, sha256('item|' || lang || '|' || doc_id) AS item, sha256('rank|' || doc_id) AS rank_key FROM documents""")
def sc07(spark, d):
    i = F.col("doc_id").cast("string")
    return X.table(spark, d, "documents").select("doc_id", I.digest(F.concat_ws("|", F.lit("item"), "lang", i)).alias("item"), I.digest(F.concat_ws("|", F.lit("rank"), i)).alias("rank_key"))


@query("sc08_content_fingerprint", "SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def sc08(spark, d):
    return X.table(spark, d, "documents").groupBy(I.digest(F.col("text")).alias("content")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("sc09_normalize_text", "SELECT doc_id, length(trim(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), ' ' || chr(10) || chr(9))) AS n FROM documents")
def sc09(spark, d):
    from ..sources.text import normalize_text

    return X.table(spark, d, "documents").select("doc_id", F.length(normalize_text(F.col("text"))).alias("n"))


def _f2(name, sql, columns):
    @query(name, f"WITH {X.F2} SELECT item_id, {sql} FROM o2")
    def run(spark, d, columns=columns):
        return X.bool_observations(spark, d).select("item_id", *columns())


_f2("sc10_logaddexp", "round(greatest(l_true, l_false) + ln(1 + exp(-abs(l_true - l_false))), 9) AS lse", lambda: [r9(N.logaddexp(F.col("l_true"), F.col("l_false")), "lse")])
_f2("sc12_probability_from_log_ratio", "round(exp(l_true - vocab_lse), 9) AS q", lambda: [r9(N.probability_from_log_ratio(F.col("l_true") - F.col("vocab_lse"), F.col("vocab_lse")), "q")])
_f2("sc13_verbalizer_mass", "round((exp(l_true) + exp(l_false)) / (exp(l_true) + exp(l_false) + exp(0.25)), 9) AS mass", lambda: [r9(N.probability_from_log_ratio(N.logaddexp(F.col("l_true"), F.col("l_false")) - F.col("vocab_lse"), F.col("vocab_lse")), "mass")])
_f2("sc14_full_vocab_probability", "round(exp(l_false) / (exp(l_true) + exp(l_false) + exp(0.25)), 9) AS q", lambda: [r9(N.probability_from_log_ratio(F.col("l_false") - F.col("vocab_lse"), F.col("vocab_lse")), "q")])
_f2("sc21_select_bool", "selected", lambda: ["selected"])
_f2("sc22_selected_probability", "round(selected_p, 9) AS q", lambda: [r9("selected_p", "q")])
_f2("sc23_sigmoid", "round(p, 9) AS q", lambda: [r9(N.sigmoid(F.col("l_true") - F.col("l_false")), "q")])
_f2("sc24_softplus", "round(ln(1 + exp(l_true - l_false)), 9) AS q", lambda: [r9(N.softplus(F.col("l_true") - F.col("l_false")), "q")])
_f2("sc25_logit_feature", "round(ln(p / (1 - p)), 9) AS q", lambda: [r9(N.logit(F.col("p")), "q")])
_f2("sc26_beta_features", "round(ln(p), 9) AS a, round(-ln(1 - p), 9) AS b", lambda: [r9(N.beta_features(F.col("p"))[0], "a"), r9(N.beta_features(F.col("p"))[1], "b")])


def _f1(name, sql, columns):
    @query(name, f"WITH {X.S1} SELECT item_id, {sql} FROM s1")
    def run(spark, d, columns=columns):
        return scoring.score_choices(X.choice_evidence(spark, d)).select("item_id", *columns())


_f1("sc11_logsumexp", "round(label_lse, 9) AS lse", lambda: [r9(N.logsumexp(F.col("values")), "lse")])
_f1("sc15_scoring_label_mass", "round(exp(label_lse - vocab_lse), 9) AS mass", lambda: [r9(N.probability_from_log_ratio(N.logsumexp(F.col("values")) - F.col("vocab_lse"), F.col("vocab_lse")), "mass")])
_f1("sc16_normalized_entropy", "round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(8), 9) AS entropy", lambda: [r9(N.normalized_entropy(F.col("p")), "entropy")])
_f1("sc17_probability_margin", "round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 9) AS margin", lambda: [r9(N.margin(F.col("p")), "margin")])
_f1("sc18_concentration", "round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(8), 9) AS concentration", lambda: [r9(1 - N.normalized_entropy(F.col("p")), "concentration")])
_f1("sc19_validate_distribution", "abs(list_sum(p) - 1) <= 1e-9 AND list_min(p) >= 0 AND list_max(p) <= 1 AS valid", lambda: [N.valid_distribution(F.col("p")).alias("valid")])
_f1("sc20_first_argmax", "winner", lambda: ["winner"])


def _edge(name, sql, columns):
    @query(name, f"WITH {E} SELECT id, {sql} FROM e")
    def run(spark, d, columns=columns):
        return edges(spark).select("id", *columns())


_edge("sc27_log_loss_term", "CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) = 0 THEN 'inf' ELSE 'finite' END AS state, CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) = 0 THEN NULL ELSE round(abs(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) END AS loss", lambda: [F.when(N.log_loss(F.col("p"), F.col("y") == 1) == N.INF, "inf").otherwise("finite").alias("state"), F.when(N.log_loss(F.col("p"), F.col("y") == 1) != N.INF, F.round(F.abs(N.log_loss(F.col("p"), F.col("y") == 1)), 6)).alias("loss")])
_edge("sc28_brier_loss", "round((p - y) * (p - y), 9) AS loss", lambda: [r9(N.brier(F.col("p"), F.col("y")), "loss")])
_edge("sc29_extended_log_loss", "CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) = 0 THEN 'POSITIVE_INFINITY' ELSE 'FINITE' END AS state", lambda: [N.state(N.log_loss(F.col("p"), F.col("y") == 1)).alias("state")])
_edge("sc33_encoded_metric", "CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) = 0 THEN '+inf' ELSE 'finite' END AS tag", lambda: [F.when(N.log_loss(F.col("p"), F.col("y") == 1) == N.INF, "+inf").otherwise("finite").alias("tag")])

#: Fixed values.
REALS = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in (0.0, 1.5, float("inf"), float("-inf")) for b in (-2.0, float("inf"), float("-inf")))]
_real = lambda x: f"CAST('{x}' AS DOUBLE)"
_sql_state = lambda x: f"CASE WHEN isnan({x}) THEN 'UNDEFINED' WHEN {x} = CAST('inf' AS DOUBLE) THEN 'POSITIVE_INFINITY' WHEN {x} = CAST('-inf' AS DOUBLE) THEN 'NEGATIVE_INFINITY' ELSE 'FINITE' END"


@query("sc34_extended_reals", "WITH r(id, a, b) AS (VALUES " + ", ".join(f"({i}, {_real(a)}, {_real(b)})" for i, a, b in REALS) + f") SELECT id, {_sql_state('a + b')} AS added, {_sql_state('a - b')} AS subtracted, {_sql_state('-a')} AS negated FROM r")
def sc34(spark, d):
    r = spark.createDataFrame(REALS, "id int, a double, b double")
    return r.select("id", N.state(F.col("a") + F.col("b")).alias("added"), N.state(F.col("a") - F.col("b")).alias("subtracted"), N.state(-F.col("a")).alias("negated"))


BIN_SQL = """(SELECT item_id, p, floor(p * 15) AS k, (p * 134217729.0) - ((p * 134217729.0) - p) AS hi FROM o2)"""


@query("sc30_equal_width_bin", f"WITH {X.F2} SELECT item_id, CAST(least(k - CAST((hi * 15 - k) + (p - hi) * 15 < 0 AS INTEGER) + CAST((hi * 15 - k) + (p - hi) * 15 >= 1 AS INTEGER), 14) AS BIGINT) AS bin FROM {BIN_SQL}")
def sc30(spark, d):
    return X.bool_observations(spark, d).select("item_id", N.equal_width_bin(F.col("p"), 15).alias("bin"))


@query("sc30_equal_width_bin_edges", "SELECT k AS id, b, CASE WHEN k = 3 AND b = 10 THEN 2 ELSE NULL END AS bin FROM (SELECT 3 AS k, 10 AS b)")
def sc30_edges(spark, d):
    return spark.range(1).select(F.lit(3).alias("id"), F.lit(10).alias("b"), N.equal_width_bin(F.lit(0.3), 10).cast("int").alias("bin"))


def _maps(spark, d):
    f4 = X.perturbed_records(spark, d).withColumn("m", F.map_from_arrays("names", "p"))
    base = f4.where("rotation = 0").select("item_id", F.col("m").alias("base"))
    return f4.where("rotation > 0").join(base, "item_id")


_PAIR = f"WITH {X.F4} SELECT a.item_id, a.rotation, {{}} AS v FROM f4 a JOIN f4 b ON a.item_id = b.item_id AND b.rotation = 0 WHERE a.rotation > 0"


@query("sc31_tv_distance", _PAIR.format("round(list_sum(list_transform(range(1, 9), lambda i: abs(a.p[i] - b.p[i]))) / 2, 9)"))
def sc31(spark, d):
    return _maps(spark, d).select("item_id", "rotation", r9(N.tv_distance(F.col("m"), F.col("base")), "v"))


@query("sc32_max_abs_drift", _PAIR.format("round(list_max(list_transform(range(1, 9), lambda i: abs(a.p[i] - b.p[i]))), 9)"))
def sc32(spark, d):
    return _maps(spark, d).select("item_id", "rotation", r9(N.max_drift(F.col("m"), F.col("base")), "v"))


@query("sc35_excludes_zero", f"WITH {X.F3} SELECT item_id, cat_score - 0.6 > 0 OR cat_score - 0.3 < 0 AS excludes, CASE WHEN cat_score - 0.3 < 0 THEN 'improvement' WHEN cat_score - 0.6 > 0 THEN 'degradation' ELSE 'unresolved' END AS state FROM f3")
def sc35(spark, d):
    low, high = F.col("cat_score") - 0.6, F.col("cat_score") - 0.3
    return X.paired_rows(spark, d).select("item_id", N.excludes_zero(low, high).alias("excludes"), N.direction_state(low, high).alias("state"))


@query("sc36_native_reference_state", f"WITH {X.F3}, i AS (SELECT cluster_id, quantile_disc(x, 0.25) AS lo, quantile_disc(x, 0.75) AS hi FROM (SELECT cluster_id, pow(cat_score - label, 2) - pow(ovr_score - label, 2) AS x FROM f3) GROUP BY cluster_id) SELECT cluster_id, CASE WHEN hi < 0 THEN 'improvement' WHEN lo > 0 THEN 'degradation' ELSE 'unresolved' END AS state FROM i")
def sc36(spark, d):
    """By cluster, from the quartiles of its rows' loss differences."""
    x = N.brier(F.col("cat_score"), F.col("label")) - N.brier(F.col("ovr_score"), F.col("label"))
    i = X.paired_rows(spark, d).withColumn("x", x).groupBy("cluster_id").agg(F.expr("percentile_disc(0.25) within group (order by x)").alias("lo"), F.expr("percentile_disc(0.75) within group (order by x)").alias("hi"))
    return i.select("cluster_id", N.direction_state(F.col("lo"), F.col("hi")).alias("state"))


@query("sc37_rendering_semantics", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{\"enable_thinking\":true}' WHEN doc_id % 3 = 1 THEN '{\"enable_thinking\":false}' ELSE '{}' END AS semantics FROM documents")
def sc37(spark, d):
    cfg = F.when(F.col("doc_id") % 3 == 0, F.lit('{"enable_thinking":true,"x":1}')).when(F.col("doc_id") % 3 == 1, F.lit('{"enable_thinking":false}')).otherwise(F.lit('{"x":2}'))
    kept = F.get_json_object(cfg, "$.enable_thinking")
    return X.table(spark, d, "documents").select("doc_id", F.when(kept.isNull(), "{}").otherwise(F.concat(F.lit('{"enable_thinking":'), kept, F.lit("}"))).alias("semantics"))


@query("sc38_render", "SELECT conv_id, turn, replace(replace('Q: {question} C: {context}', '{question}', role), '{context}', text) AS prompt FROM conversations")
def sc38(spark, d):
    from ..plans.compile import render

    return X.table(spark, d, "conversations").select("conv_id", "turn", render("Q: {question} C: {context}", {"{question}": F.col("role"), "{context}": F.col("text")}).alias("prompt"))


@query("sc39_render_input_text", "SELECT conv_id, turn, 'You decide.' || chr(10) || chr(10) || text AS prompt FROM conversations")
def sc39(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("\n\n", F.lit("You decide."), "text").alias("prompt"))


#: Labels and their one token in the byte-level vocabulary of 50,257, none where they have more.
CONTINUATIONS = [("yes", 3763), ("no", 645), ("true", 2081), ("false", 3991), ("undecidable", None)]


@query("sc40_single_token_continuation", "SELECT conv_id, turn, label, CAST(token_id AS BIGINT) AS token_id FROM conversations, (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else b})" for a, b in CONTINUATIONS) + ") AS t(label, token_id)")
def sc40(spark, d):
    """Labels that the public byte-level tokenizer continues every prompt with by one token."""
    import public_tokenizers

    from ..sources.verbalizers import library, single_token_continuations

    c = X.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("item_id"), F.concat(F.lit("Is it "), F.coalesce("role", F.lit("")), F.lit("?")).alias("prompt"))
    found = single_token_continuations(c, "prompt", [a for a, _ in CONTINUATIONS], library(public_tokenizers.path("byte_bpe_50k.json")))
    return found.select("item_id.conv_id", "item_id.turn", "label", "token_id")


@query("sc41_proposition", f"WITH {X.F1} SELECT item_id, n AS name, 'The right category is ' || n || '.' AS proposition FROM (SELECT item_id, unnest(names) AS n FROM f1)")
def sc41(spark, d):
    return X.choice_evidence(spark, d).select("item_id", F.explode("names").alias("name")).withColumn("proposition", F.format_string("The right category is %s.", "name"))


@query("sc42_fixed_event", f"WITH {X.F1} SELECT item_id, CAST(coalesce(truth = 'c1', false) AS INTEGER) AS event FROM f1")
def sc42(spark, d):
    return X.choice_evidence(spark, d).select("item_id", F.coalesce(F.col("truth") == "c1", F.lit(False)).cast("int").alias("event"))


@query("sc43_hamilton_quota", """WITH w AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT lang, n, 100.0 * n / sum(n) OVER () AS share, (100 * n) // (sum(n) OVER ())::BIGINT AS base, (100 * n) % (sum(n) OVER ())::BIGINT AS rest FROM w)
SELECT lang, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t""")
def sc43(spark, d):
    from ..operators.sampling import hamilton_quota

    return hamilton_quota(X.table(spark, d, "documents").groupBy("lang").count().withColumnRenamed("count", "weight"), "lang", "weight", 100)
