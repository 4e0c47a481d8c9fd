"""Joins and set operations (JO*, SO*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import identity as I
from ..functions import numeric as N
from ..operators import matching as J
from . import query
from .scalars import r9
from .scoring import observed

W3, W1, W4, W5, W7 = (f"WITH {x}" for x in (X.F3, X.F1, X.F4, X.F5, X.F7))


def _paired(spark, d):
    return X.paired_rows(spark, d)


@query("jo01_paired_decisions", W3 + " SELECT item_id, split, round(cat_score, 9) AS a, round(ovr_score, 9) AS b FROM f3")
def jo01(spark, d):
    p = _paired(spark, d)
    return J.paired(p.select("item_id", "split"), p.select("item_id", r9("cat_score", "a")), p.select("item_id", r9("ovr_score", "b")), "item_id")


@query("jo02_exact_item_set", "SELECT event_id AS item_id, CASE WHEN event_id % 100 = 0 THEN 'missing' ELSE 'extra' END AS reason FROM events WHERE event_id % 100 IN (0, 1)")
def jo02(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_id").alias("item_id"))
    return J.diff(e.where("item_id % 100 <> 1"), e.where("item_id % 100 <> 0"), "item_id")


@query("jo03_completeness", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'unexpected' WHEN n_chars < 100 THEN 'short' WHEN n_chars > 9000 THEN 'long' ELSE 'complete' END AS reason FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0)")
def jo03(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "n_chars")
    return J.completeness(docs.where("doc_id % 11 <> 0").select("doc_id"), docs.where("doc_id % 7 <> 0"), "doc_id", [("short", "n_chars < 100"), ("long", "n_chars > 9000")])


@query("jo04_trace_linkage", "SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.n_chars < 200 THEN 'no trace id' WHEN l.doc_id IS NULL THEN 'no trace' ELSE 'linked' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jo04(spark, d):
    """Results are documents, their traces the labels, which most have not; very short ones carry no trace id."""
    results = X.table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull() & (F.col("n_chars") >= 200), F.col("doc_id")).alias("trace_id"))
    return J.linkage(results, X.table(spark, d, "labels").select(F.col("doc_id").alias("trace_id")), "trace_id").select("doc_id", "state")


@query("jo05_plan_lineage", "SELECT o_orderkey, o_orderkey % 40 = 0 AS mismatch FROM orders")
def jo05(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey")
    fp = lambda c: I.digest(F.concat(F.lit("plan"), c.cast("string")))
    plans = o.select("o_orderkey", fp(F.col("o_orderkey")).alias("p"))
    evidence = o.select("o_orderkey", fp(F.when(F.col("o_orderkey") % 40 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))).alias("e"))
    return plans.join(evidence, "o_orderkey").select("o_orderkey", (F.col("p") != F.col("e")).alias("mismatch"))


@query("jo06_winner_changes", W4 + " SELECT b.item_id, b.rotation::INTEGER AS rotation, a.winner AS before, b.winner AS after FROM f4 a JOIN f4 b ON a.item_id = b.item_id AND a.rotation = 0 AND b.rotation > 0 WHERE a.winner <> b.winner")
def jo06(spark, d):
    f4 = X.perturbed_records(spark, d)
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("rotation")))
    base = f4.where("rotation = 0").withColumn("k", last).where("k = 1").select("item_id", F.col("winner").alias("before"))
    return f4.where("rotation > 0").join(base, "item_id").where("winner <> before").select("item_id", "rotation", "before", F.col("winner").alias("after"))


@query("jo07_pair_preservation", W4 + " SELECT b.rotation::INTEGER AS rotation, count(*) AS n, round(avg((a.winner = b.winner)::INTEGER), 9) AS preserved FROM f4 a JOIN f4 b ON a.item_id = b.item_id AND a.rotation = 0 AND b.rotation > 0 GROUP BY b.rotation")
def jo07(spark, d):
    f4 = X.perturbed_records(spark, d)
    base = f4.where("rotation = 0").select("item_id", F.col("winner").alias("before"))
    return f4.where("rotation > 0").join(base, "item_id").groupBy("rotation").agg(F.count("*").alias("n"), r9(F.avg((F.col("winner") == F.col("before")).cast("int").cast("double")), "preserved"))


@query("jo08_mapping_consistency", W5 + " SELECT a.family AS a, b.family AS b, count(*) AS cases, round(avg(((a.p > 0.5) = (b.p > 0.5))::INTEGER), 9) AS consistent, round(max(abs(a.p - b.p)), 9) AS gap FROM f5 a JOIN f5 b ON a.case_id = b.case_id AND a.rung = b.rung AND a.family < b.family GROUP BY a.family, b.family")
def jo08(spark, d):
    f5 = X.ladder_records(spark, d)
    a, b = (f5.select("case_id", "rung", F.col("family").alias(x), F.col("p").alias(f"p{x}")) for x in ("a", "b"))
    j = a.join(b, ["case_id", "rung"]).where("a < b")
    return j.groupBy("a", "b").agg(F.count("*").alias("cases"), r9(F.avg(((F.col("pa") > 0.5) == (F.col("pb") > 0.5)).cast("int").cast("double")), "consistent"), r9(F.max(F.abs(F.col("pa") - F.col("pb"))), "gap"))


@query("jo09_cross_condition", "SELECT count(*) AS n, count(*) FILTER (lang IS DISTINCT FROM CASE WHEN doc_id % 90 = 0 THEN 'xx' ELSE lang END) AS mismatches FROM documents")
def jo09(spark, d):
    a = X.table(spark, d, "documents").select("doc_id", "lang")
    b = a.select("doc_id", F.when(F.col("doc_id") % 90 == 0, "xx").otherwise(F.col("lang")).alias("other"))
    return a.join(b, "doc_id", "full_outer").agg(F.count("*").alias("n"), F.count_if(~F.col("lang").eqNullSafe(F.col("other"))).alias("mismatches"))


@query("jo10_content_guard", "WITH t AS (SELECT DISTINCT text FROM documents WHERE doc_id % 10 = 0) SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND text NOT IN (SELECT text FROM t)")
def jo10(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", I.digest(F.col("text")).alias("content"))
    return docs.where("doc_id % 10 <> 0").join(docs.where("doc_id % 10 = 0").select("content").distinct(), "content", "left_anti").select("doc_id")


_RANKED = W3 + ", k AS (SELECT item_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('n' || item_id)) AS r, row_number() OVER (PARTITION BY stratum ORDER BY sha256('other' || item_id)) AS o FROM f3 WHERE split = 'TRAIN')"


@query("jo11_nestedness", _RANKED + " SELECT pair, count(*) FILTER (small AND NOT large) AS not_nested, count(*) FILTER (small) AS n FROM (SELECT 'by one rank' AS pair, r <= 10 AS small, r <= 20 AS large FROM k UNION ALL SELECT 'by two ranks', r <= 10, o <= 20 FROM k) GROUP BY pair")
def jo11(spark, d):
    """A selection by rank lies in a larger one by the same rank, and hardly in one by another."""
    p = _paired(spark, d).where("split = 'TRAIN'")
    rank = lambda name: F.row_number().over(Window.partitionBy("stratum").orderBy(I.digest(F.concat(F.lit(name), F.col("item_id").cast("string")))))
    k = p.select("item_id", rank("n").alias("r"), rank("other").alias("o"))
    small = k.where("r <= 10").select("item_id")
    one = lambda large, pair: J.nestedness(small, k.where(large).select("item_id"), "item_id").select(F.lit(pair).alias("pair"), "not_nested", "n")
    return one("r <= 20", "by one rank").unionByName(one("o <= 20", "by two ranks"))


@query("jo12_cluster_in_one_stratum", "SELECT user_id, min(event_type) AS lo, max(event_type) AS hi FROM events GROUP BY user_id HAVING min(event_type) <> max(event_type)")
def jo12(spark, d):
    return J.violations_of_dependency(X.table(spark, d, "events"), "user_id", "event_type")


def _jo13_sql() -> str:
    from .resampling import T3, _draws

    return T3 + ", " + _draws("item_id", "t", reps=10) + " SELECT CAST(replicate AS INTEGER) AS replicate, t.stratum, item_id, w, round(w * raw, 9) AS raw FROM w JOIN t USING (item_id)"


@query("jo13_reindexed_rows", _jo13_sql())
def jo13(spark, d):
    """The rows that ten bootstrap draws name, each as often as it was drawn."""
    from ..operators.resampling import weights
    from .resampling import train

    t = train(spark, d)
    drawn = weights(t, "item_id", "stratum", 10, "p").drop("stratum")
    return drawn.join(t.select("item_id", "stratum", "raw"), "item_id").select("replicate", "stratum", "item_id", "w", r9(F.col("w") * F.col("raw"), "raw"))


_PJ = W7 + " SELECT d.doc_id, f7.profile_fp, round(1 / (1 + exp(-(slope * 0.5 + intercept))), 9) AS q FROM documents d JOIN f7 USING (lang)"


@query("jo14_binding_match", _PJ)
def jo14(spark, d):
    p = F.broadcast(X.catalog_profiles(spark))
    return X.table(spark, d, "documents").select("doc_id", "lang").join(p, "lang").select("doc_id", "profile_fp", r9(N.sigmoid(F.col("slope") * 0.5 + F.col("intercept")), "q"))


@query("jo15_discover_profiles", W7 + " SELECT d.doc_id, string_agg(profile_fp || '@' || version, ',' ORDER BY version, profile_fp) AS refs FROM documents d JOIN f7 USING (lang) GROUP BY d.doc_id")
def jo15(spark, d):
    p = F.broadcast(X.catalog_profiles(spark))
    found = X.table(spark, d, "documents").select("doc_id", "lang").join(p, "lang").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("version", "profile_fp"))).alias("r"))
    return found.select("doc_id", F.array_join(F.transform("r", lambda x: F.concat(x["profile_fp"], F.lit("@"), x["version"].cast("string"))), ",").alias("refs"))


@query("jo16_select_profile", W7 + ", n AS (SELECT lang, count(*) AS n, min(profile_fp) AS fp FROM f7 GROUP BY lang) SELECT doc_id, CASE WHEN n IS NULL THEN 'NO_ELIGIBLE' WHEN n = 1 THEN 'SELECTED' ELSE 'AMBIGUOUS' END AS state, CASE WHEN n = 1 THEN fp END AS profile_fp FROM documents LEFT JOIN n USING (lang)")
def jo16(spark, d):
    return J.select_profile(X.table(spark, d, "documents").select("doc_id", "lang"), X.catalog_profiles(spark), "doc_id", "lang")


@query("jo17_winner_diagnostics", W4 + " SELECT count(*) AS n, round(avg((a.winner = a.truth)::INTEGER), 9) AS a, round(avg((b.winner = a.truth)::INTEGER), 9) AS b FROM f4 a JOIN f4 b ON a.item_id = b.item_id AND a.rotation = 1 AND b.rotation = 2 WHERE a.truth IS NOT NULL")
def jo17(spark, d):
    f4 = X.perturbed_records(spark, d)
    truth = f4.where("rotation = 0 and truth is not null").select("item_id", "truth")
    a, b = (f4.where(f"rotation = {r}").select("item_id", F.col("winner").alias(n)) for r, n in ((1, "x"), (2, "y")))
    rate = lambda c, n: r9(F.avg((F.col(c) == F.col("truth")).cast("int").cast("double")), n)
    return truth.join(a, "item_id").join(b, "item_id").agg(F.count("*").alias("n"), rate("x", "a"), rate("y", "b"))


@query("jo18_split_type", W3 + ", k(stratum_type, first) AS (VALUES ('early', true), ('late', false)) SELECT stratum_type, count(item_id) AS n, round(avg((cat_score - label) * (cat_score - label)), 9) AS brier FROM k LEFT JOIN f3 ON (item_id < 5000) = first GROUP BY stratum_type")
def jo18(spark, d):
    kinds = spark.createDataFrame([("early", True), ("late", False)], "stratum_type string, first boolean")
    rows = _paired(spark, d).select((F.col("item_id") < 5000).alias("first"), "item_id", N.brier(F.col("cat_score"), F.col("label")).alias("l"))
    return F.broadcast(kinds).join(rows, "first", "left").groupBy("stratum_type").agg(F.count("item_id").alias("n"), r9(F.avg("l"), "brier"))


@query("so01_repeated_identities", W7 + " SELECT lang, count(*) AS n FROM f7 GROUP BY lang HAVING count(*) > 1")
def so01(spark, d):
    return X.catalog_profiles(spark).groupBy("lang").agg(F.count("*").alias("n")).where("n > 1")


@query("so02_set_difference", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' ELSE 'extra' END AS side FROM nation WHERE (n_nationkey % 4 = 0) <> (n_nationkey % 3 = 0)")
def so02(spark, d):
    n = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    a, b = n.where("k % 4 = 0"), n.where("k % 3 = 0")
    return a.exceptAll(b).select("k", F.lit("missing").alias("side")).unionByName(b.exceptAll(a).select("k", F.lit("extra").alias("side")))


_LIKELY = W4 + ", k AS (SELECT item_id, rotation, list_filter(names, lambda n: p[list_position(names, n)] > 0.125) AS keys FROM f4)"


@query("so03_key_union", _LIKELY + " SELECT a.item_id, len(list_distinct(list_concat(a.keys, b.keys))) AS n, len(list_intersect(a.keys, b.keys)) AS common FROM k a JOIN k b ON a.item_id = b.item_id AND a.rotation = 0 AND b.rotation = 1")
def so03(spark, d):
    """Keys of two distributions: the candidates above an even share under two rotations."""
    f4 = X.perturbed_records(spark, d)
    keys = F.transform(F.filter(F.arrays_zip("names", "p"), lambda z: z["p"] > 0.125), lambda z: z["names"])
    a, b = (f4.where(f"rotation = {r}").select("item_id", keys.alias(c)) for r, c in ((0, "a"), (1, "b")))
    return a.join(b, "item_id").select("item_id", F.size(F.array_union("a", "b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("common"))


@query("so04_key_intersection", W5 + " SELECT case_id, rung FROM f5 WHERE family = 'F' INTERSECT SELECT case_id, rung FROM f5 WHERE family = 'O'")
def so04(spark, d):
    f5 = X.ladder_records(spark, d)
    return f5.where("family = 'F'").select("case_id", "rung").intersect(f5.where("family = 'O'").select("case_id", "rung"))


@query("so05_merge_panels", W3 + ", m AS (SELECT 'halves' AS panels, item_id FROM f3 UNION ALL SELECT 'overlapping', item_id FROM f3 WHERE split = 'TRAIN' OR cat_score < 0.5 UNION ALL SELECT 'overlapping', item_id FROM f3 WHERE split = 'TEST') SELECT panels, count(*) AS n, count(*) FILTER (copies > 1) AS repeated FROM (SELECT panels, item_id, count(*) AS copies FROM m GROUP BY ALL) GROUP BY panels")
def so05(spark, d):
    """Panels merge if no item is in two of them."""
    p = _paired(spark, d).select("split", "item_id", "cat_score")
    train_, test_ = p.where("split = 'TRAIN'"), p.where("split = 'TEST'")
    halves, overlapping = J.merged([train_, test_], "item_id"), J.merged([p.where("split = 'TRAIN' or cat_score < 0.5"), test_], "item_id")
    one = lambda m, name: m.agg(F.count("*").alias("n"), F.count_if(F.col("copies") > 1).alias("repeated")).select(F.lit(name).alias("panels"), "n", "repeated")
    return one(halves, "halves").unionByName(one(overlapping, "overlapping"))


@query("cp05_catalog_from_profiles", W7 + " SELECT profile_fp, version, CAST(row_number() OVER (ORDER BY version, profile_fp) AS INTEGER) AS place FROM f7")
def cp05(spark, d):
    # a catalogue is a few rows; its order is one small window
    return X.catalog_profiles(spark).select("profile_fp", "version", F.row_number().over(Window.orderBy("version", "profile_fp")).alias("place"))


@query("su_eligible_observations", f"WITH {X.S1} SELECT item_id FROM s1 WHERE bucket = 'eligible'")
def su_eligible(spark, d):
    return observed(spark, d).where("bucket = 'eligible'").select("item_id")
