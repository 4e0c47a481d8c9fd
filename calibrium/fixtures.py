"""Scored decisions derived from the test tables, in Spark and, alike, in SQL.

Every derivation is a plain select, so predicates and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identity as I
from .functions import numeric as N

LABELS = ["A", "B", "C", "D", "E", "F", "G", "H"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def choice_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Eight label logits a row, the whole vocabulary's statistics, and the truth."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 8)
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("item_id"), "label", scaled.alias("logits"))
    return e.select(
        "item_id",
        F.array(*[F.lit(x) for x in LABELS]).alias("labels"),
        F.array(*[F.lit(f"c{i}") for i in range(8)]).alias("names"),
        F.slice("logits", 1, 8).alias("values"),
        N.logsumexp(F.col("logits")).alias("vocab_lse"),
        (F.array_position("logits", F.array_max("logits")) - 1).cast("bigint").alias("top_token_id"),
        F.array_max("logits").alias("top_token_logit"),
        F.when(F.col("item_id") % 13 != 0, F.concat(F.lit("c"), F.col("label").cast("string"))).alias("truth"),
        (F.col("item_id") % 11 != 0).alias("adjudicated"),
    )


F1 = """f1 AS (
  SELECT CAST(vec_id AS BIGINT) AS item_id, list_transform(embedding, lambda x: 8 * CAST(x AS DOUBLE)) AS logits, list_transform(embedding[1:8], lambda x: 8 * CAST(x AS DOUBLE)) AS v,
    list_transform(range(0, 8), lambda i: 'c' || i) AS names, CASE WHEN vec_id % 13 <> 0 THEN 'c' || label END AS truth, vec_id % 11 <> 0 AS adjudicated FROM embeddings)"""

#: F1 scored: p, lse over the labels, vocabulary statistics, winner, status, bucket.
S1 = (
    F1
    + """, s1a AS (
  SELECT *, list_max(v) AS top, list_max(logits) AS top_token_logit, list_position(logits, list_max(logits)) - 1 AS top_token_id FROM f1),
s1b AS (SELECT *, top + ln(list_sum(list_transform(v, lambda x: exp(x - top)))) AS label_lse, top_token_logit + ln(list_sum(list_transform(logits, lambda x: exp(x - top_token_logit)))) AS vocab_lse,
  list_transform(v, lambda x: exp(x - top)) AS parts FROM s1a),
s1c AS (SELECT *, list_transform(parts, lambda x: x / list_sum(parts)) AS p FROM s1b),
s1d AS (SELECT *, list_max(p) AS selected_p, names[list_position(p, list_max(p))] AS winner FROM s1c),
s1 AS (SELECT *, CASE WHEN truth IS NULL THEN 'UNRESOLVED' WHEN NOT list_contains(names, truth) THEN 'TAXONOMY_MISS' ELSE 'RESOLVED' END AS status,
  CASE WHEN truth IS NULL OR NOT list_contains(names, truth) THEN NULL ELSE winner = truth END AS correct,
  CASE WHEN truth IS NULL THEN 'unresolved' WHEN NOT list_contains(names, truth) THEN 'taxonomy_miss' WHEN NOT adjudicated THEN 'unadjudicated' ELSE 'eligible' END AS bucket FROM s1d)"""
)


def bool_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Two logits a document; truth is the quality label."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left")
    t, f = F.log(1 + F.col("n_chars")) / 4, (F.col("doc_id") % 17) / 8
    return rows.select(
        F.col("doc_id").alias("item_id"),
        t.alias("l_true"),
        f.alias("l_false"),
        N.logsumexp(F.array(t, f, F.lit(0.25))).alias("vocab_lse"),
        (F.col("quality") == 1).alias("truth"),
        (F.col("doc_id") % 10 != 0).alias("adjudicated"),
        F.col("lang").alias("stratum"),
        F.col("source"),
    )


F2 = """f2 AS (
  SELECT d.doc_id AS item_id, ln(1 + n_chars) / 4 AS l_true, (d.doc_id % 17) / 8 AS l_false, quality = 1 AS truth, d.doc_id % 10 <> 0 AS adjudicated, lang AS stratum, source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s2 AS (SELECT *, ln(exp(l_true) + exp(l_false) + exp(0.25)) AS vocab_lse, 1 / (1 + exp(l_false - l_true)) AS p, 1 / (1 + exp(l_false - l_true)) > 0.5 AS selected FROM f2),
o2 AS (SELECT *, CASE WHEN selected THEN p ELSE 1 - p END AS selected_p, CASE WHEN truth IS NULL THEN NULL ELSE selected = truth END AS correct,
  CASE WHEN truth IS NULL THEN 'unresolved' WHEN NOT adjudicated THEN 'unadjudicated' ELSE 'eligible' END AS bucket FROM s2)"""


def bool_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = bool_evidence(spark, d).withColumn("p", N.binary_softmax(F.col("l_true"), F.col("l_false")))
    rows = rows.withColumn("selected", F.col("p") > 0.5)
    bucket = F.when(F.col("truth").isNull(), "unresolved").when(~F.col("adjudicated"), "unadjudicated").otherwise("eligible")
    return rows.withColumns({"selected_p": F.when(F.col("selected"), F.col("p")).otherwise(1 - F.col("p")), "correct": F.col("selected") == F.col("truth"), "bucket": bucket})


def _unit(prefix: str) -> Column:
    return I.index64(I.digest(F.concat(F.lit(prefix), F.col("event_id").cast("string"))), F.lit(10000))


def paired_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two scores and one label an event, strata of types and clusters of users in them."""
    cat = (_unit("cat:") + F.lit(0.5)) / 10000
    e = table(spark, d, "events").select("event_id", "event_type", "user_id").withColumn("cat_score", cat)
    return e.select(
        F.col("event_id").alias("item_id"),
        F.col("event_type").alias("stratum"),
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("cluster_id"),
        "cat_score",
        (((_unit("ovr:") + F.lit(0.5)) / 10000 + F.col("cat_score")) / 2).alias("ovr_score"),
        (_unit("y:") < 10000 * F.col("cat_score")).cast("int").alias("label"),
        F.when(F.col("event_id") % 20 == 0, "TRAIN").otherwise("TEST").alias("split"),
    )


F3 = """f3a AS (
  SELECT event_id AS item_id, event_type AS stratum, event_type || '/' || user_id AS cluster_id, (('0x' || substr(sha256('cat:' || event_id), 1, 16))::UBIGINT % 10000 + 0.5) / 10000 AS cat_score,
    (('0x' || substr(sha256('ovr:' || event_id), 1, 16))::UBIGINT % 10000 + 0.5) / 10000 AS o, CAST(('0x' || substr(sha256('y:' || event_id), 1, 16))::UBIGINT % 10000 AS DOUBLE) AS y, CASE WHEN event_id % 20 = 0 THEN 'TRAIN' ELSE 'TEST' END AS split FROM events),
f3 AS (SELECT item_id, stratum, cluster_id, cat_score, (o + cat_score) / 2 AS ovr_score, CAST(y < 10000 * cat_score AS INTEGER) AS label, split FROM f3a)"""


def perturbed_records(spark: SparkSession, d: str) -> DataFrame:
    """Choice evidence under three label rotations; rotation 0 is the reference."""
    rows = choice_evidence(spark, d).select("item_id", "names", "values", "truth", F.explode(F.array(*map(F.lit, range(3)))).alias("rotation"))
    moved = F.transform("values", lambda x, i: x + 0.3 * ((i + F.col("rotation")) % 3))
    rows = rows.withColumn("p", N.softmax(moved))
    return rows.select("item_id", "rotation", "names", "p", "truth", N.first_argmax(F.col("names"), F.col("p")).alias("winner"))


F4 = (
    F1
    + """, f4a AS (SELECT item_id, names, truth, r AS rotation, list_transform(v, lambda x, i: x + 0.3 * ((i - 1 + r) % 3)) AS w FROM f1 CROSS JOIN (SELECT unnest(range(0, 3)) AS r)),
f4b AS (SELECT *, list_transform(w, lambda x: exp(x - list_max(w))) AS e FROM f4a),
f4c AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM f4b),
f4 AS (SELECT item_id, rotation, names, p, truth, names[list_position(p, list_max(p))] AS winner FROM f4c)"""
)


def ladder_records(spark: SparkSession, d: str) -> DataFrame:
    """A probability for each rung (order priority), case and label family (order status).

    A case is about 25 customers, so there are more of them in larger tables, 40 at least.
    """
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").cast("double").alias("top"))
    cases = table(spark, d, "customer").agg(F.greatest(F.lit(40), F.floor(F.count("*") / 25)).alias("cases"))
    o = o.crossJoin(F.broadcast(cases))
    by = o.groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("rung"), (F.col("o_custkey") % F.col("cases")).cast("int").alias("case_id"), F.col("o_orderstatus").alias("family"))
    return by.agg(F.avg(F.col("o_totalprice").cast("double")).alias("mean")).crossJoin(F.broadcast(top)).select("rung", "case_id", "family", (F.col("mean") / F.col("top")).alias("p"))


F5 = """f5 AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rung, CAST(o_custkey % (SELECT greatest(40, count(*) // 25) FROM customer) AS INTEGER) AS case_id, o_orderstatus AS family,
  avg(CAST(o_totalprice AS DOUBLE)) / (SELECT max(CAST(o_totalprice AS DOUBLE)) FROM orders) AS p FROM orders GROUP BY ALL)"""


def catalog_profiles(spark: SparkSession) -> DataFrame:
    """Twelve profiles of four languages; bindings with none, one or several profiles."""
    return spark.createDataFrame(PROFILES, "profile_fp string, version int, lang string, slope double, intercept double")


#: Fingerprint, version, binding, slope, intercept.
PROFILES = [(f"p{i:02d}", 1 + i % 3, lang, 0.5 + 0.25 * i, -0.5 + 0.125 * i) for i, lang in enumerate(["de", "en", "en", "fr", "fr", "fr", "it", "it", "pt", "pt", "pl", "nl"])]
F7 = "f7(profile_fp, version, lang, slope, intercept) AS (VALUES " + ", ".join(repr(x) for x in PROFILES) + ")"
