"""The registered queries opN_<name> and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, language_id, lexical_search, lm_scoring, near_dedup, secret_scan, sentencepiece_scan, substring_dedup, token_files, url_rules, warc, whitening

#: The rules of op3: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
WORD_VOCABULARY = 49408


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_of_edits(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every document's ids, and whether decoding gives its text back."""
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), digest=True)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of quality and not toxic; background: all."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.score(table(spark, sf_dir, "documents"), good, public_tokenizer("word_bpe_49k.json"), WORD_VOCABULARY)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), WORD_VOCABULARY)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, near-duplicates included, by document."""
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", "n_removed", "class_id", "repeated", F.transform(F.coalesce("spans", F.array()), lambda s: F.concat_ws("-", s["first"], s["end"])).alias("removed"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item."""
    return lexical_search.search(lexical_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_near_dedup, op2_decontaminate, op3_url_rules, op4_warc, op5_fingerprints, op6_sentencepiece, op7_lm_scoring, op8_language_id, op9_token_files, op10_substring_dedup, op11_lexical_search, op12_secret_scan, op13_whitening)
    return {f.__name__: f for f in own}


#: Lower-cases A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id
), least_id AS (
  SELECT id, min(r) AS component_id FROM reach GROUP BY id
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN least_id ON sets.doc_id = least_id.id
"""


OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), place AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w CROSS JOIN (SELECT DISTINCT n FROM phrase))
), hit AS (
  SELECT doc_id, item_id, k, n FROM place JOIN phrase USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = """
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM cut),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM split),
fit AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND fit.k = 1
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS target FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN target END AS refers_to
FROM d
"""


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark),
sizes AS (SELECT row, count(*) AS n FROM d GROUP BY row),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
part AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS part FROM tf JOIN sizes USING (row) JOIN weight USING (term), total),
score AS (SELECT item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM part JOIN q USING (term) GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op3_url_rules": OP3_SQL, "op4_warc": OP4_SQL, "op11_lexical_search": OP11_SQL}
