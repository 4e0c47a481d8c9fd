"""Ordering, ranking, sampling (RK*) and the selections built on them (CP6-CP8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import identity as I
from ..functions import numeric as N
from ..operators import matching as M
from ..operators import sampling as S
from . import query
from .scalars import r9

W3, W4, W5 = (f"WITH {x}" for x in (X.F3, X.F4, X.F5))
POOL = "pool AS (SELECT doc_id, lang, lang || '/' || source AS grp, sha256(text) AS content, sha256('rank' || doc_id) AS rk, doc_id % 10 = 0 AS is_test FROM documents)"


def pool(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", "lang", F.concat_ws("/", "lang", "source").alias("grp"), I.digest(F.col("text")).alias("content"), I.digest(F.concat(F.lit("rank"), F.col("doc_id").cast("string"))).alias("rk"), (F.col("doc_id") % 10 == 0).alias("is_test"))


@query("rk01_select_rows", f"WITH {POOL} SELECT lang, doc_id, k AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY rk, doc_id) AS INTEGER) AS k FROM pool) WHERE k <= 20")
def rk01(spark, d):
    return S.top_k(pool(spark, d), ["lang"], ["rk", "doc_id"], 20).select("lang", "doc_id", "rank")


@query("rk02_rank_entries", f"WITH {POOL} SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY rk) AS INTEGER) AS rank FROM pool")
def rk02(spark, d):
    return S.ranked(pool(spark, d), ["lang"], ["rk"]).select("lang", "doc_id", "rank")


#: The pool to select from: groups span languages and some rows have none; copies of a text may differ in source, its truth.
GROUPS = "CASE WHEN doc_id % 10 <> 3 THEN source || '/' || CAST(n_chars % 40 AS VARCHAR) END"


def selection_pool(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", "lang", "source", F.expr(GROUPS.replace("VARCHAR", "string")).alias("grp"), I.digest(F.col("text")).alias("content"), I.digest(F.concat(F.lit("rank"), F.col("doc_id").cast("string"))).alias("rk"), (F.col("doc_id") % 10 == 0).alias("is_test"))


def _walk(name, quota, after=None):
    """SQL of a selection, stratum by stratum: CTEs of steps (i, used groups, ids) and of the last one's ids.

    quota: a CTE (lang, quota). after: an earlier selection, whose groups and rows are passed over.
    """
    start = f"SELECT 0 AS i, used, []::BIGINT[] AS ids, ids AS old FROM {after}_last" if after else "SELECT 0 AS i, []::VARCHAR[] AS used, []::BIGINT[] AS ids, []::BIGINT[] AS old"
    return f"""{name}_steps AS ({start} UNION ALL
  SELECT i + 1, any_value(used) || coalesce(list(grp) FILTER (k = 1 AND place <= quota AND grp IS NOT NULL), []), any_value(ids) || coalesce(list(doc_id) FILTER (k = 1 AND place <= quota), []), any_value(old)
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rk) AS place FROM (
    SELECT w.i, w.used, w.ids, w.old, r.grp, r.doc_id, r.rk, r.quota, CASE WHEN r.doc_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY coalesce(r.grp, CAST(r.doc_id AS VARCHAR)) ORDER BY r.rk) END AS k
    FROM {name}_steps w LEFT JOIN (SELECT rows_.*, {quota}.quota FROM rows_ JOIN {quota} USING (lang)) r ON r.s = w.i + 1 AND NOT r.hit AND (r.grp IS NULL OR NOT list_contains(w.used, r.grp)) AND NOT list_contains(w.old, r.doc_id)
    WHERE w.i < (SELECT max(s) FROM rows_))) GROUP BY i),
{name}_last AS (SELECT used, ids FROM {name}_steps WHERE i = (SELECT max(s) FROM rows_))"""


_ROWS = f"""pool AS (SELECT doc_id, lang, source AS truth, {GROUPS} AS grp, sha256(text) AS content, sha256('rank' || doc_id) AS rk, doc_id % 10 = 0 AS is_test FROM documents),
test AS (SELECT content, count(DISTINCT truth) AS k, min(truth) AS t FROM pool WHERE is_test GROUP BY content),
rows_ AS (SELECT pool.*, dense_rank() OVER (ORDER BY lang) AS s, test.content IS NOT NULL AS hit, test.content IS NOT NULL AND NOT (k = 1 AND t = truth) AS clash FROM pool LEFT JOIN test USING (content) WHERE NOT is_test),
weights AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)"""


def _hamilton(name, total):
    return f"{name} AS (SELECT lang, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= {total} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT lang, ({total} * n) // (sum(n) OVER ())::BIGINT AS base, ({total} * n) % (sum(n) OVER ())::BIGINT AS rest FROM weights))"


def quotas(spark, d, total):
    """Shares of `total` by the size of a language, the largest remainders first."""
    weights = X.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return S.hamilton_quota(weights, "lang", "n", total)


def selection(spark, d, quota, earlier=None):
    p = selection_pool(spark, d)
    return S.select_by_quota(p.where("not is_test"), p.where("is_test"), quota, "lang", "grp", "content", "rk", "doc_id", "source", earlier)


_EACH = "q AS (SELECT lang, CAST(40 AS BIGINT) AS quota FROM weights)"
_REPORT = """, picked AS (SELECT unnest(ids) AS doc_id FROM sel_last), m AS (SELECT rows_.*, picked.doc_id IS NOT NULL AS sel FROM rows_ LEFT JOIN picked USING (doc_id)),
ends AS (SELECT lang, count(*) AS taken, max(rk) AS last FROM m WHERE sel GROUP BY lang),
told AS (SELECT q.lang, q.quota, coalesce(taken, 0) AS taken, last FROM q LEFT JOIN ends USING (lang)),
seen AS (SELECT m.* FROM m JOIN told USING (lang) WHERE quota > 0 AND (taken < quota OR rk < last)),
c AS (SELECT lang, count(*) FILTER (hit) AS overlap_excluded, count(*) FILTER (NOT hit AND NOT sel AND grp IS NOT NULL) AS group_skipped, bool_or(clash) AS clash FROM seen GROUP BY lang)
SELECT lang, quota, taken, coalesce(overlap_excluded, 0) AS overlap_excluded, coalesce(group_skipped, 0) AS group_skipped, CASE WHEN clash THEN 'CONFLICT' WHEN taken < quota THEN 'SHORT' ELSE 'SATISFIED' END AS state FROM told LEFT JOIN c USING (lang)"""


@query("rk03_stratified_select", f"WITH RECURSIVE {_ROWS}, {_EACH}, {_walk('sel', 'q')} SELECT lang, grp, doc_id FROM rows_ WHERE list_contains((SELECT ids FROM sel_last), doc_id)")
def rk03(spark, d):
    quota = X.table(spark, d, "documents").select("lang").distinct().withColumn("quota", F.lit(40).cast("long"))
    return selection(spark, d, quota).rows.select("lang", "grp", "doc_id")


@query("rk03_selection_states", f"WITH RECURSIVE {_ROWS}, {_EACH}, {_walk('sel', 'q')}{_REPORT}")
def rk03_states(spark, d):
    quota = X.table(spark, d, "documents").select("lang").distinct().withColumn("quota", F.lit(40).cast("long"))
    return selection(spark, d, quota).report


@query("rk04_mid_ranks", W5 + " SELECT family, case_id, rung, rank() OVER (PARTITION BY family ORDER BY round(p, 2)) + (count(*) OVER (PARTITION BY family, round(p, 2)) - 1) / 2 AS mid FROM f5")
def rk04(spark, d):
    return S.mid_ranks(X.ladder_records(spark, d).withColumn("v", F.round("p", 2)), ["family"], "v", "mid").select("family", "case_id", "rung", "mid")


@query("rk05_spearman", W5 + ", r AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY p) + (count(*) OVER (PARTITION BY family, p) - 1) / 2 AS a, rank() OVER (PARTITION BY family ORDER BY rung) + (count(*) OVER (PARTITION BY family, rung) - 1) / 2 AS b FROM f5) SELECT family, round(corr(a, b), 9) AS rho FROM r GROUP BY family")
def rk05(spark, d):
    r = S.mid_ranks(S.mid_ranks(X.ladder_records(spark, d), ["family"], "p", "a"), ["family"], "rung", "b")
    return r.groupBy("family").agg(r9(N.safe_correlation(F.col("a"), F.col("b")), "rho"))


@query("rk06_worst_cases", W4 + ", t AS (SELECT a.item_id, a.rotation, round(list_sum(list_transform(range(1, 9), lambda i: abs(a.p[i] - b.p[i]))) / 2, 9) AS tv FROM f4 a JOIN f4 b ON a.item_id = b.item_id AND b.rotation = 0), m AS (SELECT item_id, max(tv) AS tv FROM t GROUP BY item_id) SELECT item_id, tv FROM m ORDER BY tv DESC, item_id LIMIT 3")
def rk06(spark, d):
    f4 = X.perturbed_records(spark, d).withColumn("m", F.map_from_arrays("names", "p"))
    base = f4.where("rotation = 0").select("item_id", F.col("m").alias("b"))
    tv = f4.join(base, "item_id").groupBy("item_id").agg(F.max(F.round(N.tv_distance(F.col("m"), F.col("b")), 9)).alias("tv"))
    return tv.orderBy(F.desc("tv"), "item_id").limit(3)


@query("rk07_split_ordinals", "SELECT doc_id, CASE WHEN k <= 6 THEN 'TRAIN' WHEN k <= 10 THEN 'TEST' ELSE 'REST' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents)")
def rk07(spark, d):
    k = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return X.table(spark, d, "documents").select("doc_id", k.alias("k")).select("doc_id", F.when(F.col("k") <= 6, "TRAIN").when(F.col("k") <= 10, "TEST").otherwise("REST").alias("split"))


@query("rk08_stable_order", W3 + " SELECT stratum, cluster_id, CAST(row_number() OVER (PARTITION BY stratum ORDER BY cluster_id) AS INTEGER) AS place FROM (SELECT DISTINCT stratum, cluster_id FROM f3)")
def rk08(spark, d):
    c = X.paired_rows(spark, d).select("stratum", "cluster_id").distinct()
    return S.ranked(c, ["stratum"], ["cluster_id"]).select("stratum", "cluster_id", F.col("rank").alias("place"))


@query("rk09_pending", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'committed' WHEN doc_id % 5 = 0 THEN 'replay' ELSE 'fresh' END AS state FROM documents")
def rk09(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id")
    return S.pending(docs, docs.where("doc_id % 3 = 0"), docs.where("doc_id % 5 = 0"), "doc_id")


@query("cp06_build_manifest", f"WITH {POOL}, t AS (SELECT lang, doc_id, content, row_number() OVER (PARTITION BY lang ORDER BY rk) AS k FROM pool), test AS (SELECT * FROM t WHERE k <= 10) SELECT 'TEST' AS split, lang, doc_id FROM test UNION ALL SELECT 'TRAIN', lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY rk) AS k FROM pool WHERE content NOT IN (SELECT content FROM test)) WHERE k <= 20")
def cp06(spark, d):
    p = pool(spark, d)
    test = S.top_k(p, ["lang"], ["rk"], 10)
    train = S.top_k(p.join(test.select("content").distinct(), "content", "left_anti"), ["lang"], ["rk"], 20)
    return test.select(F.lit("TEST").alias("split"), "lang", "doc_id").unionByName(train.select(F.lit("TRAIN").alias("split"), "lang", "doc_id"))


_TWO = f"WITH RECURSIVE {_ROWS}, {_hamilton('q', 60)}, {_hamilton('q2', 30)}, {_walk('sel', 'q')}, {_walk('more', 'q2', 'sel')}"


@query("cp07_population_candidate", f"WITH RECURSIVE {_ROWS}, {_hamilton('q', 60)}, {_walk('sel', 'q')}{_REPORT}")
def cp07(spark, d):
    """A population of 60, by the largest remainders of the languages, with the states of its strata."""
    return selection(spark, d, quotas(spark, d, 60)).report


@query("cp08_nested_extension", _TWO + " SELECT lang, doc_id, list_contains((SELECT ids FROM sel_last), doc_id) AS in_small FROM rows_ WHERE list_contains((SELECT ids FROM sel_last), doc_id) OR list_contains((SELECT ids FROM more_last), doc_id)")
def cp08(spark, d):
    """The population of 60 and 30 more rows, none of its rows and groups among them."""
    small = selection(spark, d, quotas(spark, d, 60)).rows
    more = selection(spark, d, quotas(spark, d, 30), small).rows
    side = lambda df, s: df.select("lang", "doc_id", F.lit(s).alias("in_small"))
    return side(small, True).unionByName(side(more, False))


@query("cp08_nestedness", _TWO + " SELECT CAST(0 AS BIGINT) AS not_nested, CAST(len((SELECT ids FROM sel_last)) AS BIGINT) AS n, CAST(len((SELECT ids FROM sel_last)) + len((SELECT ids FROM more_last)) AS BIGINT) AS n_large, (SELECT count(*) FROM (SELECT unnest(used) AS g FROM more_last) GROUP BY ALL HAVING g IS NOT NULL AND count(*) > 1) IS NULL AS groups_apart")
def cp08_nested(spark, d):
    """Whether all rows of the small population are in the large one, and no group occurs twice."""
    both = cp08(spark, d)
    one = M.nestedness(both.where("in_small"), both, "doc_id")
    groups = both.join(selection_pool(spark, d).select("doc_id", "grp"), "doc_id").where("grp is not null").groupBy("grp").count()
    return one.crossJoin(both.agg(F.count("*").alias("n_large"))).crossJoin(groups.agg(F.coalesce(F.max("count") == 1, F.lit(True)).alias("groups_apart")))
