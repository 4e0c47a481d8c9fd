"""Quotas, ranked selections by digest, overlap guards and resumption."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder


def hamilton_quota(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, quota): shares of `total` by weight, the rest to the largest remainders, then by name.

    One row for each stratum; the window over all strata is as small as they are few.
    """
    every = Window.partitionBy(F.lit(0))
    rows = weights.select(key, (F.col(weight) * total).cast("bigint").alias("_s"), F.sum(weight).over(every).cast("bigint").alias("_w"))
    rows = rows.select(key, F.expr("_s div _w").alias("base"), (F.col("_s") % F.col("_w")).alias("rest"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), key)
    left = F.lit(total) - F.sum("base").over(every)
    return rows.select(key, (F.col("base") + (F.row_number().over(order) <= left).cast("bigint")).alias("quota"))


def ranked(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(rows: DataFrame, by: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first k of each group; Spark keeps k a task before the shuffle."""
    return ranked(rows, by, order).where(F.col("rank") <= k)


class Selection(NamedTuple):
    """`rows`: the pool's rows that are selected, with their `place` in the stratum. `report`: a row a stratum of the quota."""

    rows: DataFrame
    report: DataFrame


def select_by_quota(pool: DataFrame, test: DataFrame, quota: DataFrame, stratum: str, group: str, content: str, rank: str, key: str, truth: str | None = None, earlier: DataFrame | None = None) -> Selection:
    """Quota rows a stratum by (rank, key), at most one a group in all strata, none with the content of a test row.

    Equal to going through the strata by name and each stratum's rows by rank,
    where a row is passed over if it was selected `earlier` (a table with key and
    group), if a test row has its content, or if its group has been taken; rows
    of null group are in nobody's way. Here all strata claim at once: a group
    stays with the first stratum that claims it, the others claim their next
    rows, until no group has two claims. What a stratum claims depends on those
    before it alone, so the result is the sequential one.

    report: (stratum, quota, taken, overlap_excluded, group_skipped, state), of
    the rows up to the last one taken, or of all if the quota is not filled.
    state: CONFLICT where one of them has the content of test rows but not their
    one `truth`, else SHORT below the quota, else SATISFIED; a stratum of the
    quota without rows is short. The sequential form stops at the first stratum
    that is not satisfied. Strata without quota take none. Keys are unique.

    Only the best row of a group in a stratum can be taken, so claims are made
    over those, and a task sends no more than the largest quota of rows of a
    stratum to be ranked. Claims are written each round.
    """
    spark, order = pool.sparkSession, F.struct(F.col(rank).alias("rank"), F.col(key).alias("key"))
    most = quota.agg(F.max("quota")).first()[0] or 0
    hits = test.groupBy(F.col(content).alias("_content")).agg(F.lit(True).alias("_test"), *([F.min(truth).alias("_lo"), F.max(truth).alias("_hi"), F.count(truth).alias("_known"), F.count("*").alias("_all")] if truth else []))
    rows = pool.withColumn("_order", order).join(quota.select(F.col(stratum).alias("_s"), F.col("quota").alias("_quota")), F.col(stratum) == F.col("_s")).drop("_s")
    rows = rows.join(hits, F.col(content).eqNullSafe(F.col("_content")), "left").drop("_content")
    one_truth = F.lit(True)
    if truth:
        one_truth = F.when(F.col("_known") == 0, F.col(truth).isNull()).otherwise(F.coalesce((F.col("_known") == F.col("_all")) & (F.col("_lo") == F.col(truth)) & (F.col("_hi") == F.col(truth)), F.lit(False)))
    rows = rows.withColumn("_conflict", F.col("_test").isNotNull() & ~one_truth)
    free = rows.where("_test is null")
    if earlier is not None:
        rows, free = (df.join(earlier.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti") for df in (rows, free))
        free = free.join(earlier.select(F.col(group).alias("_g")).where("_g is not null").distinct(), F.col(group) == F.col("_g"), "left_anti")
    best = free.where(F.col(group).isNotNull()).groupBy(F.col(stratum).alias("s"), F.col(group).alias("g"), "_quota").agg(F.min("_order").alias("o"))
    alone = free.where(F.col(group).isNull()).select(F.col(stratum).alias("s"), F.col(group).alias("g"), "_quota", F.col("_order").alias("o"))
    folder, n = shared_folder(spark, "selection"), 0

    def written(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    wanted = written(best.unionByName(alone))
    place = F.row_number().over(Window.partitionBy("s").orderBy("o"))
    owned: DataFrame | None = None
    while True:
        open_ = wanted if owned is None else wanted.join(owned, "g", "left").where("owner is null or owner >= s").drop("owner")
        held = written(open_.withColumn("place", place).where(F.col("place") <= most).where("place <= _quota"))
        owned = held.where("g is not null").groupBy("g").agg(F.min("s").alias("owner"))
        if held.join(owned, "g").where("owner < s").isEmpty():
            break
    chosen = held.select(F.col("s").alias("_s"), F.col("o.key").alias("_k"), "place")
    picked = pool.join(chosen, (F.col(stratum) == F.col("_s")) & (F.col(key) == F.col("_k"))).drop("_s", "_k")
    ends = held.groupBy("s").agg(F.count("*").alias("taken"), F.max("o").alias("last"))
    seen = rows.join(ends, F.col(stratum) == F.col("s"), "left").join(chosen.select("_s", "_k"), (F.col(stratum) == F.col("_s")) & (F.col(key) == F.col("_k")), "left")
    seen = seen.where((F.col("_quota") > 0) & ((F.coalesce("taken", F.lit(0)) < F.col("_quota")) | (F.col("_order") < F.col("last"))))
    skipped = F.col("_test").isNull() & F.col("_k").isNull() & F.col(group).isNotNull()
    counts = seen.groupBy(F.col(stratum).alias("s")).agg(F.count_if(F.col("_test").isNotNull()).alias("overlap_excluded"), F.count_if(skipped).alias("group_skipped"), F.bool_or("_conflict").alias("conflict"))
    told = quota.select(F.col(stratum).alias("s"), "quota").join(ends.drop("last"), "s", "left").join(counts, "s", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    told = told.select(F.col("s").alias(stratum), "quota", none("taken"), none("overlap_excluded"), none("group_skipped"), "conflict")
    state = F.when(F.coalesce("conflict", F.lit(False)), "CONFLICT").when(F.col("taken") < F.col("quota"), "SHORT").otherwise("SATISFIED")
    return Selection(picked, told.withColumn("state", state).drop("conflict"))


def overlap(a: DataFrame, b: DataFrame, content: str, label: str) -> DataFrame:
    """Per content that both sides have: rows of each and whether their labels conflict."""
    x = a.groupBy(content).agg(F.count("*").alias("n_a"), F.min(label).alias("a_lo"), F.max(label).alias("a_hi"))
    y = b.groupBy(content).agg(F.count("*").alias("n_b"), F.min(label).alias("b_lo"), F.max(label).alias("b_hi"))
    conflict = F.least("a_lo", "b_lo") != F.greatest("a_hi", "b_hi")
    return x.join(y, content).select(content, "n_a", "n_b", conflict.alias("conflict"))


def mid_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*by)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def pending(manifest: DataFrame, committed: DataFrame, inflight: DataFrame, key: str) -> DataFrame:
    """State of every planned row: committed, replay (in flight, not committed) or fresh."""
    c = committed.select(key).distinct().withColumn("_c", F.lit(True))
    i = inflight.select(key).distinct().withColumn("_i", F.lit(True))
    rows = manifest.join(c, key, "left").join(i, key, "left")
    return rows.withColumn("state", F.when(F.col("_c"), "committed").when(F.col("_i"), "replay").otherwise("fresh")).drop("_c", "_i")
