"""Joins with their failure states: pairing, completeness, linkage, profile selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that are repeated, or on one side alone: (key, reason)."""
    a = left.groupBy(key).agg(F.count("*").alias("_a"))
    b = right.groupBy(key).agg(F.count("*").alias("_b"))
    reason = F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated")
    return a.join(b, key, "full_outer").select(key, reason.alias("reason")).where("reason is not null")


def paired(plan: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """1:1:1 rows of a plan and two measurements; `diff` of each side must be empty."""
    return plan.join(a, key).join(b, key)


def completeness(expected: DataFrame, provided: DataFrame, key: str, checks: list[tuple[str, str]]) -> DataFrame:
    """(key, reason) of expected or provided rows; the first failing check in order counts."""
    e, p = expected.withColumn("_e", F.lit(True)), provided.withColumn("_p", F.lit(True))
    rows = e.join(p, key, "full_outer")
    reason = F.when(F.col("_p").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    for name, condition in checks:
        reason = reason.when(F.expr(condition), name)
    return rows.select(key, reason.otherwise("complete").alias("reason"))


def select_profile(evaluations: DataFrame, profiles: DataFrame, key: str, binding: str) -> DataFrame:
    """The one profile of each evaluation's binding: SELECTED, NO_ELIGIBLE or AMBIGUOUS.

    Profiles are counted by binding first, so the join adds no rows.
    """
    by = profiles.groupBy(binding).agg(F.count("*").alias("_n"), F.min("profile_fp").alias("_fp"))
    rows = evaluations.join(by, binding, "left")
    state = F.when(F.coalesce("_n", F.lit(0)) == 0, "NO_ELIGIBLE").when(F.col("_n") == 1, "SELECTED").otherwise("AMBIGUOUS")
    return rows.select(key, state.alias("state"), F.when(F.col("_n") == 1, F.col("_fp")).alias("profile_fp"))


def violations_of_dependency(rows: DataFrame, of: str, on: str) -> DataFrame:
    """Values of `of` that come with several values of `on`; must be empty."""
    return rows.groupBy(of).agg(F.min(on).alias("lo"), F.max(on).alias("hi")).where("lo <> hi")


def linkage(results: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """`results` with `state`: linked, no trace (a dangling id), or no trace id."""
    known = traces.select(key).distinct().withColumn("_known", F.lit(True))
    state = F.when(F.col(key).isNull(), "no trace id").when(F.col("_known"), "linked").otherwise("no trace")
    return results.join(known, key, "left").withColumn("state", state).drop("_known")


def nestedness(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """One row (not_nested, n): keys of `small`, and those that `large` has not."""
    has = large.select(key).distinct().withColumn("_in", F.lit(True))
    return small.join(has, key, "left").agg(F.count_if(F.col("_in").isNull()).alias("not_nested"), F.count("*").alias("n"))


def merged(panels: list[DataFrame], key: str) -> DataFrame:
    """(key, copies) of the union of panels; they are disjoint if no key has two copies."""
    out = panels[0].select(key)
    for p in panels[1:]:
        out = out.unionByName(p.select(key))
    return out.groupBy(key).agg(F.count("*").alias("copies"))
