"""Losses, diagnostics and reliability of observations, before and after calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import numeric as N
from ..functions.exact import exact_means, exact_sums


def _matched(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of two tables of one row a group, side by side; keys may be null."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.toDF(*[f"_{c}" if c in by else c for c in right.columns])
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])


def summary(rows: DataFrame, p: str, correct: str, by: list[str]) -> DataFrame:
    """Count, correct, rate, mean probability, Brier, log loss and the constant's Brier.

    Every mean is the exact sum, rounded once, over the number of rows.
    """
    y = F.col(correct).cast("int")
    means = exact_means(rows, by, {"mean_p": F.col(p), "brier": N.brier(F.col(p), y), "log_loss": N.log_loss(F.col(p), F.col(correct)), "rate": y})
    means = means.withColumn("n_correct", F.round(F.col("rate") * F.col("n")).cast("bigint"))
    each = lambda value, n: F.struct(value.alias("v"), n.alias("w"))
    wrong = means.select(*by, F.explode(F.array(each((F.col("rate") - 1) * (F.col("rate") - 1), F.col("n_correct")), each(F.col("rate") * F.col("rate"), F.col("n") - F.col("n_correct")))).alias("x"))
    constant = exact_means(wrong, by, {"constant_brier": F.col("x.v")}, F.coalesce(F.col("x.w"), F.lit(0))).drop("n")
    return _matched(means, constant, by).select(*by, "n", F.when(F.col("n") > 0, F.col("n_correct")).alias("n_correct"), "rate", "mean_p", "brier", "log_loss", "constant_brier")


def reliability(rows: DataFrame, p: str, correct: str, bins: int, key: str, bin_of: Column | None = None) -> DataFrame:
    """A row for each bin, empty ones with null statistics; the fingerprint is of the bin's sorted keys."""
    spark = rows.sparkSession
    rows = rows.withColumn("_bin", N.equal_width_bin(F.col(p), bins) if bin_of is None else bin_of)
    members = rows.groupBy(F.col("_bin").alias("bin")).agg(F.count_if(F.col(correct)).alias("n_correct"), I.multiset_digest(F.col(key).cast("string")).alias("members_fp"))
    means = exact_means(rows, ["_bin"], {"mean_p": F.col(p)}).withColumnRenamed("_bin", "bin")
    every = spark.range(bins).select(F.col("id").alias("bin"))
    filled = every.join(means, "bin", "left").join(members, "bin", "left")
    return filled.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"), "mean_p", F.try_divide("n_correct", "n").alias("rate"), "members_fp")


def binned_gap(reliability_rows: DataFrame) -> DataFrame:
    """Sum over bins of their share times |mean - rate|; over no rows null."""
    r = reliability_rows.where("n > 0")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # of a few bins
    r = r.withColumn("_term", F.col("n") / total * F.abs(F.col("mean_p") - F.col("rate")))
    return exact_sums(r, [], {"gap": F.col("_term")}).select(F.when(F.col("n") > 0, F.col("gap")).alias("gap"))


def risks(rows: DataFrame, y: str, columns: dict[str, str], by: list[str]) -> DataFrame:
    """(by, names): mean Brier loss of each named score."""
    return exact_means(rows, by, {name: N.brier(F.col(c), F.col(y)) for name, c in columns.items()}).drop("n")


def mean_of_means(rows: DataFrame, value: Column, stratum: str, by: list[str]) -> DataFrame:
    inner = exact_means(rows, [*by, stratum], {"_m": value})
    return exact_means(inner, by, {"mean": F.col("_m")}).withColumnRenamed("n", "strata")
