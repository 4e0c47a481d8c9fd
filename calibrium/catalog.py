"""All queries of the reference's operators and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import QUERIES, SQL, Query
from .queries import aggregates, fits, inputs, joins, ranking, resampling, scalars, scoring, shift, study, support  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["slice0_scored_observations"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
