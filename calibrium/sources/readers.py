"""Readers of records: JSON lines, case files, Parquet shards, CSV inside tar archives."""

from __future__ import annotations

import csv
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, any other text fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_case_file(spark: SparkSession, path: str, schema: str, cases: str) -> DataFrame:
    """One nested document a file; a row for each element of its array `cases`."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode(cases).alias("case")).select("case.*")


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_tar_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of headerless CSV files in tar archives: (member, line, columns); an archive is read by one task."""
    fields = ", ".join(f"{c} string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".csv"):
                            rows = list(csv.reader(io.TextIOWrapper(tar.extractfile(m), "utf-8", newline="")))
                            if any(len(r) != len(columns) for r in rows):
                                raise ValueError(f"{m.name}: a row has not {len(columns)} columns")
                            yield pd.DataFrame([(m.name, i, *r) for i, r in enumerate(rows)], columns=["member", "line", *columns])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"member string, line long, {fields}")
