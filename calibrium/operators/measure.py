"""Measuring rows with a scorer that may declare that it can't."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class Inability(Exception):
    """What a scorer declares it can't measure; anything else it raises is a fault."""


class ScoringLabelError(Inability):
    pass


class UnsupportedCapabilityError(Inability):
    pass


class UnsupportedDecisionError(Inability):
    pass


def classify(error: BaseException) -> tuple[str, str] | None:
    """(INELIGIBLE, reason) of a declared inability; null for a fault, which must stop the run."""
    return ("INELIGIBLE", f"{type(error).__name__}: {error}") if isinstance(error, Inability) else None


def measured(rows: DataFrame, score: Callable[[dict], float]) -> DataFrame:
    """`rows` with status, reason and score, each row measured by itself.

    A declared inability becomes an INELIGIBLE row with its reason; any other
    exception fails the task, so that a fault is never recorded as data.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append(("SCORED", None, score(row)))
                except Exception as error:
                    if (told := classify(error)) is None:
                        raise
                    out.append((*told, None))
            status, reason, value = zip(*out) if out else ((), (), ())
            yield batch.assign(status=list(status), reason=list(reason), score=pd.Series(list(value), dtype="float64", index=batch.index))

    return rows.mapInPandas(run, StructType(list(rows.schema.fields)).add("status", "string").add("reason", "string").add("score", "double"))
