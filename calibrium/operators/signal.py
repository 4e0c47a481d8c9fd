"""Prompt-sensitivity helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N


def centred(p: Column) -> Column:
    """Log probabilities less their mean."""
    logs = F.transform(p, lambda x: F.log(x))
    return F.transform(logs, lambda x: x - N.array_sum(logs) / F.size(p))
