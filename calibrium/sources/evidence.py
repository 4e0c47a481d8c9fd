"""Evidence for plans from a table of logits: where a model's forward pass would be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer(plans: DataFrame, logits: DataFrame, key: str) -> DataFrame:
    """`plans` (key, labels, plan_fp) with `values`: the logits of its labels in its order.

    logits: (key, logits map<label, double>). A plan without logits has null
    values; one that asks for a label there is no logit of fails the query.
    """
    rows = plans.join(logits, key, "left")
    one = lambda x: F.coalesce(F.try_element_at("logits", x), F.raise_error(F.concat(F.lit("no logit of "), x)).cast("double"))
    return rows.withColumn("values", F.when(F.col("logits").isNotNull(), F.transform("labels", one))).drop("logits")
