"""Decisions to prompts: doctrine text, candidate labels, permutations, probe grids."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I

#: Labels of candidates, verbalizers of a yes/no question.
CATEGORY_LABELS, VERBALIZERS = ["A", "B", "C", "D", "E", "F", "G", "H"], ["no", "yes"]
BOOL_TEMPLATE = "Question: {question}\nContext: {context}\nAnswer yes or no."
CHOICE_TEMPLATE = "Question: {question}\nContext: {context}\nCategories:\n{candidates}\nAnswer with one label."


def render(template: str, values: dict[str, Column]) -> Column:
    """Placeholders replaced one after the other: a later one in an earlier value is replaced too."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(k), v)
    return out


def compile_bools(decisions: DataFrame) -> DataFrame:
    """(decision_id, prompt, labels, capability_error, plan_fp) of (decision_id, question, context, can_score)."""
    prompt = render(BOOL_TEMPLATE, {"{question}": F.col("question"), "{context}": F.col("context")})
    rows = decisions.select("decision_id", prompt.alias("prompt"), F.array(*map(F.lit, VERBALIZERS)).alias("labels"), F.when(~F.col("can_score"), "no restricted logits").alias("capability_error"))
    return rows.withColumn("plan_fp", I.digest(I.record_text({"kind": F.lit('"bool"'), "prompt": I.quoted(I.digest(F.col("prompt"))), "v": F.lit(6)})))


def mapping_lines(names: Column) -> Column:
    labels = F.array(*map(F.lit, CATEGORY_LABELS))
    return F.array_join(F.transform(names, lambda n, i: F.concat(F.get(labels, i), F.lit(": "), n)), "\n")


def compile_choices(decisions: DataFrame) -> DataFrame:
    """As compile_bools, for (decision_id, question, context, names); 2 to 8 candidates."""
    n = F.size("names")
    prompt = render(CHOICE_TEMPLATE, {"{question}": F.col("question"), "{context}": F.col("context"), "{candidates}": mapping_lines(F.col("names"))})
    error = F.when(n < 2, "fewer than two candidates").when(n > len(CATEGORY_LABELS), "more candidates than labels").when(F.size(F.array_distinct("names")) < n, "repeated candidates")
    return decisions.select("decision_id", prompt.alias("prompt"), F.slice(F.array(*map(F.lit, CATEGORY_LABELS)), 1, n).alias("labels"), error.alias("error"))


def label_permutations(spark: SparkSession, n: int) -> DataFrame:
    """(permutation, labels): every order of the first n labels, in lexicographic order."""
    rows = [(i, list(p)) for i, p in enumerate(permutations(CATEGORY_LABELS[:n]))]
    return spark.createDataFrame(rows, "permutation int, labels array<string>")


def formulations(spark: SparkSession) -> DataFrame:
    """Doctrines x label families x orders x mappings, without mappings a family doesn't have."""
    dims = {"doctrine": ["base", "strict"], "family": ["yes_no", "true_false", "a_b"], "label_order": ["false_true", "true_false"], "mapping": ["direct", "inverted"]}
    out = None
    for k, values in dims.items():
        one = spark.createDataFrame([(v,) for v in values], f"{k} string")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.where("family = 'a_b' or mapping = 'direct'")
