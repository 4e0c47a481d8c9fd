"""From logits to probabilities, certainty, diagnostics, selection and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N


def score_choices(evidence: DataFrame) -> DataFrame:
    """Softmax over the labels of a row, keyed by candidate, and the first-maximum winner."""
    rows = evidence.withColumn("p", N.softmax(F.col("values")))
    return rows.withColumns({"winner": N.first_argmax(F.col("names"), F.col("p")), "selected_p": F.array_max("p")})


def certainty(p: Column) -> dict[str, Column]:
    entropy = N.normalized_entropy(p)
    return {"entropy": entropy, "margin": N.margin(p), "concentration": 1 - entropy}


def diagnose_choices(evidence: DataFrame) -> DataFrame:
    """Mass of the labels in the whole vocabulary, its best token, and each label's share."""
    lse = N.logsumexp(F.col("values"))
    return evidence.withColumns(
        {
            "log_label_mass": lse - F.col("vocab_lse"),
            "label_mass": N.probability_from_log_ratio(lse - F.col("vocab_lse"), F.col("vocab_lse")),
            "top_token_probability": N.probability_from_log_ratio(F.col("top_token_logit") - F.col("vocab_lse"), F.col("vocab_lse")),
            "label_probabilities": F.transform("values", lambda x: N.probability_from_log_ratio(x - F.col("vocab_lse"), F.col("vocab_lse"))),
        }
    )


def diagnose_bools(evidence: DataFrame) -> DataFrame:
    log_mass = N.logaddexp(F.col("l_true"), F.col("l_false")) - F.col("vocab_lse")
    return evidence.withColumns(
        {
            "log_mass": log_mass,
            "mass": N.probability_from_log_ratio(log_mass, F.col("vocab_lse")),
            "true_probability": N.probability_from_log_ratio(F.col("l_true") - F.col("vocab_lse"), F.col("vocab_lse")),
            "false_probability": N.probability_from_log_ratio(F.col("l_false") - F.col("vocab_lse"), F.col("vocab_lse")),
        }
    )


def observe_choices(scored: DataFrame) -> DataFrame:
    """Status of the truth, whether the selection is right, and the bucket of a row.

    UNRESOLVED before TAXONOMY_MISS before RESOLVED; correct is null unless
    resolved; only adjudicated resolved rows are eligible.
    """
    missing, outside = F.col("truth").isNull(), ~F.array_contains("names", F.col("truth"))
    status = F.when(missing, "UNRESOLVED").when(outside, "TAXONOMY_MISS").otherwise("RESOLVED")
    rows = scored.withColumn("status", status)
    resolved = F.col("status") == "RESOLVED"
    bucket = F.when(F.col("status") == "UNRESOLVED", "unresolved").when(F.col("status") == "TAXONOMY_MISS", "taxonomy_miss").when(~F.col("adjudicated"), "unadjudicated").otherwise("eligible")
    return rows.withColumns({"correct": F.when(resolved, F.col("winner") == F.col("truth")), "fit_eligible": resolved & F.col("adjudicated"), "bucket": bucket})


def coherent_taxonomies(binding: Column, binding_version: Column, truth: Column, truth_version: Column) -> Column:
    """Whether two declared taxonomies can both be true: what is unknown contradicts nothing."""
    same_version = binding_version.isNull() | truth_version.isNull() | (binding_version == truth_version)
    return binding.isNull() | truth.isNull() | ((binding == truth) & same_version)


def first_violation(rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule (name, SQL condition) a row breaks, or `ok`."""
    out = None
    for name, broken in rules:
        out = F.when(F.expr(broken), name) if out is None else out.when(F.expr(broken), name)
    return out.otherwise("ok")


def coherent_calibration(calibrated: Column, predicted: Column, profile: Column) -> Column:
    """Whether a result is calibrated exactly where it has both a prediction and its profile, and else has neither."""
    both = predicted.isNotNull() & profile.isNotNull()
    return (calibrated == both) & (predicted.isNotNull() == profile.isNotNull())
