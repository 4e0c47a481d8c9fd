"""Numeric column functions: stable sums of exponentials, losses, exact bins, extended reals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: How far a log ratio may be over 0, relative to max(1, |magnitude|); how far a distribution's sum from 1.
OVERSHOOT, SUM_TOLERANCE = 1e-6, 1e-9
#: Splits a double into two halves of 26 bits (2**27 + 1).
SPLITTER = 134217729.0


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def logaddexp(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def logsumexp(values: Column) -> Column:
    """ln of the sum of exp over an array, shifted by its maximum."""
    top = F.array_max(values)
    return top + F.log(array_sum(F.transform(values, lambda x: F.exp(x - top))))


def softmax(values: Column) -> Column:
    """Shares of exp over an array, shifted by its maximum."""
    top = F.array_max(values)
    parts = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(parts, lambda e: e / array_sum(parts))


def binary_softmax(true: Column, false: Column) -> Column:
    """Probability of the first of two logits."""
    return sigmoid(true - false)


def probability_from_log_ratio(delta: Column, magnitude: Column) -> Column:
    """exp(delta); a delta over 0 by rounding alone counts as 0, any other is an error."""
    slack = F.greatest(F.lit(1.0), F.abs(magnitude)) * OVERSHOOT
    return F.when(delta < 0, F.exp(delta)).when(delta <= slack, F.lit(1.0)).otherwise(F.raise_error(F.lit("a part exceeds the whole")).cast("double"))


def normalized_entropy(p: Column) -> Column:
    """Entropy over its greatest value, 0 to 1; one outcome has 0."""
    h = array_sum(F.transform(F.filter(p, lambda x: x > 0), lambda x: -x * F.log(x)))
    return F.when(F.size(p) <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h / F.log(F.size(p).cast("double")))))


def margin(p: Column) -> Column:
    """The largest probability less the second; the only one where there is one."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) == 1, s[0]).otherwise(F.get(s, 0) - F.get(s, 1))


def valid_distribution(p: Column) -> Column:
    ok = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return ok & (F.abs(array_sum(p) - 1) <= SUM_TOLERANCE)


def first_argmax(names: Column, p: Column) -> Column:
    """Name of the greatest value, of equal ones the first."""
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softplus(z: Column) -> Column:
    return F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)); null at the ends, where it has no finite value."""
    return F.when((p > 0) & (p < 1), F.log(p / (1 - p)))


def beta_features(s: Column) -> tuple[Column, Column]:
    """(ln s, -ln(1 - s)); null at the ends."""
    inside = (s > 0) & (s < 1)
    return F.when(inside, F.log(s)), F.when(inside, -F.log1p(-s))


def log_loss(p: Column, correct: Column) -> Column:
    """-ln of the probability given to what happened; infinite at the wrong end, 0 at the right one."""
    q = F.when(correct, p).otherwise(1 - p)
    exact = F.when(correct, -F.log(F.when(p > 0, p))).otherwise(-F.log1p(F.when(p < 1, -p)))
    return F.when(q == 1, F.lit(0.0)).when(q == 0, F.lit(INF)).otherwise(exact)


def brier(p: Column, y: Column) -> Column:
    d = p - y.cast("double")
    return d * d


def equal_width_bin(p: Column, bins: int) -> Column:
    """floor(p * bins) of the exact product; 1 belongs to the last bin.

    The product is taken with its rounding error: p is split in two halves
    whose products with `bins` are exact.
    """
    b = float(bins)
    t = p * SPLITTER
    high = t - (t - p)
    low = p - high
    k = F.floor(p * b).cast("double")
    rest = (high * b - k) + low * b
    fixed = k - (rest < 0).cast("int") + (rest >= 1).cast("int")
    return F.least(fixed.cast("bigint"), F.lit(bins - 1).cast("bigint"))


def naive_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1).cast("bigint"))


def tv_distance(left: Column, right: Column) -> Column:
    """Half the sum of differences of two maps of probabilities over the union of their keys."""
    return array_sum(F.map_values(F.map_zip_with(left, right, lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))))) / 2


def max_drift(left: Column, right: Column) -> Column:
    return F.array_max(F.map_values(F.map_zip_with(left, right, lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))))


def state(x: Column) -> Column:
    """FINITE, POSITIVE_INFINITY, NEGATIVE_INFINITY or UNDEFINED of an IEEE double."""
    return F.when(x.isNull() | F.isnan(x), "UNDEFINED").when(x == INF, "POSITIVE_INFINITY").when(x == -INF, "NEGATIVE_INFINITY").otherwise("FINITE")


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def direction_state(low: Column, high: Column) -> Column:
    """What an interval of loss differences says: below 0 the loss fell."""
    return F.when(high < 0, "improvement").when(low > 0, "degradation").otherwise("unresolved")


def safe_correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation; null where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def nearest_rank(value: Column, level: float) -> Column:
    return F.expr(f"percentile_disc({level!r}) within group (order by {value._jc.toString()})")
