"""Losses of raw, crossed and native maps, and contrasts of four procedures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N


def risk_matrix(rows: DataFrame, score: str, cross: tuple[float, float], native: tuple[float, float]) -> DataFrame:
    """Brier losses a row: of the score, and of it under two fitted maps (slope, intercept)."""
    y = F.col("label")
    mapped = lambda m: N.brier(N.sigmoid(m[0] * F.col(score) + m[1]), y)
    return rows.withColumns({"raw": N.brier(F.col(score), y), "crossed": mapped(cross), "native": mapped(native)})


def contrasts(rows: DataFrame, by: str, four: dict[str, Column]) -> DataFrame:
    """Main effects of feature and strength and their interaction, of the means of a 2 x 2 design."""
    m = rows.groupBy(by).agg(*[F.avg(c).alias(k) for k, c in four.items()])
    pl, ph, ll, lh = (F.col(k) for k in ("p_lo", "p_hi", "logit_lo", "logit_hi"))
    return m.select(by, F.round((ll + lh) / 2 - (pl + ph) / 2, 9).alias("feature"), F.round((pl + ll) / 2 - (ph + lh) / 2, 9).alias("strength"), F.round((ll - lh) - (pl - ph), 9).alias("interaction"))
