"""The logistic objective solved in decimals, to hold the fits in doubles against."""

from __future__ import annotations

import decimal
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digits, largest objective gap, iterations.
DIGITS, GAP, ITERATIONS = 80, Decimal("1e-24"), 60


def solve(rows: list[tuple[Decimal, int, int]], strength: Decimal, start: tuple[Decimal, Decimal] = (Decimal(0), Decimal(0))) -> tuple[Decimal, Decimal, Decimal]:
    """Slope, intercept and bound of the objective gap of rows (score, label, count).

    Newton's method with halved steps until |gradient|^2 / (2 strength) is at
    most GAP; ArithmeticError where that is not reached.
    """
    if not rows:
        raise ArithmeticError("no rows to fit")
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        n, half, (a, b) = Decimal(sum(c for *_, c in rows)), strength / 2, start

        def at(a: Decimal, b: Decimal) -> tuple[Decimal, ...]:
            loss, ga, gb, haa, hab, hbb = half * (a * a + b * b), strength * a, strength * b, strength, Decimal(0), strength
            for x, y, c in rows:
                z = a * x + b
                small = (-abs(z)).exp()
                q = (1 if z >= 0 else small) / (1 + small)
                w = c * small / (1 + small) ** 2 / n
                loss += c * ((1 + small).ln() + max(-z if y else z, Decimal(0))) / n
                r = c * (q - y) / n
                ga, gb, haa, hab, hbb = ga + r * x, gb + r, haa + w * x * x, hab + w * x, hbb + w
            return loss, ga, gb, haa, hab, hbb

        here = at(a, b)
        for _ in range(ITERATIONS):
            loss, ga, gb, haa, hab, hbb = here
            gap = (ga * ga + gb * gb) / (2 * strength)
            if gap <= GAP:
                return a, b, gap
            det = haa * hbb - hab * hab
            da, db, size = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, Decimal(1)
            while (there := at(a - size * da, b - size * db))[0] > loss and size > Decimal("1e-18"):
                size /= 2
            a, b, here = a - size * da, b - size * db, there
        raise ArithmeticError("the objective gap was not reached")


def objective(rows: list[tuple[Decimal, int, int]], strength: Decimal, a: Decimal, b: Decimal) -> Decimal:
    """The mean loss with its penalty at (a, b)."""
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        total = sum(c * ((1 + (-abs(z := a * x + b)).exp()).ln() + max(-z if y else z, Decimal(0))) for x, y, c in rows)
        return total / sum(c for *_, c in rows) + strength / 2 * (a * a + b * b)


def reference_fit(rows: DataFrame, x: str, y: str, n: str, strength: str, start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(slope, intercept, gap) of one training set, given as distinct scores with counts.

    Solved in one worker: a study's training set, not a corpus. `start` is where
    Newton's method begins; a failure to certify fails the query.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counted = [(Decimal(a), int(b), int(c)) for a, b, c in zip(pdf["x"].tolist(), pdf["y"], pdf["n"])]
        a, b, gap = solve(counted, Decimal(strength), (Decimal(start[0]), Decimal(start[1])))
        return pd.DataFrame({"slope": [float(a)], "intercept": [float(b)], "gap": [float(gap)]})

    rows = rows.select(F.lit(1).alias("g"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(n).alias("n"))
    return rows.groupBy("g").applyInPandas(run, "slope double, intercept double, gap double")


def failure_class(reference_failed: int, disagreements: int, failed: int, within_gap: int, certified_there: int) -> str | None:
    """What kind of failure a set of uncertified fits shows; null where none of the four fits.

    C: a reference fit failed. D: fits disagree with the reference. A: at every
    rounded reference point the gap is within its bound, but none is certified.
    B: it is at none.
    """
    if reference_failed:
        return "C"
    if disagreements:
        return "D"
    if failed and within_gap == failed and not certified_there:
        return "A"
    return "B" if failed and not within_gap else None
