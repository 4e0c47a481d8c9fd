"""Fitting and applying maps from a score to a probability: logistic, isotonic, beta."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import numeric as N
from ..functions.exact import collected_means, exact_means

#: Fixed values of the solver: objective gap of the certificate, iterations, Armijo share, halvings; KKT bound of beta.
GAP, ITERATIONS, ARMIJO, HALVINGS, KKT = 1e-14, 100, 1e-4, 60, 1e-10


def objective_values(x: Column, y: Column, a: Column | float, b: Column | float) -> dict[str, Column]:
    """A row's negative log likelihood, its gradient and its Hessian at (a, b)."""
    z = x * a + b
    q = N.sigmoid(z)
    r = F.when(y == 1, -N.sigmoid(-z)).otherwise(q)  # no q - 1: it would cancel
    w = q * N.sigmoid(-z)
    return {"nll": N.softplus(F.when(y == 1, -z).otherwise(z)), "ga": r * x, "gb": r, "haa": w * x * x, "hab": w * x, "hbb": w}


def certificate(strength: float) -> float:
    """A gradient this short is within GAP of the optimum of a `strength`-convex objective."""
    return float(np.sqrt(2.0) * np.sqrt(strength) * np.sqrt(GAP))  # a product under one root would underflow


class _Newton:
    """Damped Newton of one group, fed with the objective's terms at the points it asks for."""

    def __init__(self, strength: float):
        self.bound, self.point, self.best, self.steps, self.halvings, self.done = certificate(strength), np.zeros(2), None, 0, 0, False
        self.step, self.size = np.zeros(2), 1.0

    def told(self, value: float, g: np.ndarray, h: np.ndarray) -> None:
        norm = float(np.linalg.norm(g))
        if self.best is not None:
            _, old, old_g, _, old_norm = self.best
            if old_norm <= self.bound:  # one step beyond the certificate, if it is one
                self.done = True
                if norm >= old_norm:
                    return
            elif not (value <= old - ARMIJO * self.size * float(old_g @ self.step) or norm <= self.bound):
                self.size, self.halvings = self.size / 2, self.halvings + 1
                self.point, self.done = self.best[0] - self.size * self.step, self.halvings > HALVINGS
                return
        self.best, self.steps, self.halvings, self.size = (self.point, value, g, h, norm), self.steps + 1, 0, 1.0
        self.done = self.done or self.steps > ITERATIONS
        self.step = np.linalg.solve(h, g)
        self.point = self.point - self.step


#: Groups that `fit_many` steers from the driver at once, a few numbers each.
MOST_GROUPS = 100_000


def _local(spark, rows: list[tuple], kind: StructType) -> DataFrame:
    """A small table that travels with the plan."""
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), to_arrow_schema(kind))], schema=to_arrow_schema(kind)), kind)


#: Groups whose sums by exponent are rounded on the driver; those of more are rounded in tasks.
ROUNDED_HERE = 2_000


#: Distinct rows that a task of a step has.
STEP_ROWS = 1 << 15


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """n persisted rows in as few partitions as they need: a step is many small tasks otherwise, whatever the rows."""
    return rows.coalesce(max(1, -(-n // STEP_ROWS)))


def _means(rows: DataFrame, keys: list[str], terms: dict[str, Column], groups: int) -> dict[tuple, list[float]]:
    """Exact means of rows of weight `w`, by key."""
    if groups <= ROUNDED_HERE:
        return collected_means(rows, keys, terms, F.col("w"))
    return {tuple(r[c] for c in keys): [r[c] for c in terms] for r in exact_means(rows, keys, terms, F.col("w")).collect()}


def fit_many(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, strength, slope, intercept, objective, gradient_norm, certified) of all groups at once.

    rows: (by, strength, x, y, w), w (a whole number) rows of one score and label.
    The loss is the mean negative log likelihood plus strength / 2 (a^2 + b^2).
    Every step is one aggregate of six exact sums for all groups that are not
    done, so a fit is the same at any partitioning; only these reach the driver, so a group may have any number of rows. Without
    its certificate a pair is none: both are null. No rows: no groups. More than
    MOST_GROUPS: ValueError.
    """
    spark = rows.sparkSession
    keys = [*by, "strength"]
    kept = rows.groupBy(*keys, "x", "y").agg(F.sum("w").alias("w")).persist()
    try:
        found = kept.groupBy(*keys).agg(F.count("*")).limit(MOST_GROUPS + 1).collect()
        if len(found) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        rows, found = _packed(kept, sum(r[-1] for r in found)), [r[:-1] for r in found]
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
        groups = {tuple(r): _Newton(r[-1]) for r in found}
        terms = {f"_{k}": c for k, c in objective_values(F.col("x"), F.col("y"), F.col("_a"), F.col("_b")).items()}
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        while open_ := {k: n for k, n in groups.items() if not n.done}:
            points = F.broadcast(_local(spark, [(*k, float(n.point[0]), float(n.point[1])) for k, n in open_.items()], StructType([*[StructField(f"_{c}", rows.schema[c].dataType) for c in keys], StructField("_a", DoubleType()), StructField("_b", DoubleType())])))
            for k, (nll, ga, gb, haa, hab, hbb) in _means(rows.join(points, same), keys, terms, len(open_)).items():
                (a, b), s = groups[k].point, k[-1]
                g, h = np.array([ga + s * a, gb + s * b]), np.array([[haa + s, hab], [hab, hbb + s]])
                groups[k].told(nll + s / 2 * (a * a + b * b), g, h)
    finally:
        kept.unpersist()
    out = []
    for k, n in groups.items():
        (a, b), value, _, _, norm = n.best
        sure = norm <= n.bound
        out.append((*k, float(a) if sure else None, float(b) if sure else None, float(value), norm, sure))
    return spark.createDataFrame(out, f"{kinds}, slope double, intercept double, objective double, gradient_norm double, certified boolean")


def fit_logistic(rows: DataFrame, x: Column, y: Column, strength: float) -> dict[str, float | bool]:
    """`fit_many` of one group: slope, intercept, objective, gradient_norm, certified."""
    one = rows.select(F.lit(float(strength)).alias("strength"), x.cast("double").alias("x"), y.cast("int").alias("y"), F.lit(1.0).alias("w"))
    return fit_many(one, []).first().asDict()


def solve_logistic(x: np.ndarray, y: np.ndarray, strength: float, weight: np.ndarray | None = None) -> tuple[float, float, bool]:
    """The same objective on rows of one group, in numpy; rows may stand for `weight` equal ones.

    The last value tells whether the gradient at the returned point reaches the
    certificate; a pair without it is no fit.
    """
    f = np.column_stack((x, np.ones_like(x)))
    sign = np.where(y == 1, -1.0, 1.0)
    share = np.full(len(x), 1 / len(x)) if weight is None else weight / weight.sum()

    def value(u: np.ndarray) -> float:
        return float(share @ np.logaddexp(0, sign * (f @ u)) + strength / 2 * u @ u)

    def gradient(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = sign * (f @ u)
        s = np.exp(-np.logaddexp(0, -z))
        return f.T @ (share * sign * s) + strength * u, s * np.exp(-np.logaddexp(0, z))

    v = np.zeros(2)
    g, w = gradient(v)
    for _ in range(ITERATIONS):
        if np.linalg.norm(g) <= certificate(strength):
            break
        step, size, here = np.linalg.solve((f * (share * w)[:, None]).T @ f + strength * np.eye(2), g), 1.0, value(v)
        for _ in range(HALVINGS):
            new_g, new_w = gradient(v - size * step)
            if value(v - size * step) <= here - ARMIJO * size * float(g @ step) or np.linalg.norm(new_g) <= certificate(strength):
                break
            size /= 2
        v, g, w = v - size * step, new_g, new_w
    # one step beyond the certificate, if it is one
    polished = v - np.linalg.solve((f * (share * w)[:, None]).T @ f + strength * np.eye(2), g)
    if np.linalg.norm(new_g := gradient(polished)[0]) < np.linalg.norm(g):
        v, g = polished, new_g
    return float(v[0]), float(v[1]), bool(np.linalg.norm(g) <= certificate(strength))


def solve_isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and block means: ties pooled, neighbours merged while they fall."""
    knots, at = np.unique(score, return_inverse=True)
    n, total = np.bincount(at).astype(float), np.bincount(at, label)
    blocks: list[list[float]] = []
    for w, s in zip(n, total):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] > blocks[-1][1] * blocks[-2][0]:
            w2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return knots, np.concatenate([np.full(int(k), s / w) for w, s, k in blocks])


#: Which of the two slopes are held at 0, in the order that decides exact ties.
FACES = {"A0_B0": (False, False), "A0": (False, True), "B0": (True, False), "INTERIOR": (True, True)}


def solve_beta(score: np.ndarray, label: np.ndarray, strength: float = 0.0, start: np.ndarray | None = None) -> dict[str, float | str]:
    """Slopes a, b >= 0 on (ln s, -ln(1 - s)) and an intercept: the best of four faces by damped Newton."""
    f = np.column_stack((np.log(score), -np.log1p(-score), np.ones_like(score)))
    sign = np.where(label == 1, -1.0, 1.0)
    value = lambda u: float(np.logaddexp(0, sign * (f @ u)).mean() + strength / 2 * u @ u)

    def gradient(u: np.ndarray) -> np.ndarray:
        return f.T @ (sign / (1 + np.exp(-sign * (f @ u)))) / len(score) + strength * u

    best: tuple[float, str, np.ndarray, float] | None = None
    for face, free in FACES.items():
        on = np.array([*free, True])
        v = np.zeros(3) if start is None else np.where(on, start, 0.0)
        for _ in range(ITERATIONS):
            g = gradient(v)
            if np.abs(g[on]).max() <= KKT / 10:
                break
            s = 1 / (1 + np.exp(-sign * (f @ v)))
            h = (f[:, on] * (s * (1 - s))[:, None]).T @ f[:, on] / len(score) + (strength + 1e-14) * np.eye(int(on.sum()))
            step, size = np.zeros(3), 1.0
            step[on] = np.linalg.solve(h, g[on])
            for _ in range(HALVINGS):
                if value(v - size * step) <= value(v) - ARMIJO * size * float(g @ step) + 1e-16:
                    break
                size /= 2
            v = v - size * step
        if (v[:2] < 0).any():
            continue
        g = gradient(v)
        kkt = max(np.abs(g[on]).max(), max([0.0, *(-g[:2][~on[:2]])]))
        if kkt <= KKT and (best is None or value(v) < best[0]):
            best = (value(v), face, v, float(kkt))
    if best is None:
        return {"a": float("nan"), "b": float("nan"), "c": float("nan"), "face": "FAILED", "kkt": float("nan")}
    return {"a": float(best[2][0]), "b": float(best[2][1]), "c": float(best[2][2]), "face": best[1], "kkt": best[3]}


def beta_values(s: Column, y: Column, a: Column, b: Column, c: Column) -> dict[str, Column]:
    """A row's negative log likelihood at (a, b, c), its gradient and the upper triangle of its Hessian."""
    u, v = F.log(s), -F.log1p(-s)
    z = a * u + b * v + c
    q = N.sigmoid(z)
    r = F.when(y == 1, -N.sigmoid(-z)).otherwise(q)
    w = q * N.sigmoid(-z)
    return {"f": N.softplus(F.when(y == 1, -z).otherwise(z)), "g0": r * u, "g1": r * v, "g2": r, "h00": w * u * u, "h01": w * u * v, "h02": w * u, "h11": w * v * v, "h12": w * v, "h22": w}


class _FaceNewton:
    """Damped Newton of many problems side by side, each on the coordinates that are on."""

    def __init__(self, on: np.ndarray, start: np.ndarray):
        n = len(on)
        self.on, self.point = on, np.where(on, start, 0.0)
        self.best, self.value, self.norm = self.point.copy(), np.full(n, np.inf), np.full(n, np.inf)
        self.gradient, self.step, self.size = np.zeros((n, 3)), np.zeros((n, 3)), np.ones(n)
        self.steps, self.halvings, self.done = np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool)

    def told(self, at: np.ndarray, value: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Values, gradients and Hessians of the problems `at`, at their points.

        A point is taken if the value falls enough, or, where rounding hides
        that, if the gradient is at most half as long; else the step is halved.
        """
        norm = np.abs(np.where(self.on[at], g, 0.0)).max(axis=1)
        falls = value <= self.value[at] - ARMIJO * self.size[at] * (self.gradient[at] * self.step[at]).sum(axis=1) + 1e-16
        ok = falls | (norm <= self.norm[at] / 2) | ~np.isfinite(self.value[at])
        good, bad = at[ok], at[~ok]
        self.best[good], self.value[good], self.norm[good], self.gradient[good] = self.point[good], value[ok], norm[ok], g[ok]
        both = self.on[good][:, :, None] & self.on[good][:, None, :]
        held = np.where(both, h[ok], 0.0) + np.eye(3) * np.where(self.on[good], 1e-14, 1.0)[:, None, :]
        if len(good):
            self.step[good] = np.linalg.solve(held, np.where(self.on[good], g[ok], 0.0)[:, :, None])[:, :, 0]
        self.size[good], self.halvings[good] = 1.0, 0
        self.steps[good] += 1
        self.size[bad] /= 2
        self.halvings[bad] += 1
        self.point[at] = self.best[at] - self.size[at][:, None] * self.step[at]
        self.done[at] = (self.norm[at] <= KKT / 10) | (self.steps[at] > ITERATIONS) | (self.halvings[at] > HALVINGS)


def fit_beta_many(rows: DataFrame, by: list[str], strength: float = 0.0, starts: Sequence[tuple[float, float, float]] = ((0.0, 0.0, 0.0),)) -> DataFrame:
    """(by, start, a, b, c, face, objective, kkt) of all groups, from each of the starts.

    rows: (by, s, y, w), w (a whole number) rows of one score inside (0, 1) and
    label. Slopes a, b >= 0 on (ln s, -ln(1 - s)) and an intercept: Newton on
    four faces (a or b held at 0), for all groups, faces and starts at once. A
    step is one aggregate of ten exact sums a problem, which alone reach the
    driver, so a group may have any number of rows. Of the faces whose slopes are
    feasible and whose optimality residual is at most KKT the least objective
    counts, of equal ones the first in FACES; without one, face is FAILED and the
    numbers are null. Groups are taken MOST_GROUPS problems at a time.
    """
    spark = rows.sparkSession
    kept = rows.groupBy(*by, "s", "y").agg(F.sum("w").alias("w")).persist()
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}{', ' if by else ''}start int, a double, b double, c double, face string, objective double, kkt double"
    try:
        each, rows = len(FACES) * len(starts), _packed(kept, kept.count() * len(FACES) * len(starts))
        parts = 1 + rows.select(*by).distinct().count() * each // MOST_GROUPS
        out = []
        for part in range(parts):
            own = rows.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == part) if by and parts > 1 else rows
            groups = [tuple(r) for r in own.select(*by).distinct().collect()] if by else [()] * (own.limit(1).count())
            out += _fit_faces(spark, own, by, kinds, groups, strength, starts)
    finally:
        kept.unpersist()
    return spark.createDataFrame(out, schema)


def _fit_faces(spark, rows: DataFrame, by: list[str], kinds: str, groups: list[tuple], strength: float, starts) -> list[tuple]:
    names, k, m = list(FACES), len(FACES), len(starts)
    on = np.array([(*FACES[f], True) for f in names] * (len(groups) * m)).reshape(-1, 3)
    first = np.array([p for p in starts for _ in names] * len(groups), float).reshape(-1, 3)
    newton, number = _FaceNewton(on, first), {g: i for i, g in enumerate(groups)}
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    terms = beta_values(F.col("s"), F.col("y"), F.col("_a"), F.col("_b"), F.col("_c"))
    kind = StructType([*[StructField(f"_{c}", rows.schema[c].dataType) for c in by], StructField("_p", LongType()), *[StructField(c, DoubleType()) for c in ("_a", "_b", "_c")]])
    while not newton.done.all():
        open_ = np.flatnonzero(~newton.done)
        points = [(*groups[i // (k * m)], int(i), *map(float, newton.point[i])) for i in open_]
        table = _local(spark, points, kind)
        met = rows.join(F.broadcast(table), same) if by else rows.crossJoin(F.broadcast(table))
        got = sorted(_means(met, ["_p"], terms, len(open_)).items())
        at, x = np.array([p for (p,), _ in got]), dict(zip(terms, np.array([v for _, v in got]).T))
        here = newton.point[at]
        g = np.column_stack([x["g0"], x["g1"], x["g2"]]) + strength * here
        h = np.array([[x["h00"], x["h01"], x["h02"]], [x["h01"], x["h11"], x["h12"]], [x["h02"], x["h12"], x["h22"]]]).transpose(2, 0, 1) + strength * np.eye(3)
        newton.told(at, x["f"] + strength / 2 * (here * here).sum(axis=1), g, h)
    off = np.where(newton.on[:, :2], 0.0, -newton.gradient[:, :2]).max(axis=1)
    kkt = np.maximum(newton.norm, off)
    good = (newton.best[:, :2] >= 0).all(axis=1) & (kkt <= KKT)
    out = []
    for g in groups:
        for j in range(m):
            own = [(number[g] * m + j) * k + f for f in range(k)]
            fine = [i for i in own if good[i]]
            if not fine:
                out.append((*g, j, None, None, None, "FAILED", None, None))
                continue
            i = min(fine, key=lambda i: newton.value[i])  # of equal ones the first
            out.append((*g, j, *map(float, newton.best[i]), names[i % k], float(newton.value[i]), float(kkt[i])))
    return out


def beta_eligibility(score: Column, label: Column) -> Column:
    """Whether a group can be fitted: ends, one class, few scores, separation, in this order."""
    one, zero = F.when(label == 1, score), F.when(label == 0, score)
    return (
        F.when((F.min(score) <= 0) | (F.max(score) >= 1), "endpoint")
        .when(F.min(label) == F.max(label), "single class")
        .when(F.countDistinct(score) < 3, "too few scores")
        .when((F.max(zero) < F.min(one)) | (F.max(one) < F.min(zero)), "separated")
        .otherwise("eligible")
    )


def fit_groups(rows: DataFrame, by: list[str], solve: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One fit a group, groups side by side; a group is a training set that fits a worker."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {k: pdf[k].iloc[0] for k in by} | solve(pdf)
        return pd.DataFrame([out])[names]

    return rows.groupBy(*by).applyInPandas(run, schema)


def apply_beta(s: Column, a: Column, b: Column, c: Column) -> Column:
    """sigmoid(a ln s - b ln(1 - s) + c) with its limits at the ends."""
    z = a * F.log(F.when(s > 0, s)) - b * F.log1p(F.when(s < 1, -s)) + c
    at_0 = F.when(a > 0, F.lit(0.0)).otherwise(N.sigmoid(c))
    at_1 = F.when(b > 0, F.lit(1.0)).otherwise(N.sigmoid(c))
    return F.when(s <= 0, at_0).when(s >= 1, at_1).otherwise(N.sigmoid(z))


def apply_isotonic(rows: DataFrame, score: str, knots: list[tuple[float, float]]) -> DataFrame:
    """Clamped at the ends, exact at knots, straight between. `knots` is one fit's sorted list."""
    xs, ys = F.lit([float(k) for k, _ in knots]), F.lit([float(v) for _, v in knots])
    k = F.size(F.filter(xs, lambda x: x <= F.col(score)))
    lo, hi = F.get(xs, k - 1), F.get(xs, k)
    a, b = F.get(ys, k - 1), F.get(ys, k)
    return rows.withColumn("fitted", F.when(k == 0, F.get(ys, F.lit(0))).when((k == len(knots)) | (lo == F.col(score)), a).otherwise(a + (b - a) * (F.col(score) - lo) / (hi - lo)))
