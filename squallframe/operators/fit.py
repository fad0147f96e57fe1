"""Bounded sigmoid fits where every iteration is one distributed aggregate for all groups."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hazard import sigmoid

# Start and bounds of (a, b, c, d) in y = a + b / (1 + exp(c (x - d))).
START = (6.5, 57.4, -1.9, 10.8)
LOWER = (0.0, 10.0, -20.0, 0.0)
UPPER = (20.0, 80.0, -0.01, 20.0)
MIN_SAMPLES = 1000


@dataclass(frozen=True)
class SigmoidFit:
    a: float
    b: float
    c: float
    d: float
    rmse: float
    mae: float
    r2: float
    n: int

    @property
    def params(self) -> tuple[float, float, float, float]:
        return self.a, self.b, self.c, self.d


@dataclass
class _State:
    """One group's place in its own damped descent."""

    params: np.ndarray
    jtj: np.ndarray | None = None
    jtr: np.ndarray | None = None
    sse: float = math.inf
    n: int = 0
    damping: float = 1e-3
    done: bool = False

    def trial(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if self.jtj is None:
            return self.params
        free = ~(((self.params <= low) & (self.jtr < 0)) | ((self.params >= high) & (self.jtr > 0)))
        step = np.zeros(4)
        system = self.jtj[np.ix_(free, free)]
        system = system + self.damping * np.diag(np.maximum(np.diag(system), 1e-12))
        step[free] = np.linalg.lstsq(system, self.jtr[free], rcond=None)[0]
        return np.clip(self.params + step, low, high)

    def judge(self, trial: np.ndarray, jtj: np.ndarray, jtr: np.ndarray, sse: float, n: int, tolerance: float) -> None:
        """Take the trial if it is no worse, and tell whether to go on."""
        if sse <= self.sse:
            self.done = self.jtj is not None and self.sse - sse <= tolerance * max(self.sse, 1e-300)
            self.damping = self.damping if self.jtj is None else max(self.damping / 10, 1e-12)
            self.params, self.jtj, self.jtr, self.sse, self.n = trial, jtj, jtr, sse, n
        else:
            self.damping *= 10
            self.done = self.damping > 1e12


def _normal_equations(rows: DataFrame, trials: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray, float, int]]:
    """Sums of every group's Gauss-Newton system at its own trial: one aggregate, one row of 16 sums for each group.

    The trials (one row for each group still moving) are held by the driver anyway, so they are broadcast.
    """
    table = rows.sparkSession.createDataFrame([(g, *map(float, p)) for g, p in trials.items()], "scope string, a double, b double, c double, d double")
    a, b, c, d = (F.col(k) for k in "abcd")
    shift = F.col("x") - d
    g = 1.0 / (1.0 + F.exp(c * shift))
    bend = g * (1.0 - g)
    jac = [F.lit(1.0), g, -b * shift * bend, b * c * bend]
    res = F.col("y") - (a + b * g)
    n = F.col("__n")
    terms = [F.sum(n * jac[i] * jac[j]) for i in range(4) for j in range(i, 4)]
    terms += [F.sum(n * j * res) for j in jac] + [F.sum(n * res * res), F.sum(n)]
    sums = rows.join(F.broadcast(table), "scope").groupBy("scope").agg(*[t.alias(f"t{i}") for i, t in enumerate(terms)])
    out = {}
    for row in sums.collect():
        values = [0.0 if v is None else float(v) for v in row[1:]]
        jtj = np.zeros((4, 4))
        jtj[np.triu_indices(4)] = values[:10]
        out[row[0]] = jtj + np.triu(jtj, 1).T, np.array(values[10:14]), values[14], int(values[15])
    return out


def fit_sigmoid_scopes(sample: DataFrame, by: str | None = None, x: str = "x", y: str = "y", combined: str = "combined", start=START, lower=LOWER,
                       upper=UPPER, max_iterations: int = 100, tolerance: float = 1e-12, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Fits of every group of ``by`` and of all rows: scope, a, b, c, d, n, rmse, mae, r2, gradient.

    Projected Levenberg-Marquardt for all scopes at once: each has its own damping and stops by itself, and an iteration is one aggregate
    over the rows, whatever the number of scopes. A row counts for its group and for ``combined``; equal rows of a group are counted once
    before, so an iteration reads distinct rows.
    ``gradient`` is the largest free component of the last normal equations, relative to what the residuals allow: near
    zero at a solution. A scope with fewer than ``min_samples`` rows fails the fit. The groups are years or the like:
    their parameters are the driver's.
    """
    scopes = [F.lit(combined)] if by is None else [F.col("__own"), F.lit(combined)]
    own = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    counted = (sample.select(own.alias("__own"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
               .filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
               .groupBy("__own", "x", "y").agg(F.count(F.lit(1)).alias("__n")))
    rows = (counted.select(F.explode(F.array(*scopes)).alias("scope"), "x", "y", "__n").filter("scope is not null").persist())
    try:
        low, high = np.array(lower), np.array(upper)
        means = {r[0]: r[1] for r in rows.groupBy("scope").agg(F.sum(F.col("__n") * F.col("y")) / F.sum("__n")).collect()}
        names = list(means) or [combined]
        states = {g: _State(np.clip(np.array(start, dtype=float), low, high)) for g in names}
        for _ in range(max_iterations + 1):
            trials = {g: s.trial(low, high) for g, s in states.items() if not s.done}
            if not trials:
                break
            for g, found in _normal_equations(rows, trials).items():
                states[g].judge(trials[g], *found, tolerance)
            few = {g: s.n for g, s in states.items() if s.n < min_samples}
            if few:
                raise ValueError(f"too few samples for a fit: {few}, need {min_samples}")
        facts = []
        for g, s in states.items():
            free = ~(((s.params <= low) & (s.jtr < 0)) | ((s.params >= high) & (s.jtr > 0)))
            scale = np.sqrt(np.maximum(np.diag(s.jtj), 1e-300) * max(s.sse, 1e-300))
            facts.append((g, *map(float, s.params), float(np.max(np.abs(s.jtr / scale)[free], initial=0.0)), means[g]))
        table = sample.sparkSession.createDataFrame(facts, "scope string, a double, b double, c double, d double, gradient double, __mean double")
        residual = F.col("y") - sigmoid(F.col("x"), *[F.col(c) for c in "abcd"])
        mean = lambda value: F.sum(F.col("__n") * value) / F.sum("__n")
        told = rows.join(F.broadcast(table), "scope").groupBy("scope", *"abcd", "gradient").agg(
            F.sum("__n").alias("n"), F.sqrt(mean(residual * residual)).alias("rmse"), mean(F.abs(residual)).alias("mae"),
            F.when(F.min("y") < F.max("y"), mean((F.col("y") - F.col("__mean")) * (F.col("y") - F.col("__mean")))).alias("__var"))
        told = told.withColumn("r2", F.when(F.col("__var") > 0, 1.0 - F.col("rmse") * F.col("rmse") / F.col("__var")))
        kept = told.select("scope", *"abcd", "n", "rmse", "mae", "r2", "gradient").collect()  # a row for each scope
        return sample.sparkSession.createDataFrame(kept, "scope string, a double, b double, c double, d double, n long, rmse double, mae double, r2 double, gradient double")
    finally:
        rows.unpersist()


def fit_sigmoid(sample: DataFrame, x: str = "x", y: str = "y", **options) -> SigmoidFit:
    """The fit of all rows alone."""
    row = fit_sigmoid_scopes(sample, None, x, y, **options).first()
    r2 = row["r2"] if row["r2"] is not None else float("nan")
    return SigmoidFit(*[row[c] for c in "abcd"], rmse=row["rmse"], mae=row["mae"], r2=r2, n=row["n"])


def apply_sigmoid(cells: DataFrame, x: str, params, out: str = "dn", low: float = 0.0, high: float = 63.0) -> DataFrame:
    fitted = sigmoid(F.col(x), *params)
    return cells.withColumn(out, F.when(F.col(x).isNotNull(), F.least(F.greatest(fitted, F.lit(low)), F.lit(high))))
