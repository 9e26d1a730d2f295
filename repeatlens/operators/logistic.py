"""ML-3, ML-7: logistic regression by Newton steps (iteratively reweighted
least squares).

Each step is one pass over the rows: a task adds up the loss, the gradient
and the weighted Gram matrix of its standardised rows, partial sums meet in
groups and the driver solves one system of the features' number.  That number
is the vocabulary of the dummies, not the data; ``max_features`` guards it.
The objective is strictly convex, so the optimum is one point and the
gradient there says how close the fit is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums meet in so many groups before they reach the driver.
GROUPS = 16


@dataclass(frozen=True)
class LogisticFit:
    """Coefficients of the standardised features, and what shows the optimum."""

    intercept: float
    coefficients: np.ndarray
    gradient: np.ndarray    # of the mean loss with penalty; intercept last
    loss: float
    iterations: int
    mean: np.ndarray
    std: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return scaled(x, self.mean, self.std) @ self.coefficients + self.intercept


def scaled(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised rows; a constant feature is 0."""
    return np.where(std > 0, (x - mean) / np.where(std > 0, std, 1.0), 0.0)


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of rows of float64 bytes, first within ``GROUPS`` groups."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        seen = False
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py())
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    grouped = parts.repartition(GROUPS).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(bytes(r.sums)) for r in grouped.collect()), np.zeros(size))


def _pass(rows: DataFrame, width: int, work) -> np.ndarray:
    """Adds up ``work(x, y, w)`` -- an array -- over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            got = work(x, batch.column("y").to_numpy(zero_copy_only=False),
                       batch.column("w").to_numpy(zero_copy_only=False))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    size = len(work(np.zeros((0, width)), np.zeros(0), np.zeros(0)))
    return _summed(rows.mapInArrow(run, "sums binary"), size)


def fit_logistic(df: DataFrame, features: str, label: str, weight: str, reg: float,
                 tol: float = 1e-10, max_iter: int = 50, max_features: int = 2000) -> LogisticFit:
    """Minimises sum(w * log loss) / sum(w) + reg / 2 * |coefficients|^2 over
    standardised features; the intercept is free.

    ``df`` is read once for the scaling and once per step: pass a stored
    frame.  Null labels or weights are refused; a table without rows or
    without both classes has no optimum and raises.
    """
    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"),
                     F.col(weight).cast("double").alias("w"))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to fit")
    p = len(first.x)
    if p > max_features:
        raise ValueError(f"{p} features: the Gram matrix would hold {p * p} numbers")

    def scaling(x, y, w):
        if np.isnan(y).any() or np.isnan(w).any():
            raise ValueError("null label or weight")
        return np.concatenate([[len(x), w.sum(), (w * y).sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    s = _pass(rows, p, scaling)
    n, total, positive = s[:3]
    if not 0 < positive < total:
        raise ValueError("both classes are needed")
    mean = s[3:3 + p] / n
    std = np.sqrt(np.maximum(s[3 + p:] - n * mean * mean, 0) / max(n - 1, 1))
    beta = np.zeros(p + 1)
    beta[-1] = np.log(positive / (total - positive))
    penalty = np.append(np.full(p, reg), 0.0)

    def step_sums(b):
        def work(x, y, w):
            z = np.column_stack([scaled(x, mean, std), np.ones(len(x))])
            m = z @ b
            prob = 0.5 * (1 + np.tanh(m / 2))
            loss = (w * (np.logaddexp(0, m) - y * m)).sum()
            gram = (z * (w * prob * (1 - prob))[:, None]).T @ z
            return np.concatenate([[loss], z.T @ (w * (prob - y)), gram.ravel()])

        got = _pass(rows, p, work) / total
        return (got[0] + (penalty * b * b).sum() / 2, got[1:p + 2] + penalty * b,
                got[p + 2:].reshape(p + 1, p + 1) + np.diag(penalty))

    loss, gradient, gram = step_sums(beta)
    for i in range(max_iter):
        if np.abs(gradient).max() <= tol:
            break
        # constant features have no curvature beyond the penalty
        direction = np.linalg.lstsq(gram, gradient, rcond=None)[0]
        size = 1.0
        while True:  # halve a step that overshoots
            new = step_sums(beta - size * direction)
            if new[0] <= loss + 1e-15 * abs(loss) or size < 1e-6:
                break
            size /= 2
        beta = beta - size * direction
        loss, gradient, gram = new
    else:
        i = max_iter
    return LogisticFit(float(beta[-1]), beta[:-1], gradient, float(loss), i, mean, std)


def score_logistic(df: DataFrame, fit: LogisticFit, features: str, out: str = "score") -> DataFrame:
    """``df`` with the probability of class 1."""
    slope = np.where(fit.std > 0, fit.coefficients / np.where(fit.std > 0, fit.std, 1.0), 0.0)
    base = fit.intercept - float(slope @ fit.mean)
    x = vector_to_array(F.col(features))
    dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in slope]), lambda a, b: a * b),
                      F.lit(base), lambda acc, v: acc + v)
    return df.withColumn(out, 1 / (1 + F.exp(-dot)))
