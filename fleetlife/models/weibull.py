"""Weibull accelerated failure time with a ridge penalty, by Newton steps.

ln T = intercept + x b + W / shape with W a Gumbel minimum, so a unit outlives t with the probability
exp(-exp(z)), z = shape (ln t - intercept - x b). Maximised is the mean log-likelihood of the rows less
penalty / 2 times the squares of b on standardised inputs; intercept and shape are free. A step sums the
likelihood, its gradient and its curvature over all rows in one pass, as one block per task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.labels import clean_rul
from fleetlife.models.blocks import block_sums, matrix, standardised
from fleetlife.models.survival import INPUTS, positive_durations
from fleetlife.session import stage


@dataclass(frozen=True)
class WeibullModel:
    """Coefficients on standardised inputs. ``gradient`` is the largest slope of the objective at the end."""

    inputs: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    intercept: float
    coefficients: tuple[float, ...]
    shape: float
    penalty: float
    steps: int
    gradient: float

    def plain(self) -> dict[str, float]:
        """Coefficients per unit of the inputs."""
        return {c: b / s for c, b, s in zip(self.inputs, self.coefficients, self.deviations)}

    def location(self) -> Column:
        total = F.lit(self.intercept)
        for c, m, s, b in zip(self.inputs, self.means, self.deviations, self.coefficients):
            total = total + (F.col(c).cast("double") - m) * (b / s)
        return total

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> WeibullModel:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def likelihood_sums(rows: DataFrame, p: int, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and curvature, summed over rows (lived, event, x0, ...) with ``lived`` = ln t.

    ``at``: intercept, the p coefficients, ln shape.
    """
    size, k = p + 2, np.exp(at[-1])

    def sums(columns: dict[str, np.ndarray]) -> np.ndarray:
        x = np.column_stack([np.ones(len(columns["lived"])), matrix(columns, p)])
        lived, died = columns["lived"], columns["event"]
        z = np.minimum(k * (lived - x @ at[:-1]), 500.0)
        e = np.exp(z)
        value = (died * (at[-1] + z - lived) - e).sum()
        slope = k * (e - died)
        gradient = np.append(x.T @ slope, (died * (1 + z) - z * e).sum())
        curve = np.empty((size, size))
        curve[:-1, :-1] = -(x.T * (k * k * e)) @ x
        curve[:-1, -1] = curve[-1, :-1] = x.T @ (slope + k * e * z)
        curve[-1, -1] = (died * z - z * e * (1 + z)).sum()
        return np.concatenate([[value], gradient, curve.reshape(-1)])

    total = block_sums(rows, 1 + size + size * size, sums)
    return float(total[0]), total[1 : 1 + size], total[1 + size :].reshape(size, size)


def fit_weibull_ridge(
    frame: DataFrame,
    inputs: Sequence[str] = tuple(INPUTS),
    penalty: float = 0.1,
    max_steps: int = 50,
    tolerance: float = 1e-8,
) -> WeibullModel:
    """Fit on (duration, event); durations below one day count as one.

    Raises ``ValueError`` without rows or without any failure, and ``ArithmeticError`` if the gradient of the
    mean objective is not below ``tolerance`` after ``max_steps``.
    """
    p = len(inputs)
    ready = positive_durations(frame).withColumn("lived", F.log("duration")).withColumn("event", F.col("event").cast("double"))
    rows, means, spread = standardised(ready, inputs, ["lived", "event"])
    rows = stage(rows)
    n, failed, lived = rows.agg(F.count(F.lit(1)), F.sum("event"), F.avg("lived")).first()
    if not n or not failed:
        raise ValueError("no failures to fit a life time to")
    held = np.full(p + 2, penalty)
    held[0] = held[-1] = 0.0
    at = np.zeros(p + 2)
    at[0] = lived

    def objective(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, gradient, curve = likelihood_sums(rows, p, point)
        return value / n - (held * point**2).sum() / 2, gradient / n - held * point, curve / n - np.diag(held)

    value, gradient, curve = objective(at)
    steps = 0
    while np.abs(gradient).max() > tolerance and steps < max_steps:
        steps += 1
        direction = _uphill(gradient, curve)
        length = 1.0
        while True:
            trial = at + length * direction
            reached = objective(trial)
            if np.isfinite(reached[0]) and reached[0] >= value - 1e-12 * abs(value):
                break
            if length < 1e-6:
                raise ArithmeticError("no step improves the fit")
            length /= 2
        at, (value, gradient, curve) = trial, reached
    if np.abs(gradient).max() > tolerance:
        raise ArithmeticError(f"gradient {np.abs(gradient).max():.2g} after {steps} steps")
    return WeibullModel(
        tuple(inputs), tuple(map(float, means)), tuple(map(float, spread)), float(at[0]), tuple(map(float, at[1:-1])),
        float(np.exp(at[-1])), penalty, steps, float(np.abs(gradient).max()),
    )


def _uphill(gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The Newton direction, where necessary with the curvature made negative definite; not over 2 in any parameter."""
    values, vectors = np.linalg.eigh(-curve)
    direction = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max())))
    return direction * min(1.0, 2.0 / max(np.abs(direction).max(), 1e-300))


def predict_weibull_ridge(model: WeibullModel, frame: DataFrame) -> DataFrame:
    """Median remaining days; the risk is its negative."""
    median = F.exp(model.location()) * float(np.log(2.0) ** (1.0 / model.shape))
    predicted = frame.withColumn("pred_time", clean_rul(median))
    return predicted.withColumn("risk", -F.col("pred_time"))
