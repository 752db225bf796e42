"""Remaining life from windows of readings, trained on the censoring-aware loss itself.

The loss is that of ``survmetrics.censored_rul_loss``: smooth absolute error on failed rows plus the mean
shortfall on censored rows, whose life is only known to be longer. A linear model over all steps of a window
minimises it by L-BFGS. A step needs the loss and its slopes, summed over Arrow blocks of rows by the tasks;
the driver holds a few vectors of as many numbers as a window has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.labels import clean_rul
from fleetlife.models.blocks import block_sums
from fleetlife.operators.sequences import reading_stats
from fleetlife.session import stage

#: Lives beyond this many days are all the same to the training.
RUL_CEILING = 200.0


@dataclass(frozen=True)
class SequenceModel:
    """Weights per step and reading, on readings standardised by ``means`` and ``deviations``."""

    means: np.ndarray
    deviations: np.ndarray
    weights: np.ndarray  # steps x readings
    intercept: float
    loss: float
    steps: int


def flat_windows(frame: DataFrame, event: str = "event", duration: str = "dur", ceiling: float = RUL_CEILING) -> DataFrame:
    """(x, event, dur): the window as one array of doubles, the life cut at the ceiling."""
    values: Column = F.transform(F.flatten("window"), lambda v: v.cast("double"))
    return frame.select(
        values.alias("x"), F.col(event).cast("int").alias("event"),
        F.least(F.col(duration).cast("double"), F.lit(ceiling)).alias("dur"),
    )


def loss_sums(rows: DataFrame, weights: np.ndarray, intercept: float, means: np.ndarray, deviations: np.ndarray) -> np.ndarray:
    """Summed loss and slopes of failed rows, then of censored ones: for each [loss, intercept, weights...].

    ``means`` and ``deviations`` are as long as a window; at its kinks a slope is one of its sides.
    """
    size = len(weights)

    def sums(columns: dict[str, np.ndarray]) -> np.ndarray:
        x = (np.stack(columns["x"]) - means) / deviations
        over = x @ weights + intercept - columns["dur"]
        failed = columns["event"] == 1
        gap = np.abs(over)
        loss = np.where(failed, np.where(gap < 1, 0.5 * gap * gap, gap - 0.5), np.maximum(-over, 0.0))
        slope = np.where(failed, np.clip(over, -1.0, 1.0), np.where(over < 0, -1.0, 0.0))
        return np.concatenate([
            np.concatenate([[loss[own].sum(), slope[own].sum()], x[own].T @ slope[own]]) for own in (failed, ~failed)
        ])

    return block_sums(rows, 2 * (size + 2), sums)


def fit_sequence_rul(
    frame: DataFrame, penalty: float = 1e-4, max_steps: int = 60, memory: int = 8, tolerance: float = 1e-5,
    ceiling: float = RUL_CEILING,
) -> SequenceModel:
    """Fit on (window, event, dur) rows of ``sequences.sequence_dataset``.

    ``penalty`` / 2 times the squared weights is added to the loss. Stops when a step gains less than
    ``tolerance`` of the loss. Raises ``ValueError`` without rows.
    """
    stats = reading_stats(frame).collect()  # one row per reading
    rows = stage(flat_windows(frame, ceiling=ceiling))
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no windows to learn from")
    length = first.n // len(stats)
    means, deviations = np.array([r["mean"] for r in stats]), np.array([r["std"] for r in stats])
    tiled = np.tile(means, length), np.tile(deviations, length)
    counts = rows.agg(F.count_if(F.col("event") == 1), F.count_if(F.col("event") != 1), F.median("dur")).first()
    shares = [1.0 / max(c, 1) for c in counts[:2]]
    size = length * len(stats)

    def objective(at: np.ndarray) -> tuple[float, np.ndarray]:
        total = loss_sums(rows, at[1:], float(at[0]), *tiled).reshape(2, -1)
        mean = shares[0] * total[0] + shares[1] * total[1]
        held = penalty * np.concatenate([[0.0], at[1:]])
        return float(mean[0] + held @ at / 2), mean[1:] + held

    at = np.zeros(size + 1)
    at[0] = counts[2]
    value, slope = objective(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    steps = 0
    while steps < max_steps:
        steps += 1
        direction = -_curved(slope, past)
        if direction @ slope >= 0:
            past, direction = [], -slope
        length_, moved = (1.0 if past else min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-12))), None
        while length_ > 1e-10:
            trial = at + length_ * direction
            reached, steeper = objective(trial)
            if reached <= value + 1e-4 * length_ * (direction @ slope):
                moved = trial - at, steeper - slope
                break
            length_ /= 2
        if moved is None:
            if not past:
                break
            past = []  # a kink: start again downhill
            continue
        gained = value - reached
        at, value, slope = trial, reached, steeper
        if moved[0] @ moved[1] > 1e-12:
            past = [*past, moved][-memory:]
        if gained < tolerance * abs(value):
            break
    return SequenceModel(means, deviations, at[1:].reshape(length, len(stats)), float(at[0]), value, steps)


def _curved(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse curvature that the last steps show."""
    out, used = slope.copy(), []
    for s, y in reversed(past):
        share = (s @ out) / (s @ y)
        out -= share * y
        used.append(share)
    if past:
        s, y = past[-1]
        out *= (s @ y) / (y @ y)
    for (s, y), share in zip(past, reversed(used)):
        out += s * (share - (y @ out) / (s @ y))
    return out


def predict_sequence_rul(model: SequenceModel, frame: DataFrame) -> DataFrame:
    """Add ``pred_time`` in days and ``risk``, its negative; the window is dropped."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predicted(values: pd.Series) -> pd.Series:
        m = shared.value
        if not len(values):
            return pd.Series([], dtype=float)
        x = np.stack(values.to_list()).reshape(len(values), *m.weights.shape)
        return pd.Series((((x - m.means) / m.deviations) * m.weights).sum((1, 2)) + m.intercept)

    flat = F.transform(F.flatten("window"), lambda v: v.cast("double"))
    scored = frame.withColumn("pred_time", clean_rul(predicted(flat))).drop("window")
    return scored.withColumn("risk", -F.col("pred_time"))
