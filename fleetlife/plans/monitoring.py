"""Monitor the fleet, decide, and retrain when needed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from fleetlife.contracts import Settings
from fleetlife.models.publish import Artifacts, publish, score_rows
from fleetlife.operators.drift import drift_report, drift_summary, retrain_decision
from fleetlife.operators.lifecycle import unit_lives
from fleetlife.operators.rankmetrics import average_precision, rank_curve
from fleetlife.plans.datasets import training_frame
from fleetlife.session import stage


@dataclass
class LoopResult:
    report: DataFrame
    decision: Row
    artifacts: Artifacts | None


def monitor(
    panel: DataFrame,
    settings: Settings,
    pr_auc_current: float | None = None,
    pr_auc_reference: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Drift report of the test span against the train span, and the decision row."""
    report = stage(drift_report(panel, settings.splits["train"], settings.splits["test"]))
    decision = retrain_decision(
        drift_summary(report),
        pr_auc_current,
        pr_auc_reference,
        settings.drift_share,
        settings.pr_auc_drop,
    )
    return report, decision


def current_quality(panel: DataFrame, settings: Settings, artifacts: Artifacts) -> float | None:
    """Average precision of published models on the labelled days of the test span."""
    rows = training_frame(panel, unit_lives(panel), settings.splits["test"], settings.horizon)
    scored = score_rows(rows.where(F.col("y").isNotNull()), artifacts)
    curve = rank_curve(scored, score="raw_score")
    return curve.agg(average_precision().alias("ap")).first().ap


def mlops_loop(
    panel: DataFrame,
    settings: Settings,
    current: Artifacts | None = None,
    pr_auc_current: float | None = None,
    pr_auc_reference: float | None = None,
    retrain_if_needed: bool = True,
    train: Callable[..., Artifacts] = publish,
    **train_options: Any,
) -> LoopResult:
    """Monitor, decide, and train new artifacts when the decision says so.

    With ``current`` artifacts, their quality on the test span is compared with the quality
    noted when they were published; otherwise the two numbers may be given.
    """
    if current is not None:
        pr_auc_current = current_quality(panel, settings, current)
        pr_auc_reference = current.metadata["val_pr_auc"]
    report, decision = monitor(panel, settings, pr_auc_current, pr_auc_reference)
    row = decision.first()
    artifacts = None
    if row.retrain and retrain_if_needed:
        artifacts = train(panel, unit_lives(panel), settings, **train_options)
    return LoopResult(report, row, artifacts)
