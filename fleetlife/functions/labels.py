"""Column expressions for labels, ages, remaining life and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlife.contracts import RUL_CAP, SHORT_RUL_DAYS, WATCH_RUL_DAYS


def capacity_gb() -> Column:
    return F.col("capacity_bytes") / F.lit(1e9)


def drive_age_days() -> Column:
    """Days since the first observed day (not the true age)."""
    return F.datediff("date", "first_date")


def rul_time_days() -> Column:
    """Days to the last observed day."""
    return F.datediff("last_date", "date")


def horizon_label(horizon: int, event: str = "event", rul: str = "rul_time_days") -> Column:
    """1 = fails within the horizon, 0 = known to live that long, null = unknown (censored)."""
    fails = (F.col(event) == 1) & (F.col(rul) <= horizon)
    return F.when(fails, 1).when(F.col(rul) >= horizon, 0).cast("tinyint")


def clean_rul(prediction: Column, cap: float = RUL_CAP) -> Column:
    """Predicted remaining days in [1, cap]; NaN, null and +inf count as the cap."""
    never = prediction.isNull() | F.isnan(prediction)
    return F.greatest(F.lit(1.0), F.least(F.lit(cap), F.when(never, F.lit(cap)).otherwise(prediction)))


def alert_level(score: Column, rul: Column, critical: Column, warning: Column) -> Column:
    """Alert from the raw score and the false-alarm thresholds; a null threshold is skipped."""
    return (
        F.when(score >= critical, "critical")
        .when(score >= warning, "warning")
        .when(rul < WATCH_RUL_DAYS, "watch")
        .otherwise("ok")
    )


def coherence(alert: Column, rul: Column) -> list[Column]:
    """Do the failure score and the remaining-life estimate tell the same story?"""
    alarmed = alert.isin("critical", "warning")
    short_life = rul < SHORT_RUL_DAYS
    agree = alarmed == short_life
    note = F.when(~agree & alarmed, "high failure score but long expected life").when(
        ~agree, "short expected life but low failure score"
    )
    return [
        agree.alias("models_agree"),
        F.when(agree, "high").otherwise("low").alias("confidence"),
        note.alias("note"),
    ]
