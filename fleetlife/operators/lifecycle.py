"""Life histories and honestly censored labels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.contracts import HORIZONS, Span, quarter_name
from fleetlife.functions.labels import horizon_label, rul_time_days


def unit_lives(panel: DataFrame, as_of: date | None = None) -> DataFrame:
    """First day, last day and event per unit: all that labels need.

    The unit is failed when any of its days reports a failure; its life ends on its last day.
    ``as_of`` ignores later days, for back-tests without future knowledge.
    """
    if as_of is not None:
        panel = panel.where(F.col("date") <= F.lit(as_of))
    return panel.groupBy("serial_number").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max("failure").cast("tinyint").alias("event"),
    )


def drive_summary(panel: DataFrame, as_of: date | None = None) -> DataFrame:
    """One row per unit: life, model and capacity of the last day, days seen, lifetime.

    A first grouping by (unit, model, capacity) shrinks the panel to about a row per unit with
    hash aggregation. Taking text by the latest date needs a sorted aggregation, which then only
    sees that small result.
    """
    if as_of is not None:
        panel = panel.where(F.col("date") <= F.lit(as_of))
    spells = panel.groupBy("serial_number", "model", "capacity_bytes").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max("failure").alias("event"),
        F.count("*").alias("n_days_observed"),
    )
    return (
        spells.groupBy("serial_number")
        .agg(
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
            F.max("event").cast("tinyint").alias("event"),
            F.max_by("model", "last_date").alias("model"),
            F.max_by("capacity_bytes", "last_date").alias("capacity_bytes"),
            F.sum("n_days_observed").alias("n_days_observed"),
        )
        .withColumn("lifetime_days", F.datediff("last_date", "first_date") + 1)
    )


def with_life(panel: DataFrame, summary: DataFrame) -> DataFrame:
    """Attach first day, last day and event of the unit to each of its days.

    The summary grows with the fleet, so no broadcast is forced: Spark broadcasts it while it is
    below its size threshold and otherwise joins on the unit, which the summary is already
    partitioned by. Large units are split by the adaptive skew join.
    """
    life = summary.select("serial_number", "first_date", "last_date", "event")
    return panel.join(life, "serial_number", "left")


def labels(
    panel: DataFrame,
    horizons: Sequence[int] = tuple(HORIZONS),
    summary: DataFrame | None = None,
) -> DataFrame:
    """Daily rows with remaining life and one nullable label per horizon."""
    summary = unit_lives(panel) if summary is None else summary
    days = panel.select("date", "serial_number", "model", "capacity_bytes", "failure")
    return (
        with_life(days, summary)
        .withColumn("rul_time_days", rul_time_days())
        .select(
            "date",
            "serial_number",
            "model",
            "capacity_bytes",
            "failure",
            "event",
            "rul_time_days",
            *[horizon_label(n).alias(f"will_fail_within_{n}") for n in horizons],
        )
    )


def fleet_totals(summary: DataFrame) -> DataFrame:
    drives, failed = F.count("*"), F.sum("event").cast("long")
    return summary.agg(
        drives.alias("drives"),
        failed.alias("failed"),
        F.round(100.0 * failed / drives, 3).alias("failed_pct"),
    )


def in_span(frame: DataFrame, span: Span, column: str = "date") -> DataFrame:
    """Rows of a span of days, both ends included; reaches the Parquet scan.

    A stored panel is partitioned by quarter. Names of quarters sort like their days, so a range of
    them skips all other folders.
    """
    days = F.col(column).between(F.lit(span.first), F.lit(span.last))
    if "quarter" in frame.columns and column == "date":
        days = days & F.col("quarter").between(*(quarter_name(d) for d in (span.first, span.last)))
    return frame.where(days)


def active_units(summary: DataFrame, span: Span) -> DataFrame:
    """Units whose life overlaps the span."""
    return summary.where(
        (F.col("first_date") <= F.lit(span.last)) & (F.col("last_date") >= F.lit(span.first))
    )
