"""Dataset jobs: from the daily panel to model tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fleetlife.contracts import BASE_FEATURES, SMART_BIG5, Settings, Span, feature_columns
from fleetlife.functions.labels import capacity_gb, drive_age_days, horizon_label, rul_time_days
from fleetlife.operators.lifecycle import drive_summary, in_span, labels, with_life
from fleetlife.operators.sampling import class_counts, prune_to_units, undersample, unit_sample
from fleetlife.operators.windows import rolling_span


def smart_columns(feature_set: str, columns: Sequence[str]) -> list[str]:
    """``big5`` or ``full`` (every column that ends in _raw)."""
    if feature_set == "big5":
        return list(SMART_BIG5)
    if feature_set == "full":
        return [c for c in columns if c.endswith("_raw")]
    raise ValueError(f"unknown feature set: {feature_set}")


def with_targets(days: DataFrame, summary: DataFrame, horizon: int) -> DataFrame:
    """Add capacity_gb, drive_age_days, rul_time_days, event and the label y."""
    return (
        with_life(days, summary)
        .withColumns(
            {
                "capacity_gb": capacity_gb(),
                "drive_age_days": drive_age_days(),
                "rul_time_days": rul_time_days(),
            }
        )
        .withColumn("y", horizon_label(horizon))
    )


def label_counts(panel: DataFrame, summary: DataFrame, span: Span, horizon: int) -> DataFrame:
    """Positives and negatives of a split without computing any feature."""
    days = in_span(panel, span).select("serial_number", "date", "capacity_bytes")
    return class_counts(with_targets(days, summary, horizon))


def point_in_time_split(
    panel: DataFrame,
    summary: DataFrame,
    span: Span,
    horizon: int,
    feature_set: str = "big5",
    ratio: float | None = None,
) -> DataFrame:
    """Readings of the day as features; rows with unknown outcome are dropped, nulls are kept."""
    smart = smart_columns(feature_set, panel.columns)
    days = in_span(panel, span).select("serial_number", "date", "model", "capacity_bytes", *smart)
    rows = with_targets(days, summary, horizon).dropna(subset=["y"])
    kept = rows.select("serial_number", "date", *BASE_FEATURES, *smart, "y")
    if ratio is None:
        return kept
    return undersample(kept, ratio, counts=label_counts(panel, summary, span, horizon))


def rolling_split(
    panel: DataFrame, summary: DataFrame, span: Span, horizon: int, ratio: float | None = None
) -> DataFrame:
    """The 43 rolling features with the label.

    The class counts for sampling come from the labels alone, so windows are computed once.
    """
    rows = with_targets(rolling_span(panel, span), summary, horizon).dropna(subset=["y"])
    kept = rows.select("serial_number", "date", *feature_columns(), "y")
    if ratio is None:
        return kept
    return undersample(kept, ratio, counts=label_counts(panel, summary, span, horizon))


def survival_split(
    panel: DataFrame, summary: DataFrame, span: Span, ratio: float | None = None
) -> DataFrame:
    """The rolling features with (event, duration); censored rows are kept or sampled."""
    rows = with_targets(rolling_span(panel, span), summary, horizon=0)
    kept = rows.where(F.col("rul_time_days") >= 0).select(
        "serial_number",
        "date",
        *feature_columns(),
        F.col("event").cast("tinyint").alias("event"),
        F.col("rul_time_days").alias("duration"),
    )
    if ratio is None:
        return kept
    lives = with_life(in_span(panel, span).select("serial_number", "date"), summary)
    counts = class_counts(lives.where(rul_time_days() >= 0), "event")
    return undersample(kept, ratio, label="event", counts=counts)


def training_frame(
    panel: DataFrame,
    summary: DataFrame,
    span: Span,
    horizon: int,
    healthy: int | None = None,
    latest_only: bool = False,
) -> DataFrame:
    """Features, label and survival targets of all failed and ``healthy`` other units.

    Without a number of healthy units the whole fleet is used. Units are pruned before the
    windows. Rows with unknown label are kept.
    """
    if healthy is not None:
        panel = prune_to_units(panel, unit_sample(summary, span, healthy))
    rows = with_targets(rolling_span(panel, span, latest_only=latest_only), summary, horizon)
    return rows.select(
        "serial_number", "date", *feature_columns(), "y", "event", F.col("rul_time_days").alias("duration")
    )


def narrowed(frame: DataFrame) -> DataFrame:
    """Readings and rolling features as 4-byte floats, for writing."""
    keep = {"capacity_gb"}
    return frame.select(
        *[
            F.col(f.name).cast("float").alias(f.name)
            if isinstance(f.dataType, DoubleType) and f.name not in keep
            else F.col(f.name)
            for f in frame.schema
        ]
    )


def assert_all_known(panel: DataFrame, summary: DataFrame) -> None:
    """Stop when a unit of the panel has no life history: its rows would lose their label."""
    missing = panel.select("serial_number").join(summary, "serial_number", "left_anti")
    if not missing.isEmpty():
        raise ValueError("the panel has units without a life history")


def write_table(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = frame.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def life_history_job(panel: DataFrame, out: str, settings: Settings) -> DataFrame:
    """Write drive_summary and labels; return the written labels."""
    spark = panel.sparkSession
    write_table(drive_summary(panel), f"{out}/drive_summary")
    summary = spark.read.parquet(f"{out}/drive_summary")
    write_table(labels(panel, settings.horizons, summary), f"{out}/labels")
    return spark.read.parquet(f"{out}/labels")


def dataset_job(
    panel: DataFrame, summary: DataFrame, out: str, settings: Settings, kind: str = "rolling"
) -> dict[str, DataFrame]:
    """Write train, val and test of one dataset kind: big5, full, rolling or survival.

    Only train is undersampled, except for survival tables, where each split has its ratio.
    """
    assert_all_known(panel, summary)
    spark = panel.sparkSession
    written = {}
    for name, span in settings.splits.items():
        ratio = settings.negatives_per_positive if name == "train" else None
        if kind == "survival":
            table = survival_split(panel, summary, span, settings.survival_ratios[name])
        elif kind == "rolling":
            table = rolling_split(panel, summary, span, settings.horizon, ratio)
        else:
            table = point_in_time_split(panel, summary, span, settings.horizon, kind, ratio)
        path = f"{out}/{kind}/{name}"
        write_table(narrowed(table), path)
        written[name] = spark.read.parquet(path)
    return written
