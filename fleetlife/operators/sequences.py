"""Fixed-length windows of raw readings with survival targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.contracts import SEQUENCE_LENGTH, SMART_BIG5, Span
from fleetlife.functions.hashing import hash_slot
from fleetlife.operators.eda import feature_stats
from fleetlife.operators.lifecycle import in_span
from fleetlife.operators.sampling import balanced_cap, prune_to_units, unit_sample
from fleetlife.operators.windows import DAY_NUMBER, forward_fill, with_day_number


def with_row_windows(
    frame: DataFrame, length: int = SEQUENCE_LENGTH, columns: Sequence[str] = tuple(SMART_BIG5)
) -> DataFrame:
    """Add ``window``: the last ``length`` rows of the unit as arrays, zeros in front if fewer.

    The columns must be free of nulls. A unit has one row per day.
    """
    frame = with_day_number(frame)
    recent = Window.partitionBy("serial_number").orderBy(DAY_NUMBER).rowsBetween(-(length - 1), 0)
    reading = F.array(*[F.col(c).cast("float") for c in columns])
    rows = F.collect_list(reading).over(recent)
    zeros = F.array(*[F.lit(0.0).cast("float") for _ in columns])
    return frame.withColumn("_rows", rows).withColumn(
        "window", F.concat(F.array_repeat(zeros, F.lit(length) - F.size("_rows")), F.col("_rows"))
    ).drop("_rows")


def with_anchor_place(
    frame: DataFrame, span: Span, per_event: int = 30, per_censored: int = 4
) -> DataFrame:
    """Add ``is_anchor``: the newest days of failed units, hash-chosen days of the others."""
    inside = F.col("date").between(F.lit(span.first), F.lit(span.last))
    failed = F.col("event") == 1
    order = F.when(failed, -F.col(DAY_NUMBER).cast("long")).otherwise(hash_slot("serial_number", "date"))
    place = F.row_number().over(
        Window.partitionBy("serial_number").orderBy(inside.desc(), order, F.col(DAY_NUMBER))
    )
    limit = F.when(failed, per_event).otherwise(per_censored)
    return (
        with_day_number(frame)
        .withColumn("_place", place)
        .withColumn("is_anchor", inside & (F.col("_place") <= limit))
        .drop("_place")
    )


def sequence_dataset(
    panel: DataFrame,
    summary: DataFrame,
    span: Span,
    length: int = SEQUENCE_LENGTH,
    event_units: int | None = None,
    censored_units: int | None = None,
    max_anchors: int | None = None,
    per_event: int = 30,
    per_censored: int = 4,
) -> DataFrame:
    """Anchors with their window: serial_number, date, window, event, dur.

    Units are chosen first, then their days are read (the span and ``length`` days before it).
    All units and anchors are used; limits are an explicit choice of the caller.
    """
    units = unit_sample(summary, span, censored_units, event_units)
    days = in_span(panel, span.with_lookback(length)).select("serial_number", "date", *SMART_BIG5)
    life = units.select("serial_number", "last_date", "event")
    known = with_day_number(prune_to_units(days, life).join(life, "serial_number"))
    placed = with_anchor_place(known, span, per_event, per_censored)
    windows = with_row_windows(forward_fill(placed), length).where("is_anchor")
    remaining = F.greatest(F.datediff("last_date", "date"), F.lit(1)).cast("float")
    anchors = windows.select("serial_number", "date", "window", "event", remaining.alias("dur"))
    return anchors if max_anchors is None else balanced_cap(anchors, max_anchors)


def reading_stats(table: DataFrame, columns: Sequence[str] = tuple(SMART_BIG5)) -> DataFrame:
    """Mean and population deviation (+ 1e-6) of each reading over all rows and steps."""
    steps = table.select(F.explode("window").alias("reading"))
    values = [F.get("reading", i).cast("double").alias(c) for i, c in enumerate(columns)]
    return feature_stats(steps.select(*values), columns)
