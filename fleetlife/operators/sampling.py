"""Deterministic sampling by key hash: independent of partitioning, order and retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.contracts import Span
from fleetlife.functions.hashing import HASH_RANGE, hash_slot
from fleetlife.operators.lifecycle import active_units
from fleetlife.session import stage

UNIT_DAY = ("serial_number", "date")

#: Hash slots are counted by their leading bits first, then by these inside the one range reached: a
#: group has at most 65,536 counts each time, however many rows it has.
LOW_BITS = 16


def class_counts(frame: DataFrame, label: str = "y") -> DataFrame:
    """One row: positives and negatives."""
    return frame.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def undersample(
    frame: DataFrame,
    ratio: float,
    label: str = "y",
    keys: Sequence[str] = UNIT_DAY,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Keep every positive and a hashed share of the negatives, about ``ratio`` per positive.

    Nothing is dropped unless there are more negatives than that. ``counts`` may come from a
    cheaper frame with the same labels; by default it is a scalar subquery on ``frame``, in which
    column pruning removes everything but the label.
    """
    counts = class_counts(frame, label) if counts is None else counts
    too_many = F.col("neg") > ratio * F.col("pos")
    share = F.when(too_many, ratio * F.col("pos") / F.col("neg")).otherwise(1.0)
    return _keep_share(frame, counts.select(share).scalar(), label, keys)


def cap_negatives(
    frame: DataFrame,
    cap: int,
    label: str = "y",
    keys: Sequence[str] = ("model", "date"),
) -> DataFrame:
    """Keep every positive and a hashed share of the negatives, about ``cap`` of them.

    The default keys keep or drop whole model-days together.
    """
    share = F.least(F.lit(1.0), F.lit(float(cap)) / F.greatest(F.col("neg"), F.lit(1)))
    return _keep_share(frame, class_counts(frame, label).select(share).scalar(), label, keys)


def _keep_share(frame: DataFrame, share: Column, label: str, keys: Sequence[str]) -> DataFrame:
    drawn = (F.col(label) == 0) & (hash_slot(*keys) / F.lit(float(HASH_RANGE)) < share)
    return frame.where((F.col(label) == 1) | drawn)


def _reached(counts: DataFrame, limits: DataFrame, within: list[str], place: str) -> DataFrame:
    """Per group the place in which its first ``n`` rows end, and as ``n`` how many of them are there."""
    order = Window.partitionBy(*within).orderBy(place)
    before = F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        counts.withColumn("_before", before)
        .join(F.broadcast(limits.select(*within, "n")), within)
        .where((F.col("_before") < F.col("n")) & (F.col("_before") + F.col("_rows") >= F.col("n")))
        .select(*within, place, (F.col("n") - F.col("_before")).alias("n"))
    )


def smallest_hashes(
    frame: DataFrame,
    limits: DataFrame,
    keys: Sequence[str],
    within: Sequence[str],
) -> DataFrame:
    """Exactly ``n`` rows per ``within`` group (a column of ``limits``), lowest hash first.

    A row is its keys; ties of the hash are broken by them. Instead of ranking whole groups, rows
    are counted per range of hash slots, then per slot of the range in which the limit is reached,
    and only the rows of the one slot in which it is reached are ranked.
    """
    within = list(within)
    # One row per group, given by the caller: always broadcast, so that no join moves the rows of
    # a large group to one task.
    limits = limits.select(*within, "n")
    hashed = frame.withColumn("_slot", hash_slot(*keys))
    # Both counts read the slots alone; the rows themselves are read once more, for the choice.
    slots = stage(hashed.select(*within, "_slot"))
    per_range = slots.groupBy(*within, F.shiftright("_slot", LOW_BITS).alias("_range")).agg(F.count("*").alias("_rows"))
    # One row per group, read by two branches of the plan.
    ranges = stage(_reached(per_range, limits, within, "_range"))
    in_range = slots.join(F.broadcast(ranges.withColumnRenamed("_range", "_reached")), within)
    in_range = in_range.where(F.shiftright("_slot", LOW_BITS) == F.col("_reached"))
    per_slot = in_range.groupBy(*within, "_slot").agg(F.count("*").alias("_rows"))
    cut = _reached(per_slot, ranges, within, "_slot").select(
        *within, F.col("_slot").alias("_cut"), F.col("n").alias("_room")
    )
    has_limit = limits.where("n > 0").select(*within)
    near = (
        hashed.join(F.broadcast(has_limit), within)
        .join(F.broadcast(cut), within, "left")
        # A group that never reaches its limit has no cut and is kept whole.
        .where(F.col("_cut").isNull() | (F.col("_slot") <= F.col("_cut")))
    )
    # What is left is about the sample itself; a slot is a tiny part of its group.
    at_cut = Window.partitionBy(*within, "_slot").orderBy(*keys)
    return (
        near.withColumn("_place", F.row_number().over(at_cut))
        .where(
            F.col("_cut").isNull()
            | (F.col("_slot") < F.col("_cut"))
            | (F.col("_place") <= F.col("_room"))
        )
        .drop("_slot", "_cut", "_room", "_place")
    )


def sample_n(frame: DataFrame, n: int, keys: Sequence[str] = UNIT_DAY) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by hash."""
    one = frame.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n).alias("n"))
    return smallest_hashes(frame.withColumn("_all", F.lit(0)), one, keys, ["_all"]).drop("_all")


def unit_sample(
    summary: DataFrame,
    span: Span,
    healthy: int | None,
    failed: int | None = None,
) -> DataFrame:
    """Active units: all failed ones (or ``failed`` of them) and ``healthy`` of the others."""
    active = active_units(summary, span)
    if failed is None and healthy is None:
        return active
    no_limit = (1 << 62)
    limits = active.sparkSession.createDataFrame(
        [(1, no_limit if failed is None else failed), (0, no_limit if healthy is None else healthy)],
        "event tinyint, n bigint",
    )
    return smallest_hashes(active, limits, ["serial_number"], ["event"])


def prune_to_units(panel: DataFrame, units: DataFrame) -> DataFrame:
    """Days of the given units only; done before any window."""
    return panel.join(units.select("serial_number"), "serial_number", "left_semi")


def balanced_cap(anchors: DataFrame, cap: int, keys: Sequence[str] = UNIT_DAY) -> DataFrame:
    """At most ``cap`` rows: up to half censored, events fill, censored rows use what is left."""
    counts = anchors.agg(
        F.count_if(F.col("event") == 1).alias("ev"), F.count_if(F.col("event") == 0).alias("ce")
    )
    half = F.least(F.col("ce"), F.lit(cap // 2))
    events = F.least(F.col("ev"), F.lit(cap) - half)
    censored = F.least(F.col("ce"), F.lit(cap) - events)
    limits = counts.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).cast("tinyint").alias("event"), events.cast("long").alias("n")),
                F.struct(F.lit(0).cast("tinyint").alias("event"), censored.cast("long").alias("n")),
            )
        ).alias("limit")
    ).select("limit.event", "limit.n")
    return smallest_hashes(anchors, limits, keys, ["event"])
