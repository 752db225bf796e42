"""Fleet statistics as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.contracts import HORIZONS, RISK_BIN_EDGES, RISK_BIN_NAMES


def ingest_audit(panel: DataFrame) -> DataFrame:
    """Days, rows and failures per quarter; a partial count per day leaves each task."""
    quarter = F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string"))
    days = panel.groupBy("date").agg(F.count("*").alias("rows"), F.sum("failure").alias("failures"))
    return days.groupBy(quarter.alias("quarter")).agg(
        F.count("*").alias("days"),
        F.sum("rows").alias("rows"),
        F.sum("failures").cast("long").alias("failures"),
    )


def label_balance(labels: DataFrame, horizons: Sequence[int] = tuple(HORIZONS)) -> DataFrame:
    """Positive, negative and censored rows per horizon, in one pass over the labels."""
    counts: list[Column] = []
    for n in horizons:
        y = F.col(f"will_fail_within_{n}")
        counts += [
            F.count_if(y == 1).alias(f"pos_{n}"),
            F.count_if(y == 0).alias(f"neg_{n}"),
            F.count_if(y.isNull()).alias(f"cens_{n}"),
        ]
    lines = F.array(
        *[
            F.struct(
                F.lit(n).alias("horizon"),
                F.col(f"pos_{n}").alias("positives"),
                F.col(f"neg_{n}").alias("negatives"),
                F.col(f"cens_{n}").alias("censored"),
            )
            for n in horizons
        ]
    )
    known = F.col("positives") + F.col("negatives")
    return (
        labels.agg(*counts)
        .select(F.explode(lines).alias("line"))
        .select("line.*")
        .withColumn("positive_rate_pct", F.when(known > 0, F.round(100.0 * F.col("positives") / known, 5)))
        .withColumn(
            "negatives_per_positive",
            F.when(F.col("positives") > 0, F.round(F.col("negatives") / F.col("positives"), 1)),
        )
    )


def failures_by_month(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.trunc("date", "month").alias("month")).agg(
        F.sum("failure").cast("long").alias("failures"), F.count("*").alias("drive_days")
    )


def model_failure_rates(summary: DataFrame, min_drives: int = 1000, top: int | None = 15) -> DataFrame:
    """Share of failed units per model, for models with enough units; the ``top`` highest."""
    rates = (
        summary.groupBy("model")
        .agg(F.count("*").alias("drives"), F.sum("event").cast("long").alias("failures"))
        .where(F.col("drives") >= min_drives)
        .withColumn("failure_rate_pct", F.round(100.0 * F.col("failures") / F.col("drives"), 6))
    )
    if top is None:
        return rates
    return rates.orderBy(F.col("failure_rate_pct").desc(), F.col("model")).limit(top)


def fleet_kpis(summary: DataFrame) -> DataFrame:
    """Totals, failure percentages and median lifetimes.

    The median keeps one counter per distinct lifetime; lifetimes are whole days, so that is a
    few thousand counters however large the fleet is.
    """
    drives, failed, days = F.count("*"), F.sum("event").cast("long"), F.sum("n_days_observed")
    failed_life = F.when(F.col("event") == 1, F.col("lifetime_days"))
    return summary.agg(
        days.alias("total_drive_days"),
        drives.alias("unique_drives"),
        failed.alias("failed_drives"),
        F.round(100.0 * failed / drives, 3).alias("drive_level_failure_pct"),
        F.round(100.0 * failed / days, 5).alias("drive_day_failure_pct"),
        F.median("lifetime_days").cast("int").alias("median_lifetime_days_all"),
        F.median(failed_life).cast("int").alias("median_lifetime_days_failed"),
    )


def rul_histogram(labels: DataFrame, max_days: int = 180, bins: int = 60) -> DataFrame:
    """Equal-width histogram of the days to failure of failed units.

    Rows are first counted per day (at most ``max_days`` + 1 groups); the rest is tiny.
    """
    near = labels.where((F.col("event") == 1) & (F.col("rul_time_days") <= max_days))
    per_day = near.groupBy("rul_time_days").agg(F.count("*").alias("rows"))
    everything = Window.partitionBy(F.lit(0))
    lo, hi = F.min("rul_time_days").over(everything), F.max("rul_time_days").over(everything)
    ends = per_day.select("rul_time_days", "rows", lo.alias("lo"), hi.alias("hi"))
    reach = F.col("hi") - F.col("lo")
    place = F.coalesce(F.floor((F.col("rul_time_days") - F.col("lo")) * bins / F.nullif(reach, F.lit(0))), F.lit(0))
    return (
        ends.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("rows").alias("drive_days"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
        .select(
            "bin",
            "drive_days",
            F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / float(bins), 6).alias("left_edge"),
        )
    )


def class_weights(frame: DataFrame, label: str = "y") -> DataFrame:
    """Weight of a positive (negatives per positive) and the balanced weights of both classes."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    n = pos + neg
    return frame.agg(
        pos.alias("pos"),
        neg.alias("neg"),
        F.round(neg / F.greatest(pos, F.lit(1)), 6).alias("scale_pos_weight"),
        F.when(pos > 0, F.round(n / (2.0 * pos), 6)).alias("balanced_pos"),
        F.when(neg > 0, F.round(n / (2.0 * neg), 6)).alias("balanced_neg"),
    )


def feature_stats(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation (+ 1e-6) per column, one row each."""
    aggs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(c).alias("mean"),
            (F.stddev_pop(c) + F.lit(1e-6)).alias("std"),
        )
        for c in columns
    ]
    return frame.agg(F.array(*aggs).alias("stats")).select(F.inline("stats"))


def risk_bin(probability: Column) -> Column:
    """Right-closed bin of a probability; exactly 0 and values outside [0, 1] have none."""
    expr = None
    for left, right, name in zip(RISK_BIN_EDGES, RISK_BIN_EDGES[1:], RISK_BIN_NAMES):
        hit = (probability > left) & (probability <= right)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr


def risk_histogram(scores: DataFrame, probability: str = "failure_probability") -> DataFrame:
    """Rows per risk bin, plus a line for those outside all bins."""
    return scores.groupBy(
        F.coalesce(risk_bin(F.col(probability)), F.lit("outside")).alias("risk_bin")
    ).agg(F.count("*").alias("drives"))
