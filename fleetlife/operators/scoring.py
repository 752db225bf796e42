"""Scoring helpers: request features, scorecards, reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.contracts import SMART_BIG5, WINDOWS
from fleetlife.functions.arrays import last_filled, mean_and_spread, sample_std
from fleetlife.functions.labels import alert_level, capacity_gb, coherence


def request_features(
    requests: DataFrame,
    columns: Sequence[str] = tuple(SMART_BIG5),
    windows: Sequence[int] = tuple(WINDOWS),
) -> DataFrame:
    """Rolling features from a nested history of readings (oldest first), one request per row.

    Windows are the last readings, not calendar days. Missing readings take the value before, or
    0 at the start; an empty history gives zeros.
    """
    widest = max(windows)
    filled = requests.withColumns(
        {f"_{c}": last_filled(F.col("history").getField(c), widest) for c in columns}
    )

    def last_values(c: str, w: int) -> Column:
        values = F.col(f"_{c}")
        return F.slice(values, F.greatest(F.size(values) - w + 1, F.lit(1)), w)

    measured = filled.withColumns(
        {f"_{c}_{w}": mean_and_spread(last_values(c, w)) for c in columns for w in windows}
    )
    now = {c: F.coalesce(F.get(f"_{c}", F.size(f"_{c}") - 1), F.lit(0.0)) for c in columns}
    stats = {(c, w): F.col(f"_{c}_{w}") for c in columns for w in windows}
    features = {
        "capacity_gb": capacity_gb(),
        **now,
        **{f"{c}_rmean_{w}": stats[c, w]["mean"] for c in columns for w in windows},
        **{f"{c}_rstd_{w}": sample_std(stats[c, w]) for c in columns for w in windows},
        **{f"{c}_dev{widest}": now[c] - stats[c, widest]["mean"] for c in columns},
    }
    helpers = [*(f"_{c}" for c in columns), *(f"_{c}_{w}" for c in columns for w in windows)]
    return measured.withColumns(features).drop(*helpers)


def with_alerts(
    scored: DataFrame, critical: float | Column | None, warning: float | Column | None
) -> DataFrame:
    """Add alert_level and the agreement of both models to rows with raw_score and rul_days."""
    thresholds = [x if isinstance(x, Column) else F.lit(x).cast("double") for x in (critical, warning)]
    alert = alert_level(F.col("raw_score"), F.col("rul_days"), *thresholds)
    return scored.withColumn("alert_level", alert).select(
        "*", *coherence(F.col("alert_level"), F.col("rul_days"))
    )


def top_reasons(
    frame: DataFrame,
    effects: Mapping[str, tuple[float, float]],
    top: int = 5,
    category: tuple[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Add ``top_reasons``: the largest contributions coefficient * (value - mean) of a linear score.

    ``category`` names a text column and the contribution of each of its values (0 for others); its
    reason has no number as value.
    """
    shares = [
        F.struct(
            (-F.abs(F.lit(coefficient) * (F.col(name) - F.lit(mean)))).alias("order"),
            F.lit(name).alias("feature"),
            F.round(F.lit(coefficient) * (F.col(name) - F.lit(mean)), 4).alias("contribution"),
            F.round(F.col(name).cast("double"), 3).alias("value"),
        )
        for name, (coefficient, mean) in effects.items()
    ]
    if category is not None:
        column, by_value = category
        pairs = [F.lit(x) for item in by_value.items() for x in item]
        own = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(0.0)) if pairs else F.lit(0.0)
        shares.append(
            F.struct(
                (-F.abs(own)).alias("order"),
                F.lit(column).alias("feature"),
                F.round(own, 4).alias("contribution"),
                F.lit(None).cast("double").alias("value"),
            )
        )
    ordered = F.slice(F.array_sort(F.array(*shares)), 1, top)
    return frame.withColumn(
        "top_reasons",
        F.transform(
            ordered,
            lambda r: F.struct(
                r["feature"].alias("feature"),
                r["contribution"].alias("contribution"),
                r["value"].alias("value"),
            ),
        ),
    )


def alert_counts(scorecard: DataFrame) -> DataFrame:
    return scorecard.groupBy("alert_level").agg(F.count("*").alias("drives"))


def top_risk(scorecard: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` units with the highest probability; the id decides ties."""
    return scorecard.orderBy(F.col("failure_probability").desc(), F.col("serial_number")).limit(n)
