"""Censoring-aware metrics: concordance, remaining-life errors, risk sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.operators.prefix import CELLS_PER_BUCKET, running_totals

_EXACT = "decimal(38,0)"


def concordance(
    frame: DataFrame,
    time: str = "time",
    event: str = "event",
    risk: str = "risk",
    cells_per_bucket: int = CELLS_PER_BUCKET,
) -> DataFrame:
    """Concordance index for right-censored times in whole days, without forming pairs.

    A failed row is comparable with rows that live longer, and with rows censored on its last
    day. With rank = 2 * time + (1 if censored), that means: comparable if the other rank is
    greater. Two ranks differ first at exactly one binary digit, where the smaller has 0 and the
    larger 1, while the leading digits agree. So each row is listed once per digit under its
    leading digits, and each pair meets in exactly one such group. Inside a group the pairs are
    counted by a running total over the risk. Rows grow by the number of digits (about 15 for
    decades of days) instead of squaring.
    """
    censored = F.when(F.col(event).cast("int") == 1, 0).otherwise(1)
    cells = frame.groupBy(
        (F.col(time).cast("long") * 2 + censored).alias("rank"),
        F.col(risk).cast("double").alias("risk"),
    ).agg(F.count("*").alias("rows"))
    digits = frame.agg(F.length(F.bin(F.max(F.col(time).cast("long")) * 2 + 1))).scalar()
    digit = F.explode(F.sequence(F.lit(0), F.greatest(digits - 1, F.lit(0)))).alias("digit")
    spread = cells.select("rank", "risk", "rows", digit).select(
        "digit",
        F.expr("shiftright(rank, digit + 1)").alias("lead"),
        "risk",
        "rows",
        (F.expr("shiftright(rank, digit) & 1") == 1).alias("longer"),
        (F.col("rank") % 2 == 0).alias("failed"),
    )
    sides = (
        spread.where(F.col("longer") | F.col("failed"))
        .groupBy("digit", "lead", "risk")
        .agg(
            F.sum(F.when(F.col("longer"), F.col("rows")).otherwise(0)).alias("later"),
            F.sum(F.when(~F.col("longer"), F.col("rows")).otherwise(0)).alias("ended"),
        )
    )
    totals = running_totals(
        sides, "risk", ["later", "ended"], ["digit", "lead"], cells_per_bucket=cells_per_bucket
    )
    ended = F.col("ended").cast("decimal(19,0)")

    def pairs(column: str):
        return F.coalesce(
            F.sum((ended * F.col(column).cast("decimal(19,0)")).cast(_EXACT)), F.lit(0).cast(_EXACT)
        )

    counted = totals.agg(
        pairs("later_before").alias("concordant"),
        pairs("later").alias("tied"),
        pairs("later_total").alias("comparable"),
    )
    good = F.col("concordant").cast("double") + F.col("tied").cast("double") / 2
    whole = F.col("comparable").cast("double")
    return counted.select(
        F.when(F.col("comparable") > 0, good / whole).alias("c_index"),
        "concordant",
        "tied",
        "comparable",
    )


def rul_error(
    frame: DataFrame, time: str = "time", event: str = "event", predicted: str = "pred_time"
) -> DataFrame:
    """Mean absolute error and median true life of failed rows.

    True lives are whole days, so the exact median keeps at most one counter per day.
    """
    failed = F.col(event).cast("int") == 1
    return frame.agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("events"),
        F.avg(F.when(failed, F.abs(F.col(predicted) - F.col(time)))).alias("rul_mae_days"),
        F.median(F.when(failed, F.col(time))).alias("rul_median_true_days"),
    )


def survival_bundle(
    frame: DataFrame,
    time: str = "time",
    event: str = "event",
    risk: str = "risk",
    predicted: str = "pred_time",
) -> DataFrame:
    """Concordance and remaining-life errors in one row."""
    errors = rul_error(frame, time, event, predicted)
    index = concordance(frame, time, event, risk)
    return errors.withColumn("c_index", index.select("c_index").scalar())


def censored_rul_loss(
    frame: DataFrame, time: str = "time", event: str = "event", predicted: str = "pred_time"
) -> DataFrame:
    """Smooth absolute error on failed rows plus the mean shortfall on censored rows."""
    failed = F.col(event).cast("int") == 1
    gap = F.abs(F.col(predicted) - F.col(time))
    smooth = F.when(gap < 1, 0.5 * gap * gap).otherwise(gap - 0.5)
    short = F.greatest(F.col(time) - F.col(predicted), F.lit(0.0))
    observed = F.coalesce(F.avg(F.when(failed, smooth)), F.lit(0.0))
    under = F.coalesce(F.avg(F.when(~failed, short)), F.lit(0.0))
    return frame.agg(
        observed.alias("observed_loss"), under.alias("censored_loss"), (observed + under).alias("loss")
    )


def risk_sets(
    frame: DataFrame, weight: str, time: str = "time", event: str = "event"
) -> DataFrame:
    """Per duration: deaths and the summed weight of all rows that live at least that long.

    Durations are whole days, so the window runs over one row per day, not over the data.
    """
    per_day = frame.groupBy(F.col(time).cast("int").alias("duration")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(event).cast("int") == 1).alias("deaths"),
        F.sum(weight).alias("weight"),
    )
    longest_first = Window.orderBy(F.col("duration").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return per_day.select(
        "duration",
        "deaths",
        F.sum("n").over(longest_first).alias("at_risk"),
        F.sum("weight").over(longest_first).alias("risk_weight"),
    )
