"""Daily panels derived from the test tables (see FIXTURES.md). All rows of the tables are used."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlife.contracts import Settings, Span

#: Splits, horizons and ratios that fit the 30 days of the events table.
EVENT_SETTINGS = Settings(
    splits={
        "train": Span(date(2024, 1, 1), date(2024, 1, 14)),
        "val": Span(date(2024, 1, 15), date(2024, 1, 21)),
        "test": Span(date(2024, 1, 22), date(2024, 1, 30)),
    },
    horizon=7,
    horizons=(3, 7, 15),
    negatives_per_positive=5.0,
    survival_ratios={"train": 3.0, "val": 2.0, "test": 2.0},
    min_drives=20,
)

#: Errors on one day that end the life of a unit.
FATAL_ERRORS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value_of(kind: str):
    return F.when(F.col("event_type") == kind, F.col("value"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit = one life of a user: a day with three or more errors ends it, the next day starts
    a new one. One row per unit and day."""
    errors = F.count_if(F.col("event_type") == "error")
    clicks = F.count_if(F.col("event_type") == "click")
    days = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("date"))
        .agg(
            F.round(F.sum(_value_of("error")), 4).alias("smart_5_raw"),
            F.nullif(clicks, F.lit(0)).cast("double").alias("smart_187_raw"),
            F.round(F.sum(_value_of("view")), 4).alias("smart_188_raw"),
            F.max(_value_of("purchase")).alias("smart_197_raw"),
            F.round(F.sum(_value_of("signup")), 4).alias("smart_198_raw"),
            F.when(errors >= FATAL_ERRORS, 1).otherwise(0).cast("tinyint").alias("failure"),
        )
    )
    earlier = Window.partitionBy("user_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    life = F.coalesce(F.sum("failure").over(earlier), F.lit(0))
    kind = F.col("user_id") % 5
    return days.withColumn("life", life).select(
        F.concat(F.lit("U"), F.col("user_id"), F.lit("-"), F.col("life")).alias("serial_number"),
        "date",
        F.concat(F.lit("M"), kind, F.lit("-"), F.col("life")).alias("model"),
        ((4 + 2 * kind) * 1_000_000_000_000).cast("bigint").alias("capacity_bytes"),
        "failure",
        "smart_5_raw",
        "smart_187_raw",
        "smart_188_raw",
        "smart_197_raw",
        "smart_198_raw",
    )


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit = part, with gaps of months between its days and a history of years."""
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.sum("l_quantity").alias("smart_5_raw"),
            F.sum(returned).alias("smart_187_raw"),
            F.round(F.sum("l_extendedprice"), 2).alias("smart_188_raw"),
            F.max("l_discount").alias("smart_197_raw"),
            F.max("l_tax").alias("smart_198_raw"),
        )
    )
    # At most one row per part and shipping day, so a part has a few thousand rows at most.
    following = F.lead("date").over(Window.partitionBy("l_partkey").orderBy("date"))
    fails = following.isNull() & F.col("smart_187_raw").isNotNull()
    marked = days.withColumn("failure", F.when(fails, 1).otherwise(0).cast("tinyint"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("model"),
        (F.col("p_size").cast("bigint") * 1_000_000_000).alias("capacity_bytes"),
    )
    return marked.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("serial_number"),
        "date",
        "model",
        "capacity_bytes",
        "failure",
        "smart_5_raw",
        "smart_187_raw",
        "smart_188_raw",
        "smart_197_raw",
        "smart_198_raw",
    )


def formula_scores(labels: DataFrame, horizon: int = 7) -> DataFrame:
    """Scores computed from a row hash, so that metrics can be checked without a model.

    Columns: serial_number, date, model, y, event, time (days, at least 1), score in [0, 1],
    score_tied (one decimal), pred_time (days), risk.
    """
    from fleetlife.functions.hashing import hash_slot

    h = F.col("_h")
    return (
        labels.withColumn("_h", hash_slot("serial_number", "date") % 1_000_000)
        .withColumn("score", F.round((h / 1_000_000.0 + F.col("event") * 0.5) / 1.5, 6))
        .withColumn("pred_time", (h % 40 + 1).cast("double"))
        .select(
            "serial_number",
            "date",
            "model",
            F.col(f"will_fail_within_{horizon}").alias("y"),
            "event",
            F.greatest(F.col("rul_time_days"), F.lit(1)).alias("time"),
            "score",
            F.round("score", 1).alias("score_tied"),
            "pred_time",
            (-F.col("pred_time")).alias("risk"),
        )
    )
