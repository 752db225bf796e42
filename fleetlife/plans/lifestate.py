"""Life histories kept up to date by days, without reading what a new day can't change.

The state has one row per unit: first and last day, event, days seen, and model and capacity of the last day.
These are mergeable, so the state after some new days is the old one merged with the new days' own. A label
of a stored day depends on how far its unit's end is beyond it: only days within the longest horizon before
the former end can change, so only the quarters that hold such days, and the new ones, are written again.
Remaining life and event change with every new day; they are joined from the state when labels are read.

A batch of days is applied under a name of its own. The state is written first, as a version that carries the
name, then the labels; applied again after a failure, a batch finds its version and only writes the labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.contracts import HORIZONS
from fleetlife.functions.labels import horizon_label, rul_time_days
from fleetlife.operators.lifecycle import with_life
from fleetlife.session import stage
from fleetlife.sources.panel import in_quarters, one_row_per_day, path_exists, with_quarter

UNIT_DAY = ["serial_number", "date"]
DAY_COLUMNS = ["date", "serial_number", "model", "capacity_bytes", "failure"]

#: Versions of the state that are kept: the newest, and the one before, which a repeated batch needs.
KEPT_VERSIONS = 2


def unit_state(days: DataFrame) -> DataFrame:
    """The state of units seen on ``days``, which has each unit-day once."""
    last = F.max_by(F.struct("model", "capacity_bytes"), F.col("date"))
    return days.groupBy("serial_number").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max("failure").cast("tinyint").alias("event"),
        F.count(F.lit(1)).alias("n_days_observed"),
        last.alias("shown"),
    )


def merge_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """The state of the days of both, which have no unit-day in common."""
    return one.unionByName(other).groupBy("serial_number").agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.max("event").alias("event"),
        F.sum("n_days_observed").alias("n_days_observed"),
        F.max_by("shown", "last_date").alias("shown"),
    )


def summary_of(state: DataFrame) -> DataFrame:
    """The columns of ``lifecycle.drive_summary``."""
    return state.select(
        "serial_number", "first_date", "last_date", "event", "shown.model", "shown.capacity_bytes", "n_days_observed",
        (F.datediff("last_date", "first_date") + 1).alias("lifetime_days"),
    )


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the stored versions, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/life_state")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    done = [n for n in names if path_exists(spark, f"{root}/life_state/{n}/_SUCCESS")]
    return sorted(done)


def _read(spark: SparkSession, root: str, version: str | None) -> DataFrame | None:
    return spark.read.parquet(f"{root}/life_state/{version}") if version else None


def _drop_old(spark: SparkSession, root: str) -> None:
    for name in _versions(spark, root)[:-KEPT_VERSIONS]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/life_state/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def touched_quarters(days: DataFrame, before: DataFrame | None, after: DataFrame, longest: int) -> list[str]:
    """Quarters of the new days, and those with days within ``longest`` of the former end of a changed unit.

    ``days`` are the new ones, ``before`` and ``after`` the states. Names of quarters, few whatever the data.
    """
    names = with_quarter(days.select("date")).select("quarter")
    if before is not None:
        units = days.select("serial_number").distinct()
        old = before.join(units, "serial_number", "left_semi").select("serial_number", F.col("last_date").alias("was"), F.col("event").alias("had"))
        moved = old.join(after.select("serial_number", "last_date", "event"), "serial_number").where(
            (F.col("was") != F.col("last_date")) | (F.col("had") != F.col("event"))
        )
        # Reached back from the former end; a failure that is reported late changes days at the end that stays.
        months = F.sequence(F.trunc(F.date_sub("was", longest), "month"), F.trunc("was", "month"), F.expr("interval 1 month"))
        names = names.union(with_quarter(moved.select(F.explode(months).alias("date"))).select("quarter"))
    return sorted(r[0] for r in names.distinct().collect())


def apply_days(spark: SparkSession, root: str, days: DataFrame, batch: str, horizons: Sequence[int] = tuple(HORIZONS)) -> list[str]:
    """Bring the life history below ``root`` up to date with ``days``; returns the quarters written.

    Days may come in any order. A unit-day that is stored already replaces its row, is not counted again, and
    can only add an event. ``batch`` names the days; the same name again means the same days.
    """
    delta = stage(one_row_per_day(days.select(*DAY_COLUMNS)))
    versions = _versions(spark, root)
    stored_path = f"{root}/label_days"
    stored = spark.read.parquet(stored_path) if path_exists(spark, stored_path) else None
    own = [n for n in versions if n.split("-", 1)[1] == batch]
    if own:
        version = own[-1]
        at = versions.index(version)
        before = _read(spark, root, versions[at - 1] if at else None)
    else:
        before = _read(spark, root, versions[-1] if versions else None)
        fresh, seen = delta, None
        if stored is not None:
            named = sorted(r[0] for r in with_quarter(delta.select("date")).select("quarter").distinct().collect())
            known = in_quarters(stored, named).select(*UNIT_DAY)
            fresh, seen = delta.join(known, UNIT_DAY, "left_anti"), delta.join(known, UNIT_DAY, "left_semi")
        merged = unit_state(fresh)
        if seen is not None:
            # Days that come again: their event counts, their number doesn't.
            again = unit_state(seen).withColumn("n_days_observed", F.lit(0).cast("long"))
            merged = merge_states(merged, again)
        merged = merged if before is None else merge_states(before, merged)
        number = int(versions[-1].split("-", 1)[0]) + 1 if versions else 0
        version = f"{number:08d}-{batch}"
        merged.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/life_state/{version}")
    after = _read(spark, root, version)
    quarters = touched_quarters(delta, before, after, max(horizons, default=0))
    rows = with_quarter(delta)
    if stored is not None:
        kept = in_quarters(stored, quarters).select(*DAY_COLUMNS, "quarter").join(delta.select(*UNIT_DAY), UNIT_DAY, "left_anti")
        rows = rows.unionByName(kept)
    labelled = with_life(rows, after).withColumn("rul_time_days", rul_time_days()).select(
        *DAY_COLUMNS, *[horizon_label(n).alias(f"will_fail_within_{n}") for n in horizons], "quarter"
    )
    # Staged, because the same folders are written.
    (
        stage(labelled)
        .repartition("quarter", "serial_number")
        .sortWithinPartitions("quarter", "serial_number", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("quarter")
        .parquet(stored_path)
    )
    _drop_old(spark, root)
    return quarters


def read_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row per unit, as ``lifecycle.drive_summary`` has it for all days applied."""
    return summary_of(spark.read.parquet(f"{root}/life_state/{_versions(spark, root)[-1]}"))


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """Daily rows with event, remaining life and labels, as ``lifecycle.labels`` has them for all days applied."""
    days = spark.read.parquet(f"{root}/label_days")
    named = [c for c in days.columns if c.startswith("will_fail_within_")]
    joined = with_life(days, read_summary(spark, root)).withColumn("rul_time_days", rul_time_days())
    return joined.select(*DAY_COLUMNS, "event", "rul_time_days", *named, "quarter")
