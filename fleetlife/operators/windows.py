"""Per-unit windows: forward fill, calendar rolling statistics, slope, latest day.

All windows of one job share one shuffle and one sort by (unit, day). A unit has one row per day
(see ``sources.panel.one_row_per_day``), and jobs read a split plus its look-back only, so a
window group holds at most the number of days in that span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetlife.contracts import SMART_BIG5, WINDOWS, Span
from fleetlife.operators.lifecycle import in_span


#: Day number all windows order by. One shared column keeps them on one sort.
DAY_NUMBER = "_day"


def with_day_number(frame: DataFrame) -> DataFrame:
    if DAY_NUMBER in frame.columns:
        return frame
    return frame.withColumn(DAY_NUMBER, F.unix_date("date"))


def _by_unit() -> WindowSpec:
    return Window.partitionBy("serial_number").orderBy(DAY_NUMBER)


def calendar_window(width: int) -> WindowSpec:
    """The last ``width`` calendar days including the current one."""
    return _by_unit().rangeBetween(-(width - 1), 0)


def forward_fill(frame: DataFrame, columns: Sequence[str] = tuple(SMART_BIG5)) -> DataFrame:
    """Carry the last known value of a unit forward; leading gaps become 0."""
    so_far = _by_unit().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(so_far).cast("double"), F.lit(0.0))
        for c in columns
    }
    return with_day_number(frame).withColumns(filled)


def with_rolling(
    frame: DataFrame,
    columns: Sequence[str] = tuple(SMART_BIG5),
    windows: Sequence[int] = tuple(WINDOWS),
) -> DataFrame:
    """Calendar mean and sample deviation per width, and the distance to the widest mean."""
    spec = {w: calendar_window(w) for w in windows}
    widest = max(windows)
    means = {f"{c}_rmean_{w}": F.avg(c).over(spec[w]) for c in columns for w in windows}
    stds = {f"{c}_rstd_{w}": F.stddev_samp(c).over(spec[w]) for c in columns for w in windows}
    frame = with_day_number(frame).withColumns({**means, **stds})
    return frame.withColumns(
        {f"{c}_dev{widest}": F.col(c) - F.col(f"{c}_rmean_{widest}") for c in columns}
    )


def with_slope(
    frame: DataFrame,
    columns: Sequence[str] = tuple(SMART_BIG5),
    windows: Sequence[int] = tuple(WINDOWS),
) -> DataFrame:
    """Least-squares slope per day in the same calendar windows; null for a single day."""
    return with_day_number(frame).withColumns(
        {
            f"{c}_rslope_{w}": F.regr_slope(F.col(c), F.col(DAY_NUMBER)).over(calendar_window(w))
            for c in columns
            for w in windows
        }
    )


def latest_snapshot(frame: DataFrame) -> DataFrame:
    """The newest row of each unit.

    Spark applies the limit of one row per unit before the shuffle as well as after it, so only
    about one row per unit and task moves.
    """
    newest = Window.partitionBy("serial_number").orderBy(F.col("date").desc())
    return frame.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def newest_rolling(
    frame: DataFrame,
    columns: Sequence[str] = tuple(SMART_BIG5),
    windows: Sequence[int] = tuple(WINDOWS),
) -> DataFrame:
    """What ``with_rolling`` has on the newest day of each unit, by one aggregation per unit.

    ``frame`` is filled forward. Its sort by unit serves the aggregation too; only the days within a window of
    the unit's last one count, so no window is computed for any other day.
    """
    whole = _by_unit().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = with_day_number(frame).withColumn("_last", F.max(DAY_NUMBER).over(whole))
    others = [c for c in days.columns if c not in ("serial_number", "_last", *columns)]
    ago = F.col("_last") - F.col(DAY_NUMBER)
    near = {(c, w): F.when(ago < w, F.col(c)) for c in columns for w in windows}
    newest = days.groupBy("serial_number").agg(
        F.max_by(F.struct(*others, *columns), DAY_NUMBER).alias("_row"),
        *[F.avg(x).alias(f"{c}_rmean_{w}") for (c, w), x in near.items()],
        *[F.stddev_samp(x).alias(f"{c}_rstd_{w}") for (c, w), x in near.items()],
    )
    widest = max(windows)
    shown = [F.col("_row")[c].alias(c) for c in [*others, *columns]]
    rolled = [c for c in newest.columns if c not in ("serial_number", "_row")]
    return newest.select("serial_number", *shown, *rolled).withColumns(
        {f"{c}_dev{widest}": F.col(c) - F.col(f"{c}_rmean_{widest}") for c in columns}
    )


def rolling_span(
    panel: DataFrame,
    span: Span,
    columns: Sequence[str] = tuple(SMART_BIG5),
    windows: Sequence[int] = tuple(WINDOWS),
    latest_only: bool = False,
) -> DataFrame:
    """Rolling features for the days of a span, or for the newest of those days per unit.

    Reads the span plus the widest window before it. The fill starts at that edge too. The
    optimizer does not move a day filter below a window, so both filters are written out.
    """
    wide = in_span(panel, span.with_lookback(max(windows)))
    picked = wide.select("serial_number", "date", "model", "capacity_bytes", *columns)
    rolled = newest_rolling if latest_only else with_rolling
    features = rolled(forward_fill(picked, columns), columns, windows)
    return in_span(features, span).drop(DAY_NUMBER)
