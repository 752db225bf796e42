"""Running totals over an ordered set of cells, and what follows from them (quantiles, codes).

A window without partition keys sorts everything in one task. Here the ordered domain is cut into
buckets first; a task only sees one bucket of one group, and the totals of earlier buckets are
added as an offset. The cut points are a sample of the cells chosen by a hash of their value, so
they are the same each time any part of the plan is computed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.session import stage

#: Mean number of cells in a bucket.
CELLS_PER_BUCKET = 25_000

#: Cells drawn per bucket; every eighth of them, in order, becomes a cut point. Cutting at each
#: drawn cell would make some buckets many times larger than others.
DRAWN_PER_BUCKET = 8

#: With more drawn cells than this, a tenth is drawn, and so on: the list stays small however
#: many cells there are.
MAX_DRAWN = 40_000

_HASH_SPAN = 10**12


def _is_drawn(order_by: str, cells_per_draw: int) -> Column:
    slot = F.pmod(F.xxhash64(order_by), F.lit(_HASH_SPAN))
    return slot < max(_HASH_SPAN // cells_per_draw, 1)


def _choose_rate(cells: DataFrame, order_by: str, cells_per_bucket: int, groups: int) -> tuple[int, int]:
    """Cells per drawn cell, and how many that draws."""
    finest = max(cells_per_bucket // DRAWN_PER_BUCKET, 1)
    rates = [finest * 10**i for i in range(6)]
    counts = cells.agg(*[F.count_if(_is_drawn(order_by, r)) for r in rates]).first()
    limit = MAX_DRAWN * groups
    return next(((r, n) for r, n in zip(rates, counts) if n <= limit), (rates[-1], counts[-1]))


def _with_bucket(placed: DataFrame, order_by: str, cut_points: int) -> DataFrame:
    """Number of entries of the sorted array ``_edges`` that are <= the value.

    A binary search, one projection per step, which stays in generated code. Reading past the
    end of the array gives null, which moves nothing.
    """
    placed = placed.withColumn("_bucket", F.lit(0))
    for power in reversed(range(cut_points.bit_length())):
        step = 1 << power
        probe = F.get("_edges", F.col("_bucket") + (step - 1))
        move = F.when(probe <= F.col(order_by), step).otherwise(0)
        placed = placed.withColumn("_bucket", F.col("_bucket") + move)
    return placed.drop("_edges")


def running_totals(
    cells: DataFrame,
    order_by: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
    cells_per_bucket: int = CELLS_PER_BUCKET,
    group_count: int = 1,
) -> DataFrame:
    """Add ``{s}_before``, ``{s}_upto`` and ``{s}_total`` for every summed column.

    ``cells`` has at most one row per (groups, order_by) and no nulls in those columns.
    ``before`` excludes the row itself, ``total`` is the sum over the whole group. The cells are
    written to the checkpoint folder once, because several branches of the plan read them.
    ``group_count`` is about how many groups of similar size there are.
    """
    keys = list(groups)
    if not keys:
        keys, cells = ["_all"], cells.withColumn("_all", F.lit(0))
    cells = stage(cells.select(*keys, order_by, *sums))
    rate, drawn = _choose_rate(cells, order_by, cells_per_bucket, group_count)
    order = F.col(order_by).desc() if descending else F.col(order_by).asc()
    first, current = Window.unboundedPreceding, Window.currentRow
    whole = Window.partitionBy(*keys)

    if drawn < DRAWN_PER_BUCKET:
        # Few cells: every group fits a task.
        placed = cells
        inside = whole.orderBy(order).rowsBetween(first, current)
        upto = {s: F.sum(s).over(inside) for s in sums}
        total = {s: F.sum(s).over(whole) for s in sums}
    else:
        # At most MAX_DRAWN values per group of ``group_count``: small enough to broadcast.
        ordered = F.sort_array(F.collect_list(order_by))
        last = F.lit(DRAWN_PER_BUCKET - 1)
        cuts = F.filter(ordered, lambda _, i: i % DRAWN_PER_BUCKET == last).alias("_edges")
        edge_lists = cells.where(_is_drawn(order_by, rate)).groupBy(*keys).agg(cuts)
        edged = cells.join(F.broadcast(edge_lists), keys, "left")
        placed = _with_bucket(edged, order_by, drawn // DRAWN_PER_BUCKET)
        # One row per bucket from here.
        per_bucket = placed.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
        bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
        earlier = whole.orderBy(bucket_order).rowsBetween(first, -1)
        offsets = per_bucket.select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums],
            *[F.sum(s).over(whole).alias(f"_{s}_whole") for s in sums],
        )
        placed = placed.join(offsets, [*keys, "_bucket"])
        inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(first, current)
        upto = {s: F.col(f"_{s}_offset") + F.sum(s).over(inside) for s in sums}
        total = {s: F.col(f"_{s}_whole") for s in sums}

    return placed.select(
        *groups,
        order_by,
        *sums,
        *[(upto[s] - F.col(s)).alias(f"{s}_before") for s in sums],
        *[upto[s].alias(f"{s}_upto") for s in sums],
        *[total[s].alias(f"{s}_total") for s in sums],
    )


def quantile_columns(value: str, count: str, probabilities: Sequence[float]) -> list[Column]:
    """Exact, linearly interpolated quantiles as aggregates over ``running_totals`` rows."""
    upto, total = F.col(f"{count}_upto"), F.col(f"{count}_total")
    present = F.col(count) > 0
    columns = []
    for p in probabilities:
        place = F.lit(p) * (total - 1)
        low = F.min(F.when(present & (upto > F.floor(place)), F.col(value)))
        high = F.min(F.when(present & (upto > F.ceil(place)), F.col(value)))
        weight = F.max(place - F.floor(place))
        columns.append(low + (high - low) * weight)
    return columns
