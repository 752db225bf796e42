"""Gapless numbers within groups of any size, without one task for a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean rows of one group that a task sorts together.
ROWS_PER_CELL = 20_000


def numbered(rows: DataFrame, groups: Sequence[str], position: Column, ties: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their number ``name`` from 0 in the order of ``position`` within their group.

    ``position`` is a long, evenly spread over 0 to 2**52 (a hash). Its leading bits cut each group
    into cells; a task sorts one cell, and the sizes of the earlier cells are added. How many cells
    there are follows from the number of rows, and doesn't change the numbers.
    """
    total = rows.count()
    bits = min(max((total // ROWS_PER_CELL).bit_length(), 4), 30)
    placed = rows.withColumn("_at", position).withColumn("_cell", F.shiftright("_at", 52 - bits))
    keys = [*groups, "_cell"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    # Group keys can be null: null-safe comparison keeps their rows.
    offsets = offsets.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    inside = Window.partitionBy(*keys).orderBy("_at", *ties)
    ordered = placed.withColumn("_inside", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = ordered.join(offsets, same)
    return joined.withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        "_at", "_cell", "_inside", "_offset", *[f"_k{i}" for i in range(len(keys))]
    )
