"""Joining rows to one row per group, when a group may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast at most, and rows that a group needs at least to be one of them.
HOT_GROUPS = 100_000
LEAST_HOT = 1_000


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int, hot_groups: int = HOT_GROUPS,
    least_hot: int = LEAST_HOT,
) -> DataFrame:
    """``rows`` with the columns of their group. ``size`` is the group's number of rows, ``total`` that of all.

    Groups of more than total / ``hot_groups`` rows are fewer than ``hot_groups``, so they can be broadcast
    whatever the data; all others are too small to burden a task and are joined by a shuffle. Keys are
    without nulls. ``rows`` and ``groups`` should be written tables, they are read twice.
    """
    limit = max(least_hot, -(-total // hot_groups))
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    large = rows.join(hot, list(keys))
    small = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(*keys)), list(keys), "left_anti")
    return large.unionByName(small.join(cold, list(keys)))
