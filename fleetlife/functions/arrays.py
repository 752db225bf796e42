"""Small array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_not_above(sorted_values: Column, value: Column, longest: int) -> Column:
    """How many of at most ``longest`` entries of an array are <= value; stays in generated code."""
    hits = [F.when(F.get(sorted_values, i) <= value, 1).otherwise(0) for i in range(longest)]
    total = F.lit(0)
    for hit in hits:
        total = total + hit
    return total


def mean_and_spread(values: Column) -> Column:
    """Struct(n, mean, m2) of an array of doubles in one pass; m2 = summed squared deviations."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        mean = acc["mean"] + (x - acc["mean"]) / n
        m2 = acc["m2"] + (x - acc["mean"]) * (x - mean)
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    return F.aggregate(values, start, add)


def sample_std(stats: Column) -> Column:
    """Standard deviation with n - 1 from ``mean_and_spread``; 0 for fewer than two entries."""
    return F.when(stats["n"] > 1, F.sqrt(stats["m2"] / (stats["n"] - 1))).otherwise(F.lit(0.0))


def last_filled(values: Column, keep: int) -> Column:
    """The last ``keep`` entries, nulls replaced by the last value before them, or by 0.

    Only the kept tail is rebuilt entry by entry, so a long array costs one pass.
    """
    size = F.size(values)
    head = F.filter(F.slice(values, 1, F.greatest(size - keep, F.lit(0))), lambda x: x.isNotNull())
    before = F.coalesce(F.get(head, F.size(head) - 1).cast("double"), F.lit(0.0))
    tail = F.slice(values, F.greatest(size - keep + 1, F.lit(1)), keep)

    def extend(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.coalesce(x.cast("double"), F.get(done, F.size(done) - 1))))

    filled = F.aggregate(tail, F.array(before), extend)
    return F.slice(filled, 2, keep)
