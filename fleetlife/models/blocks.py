"""Sums over all rows of a fixed number of cells, as one block per task: what a Newton step needs of the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task turns into one block at a time: with p inputs it holds a few arrays of so many rows.
BLOCK_ROWS = 65_536


def standardised(frame: DataFrame, inputs: Sequence[str], others: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``others`` and the inputs as x0, x1, ... with mean 0 and deviation 1 (population); constant ones become 0."""
    stats = frame.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(inputs)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(inputs)],
    ).first()
    means = np.array([stats[f"m{i}"] or 0.0 for i in range(len(inputs))], float)
    spread = np.array([stats[f"s{i}"] or 0.0 for i in range(len(inputs))], float)
    spread = np.where(spread > 1e-12, spread, 1.0)
    scaled = [
        ((F.col(c).cast("double") - float(m)) / float(s)).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(inputs, means, spread))
    ]
    return frame.select(*others, *scaled), means, spread


def block_sums(rows: DataFrame, size: int, sums: Callable[[dict[str, np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum of ``sums`` (``size`` numbers) over all rows; each call gets some rows as arrays by column.

    A task adds up its own rows, Spark the tasks: ``size`` numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                total += sums({n: c.to_numpy(zero_copy_only=False) for n, c in zip(part.schema.names, part.columns)})
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out


def matrix(columns: dict[str, np.ndarray], count: int) -> np.ndarray:
    """x0, x1, ... side by side."""
    names = [f"x{i}" for i in range(count)]
    return np.stack([columns[n] for n in names], axis=1) if names else np.empty((len(next(iter(columns.values()))), 0))
