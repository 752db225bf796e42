"""Connected components by pointer jumps and contraction within tasks, with bounded work per task.

A round moves the smaller end of every edge to the smallest neighbour of that end (the large star), deals the
edges by their larger end and replaces what a task has by stars around the smallest node (the small star, for
all nodes of a task at once). A star has one edge per node, so after the first time a larger end meets at most
one edge of each task, however many neighbours it had; a smaller end that very many nodes point to is met by an
aggregated table and spread by the skew handling of the join. Joins are never turned into broadcasts, so no
edges go through the driver. Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.session import stage

#: Edges that a task contracts at a time.
HELD_EDGES = 500_000

MOVED = "a long, b long, moved boolean"


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in order, and for each the smallest node that these edges reach."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes, one for every node but the smallest that it reaches."""
    nodes, root = smallest_reached(a, b)
    return nodes[nodes != root], root[nodes != root]


def _stars(a: np.ndarray, b: np.ndarray, moved: bool) -> pa.RecordBatch:
    """The edges as stars around their smallest nodes, marked if these are others than the edges or ``moved``."""
    nodes, root = smallest_reached(a, b)
    moved = moved or bool((root[np.searchsorted(nodes, a)] != b).any())
    rays = nodes != root
    marks = np.full(int(rays.sum()), moved)
    return pa.RecordBatch.from_arrays([pa.array(nodes[rays]), pa.array(root[rays]), pa.array(marks)], ["a", "b", "moved"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of rows (a, b, moved) with a > b, ``HELD_EDGES`` at a time. Neighbouring rows with one ``a`` stay together."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= HELD_EDGES:
            whole = pa.Table.from_batches(held)
            a, b, moved = (whole[name].to_numpy() for name in ("a", "b", "moved"))
            # The rows of the last node may go on.
            ends = np.flatnonzero(a[1:] != a[:-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield _stars(a[:cut], b[:cut], bool(moved[:cut].any()))
                held, count = whole.slice(cut).to_batches(), whole.num_rows - cut
            else:
                # Of one node's edges only the one to the smallest is still needed here.
                star = _stars(a, b, bool(moved.any()))
                own = pc.equal(star["a"], pa.scalar(a[0]))
                yield star.filter(pc.invert(own))
                held, count = [star.filter(own)], 1
    if count:
        whole = pa.Table.from_batches(held)
        a, b, moved = (whole[name].to_numpy() for name in ("a", "b", "moved"))
        yield _stars(a, b, bool(moved.any()))


def _dealt_stars(edges: DataFrame) -> DataFrame:
    """The rows (a, b, moved) with all of one ``a`` in one task, as stars."""
    return edges.repartition("a").sortWithinPartitions("a").mapInArrow(_contract, MOVED)


def _jumped(edges: DataFrame) -> DataFrame:
    """Every edge with the smallest neighbour of its smaller end in place of that, if that has a smaller one."""
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least"))
    joined = edges.join(least.hint("merge"), F.col("b") == F.col("n"), "left")
    return joined.select("a", F.coalesce("least", "b").alias("b"), F.col("least").isNotNull().alias("moved"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with a neighbour, the smallest node it can reach.

    Nodes are longs; loops and nulls are left out; repeated and reversed edges count once. No edges: no rows.
    """
    x, y = F.col(a), F.col(b)
    ordered = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), F.lit(False).alias("moved"))
    edges = stage(_dealt_stars(ordered))
    moved = not edges.isEmpty()
    while moved:
        edges = stage(_dealt_stars(_jumped(edges)))
        # Nothing moved: every larger end has one edge, to a node without a smaller neighbour.
        moved = edges.agg(F.bool_or("moved")).first()[0]
    ends = edges.select("a", "b").union(edges.select("b", "b"))
    return ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
