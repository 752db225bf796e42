"""Exact similarity links within candidate groups of any size.

A group is cut into blocks of bounded size. First each block is compared within itself and with a few pivots
of its group, which connects what is alike across blocks. Pairs that are connected by then need no look: only
documents outside their group's largest component meet the other blocks, in chunks. So a group of true copies
costs its size, not its square; only documents that nothing near the pivots resembles are compared with all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.llm.components import components, star_edges
from fleetlife.llm.textparts import Texts, splitmix, with_results
from fleetlife.session import stage

#: Documents and set elements of a block. A task holds a block, and a chunk or the pivots.
BLOCK_DOCS = 512
BLOCK_ELEMENTS = 400_000

#: Documents of a group that every block of it meets first.
PIVOTS = 4

#: Rows of members that are broadcast at most, about 40 bytes each; beyond it the texts are shuffled.
BROADCAST_ROWS = 1_000_000

SetsOf = Callable[[Texts], tuple[np.ndarray, np.ndarray]]
EDGES = "a long, b long"


def most_apart(size_a, size_b, percent: int):
    """The largest symmetric difference of linked sets: 100 i >= p (a + b - i), so
    a + b - 2 i <= (a + b) (100 - p) / (100 + p)."""
    return (size_a + size_b) * (100 - percent) // (100 + percent)


class Forest:
    """Union-find over a block; ``label`` may join some from the start."""

    def __init__(self, label: np.ndarray):
        _, self.label = np.unique(label, return_inverse=True)
        self.members: list[list[int]] = [[] for _ in range(int(self.label.max(initial=-1)) + 1)]
        for i, own in enumerate(self.label.tolist()):
            self.members[own].append(i)
        self.edges: list[tuple[int, int]] = []

    def union(self, a: int, b: int) -> None:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []
        self.edges.append((a, b))


def link_forest(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, side: np.ndarray | None = None):
    """Edges (i, j) that, with the given ``label``, connect the same sets as all links between them.

    Sets are sorted hashes, none is empty. With ``side`` only pairs of different sides are looked at.
    Elements are hashed to cells: two sets differ in at least as many elements as cells with different sums.
    """
    n = len(sets)
    forest = Forest(np.arange(n) if label is None else label)
    if n < 2:
        return forest.edges
    sizes = np.array([len(s) for s in sets], np.int64)
    most = int(sizes.max())
    cells = 1 << max(4, min(12, int(2 * most_apart(most, most, percent)).bit_length()))
    order = np.argsort(sizes, kind="stable")
    sums = np.empty((n, cells), np.uint32)
    for i, own in enumerate(sets[j] for j in order):
        # In 64 bits one set at a time: all of a block would take several times the sums that are kept.
        total = np.zeros(cells, np.uint64)
        np.add.at(total, (splitmix(own) & np.uint64(cells - 1)).astype(np.int64), own)
        sums[i] = splitmix(total) >> np.uint64(32)
    ranked = sizes[order]
    sides = None if side is None else side[order]
    for i in range(n):
        me = int(order[i])
        # Partners at most as large, and large enough.
        others = np.arange(int(np.searchsorted(ranked, -(-percent * ranked[i] // 100))), i)
        others = others[forest.label[order[others]] != forest.label[me]]
        if sides is not None:
            others = others[sides[others] != sides[i]]
        if not len(others):
            continue
        apart = (sums[others] != sums[i]).sum(1)
        for j in order[others[apart <= most_apart(ranked[others], ranked[i], percent)]].tolist():
            if forest.label[me] == forest.label[j]:
                continue
            place = np.searchsorted(sets[me], sets[j])
            place[place == len(sets[me])] = 0
            common = int((sets[me][place] == sets[j]).sum())
            if 100 * common >= percent * (len(sets[me]) + len(sets[j]) - common):
                forest.union(me, j)
    return forest.edges


def _blocks(members: DataFrame) -> DataFrame:
    """(node, grp, n) with the group's number of blocks, the own block, and whether a pivot."""
    need = F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_ELEMENTS)
    # A pivot is the first of its group by one of PIVOTS hashes.
    first = [F.min_by("node", F.struct(F.xxhash64("node", F.lit(k)), "node")) for k in range(PIVOTS)]
    sized = members.groupBy("grp").agg(
        F.ceil(need).alias("blocks"), F.count(F.lit(1)).alias("members"), F.array(*first).alias("pivots")
    )
    placed = members.join(sized.where("members > 1"), "grp")
    block = F.pmod(F.shiftright(F.xxhash64("node"), 8), F.col("blocks")).cast("int")
    pivot = (F.col("blocks") > 1) & F.array_contains("pivots", F.col("node"))
    return placed.select("node", "grp", "blocks", block.alias("block"), pivot.alias("pivot"))


def _with_sets(rows: DataFrame, members: DataFrame, sets_of: SetsOf, small: bool) -> DataFrame:
    """``members`` with ``set``, the bytes of their sorted hashes. ``rows`` are (_id, _text)."""

    def packed(part: Texts) -> list[pa.Array]:
        own, values = sets_of(part)
        ends = np.searchsorted(own, np.arange(len(part) + 1))
        return [pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())]

    joined = rows.join(F.broadcast(members) if small else members, F.col("_id") == F.col("node")).drop("_id")
    made = with_results(joined, "_text", [T.StructField("set", T.BinaryType())], packed, keep_text=False)
    return made.where(F.length("set") > 0)


def _forest_of(table: pa.Table, percent: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> pa.Table:
    ids = table["node"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["set"]]
    edges = link_forest(sets, percent, ids if label is None else label, side)
    a, b = star_edges(*(ids[[e[k] for e in edges]] if edges else np.empty(0, np.int64) for k in (0, 1)))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def verified_links(rows: DataFrame, members: DataFrame, sets_of: SetsOf, percent: int) -> DataFrame:
    """Edges (a, b) that connect the same documents as all links within the groups.

    ``rows``: (_id, _text) of all documents; ``members``: (node, grp, n) with the size of the node's set.
    An id may have several rows: their sets are all compared, as one node.
    """
    placed = stage(_blocks(members))
    small = placed.count() <= BROADCAST_ROWS
    # A pivot goes to all blocks of its group, others to their own.
    every = F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))
    sets = stage(_with_sets(rows, placed, sets_of, small))
    within = sets.withColumn("block", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("block"))))
    first = within.select("grp", "block", "node", "set").groupBy("grp", "block").applyInArrow(
        lambda key, table: _forest_of(table, percent), EDGES
    )
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return first
    first = stage(first)
    labels = components(first)
    known = large.join(labels, "node", "left").select(
        "node", "grp", "blocks", "block", F.coalesce("component", "node").alias("label")
    )
    counts = known.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("grp").agg(
        F.max_by("label", F.struct("k", "label")).alias("main"),
        F.ceil((F.sum("k") - F.max("k")) / BLOCK_DOCS).cast("int").alias("chunks"),
    )
    known = stage(known.join(largest.where("chunks > 0"), "grp"))
    if known.isEmpty():
        return first
    both = sets.select("node", "set").join(known, "node")
    # A block meets every chunk of the group's outsiders, and an outsider every block but its own.
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    own = both.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(0))
    other = both.where(F.col("label") != F.col("main")).withColumn("chunk", chunk)
    other = other.withColumn("to", F.explode(every)).where(F.col("to") != F.col("block"))
    other = other.withColumn("block", F.col("to")).withColumn("side", F.lit(1))
    columns = ["grp", "block", "chunk", "node", "label", "side", "set"]

    def across(key: tuple, table: pa.Table) -> pa.Table:
        return _forest_of(table, percent, table["label"].to_numpy(), table["side"].to_numpy())

    met = own.select(*columns).union(other.select(*columns)).groupBy("grp", "block", "chunk").applyInArrow(across, EDGES)
    return first.union(met)
