"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Totals flow from the leaves to the root: nodes are sorted by
reverse level order (deepest first, by Spark's external sort), every node sends its totals to its parent
through a priority queue ordered like the nodes, and a node finds what its children sent at the head of the
queue when its turn comes. A queue holds a bounded number of messages and spills the rest as sorted runs.

The trie is cut into shards so that this runs side by side. A node with more conversations than a limit is
*heavy*; a shard is a subtree below the heavy ones, so it has at most that many conversations, however many
share a first turn. Every turn of a conversation counts in one node, so at most rows / limit nodes are heavy:
``HEAVY_NODES`` by choice of the limit, whatever the data. Shards send the totals of their roots, summed per
parent before the shuffle, and the heavy nodes are processed last in the same way.

Texts never leave the task that reads them: turns are shuffled as 128-bit digests, and a node is known by the
digest of its turns' digests.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.llm.mixing import word_count
from fleetlife.session import stage

#: Heavy nodes there are at most, and conversations that a node needs at least to be one.
HEAVY_NODES = 200_000
LEAST_HEAVY = 100

#: Messages that a queue holds in memory.
HELD_MESSAGES = 200_000

#: Bits of a conversation number within one piece of the list of conversations that end at a heavy node.
PIECE_BITS = 8

#: Rows of an Arrow batch.
BATCH_ROWS = 8_192

ROOT = bytes(16)
STEPS = "conv long, depth int, key binary, parent binary, words long, last boolean"
PLACED = "shard binary, kind int, depth int, key binary, parent binary, conv long, words long, last boolean"
PARTS = (
    "kind int, key binary, parent binary, conv_id long, depth int, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends binary"
)
#: Kinds of ``PARTS``: a node with its parent, the root of a shard (the parent is in another), ids that end at a heavy node.
NODE, SHARD_ROOT, ENDS = 0, 1, 2


# --- conversations as numbered digests ---


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """(conv, p, digest, words): the turns of each conversation by number from 1.

    Null turns come first; turns of one number are in the order of their digests, so equal ones are
    interchangeable. A null role or text counts as the empty one. Rows without a conversation belong to none
    and are left out.
    """
    said_by, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, said)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(whole.cast("binary"))).alias("digest"),
        F.coalesce(word_count(text), F.lit(0)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.withColumn("p", F.row_number().over(order)).select("conv", "p", "digest", "words")


def head_length(conv: Column, most: int) -> Column:
    """How many turns a conversation takes from its group's first one: 0 to ``most``, by its CRC-32."""
    return F.crc32(conv.cast("string").cast("binary")) % (most + 1)


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """(conv, kind, p, digest, words) rows of conversations whose heads are those of another one.

    Conversation c takes the first h turns of c - c % ``every`` (all if it has fewer, none if there is no such
    conversation) in place of its own first h. Every conversation also has one row of kind 0 without a turn.
    ``turns`` should be a written table; it is read three times.
    """
    h = head_length(F.col("conv"), most)
    heads = turns.where((F.col("conv") % every == 0) & (F.col("p") <= most))
    heads = heads.select(F.col("conv").alias("_base"), "p", "digest", "words")
    convs = turns.where("p = 1").select("conv")
    taken = convs.join(heads, F.col("conv") - F.col("conv") % every == F.col("_base")).where(F.col("p") <= h)
    none = F.lit(None).cast("binary")
    return (
        convs.select("conv", F.lit(0).alias("kind"), F.lit(0).alias("p"), none.alias("digest"), F.lit(0).cast("long").alias("words"))
        .union(taken.select("conv", F.lit(1), "p", "digest", "words"))
        .union(turns.where(F.col("p") > h).select("conv", F.lit(2), "p", "digest", "words"))
    )


# --- batches ---


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], like: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [part.split() for part in like.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held) if held else [[] for _ in fields]
        arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]
        return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield batch()
            held.clear()
    yield batch()


# --- the queue ---


def _spill_folder() -> str | None:
    """Where Spark itself spills on this executor."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return folders[0] if folders[0] and os.path.isdir(folders[0]) else None


class SpillingQueue:
    """A priority queue of tuples that keeps at most ``held`` of them in memory.

    Beyond that the later half goes to a file in order. Items are taken in order as a whole.
    """

    def __init__(self, held: int = HELD_MESSAGES):
        self.held, self.heap, self.runs = held, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self.heap.sort()
            keep = self.held // 2
            file = tempfile.TemporaryFile(dir=_spill_folder())
            for later in self.heap[keep:]:
                pickle.dump(later, file)
            del self.heap[keep:]
            file.seek(0)
            self._next(file, len(self.runs))

    def _next(self, file: Any, number: int) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(file), number, file))
        except EOFError:
            file.close()

    def first(self) -> tuple | None:
        ends = [x for x in (self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None) if x]
        return min(ends) if ends else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, file = heapq.heappop(self.runs)
            self._next(file, number)
            return item
        return heapq.heappop(self.heap)


# --- the passes ---


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (conv, kind, p) as the nodes on each conversation's path, the root first."""

    def steps() -> Iterator[tuple]:
        ready, key, depth = None, ROOT, 0
        for conv, kind, _, digest, words in _rows(batches):
            if ready:
                yield *ready, kind == 0
            if kind == 0:
                key, depth = ROOT, 0
                ready = (conv, 0, ROOT, None, 0)
            else:
                parent, depth = key, depth + 1
                key = hashlib.md5(parent + digest).digest()
                ready = (conv, depth, key, parent, words)
        if ready:
            yield *ready, True

    return _batches(steps(), STEPS)


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path nodes with their shard: the first node of the path that isn't heavy. The ends of conversations
    at heavy nodes go to pieces of their lists."""

    def placed() -> Iterator[tuple]:
        shard = None
        for conv, depth, key, parent, words, last, heavy in _rows(batches):
            if heavy:
                shard = None
                if last:
                    piece = conv >> PIECE_BITS
                    yield key + piece.to_bytes(8, "big", signed=True), ENDS, 0, key, None, conv, 0, True
                continue
            # A conversation begins at the root.
            if shard is None or depth == 0:
                shard = key
            yield shard, NODE, depth, key, parent, conv, words, last

    return _batches(placed(), PLACED)


class Node(NamedTuple):
    key: bytes
    parent: bytes | None
    conv: int
    depth: int
    n: int
    children: int
    leaves: int
    saved: int
    ends: bytes

    def row(self, kind: int, parent_conv: int | None) -> tuple:
        return (kind, self.key, self.parent, self.conv, self.depth, parent_conv, self.n, self.children, self.leaves,
                self.saved, self.ends)


def forward(nodes: Iterable[Node], top: bytes | None, held: int = HELD_MESSAGES) -> Iterator[tuple]:
    """Rows of ``PARTS`` for nodes in reverse level order, up to the node ``top``, whose parent isn't among them.

    A node comes with what is its own (its saving, and what other shards sent it) and gets its children's
    totals from the queue. A child's row is made when its parent is met, as it shows the parent.
    """
    queue = SpillingQueue(held)
    for node in nodes:
        order = (-node.depth, node.key)
        children, leaves, saved = node.children, node.leaves, node.saved
        while (first := queue.first()) and first[0] == order:
            child = Node(*queue.pop()[1])
            children, leaves, saved = children + 1, leaves + child.leaves, saved + child.saved
            yield child.row(NODE, node.conv)
        node = node._replace(children=children, leaves=leaves if children else 1, saved=saved)
        if node.key == top or node.parent is None:
            yield node.row(SHARD_ROOT, None)
        else:
            queue.push(((1 - node.depth, node.parent), tuple(node)))


def _shards(batches: Iterable[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Whole shards, one after another, in the order of (shard, kind, deepest first, key, conv)."""
    rows = _rows(batches)
    row = next(rows, None)

    def nodes(shard: bytes) -> Iterator[Node]:
        """A node's rows are its conversations in order; only counts and a running hash are kept."""
        nonlocal row
        while row and row[0] == shard:
            _, _, depth, key, parent, conv, words, _ = row
            n, ends, before = 0, hashlib.sha256(), b""
            while row and row[0] == shard and row[3] == key:
                n += 1
                if row[7]:
                    ends.update(before + str(row[5]).encode())
                    before = b","
                row = next(rows, None)
            yield Node(key, parent, conv, depth, n, 0, 0, (n - 1) * words, ends.digest())

    def ids(shard: bytes) -> Iterator[str]:
        """At most 2**PIECE_BITS ids."""
        nonlocal row
        while row and row[0] == shard:
            yield str(row[5])
            row = next(rows, None)

    def parts() -> Iterator[tuple]:
        while row:
            shard, kind, _, key, _, conv, _, _ = row
            if kind == ENDS:
                yield ENDS, key, None, conv >> PIECE_BITS, 0, None, 0, 0, 0, 0, ",".join(ids(shard)).encode()
            else:
                yield from forward(nodes(shard), shard, held)

    return _batches(parts(), PARTS)


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each heavy node's list of ids, from its pieces in order."""

    def hashes() -> Iterator[tuple]:
        current, running = None, None
        for key, ids in _rows(batches):
            if key == current:
                running.update(b"," + ids)
                continue
            if current is not None:
                yield current, running.digest()
            current, running = key, hashlib.sha256(ids)
        if current is not None:
            yield current, running.digest()

    return _batches(hashes(), "key binary, ends binary")


def _top(batches: Iterable[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """The heavy nodes, deepest first, with what the shards below them sent."""
    nodes = (Node(*row) for row in _rows(batches))
    return _batches(forward(nodes, None, held), PARTS)


def trie(turns: DataFrame, heavy_nodes: int = HEAVY_NODES, least_heavy: int = LEAST_HEAVY, held: int = HELD_MESSAGES) -> DataFrame:
    """A row per node of the trie of conversations, given as rows of ``with_shared_heads``.

    Columns: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. (conv_id, depth) identifies a node.
    No conversations: no rows, not even the root. Repeated conversation numbers are one conversation.
    ``turns`` should be made of written tables; it is read twice.
    """
    steps = turns.repartition("conv").sortWithinPartitions("conv", "kind", "p").mapInArrow(_steps, STEPS)
    limit = max(least_heavy, -(-turns.count() // heavy_nodes))
    heavy = steps.groupBy("key", "parent", "depth", "words").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")
    )
    # Fewer than heavy_nodes rows: every row of ``turns`` counts in one node.
    heavy = stage(heavy.where(F.col("n") > limit))
    marked = steps.join(F.broadcast(heavy.select("key", F.lit(True).alias("heavy"))), "key", "left")
    marked = marked.select("conv", "depth", "key", "parent", "words", "last", F.coalesce("heavy", F.lit(False)).alias("heavy"))
    placed = marked.mapInArrow(_placed, PLACED).repartition("shard")
    ordered = placed.sortWithinPartitions("shard", "kind", F.desc("depth"), "key", "conv")
    parts = stage(ordered.mapInArrow(lambda batches: _shards(batches, held), PARTS))

    ids = parts.where(F.col("kind") == ENDS).select("key", "conv_id", "ends")
    ids = ids.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends")
    ends = ids.mapInArrow(_ends, "key binary, ends binary")
    roots = parts.where(F.col("kind") == SHARD_ROOT)
    sent = roots.groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    known = heavy.join(sent, "key", "left").join(ends, "key", "left").select(
        "key", "parent", "conv", "depth", "n",
        F.coalesce("children", F.lit(0)).alias("children"),
        F.coalesce("leaves", F.lit(0)).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("words")).alias("saved"),
        F.coalesce("ends", F.lit(hashlib.sha256().digest())).alias("ends"),
    )
    top = known.repartition(1).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(lambda b: _top(b, held), PARTS)
    parents = F.broadcast(heavy.select(F.col("key").alias("_key"), F.col("conv").alias("_conv")))
    joined = roots.join(parents, F.col("parent") == F.col("_key"), "left").withColumn("parent_conv_id", F.col("_conv"))
    columns = parts.columns
    nodes = parts.where(F.col("kind") == NODE).union(joined.select(*columns)).union(top)
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select(*[F.col(c).cast("long").alias(c) for c in numbers], F.lower(F.hex("ends")).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 3, **columns: str) -> DataFrame:
    """``trie`` of conversations with shared heads; ``columns`` names their columns (see ``numbered_turns``)."""
    return trie(with_shared_heads(stage(numbered_turns(conversations, **columns)), every, most))
