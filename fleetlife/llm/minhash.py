"""Near duplicates by MinHash: many universal hash minima, banding, signature verification, exact links.

Every distinct shingle is hashed by many functions of the form a x + b; a document's signature is the least
value of each. Two sets agree in a minimum with the probability of their Jaccard similarity. Bands of minima
are keys that linked documents share, except with the probability ``MISS``; one bit of each minimum is a
sketch, by whose distance the documents under one key are verified, and the sketch of a linked pair lies
beyond the cut with a probability of ``MISS`` / 10000. What is left are candidate groups, not pairs; their
links are confirmed on the full sets (``groupverify``), and components follow by alternating large and small
stars.

A key that many documents have is met by pre-aggregation: a task first compares the documents of its own chunk
with a leader under each key, and sends only the leader for those whose sketches are almost the same. Sketch
distances obey the triangle inequality, so a leader is compared with a cut wider by that distance, and no
candidate is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.llm.components import HELD_EDGES, components, star_edges
from fleetlife.llm.groupverify import verified_links
from fleetlife.llm.hotkeys import join_groups
from fleetlife.llm.shingles import set_keys, shingle_sets
from fleetlife.llm.textparts import as_lists, slices, splitmix
from fleetlife.session import stage

#: Minima of a band.
BAND_ROWS = 5

#: Probability that a pair just at the threshold shares no band.
MISS = 1e-8

#: Text and documents of a chunk.
CHUNK_BYTES = 16 << 20
CHUNK_DOCS = 16_384

#: Rows of (key, document) that a task combines at a time.
COMBINED_ROWS = 100_000

#: Times that a chunk's documents under one key are compared with a leader.
LEADER_ROUNDS = 3

SIGNED = (
    "_id long, n_shingles long, _set_a long, _set_b long, keys array<long>, near array<long>, sketch binary"
)
SET = ["n_shingles", "_set_a", "_set_b"]
EDGES = "a long, b long"
KEYED = ["key", "_id", "sketch", "leader"]


@dataclass(frozen=True)
class Plan:
    """Bands, and the sketch distances that decide: ``cut`` for candidates, ``same`` for a leader's followers."""

    bands: int
    rows: int
    cut: int
    same: int

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def _more_than(least: int, count: int, p: float) -> float:
    """Probability of more than ``least`` successes among ``count`` draws; p is below 1."""
    if not p:
        return 0.0

    def ways(k: int) -> float:
        return math.lgamma(count + 1) - math.lgamma(k + 1) - math.lgamma(count - k + 1)

    return sum(math.exp(ways(k) + k * math.log(p) + (count - k) * math.log1p(-p)) for k in range(least + 1, count + 1))


def _cut(count: int, differs: float) -> int:
    """The distance that a linked pair's sketches don't exceed but with MISS / 10000."""
    cut = 0
    while cut < count and _more_than(cut, count, differs) > MISS / 10_000:
        cut += 1
    return cut


def plan_for(percent: int, rows: int = BAND_ROWS) -> Plan:
    """Enough bands for ``MISS``. At 100 % one band would do; two guard against a chance in one."""
    alike = percent / 100
    bands = 2 if percent == 100 else max(2, math.ceil(math.log(MISS) / math.log(1 - alike**rows)))
    count, differs = bands * rows, (1 - alike) / 2
    return Plan(bands, rows, _cut(count, differs), math.ceil(count * differs))


def sketch_plan(percent: int, bits: int = 256) -> Plan:
    """The distances alone, for candidates that are found in another way."""
    differs = (1 - percent / 100) / 2
    return Plan(bits, 1, _cut(bits, differs), math.ceil(bits * differs))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The multipliers (odd) and additions of the hash functions: fixed, so that runs agree."""
    draws = splitmix(np.arange(2 * count, dtype=np.uint64) + np.uint64(0x6D696E68))
    draws = (draws >> np.uint64(32)).astype(np.uint32)
    return draws[:count] | np.uint32(1), draws[count:]


def minima(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """One line per row that has values (rows are in order), one column per hash function."""
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, np.int64)
    out = np.empty((count, len(starts)), np.uint32)
    if len(starts):
        short = (values >> np.uint64(32)).astype(np.uint32)
        for i, (a, b) in enumerate(zip(*_functions(count))):
            out[i] = np.minimum.reduceat(short * a + b, starts)
    return out.T


def band_keys(signature: np.ndarray, plan: Plan) -> np.ndarray:
    """A key for every band, with the last bit 0."""
    bands = signature.reshape(len(signature), plan.bands, plan.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(plan.bands, dtype=np.uint64), bands.shape[:2])
    for r in range(plan.rows):
        keys = splitmix(keys ^ splitmix(bands[:, :, r]))
    return keys & ~np.uint64(1)


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit of every minimum, as bytes."""
    bits = splitmix(signature.astype(np.uint64) + (np.arange(signature.shape[1], dtype=np.uint64) << np.uint64(32)))
    return np.packbits((bits & np.uint64(1)).astype(bool), axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and for each value the number of its run."""
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def follow_leaders(keys: np.ndarray, sketch: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and keys that a chunk sends (the last bit set for a leader with followers), and (follower, leader) pairs."""
    doc = np.repeat(np.arange(len(keys)), keys.shape[1])
    flat = keys.ravel()
    rest = np.lexsort((doc, flat))
    sent_doc, sent_key, pairs = [], [], [np.empty((0, 2), np.int64)]
    for turn in range(LEADER_ROUNDS):
        begin, run = _runs(flat[rest])
        if not len(begin):
            break
        leader = doc[rest[begin]][run]
        follows = distances(sketch[doc[rest]], sketch[leader]) <= plan.same
        follows[begin] = False
        pairs.append(np.unique(np.stack([doc[rest[follows]], leader[follows]], 1), axis=0))
        leads = np.zeros(len(begin), np.uint64)
        leads[run[follows]] = 1
        sent_doc.append(doc[rest[begin]])
        sent_key.append(flat[rest[begin]] | leads)
        follows[begin] = True
        rest = rest[~follows]
    sent_doc.append(doc[rest])
    sent_key.append(flat[rest])
    pairs = np.unique(np.concatenate(pairs), axis=0)
    return np.concatenate(sent_doc), np.concatenate(sent_key), pairs[:, 0], pairs[:, 1]


def _signed_chunk(parts: list[tuple], plan: Plan) -> pa.RecordBatch:
    ids = pa.concat_arrays([p[0] for p in parts])
    sizes, set_a, set_b = (np.concatenate([p[1][i] for p in parts]) for i in range(3))
    signature = np.concatenate([p[2] for p in parts])
    # Copies within the chunk are known by their set; only the first of them sends keys.
    filled = np.flatnonzero(sizes > 0)
    named = ids.is_valid().to_numpy(zero_copy_only=False)[filled]
    whole = np.stack([set_a[filled], set_b[filled], sizes[filled]], 1)[named]
    first = np.sort(np.unique(whole, axis=0, return_index=True)[1]) if len(whole) else np.empty(0, np.int64)
    line, at = np.flatnonzero(named)[first], filled[named][first]
    sketch = sketches(signature[line])
    doc, key, follower, leader = follow_leaders(band_keys(signature[line], plan), sketch, plan)
    order = np.argsort(doc, kind="stable")
    per_row = np.zeros(len(sizes), np.int64)
    per_row[at] = np.bincount(doc, minlength=len(at))
    near = np.zeros(len(sizes), np.int64)
    near[at] = np.bincount(follower, minlength=len(at))
    short: list[bytes | None] = [None] * len(sizes)
    for i, row in zip(at.tolist(), sketch):
        short[i] = row.tobytes()
    plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.array(set_a), pa.array(set_b), as_lists(pa.array(key[order].view(np.int64)), per_row),
         as_lists(pa.array(plain[at][leader]), near), pa.array(short, pa.binary())],
        [f.split()[0] for f in SIGNED.split(", ")],
    )


def signed(rows: DataFrame, n: int, plan: Plan) -> DataFrame:
    """``SIGNED`` for (_id, _text) rows: size and identity of the shingle set, band keys, followed leaders, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, count = [], 0, 0
        for batch in batches:
            for part in slices(batch, "_text"):
                own, values = shingle_sets(part, n)
                sets = set_keys(own, values, len(part))
                parts.append((part.column("_id"), sets, minima(own, values, plan.minima)))
                size, count = size + len(part.data), count + len(part)
                if size >= CHUNK_BYTES or count >= CHUNK_DOCS:
                    yield _signed_chunk(parts, plan)
                    parts, size, count = [], 0, 0
        if parts:
            yield _signed_chunk(parts, plan)

    return rows.mapInArrow(sign, SIGNED)


def close_pairs(key: np.ndarray, ids: np.ndarray, leads: np.ndarray, sketch: np.ndarray, plan: Plan) -> np.ndarray:
    """(a, b) pairs that connect, under each key, what sketches within the cut connect. Rows are in the order of the keys."""
    begin, run = _runs(key)
    far = distances(sketch, sketch[begin][run])
    close = far <= plan.cut + plan.same * (leads + leads[begin][run])
    close[begin] = False
    pairs = [np.stack([ids[close], ids[begin][run[close]]], 1)]
    close[begin] = True
    # Where some are not close to the first, they may be close to another one.
    ends = np.append(begin[1:], len(key))
    for g in np.unique(run[~close]).tolist():
        reached = (begin[g] + np.flatnonzero(close[begin[g] : ends[g]])).tolist()
        left = begin[g] + np.flatnonzero(~close[begin[g] : ends[g]])
        while len(left):
            if not reached:
                reached, left = [int(left[0])], left[1:]
            me = reached.pop()
            hit = distances(sketch[left], sketch[me]) <= plan.cut + plan.same * (leads[left] + leads[me])
            pairs.append(np.stack([ids[left[hit]], np.full(int(hit.sum()), ids[me])], 1))
            reached += left[hit].tolist()
            left = left[~hit]
    pairs = np.concatenate(pairs)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def row_sketches(rows: np.ndarray, values: np.ndarray, count: int, plan: Plan) -> pa.Array:
    """The sketch of every row of a slice; null without values."""
    out: list[bytes | None] = [None] * count
    if len(rows):
        for row, own in zip(np.unique(rows).tolist(), sketches(minima(rows, values, plan.minima))):
            out[row] = own.tobytes()
    return pa.array(out, pa.binary())


def _raw(column: pa.Array, width: int) -> np.ndarray:
    """Sketches of equal width as lines of bytes."""
    fixed = column.cast(pa.binary(width))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * width : (fixed.offset + len(fixed)) * width].reshape(-1, width)


def _combined(plan: Plan):
    """For rows (key, _id, sketch): the same with followers of a leader under a key replaced by one pair each.

    What ``follow_leaders`` does for the chunk of a task, for keys that come as rows.
    """
    width = -(-plan.minima // 8)

    def done(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        key, ids = (whole[name].to_numpy() for name in ("key", "_id"))
        sketch = _raw(whole["sketch"].combine_chunks(), width) if len(key) else np.empty((0, width), np.uint8)
        rest = np.lexsort((ids, key))
        sent, leads, pairs = [], [], [np.empty((0, 2), np.int64)]
        for _ in range(LEADER_ROUNDS):
            begin, run = _runs(key[rest])
            if not len(begin):
                break
            leader = rest[begin][run]
            follows = distances(sketch[rest], sketch[leader]) <= plan.same
            follows[begin] = False
            pairs.append(np.unique(np.stack([ids[rest[follows]], ids[leader[follows]]], 1), axis=0))
            led = np.zeros(len(begin), np.int64)
            led[run[follows]] = 1
            sent.append(rest[begin])
            leads.append(led)
            follows[begin] = True
            rest = rest[~follows]
        at = np.concatenate([*sent, rest])
        flag = np.concatenate([*leads, np.zeros(len(rest), np.int64)])
        pairs = np.unique(np.concatenate(pairs), axis=0)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[at] | flag), pa.array(ids[at]), pa.array([row.tobytes() for row in sketch[at]], pa.binary()), none], KEYED
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0] << 1), pa.array(pairs[:, 0]), pa.nulls(len(pairs), pa.binary()), pa.array(pairs[:, 1])], KEYED
        )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= COMBINED_ROWS:
                yield from done(held)
                held, count = [], 0
        if held:
            yield from done(held)

    return combine


def _linked_keys(plan: Plan):
    """For ``KEYED`` rows in the order of keys: edges that connect what the pairs under each key do. The rows of one key are held.

    A row with a leader is a pair already.
    """
    width = -(-plan.minima // 8)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[np.ndarray]) -> pa.RecordBatch:
            # What many keys connect goes on once.
            pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in star_edges(pairs[:, 0], pairs[:, 1])], ["a", "b"])

        pairs: list[np.ndarray] = []
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.uint8)]
        for batch in batches:
            led = batch.column(3).is_valid()
            known = batch.filter(led)
            if known.num_rows:
                pairs.append(np.stack([known.column(1).to_numpy(), known.column(3).to_numpy(zero_copy_only=False)], 1))
                batch = batch.filter(pc.invert(led))
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _raw(batch.column(2), width)]
            held = [np.concatenate(x) for x in zip(held, now)]
            whole = held[0] >> 1
            last = int(np.searchsorted(whole, whole[-1]))
            if last:
                pairs.append(close_pairs(whole[:last], held[1][:last], held[0][:last] & 1, held[2][:last], plan))
                held = [x[last:].copy() for x in held]
            if sum(map(len, pairs)) >= HELD_EDGES:
                yield rows(pairs)
                pairs = []
        yield rows([*pairs, close_pairs(held[0] >> 1, held[1], held[0] & 1, held[2], plan)])

    return link


def candidate_links(keyed: DataFrame, plan: Plan, combine: bool = True) -> DataFrame:
    """(a, b) pairs that connect what shares a key and has sketches within the cut.

    ``keyed``: (key, _id, sketch), with the last bit of ``key`` free for the mark of a leader. With ``combine``
    a task first replaces followers of a leader; without, that was done (the bit is set).
    """
    rows = keyed.select("key", "_id", "sketch")
    if combine:
        rows = rows.mapInArrow(_combined(plan), "key long, _id long, sketch binary, leader long")
    else:
        rows = rows.withColumn("leader", F.lit(None).cast("long"))
    return rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(_linked_keys(plan), EDGES)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, percent: int = 80,
                    band_rows: int = BAND_ROWS) -> DataFrame:
    """Per document: ``key`` (a long), ``n_shingles``, ``component_id`` and ``kept``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Two documents link when 100 times their
    common distinct runs of ``n`` words are at least ``percent`` times all of theirs; a text of fewer words is
    one run. ``component_id`` is the smallest key that links reach, and kept are those whose own it is. Null and
    empty texts have no shingles and link with nothing: their component is their own key. Other rows with the
    same key are one node; a row without a key has no component and is kept. Other columns of ``docs`` are dropped. No documents: no rows.
    """
    plan = plan_for(percent, band_rows)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    table = stage(signed(rows, n, plan))
    filled = table.where((F.col("n_shingles") > 0) & F.col("_id").isNotNull()).select("_id", *SET)
    sets = stage(filled.groupBy(*SET).agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    total = filled.count()
    placed = stage(join_groups(filled, sets, SET, "copies", total).select("_id", "first", "n_shingles"))

    keyed = table.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "_id", "sketch")
    close = candidate_links(keyed, plan, combine=False)
    followed = table.select(F.col("_id").alias("a"), F.explode("near").alias("b"))
    senders = table.where(F.size("keys") + F.size("near") > 0).select("_id")
    copies = placed.join(senders, "_id", "left_semi").where("_id != first").select("_id", "first")
    groups = components(close.union(followed).union(copies))
    firsts = sets.groupBy("first").agg(F.max("n_shingles").alias("n"))
    members = groups.join(firsts, F.col("node") == F.col("first")).select("node", F.col("component").alias("grp"), "n")
    links = verified_links(rows.where("_id is not null and _text is not null"), members, lambda p: shingle_sets(p, n), percent)
    # A key with several texts connects their sets.
    several = placed.groupBy("_id").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least != most")
    several = placed.join(several.select("_id"), "_id").select("_id", "first")
    reached = components(links.union(several))
    known = sets.join(reached, F.col("first") == F.col("node"), "left").select(
        *SET, "copies", F.coalesce("component", "first").alias("component_id")
    )
    found = join_groups(filled, stage(known), SET, "copies", total).select("_id", "n_shingles", "component_id")
    rest = table.where((F.col("n_shingles") == 0) | F.col("_id").isNull())
    out = found.union(rest.select("_id", "n_shingles", F.col("_id").alias("component_id")))
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("_id").alias(key), "n_shingles", "component_id", kept.alias("kept"))
