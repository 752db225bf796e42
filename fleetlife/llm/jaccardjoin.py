"""Jaccard join of word n-gram sets by PartEnum signatures, and the groups it connects.

Sets are dealt into bands of size. Two sets of a band's sizes with Jaccard similarity of at least the
threshold differ in at most k elements, k following from the band's largest size. The feature domain is
partitioned by hash, and signatures are made such that sets which differ in at most k elements share one:

* small bands (k <= 3): k + 2 partitions, a signature for each subset of two of them;
* others: groups of three partitions, a signature for each subset of two of a group. With g groups, g - k // 2
  have one different partition at most, so sets within k share a signature in t + 1 groups at least, for
  g = k // 2 + 1 + t. A weak signature (one element or none, as many unlike sets have) is left out by a set
  that has some in at most t groups; a set with more keeps them, so no pair loses its last common signature.

A set also gets the signatures of the next band if a partner can be that large. Sets with a common signature
are candidates if a 256-bit sketch of their minima doesn't tell them apart: chance signatures would connect most
of a large corpus into one group. Of linked sets the sketch parts one pair in 10**12. What is left is connected
into candidate groups (not pairs), and each group is verified exactly (``groupverify``).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.llm.components import components
from fleetlife.llm.groupverify import most_apart, verified_links
from fleetlife.llm.hotkeys import join_groups
from fleetlife.llm.minhash import candidate_links, row_sketches, sketch_plan
from fleetlife.llm.sharedkeys import shared, slice_bits
from fleetlife.llm.shingles import set_keys, shingle_sets
from fleetlife.llm.textparts import Texts, splitmix, with_results
from fleetlife.session import stage

#: Text of a chunk whose signatures a task holds: at 80 % they take about ten times the memory of the text.
CHUNK_BYTES = 1 << 20

#: Groups that agree beyond the last one (t above), as a share of the others.
SLACK = 0.1


@cache
def band_edges(percent: int) -> np.ndarray:
    """The smallest size of every band up to 2**40. Partners are in the same or a neighbouring band:
    a band reaches as far as a partner of its smallest size can. At 100 % partners have one size, so
    that any bands will do."""
    edges = [1]
    while edges[-1] < 1 << 40:
        reach = -(-100 * edges[-1] // percent) if percent < 100 else 2 * edges[-1]
        edges.append(max(edges[-1] + 1, reach))
    return np.array(edges, np.int64)


def _band_plan(band: int, percent: int) -> tuple[int, int, int]:
    """k, the number of partitions, and t of a band."""
    largest = int(band_edges(percent)[band + 1]) - 1
    k = int(most_apart(largest, largest, percent))
    if k <= 3:
        return k, k + 2, 0
    spare = 2 + int(SLACK * (k // 2 + 1))
    return k, 3 * (k // 2 + 1 + spare), spare


def signatures(rows: np.ndarray, values: np.ndarray, count: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signatures. ``rows`` is in order, ``values`` the elements of each row's set."""
    sizes = np.bincount(rows, minlength=count)
    edges = band_edges(percent)
    bands = np.searchsorted(edges, sizes, "right") - 1
    reach = 100 * sizes // percent
    out_rows, out = [], []
    first = np.concatenate([[0], np.cumsum(sizes)])
    mixed = splitmix(values ^ np.uint64(0x5851F42D4C957F2D))
    for shift in (0, 1):
        using = sizes > 0 if not shift else (sizes > 0) & (reach >= edges[np.minimum(bands + 1, len(edges) - 1)])
        for band in np.unique(bands[using] + shift).tolist():
            own = np.flatnonzero(using & (bands + shift == band))
            k, parts, spare = _band_plan(band, percent)
            places = _ranges(first[own], sizes[own])
            local = np.repeat(np.arange(len(own)), sizes[own])
            cell = local * parts + (mixed[places] % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(len(own) * parts, np.uint64)
            np.add.at(sums, cell, mixed[places])
            held = np.bincount(cell, minlength=len(sums)).reshape(len(own), parts)
            sums = splitmix(sums).reshape(len(own), parts)
            if k <= 3:
                pairs = list(combinations(range(parts), 2))
                for a, b in pairs:
                    tag = np.uint64(((band << 20) | (a << 10) | b) + 1)
                    out_rows.append(own)
                    out.append(splitmix(splitmix(sums[:, a] + tag) ^ sums[:, b]))
            else:
                sums, held = (x.reshape(len(own), -1, 3) for x in (sums, held))
                pairs = ((0, 1), (0, 2), (1, 2))
                weak = np.stack([held[:, :, a] + held[:, :, b] <= 1 for a, b in pairs], 2)
                keep = ~weak | (weak.any(2).sum(1) > spare)[:, None, None]
                for i, (a, b) in enumerate(pairs):
                    r, g = np.nonzero(keep[:, :, i])
                    tag = splitmix((np.uint64(band) << np.uint64(40)) + g.astype(np.uint64) * np.uint64(4) + np.uint64(i))
                    out_rows.append(own[r])
                    out.append(splitmix(splitmix(sums[r, g, a] + tag) ^ sums[r, g, b]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each size, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


SETS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("_set_a", T.LongType()),
    T.StructField("_set_b", T.LongType()),
    T.StructField("sketch", T.BinaryType()),
]


def link_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Per document: ``key`` (a long), ``n_shingles`` and ``component_id``.

    Two documents link when 100 times the common distinct shingles are at least ``percent`` times all of
    theirs; ``component_id`` is the smallest key that links reach. Null and empty texts have no shingles
    and link with nothing. Rows with the same key are one node of the graph; a row without a key has no
    component. Other columns of ``docs`` are dropped.
    """
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    sized = rows.withColumn("_bytes", F.coalesce(F.octet_length("_text"), F.lit(0)))
    near_enough = sketch_plan(percent)

    def measure(part: Texts) -> list:
        own, values = shingle_sets(part, n)
        return [*set_keys(own, values, len(part)), row_sketches(own, values, len(part), near_enough)]

    sets = stage(with_results(sized, "_text", SETS, measure, keep_text=False))
    total = sets.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    filled = sets.where((F.col("n_shingles") > 0) & F.col("_id").isNotNull())
    same = ["n_shingles", "_set_a", "_set_b"]
    alike = stage(filled.groupBy(*same).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies")))
    joined = join_groups(filled.select("_id", *same), alike, same, "_copies", filled.count())
    copies = stage(joined.select("_id", "_first").distinct())

    def keys_of(part: Texts) -> tuple[np.ndarray, np.ndarray]:
        own, values = shingle_sets(part, n)
        return signatures(own, values, len(part), percent)

    texts = rows.where(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = shared(texts, keys_of, slice_bits(total, tasks), "_id", "_text", chunk_bytes=CHUNK_BYTES)
    # Of equal sets only the first takes part from here.
    first = filled.join(alike.select(F.col("_first").alias("_id")).distinct(), "_id", "left_semi").select("_id", "sketch", "n_shingles")
    keyed = found.join(first.select(F.col("_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    keyed = keyed.select(F.col("doc_id").alias("_id"), F.explode("found").alias("key")).distinct()
    keyed = keyed.join(first.select("_id", "sketch"), "_id")
    # The last bit of a key is a mark there.
    near = candidate_links(keyed.withColumn("key", F.shiftleft(F.xxhash64("key"), 1)), near_enough)
    groups = components(near)
    sizes = first.groupBy("_id").agg(F.sum("n_shingles").alias("n"))
    members = groups.join(sizes, F.col("node") == F.col("_id")).select("node", F.col("component").alias("grp"), "n")
    links = verified_links(texts, members, lambda part: shingle_sets(part, n), percent)
    edges = links.union(copies.select("_id", "_first"))
    reached = components(edges)
    joined = sets.select("_id", "n_shingles").join(reached, F.col("_id") == F.col("node"), "left")
    return joined.select(F.col("_id").alias(key), "n_shingles", F.coalesce("component", "_id").alias("component_id"))
