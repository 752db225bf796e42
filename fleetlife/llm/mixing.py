"""Mixing sources to target weights: exact word budgets by counting documents of each length.

A source's target is taken as whole passes over all its documents plus a rest smaller than the
source. For the rest, documents are counted by exact length; from every length the same share is
taken at first, and what is then missing is made up by a bounded knapsack over the unused counts.
Where that doesn't meet the rest, more and more of the share is put back into the knapsack.
The plan names only how many documents of each length to take. Which ones follows from a seeded
hash: the documents of one length are numbered (without one task for a length) and the first are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.llm.ranks import numbered
from fleetlife.llm.sharding import draw
from fleetlife.operators.prefix import running_totals
from fleetlife.session import stage

#: No document is taken more often than this.
MOST_COPIES = 3

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)

#: Gaps are first brought down to this many words by whole documents, then solved exactly.
EXACT_WORDS = 1 << 16

#: By how much the exact part grows while the rest is not met, and the bits it may then keep. Sources
#: with few documents are solved whole within that.
GROWTH = 16
MOST_BITS = 1 << 31


def word_count(text: str) -> F.Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def reach(sizes: np.ndarray, counts: np.ndarray, budget: int) -> tuple[int, np.ndarray]:
    """The largest sum <= ``budget`` of at most ``counts[i]`` items of ``sizes[i]``, and the items used.

    Bounded knapsack by powers of two: after each part, a bit per sum tells which sums are reachable.
    The bits are kept for the way back: ``budget`` bits for each part.
    """
    used = np.zeros(len(sizes), np.int64)
    mask, states, parts = (1 << (budget + 1)) - 1, [1], []
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        left, take = min(count, budget // size if size else 0), 1
        while left and not states[-1] >> budget & 1:
            take = min(take, left)
            states.append((states[-1] | states[-1] << take * size) & mask)
            parts.append((i, take))
            left, take = left - take, take * 2
    total = at = states[-1].bit_length() - 1
    for (i, take), before in zip(reversed(parts), reversed(states[:-1])):
        if not before >> at & 1:
            used[i] += take
            at -= take * int(sizes[i])
    return total, used


def fill(sizes: np.ndarray, counts: np.ndarray, rest: int, room: int, shared: int) -> tuple[int, np.ndarray] | None:
    """Words still missing to ``rest``, and documents of each length: equal shares up to ``shared`` words, then whole
    documents down to a gap of ``room``, then the best sum for the gap. None if that needs over ``MOST_BITS``."""
    everything = int((sizes * counts).sum())
    extra = np.array([shared * c // everything for c in counts.tolist()], np.int64)  # exact: Python integers
    missing = rest - int((extra * sizes).sum())
    # From the longest down. If a document longer than the gap less the reserve is all that is left, it is taken as well.
    for reserve in (room // 2, 0):
        for i in np.argsort(-sizes, kind="stable"):
            if missing <= room:
                break
            more = min(int(counts[i] - extra[i]), max(missing - reserve, 0) // int(sizes[i])) if sizes[i] else 0
            extra[i] += more
            missing -= more * int(sizes[i])
    short = np.flatnonzero((sizes > 0) & (sizes <= missing) & (counts > extra))
    short = short[np.argsort(sizes[short], kind="stable")]
    free = (counts - extra)[short]
    parts = sum(min(c, missing // s).bit_length() for s, c in zip(sizes[short].tolist(), free.tolist()))
    if not parts:
        return missing, extra
    if room > EXACT_WORDS and parts * missing > MOST_BITS:
        return None
    # Ones, twos and so on first would close small gaps but use up all bits of memory last.
    total, used = reach(sizes[short][::-1], free[::-1], missing)
    extra[short] += used[::-1]
    return missing - total, extra


def plan_source(sizes: np.ndarray, counts: np.ndarray, target: float, most: int = MOST_COPIES) -> tuple[int, np.ndarray]:
    """Passes over everything, and documents of each length to take once more.

    The sum is the reachable one closest below the target's nearest integer; with the usual short
    documents it is the target itself. Only where ``MOST_BITS`` don't suffice to settle that, it is
    the best sum found.
    """
    everything = int((sizes * counts).sum())
    if not everything:
        return 0, np.zeros(len(sizes), np.int64)
    goal = min(int(round(target)), most * everything)
    passes, rest = divmod(goal, everything)
    unit = int(np.gcd.reduce(sizes))  # no sum is between its multiples
    sizes, rest, room = sizes // unit, rest // unit, EXACT_WORDS
    missing, extra = fill(sizes, counts, rest, room, rest)
    while missing and room < rest:
        room = min(room * GROWTH, rest)
        wider = fill(sizes, counts, rest, room, rest - room)
        if wider is None:
            break
        if wider[0] < missing:
            missing, extra = wider
    return passes, extra


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], most: int) -> DataFrame:
    """One row per source with its ``place`` by code point (null last), ``source_size`` and ``target``.

    All targets together are 100 % of all sizes; a target stops at ``most`` times its source's size, and
    what is above goes to the others by weight. Each round of that is one aggregation over the sources.
    """
    table = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    named = table.where(F.col(source).isNotNull()).withColumn("one", F.lit(1).cast("long"))
    places = running_totals(named, source, ["one"]).select(F.col(source).alias("_named"), F.col("one_before").alias("place"))
    last = named.count()
    table = table.join(places, F.col(source) == F.col("_named"), "left").drop("_named")
    table = table.withColumn("place", F.coalesce("place", F.lit(last)))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = stage(table.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))))
    limit = F.col("source_size") * float(most)
    level, total = 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row.open or row.total is None:
            break
        total = (row.total - row.held) / row.open
        if total <= level:
            break
        level = total
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), limit)).drop("weight")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """Per document: key, ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words).

    Documents without words are never taken. Repeated rows are documents of their own; rows that are
    equal in key, source and size can't be told apart, and any of them is taken. A null source is a
    source; a null key counts as an empty one for the seeded order. Texts are read once for their
    sizes; only keys, sources and sizes are shuffled.
    """
    sized = stage(docs.select(F.col(key), F.col(source).alias("_source"), word_count(text).alias("size")))
    targets = stage(source_targets(sized, "_source", "size", weights, most))
    counts = sized.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("_count"))
    same = F.col("_source").eqNullSafe(F.col("_other"))
    counts = counts.join(targets.withColumnRenamed("_source", "_other"), same).drop("_other")

    names = ["place", "size", "source_size", "target", "_passes", "_extra"]

    def plan(group: pa.Table) -> pa.Table:
        # One row per distinct length of a source: bounded by the longest document.
        group = group.sort_by("size")
        sizes, counts = (group[name].to_numpy().astype(np.int64) for name in ("size", "_count"))
        passes, extra = plan_source(sizes, counts, group["target"][0].as_py(), most)
        found = [group["place"].cast(pa.int64()), sizes, group["source_size"], group["target"], np.full(len(sizes), passes), extra]
        return pa.table(found, names)

    plans = counts.groupBy("place").applyInArrow(plan, "place long, size long, source_size long, target double, _passes long, _extra long")
    placed = sized.join(targets.select(F.col("_source").alias("_other"), "place"), same).drop("_other", "_source")
    order = draw(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    ranked = numbered(placed, ["place", "size"], order, [key], "_rank")
    plans = plans.withColumnsRenamed({"place": "_p", "size": "_s"})
    ranked = ranked.join(plans, (F.col("place") == F.col("_p")) & (F.col("size") == F.col("_s")))
    more = F.when(F.col("_rank") < F.col("_extra"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("_passes") + more).otherwise(0).cast("long")
    return ranked.select(key, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
