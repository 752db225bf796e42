"""A survival forest grown by log-rank splits, level by level.

All that a level needs of the rows are counts: for every open node, candidate input, bin and period, how many
rows leave in the period and how many of them fail. One pass counts them for all trees of the level: a task
adds up its own rows and sends the counts of a (node, input) as one value, so the rows that are shuffled are
nodes x inputs for each task, not cells. The log-rank statistic of every cut follows from the counts of one
(node, input), and the best cut per node goes to the driver: at most trees x 2**depth rows, whatever the data.
Leaves hold the Nelson-Aalen cumulative hazard of their rows.

Bootstrap weights and candidate inputs are drawn by hashes, so that a tree doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.labels import clean_rul
from fleetlife.models.survival import INPUTS, positive_durations
from fleetlife.session import stage

#: Ends of the periods in days: daily for a month, then wider. Lives beyond the last end are censored there.
PERIODS = (*range(1, 31), *range(35, 91, 5), *range(100, 401, 10))

#: Cuts per input, from approximate quantiles.
BINS = 32

#: Counters (two 4-byte numbers each) that a task holds at a time; more trees or nodes take more passes.
COUNTERS = 1 << 24

#: ``counts``: three 4-byte numbers for each cell with rows: bin x periods + period, n, deaths.
GRIDS = "tree int, node int, feature int, counts binary"
CUTS = "tree int, node int, feature int, cut int, statistic double, n_left long, deaths_left long, n long, deaths long"


@dataclass(frozen=True)
class SurvivalForest:
    """Trees as arrays over heap numbers (the children of i are 2 i and 2 i + 1).

    ``feature`` is -1 at leaves; a row goes left if its bin is at most ``cut``. ``hazard`` is the cumulative
    hazard of each leaf at the end of each period.
    """

    inputs: tuple[str, ...]
    thresholds: tuple[np.ndarray, ...]
    ends: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    hazard: dict[tuple[int, int], np.ndarray]

    def bins(self, values: Sequence[np.ndarray]) -> np.ndarray:
        """A value equal to a threshold is in the bin below it; an unknown one in the last."""
        found = [np.searchsorted(t, np.asarray(v, float), side="left") for t, v in zip(self.thresholds, values)]
        return np.stack(found, axis=1).astype(np.uint8)

    def leaf_values(self) -> tuple[np.ndarray, np.ndarray]:
        """Per (tree, node): the sum of the cumulative hazard over the periods, and the area under exp(-hazard)."""
        risk, life = np.zeros(self.feature.shape), np.zeros(self.feature.shape)
        widths = np.diff(self.ends, prepend=0)
        for (tree, node), hazard in self.hazard.items():
            alive = np.exp(-np.concatenate([[0.0], hazard]))
            risk[tree, node] = hazard.sum()
            life[tree, node] = (widths * (alive[1:] + alive[:-1]) / 2).sum()
        return risk, life


def leaves_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that each row has reached after so many levels."""
    node = np.ones(len(bins), np.int64)
    for _ in range(levels):
        inner = np.flatnonzero(feature[node] >= 0)
        at = node[inner]
        right = bins[inner, feature[at]] > cut[at]
        node[inner] = 2 * at + right
    return node


def _uniform(ids: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in [0, 1) from row ids, another one for each stream."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((stream + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def poisson_weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, as for a bootstrap of very many rows."""
    steps = np.exp(-1.0) * np.cumsum(1.0 / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(steps, _uniform(ids, seed * 1_000_003 + tree), side="right").astype(np.int32)


def log_rank(n: np.ndarray, deaths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistic, rows and deaths on the left of each cut, from counts by bin and period.

    The statistic is the squared difference of observed and expected deaths on the left over its
    hypergeometric variance; 0 where no variance is left.
    """
    left_n, left_d = np.cumsum(n, axis=0)[:-1], np.cumsum(deaths, axis=0)[:-1]
    at_risk = n.sum(0)[::-1].cumsum()[::-1].astype(float)
    left_risk = left_n[:, ::-1].cumsum(axis=1)[:, ::-1]
    d = deaths.sum(0).astype(float)
    share = left_risk / np.maximum(at_risk, 1)
    apart = (left_d - d * share).sum(1)
    spread = (d * share * (1 - share) * (at_risk - d) / np.maximum(at_risk - 1, 1)).sum(1)
    statistic = np.where(spread > 1e-12, apart**2 / np.where(spread > 1e-12, spread, 1.0), 0.0)
    return statistic, left_n.sum(1), left_d.sum(1)


def cuts_of(grids: DataFrame, bins: Sequence[int], periods: int) -> DataFrame:
    """``CUTS`` of every (tree, node, input) from its ``GRIDS``, one of each task: they are added up as they come."""

    def all_cuts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, node = (k.as_py() for k in key)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for feature, counts in zip(batch.column("feature").to_pylist(), batch.column("counts").to_pylist()):
                total = sums.setdefault(feature, np.zeros((2, bins[feature] * periods), np.int64))
                cells = np.frombuffer(counts, np.int32).reshape(-1, 3)
                # A task names a cell once.
                total[:, cells[:, 0]] += cells[:, 1:].T
        for feature, total in sums.items():
            n, deaths = total.reshape(2, bins[feature], periods)
            statistic, left_n, left_d = log_rank(n, deaths)
            count = len(statistic)
            same = {"tree": tree, "node": node, "feature": feature}
            columns = {k: pa.array([v] * count, pa.int32()) for k, v in same.items()}
            yield pa.RecordBatch.from_pydict(
                columns
                | {"cut": pa.array(np.arange(count), pa.int32()), "statistic": pa.array(statistic, pa.float64())}
                | {"n_left": pa.array(left_n, pa.int64()), "deaths_left": pa.array(left_d, pa.int64())}
                | {"n": pa.array([int(n.sum())] * count, pa.int64()), "deaths": pa.array([int(deaths.sum())] * count, pa.int64())}
            )

    return grids.groupBy("tree", "node").applyInArrow(all_cuts, CUTS)


def thresholds_of(frame: DataFrame, inputs: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Distinct approximate quantiles of every input: one aggregation with bounded sketches."""
    shares = [k / bins for k in range(1, bins)]
    row = frame.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(inputs)]).first()
    return {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(inputs)}


def binned(frame: DataFrame, thresholds: Mapping[str, Sequence[float]], ends: Sequence[int], row_key: Sequence[str]) -> DataFrame:
    """(id, period, died, bins) of every row: all that growing a forest reads. One byte per input."""
    inputs, cuts = list(thresholds), [np.asarray(t, float) for t in thresholds.values()]
    if any(len(t) > 254 for t in cuts):
        raise ValueError("at most 254 thresholds per input")
    grid = np.asarray(ends, float)
    ready = positive_durations(frame).select(
        F.xxhash64(*row_key).alias("id"), "duration", F.col("event").cast("int").alias("event"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days = batch.column(1).to_numpy(zero_copy_only=False)
            period = np.searchsorted(grid, days, side="left")
            beyond = period == len(grid)
            died = (batch.column(2).to_numpy(zero_copy_only=False) == 1) & ~beyond
            columns = [
                np.searchsorted(t, batch.column(3 + i).cast(pa.float64()).to_numpy(zero_copy_only=False), side="left")
                for i, t in enumerate(cuts)
            ]
            packed = np.stack(columns, axis=1).astype(np.uint8) if columns else np.empty((len(days), 0), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.minimum(period, len(grid) - 1).astype(np.int32)), pa.array(died),
                 pa.array([row.tobytes() for row in packed], pa.binary())],
                ["id", "period", "died", "bins"],
            )

    return ready.mapInArrow(run, "id long, period int, died boolean, bins binary")


class _Level:
    """Counts of one pass: which nodes of which trees are open, and the inputs each may be cut by."""

    def __init__(self, bins: Sequence[int], periods: int, open_: Mapping[int, Sequence[int]], tries: Callable[[int, int], np.ndarray]):
        self.bins, self.periods, self.open = list(bins), periods, {t: list(n) for t, n in open_.items()}
        self.tries = {t: np.stack([tries(t, n) for n in nodes]) for t, nodes in self.open.items()}
        self.width = max(bins)

    def count(self, batches, feature: np.ndarray, cut: np.ndarray, depth: int, weigh) -> Iterator[pa.RecordBatch]:
        totals = {t: np.zeros((2, *own.shape, self.width, self.periods), np.int32) for t, own in self.tries.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            period = batch.column(1).to_numpy(zero_copy_only=False)
            died = batch.column(2).to_numpy(zero_copy_only=False)
            bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), len(self.bins))
            for tree, own in self.tries.items():
                place = np.full(feature.shape[1], -1)
                place[self.open[tree]] = np.arange(len(own))
                at = place[leaves_of(bins, feature[tree], cut[tree], depth)]
                weight = weigh(ids, tree)
                rows = np.flatnonzero((at >= 0) & (weight > 0))
                where, shape = at[rows], (own.shape[1], self.width, self.periods)
                for j in range(own.shape[1]):
                    cell = ((where * shape[0] + j) * shape[1] + bins[rows, own[where, j]]) * shape[2] + period[rows]
                    for k, amount in ((0, weight[rows]), (1, weight[rows] * died[rows])):
                        np.add.at(totals[tree][k].reshape(-1), cell, amount)
        for tree, own in self.tries.items():
            n, deaths = totals[tree].reshape(2, own.size, -1)
            group, cell = np.nonzero(n)
            if not len(group):
                continue
            packed = np.stack([cell, n[group, cell], deaths[group, cell]], axis=1).astype(np.int32)
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = pa.py_buffer((np.append(first, len(group)) * packed.itemsize * 3).astype(np.int64))
            counts = pa.Array.from_buffers(pa.large_binary(), len(first), [None, ends, pa.py_buffer(packed)])
            node, chosen = group[first] // own.shape[1], own.reshape(-1)[group[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), tree, np.int32)),
                 pa.array(np.array(self.open[tree], np.int32)[node]),
                 pa.array(chosen.astype(np.int32)), counts.cast(pa.binary())],
                [f.split()[0] for f in GRIDS.split(", ")],
            )


def _grids(rows: DataFrame, level: _Level, feature: np.ndarray, cut: np.ndarray, depth: int, weigh) -> DataFrame:
    """``GRIDS`` of a level, those of each task."""
    return rows.mapInArrow(lambda batches: level.count(batches, feature, cut, depth, weigh), GRIDS)


def log_rank_table(frame: DataFrame, thresholds: Mapping[str, Sequence[float]], ends: Sequence[int] = PERIODS) -> DataFrame:
    """Every cut of all rows: feature, threshold, n_left, deaths_left, statistic. The candidates of a tree's root."""
    names, bins = list(thresholds), [len(t) + 1 for t in thresholds.values()]
    rows = binned(frame, thresholds, ends, ["duration"])
    every = np.arange(len(names))
    none = np.full((1, 2), -1)
    level = _Level(bins, len(ends), {0: [1]}, lambda tree, node: every)
    cuts = cuts_of(_grids(rows, level, none, none, 0, lambda ids, tree: np.ones(len(ids), np.int32)), bins, len(ends))
    shown = [(i, k, name, float(t)) for i, name in enumerate(names) for k, t in enumerate(thresholds[name])]
    spec = frame.sparkSession.createDataFrame(shown, "feature int, cut int, input string, threshold double")
    return cuts.join(F.broadcast(spec), ["feature", "cut"]).select(
        F.col("input").alias("feature"), "threshold", "n_left", "deaths_left", "statistic"
    )


def fit_survival_forest(
    frame: DataFrame,
    inputs: Sequence[str] = tuple(INPUTS),
    trees: int = 50,
    depth: int = 6,
    min_leaf: int = 100,
    tries: int | None = None,
    bootstrap: bool = True,
    ends: Sequence[int] = PERIODS,
    thresholds: Mapping[str, Sequence[float]] | None = None,
    row_key: Sequence[str] = ("serial_number", "date"),
    seed: int = 42,
) -> SurvivalForest:
    """Grow on (duration, event) with cuts that keep ``min_leaf`` (weighted) rows on either side.

    ``tries`` inputs are looked at per node (default: the root of their number). ``row_key`` names the columns
    that identify a row for the bootstrap; without them the inputs do. Of equal statistics the first input
    and the lowest cut win. No rows: leaves without hazard.
    """
    cuts = {c: list(t) for c, t in (thresholds or thresholds_of(frame, inputs)).items()}
    names, bins = list(cuts), [len(t) + 1 for t in cuts.values()]
    identity = list(row_key) if set(row_key) <= set(frame.columns) else [*names, "duration", "event"]
    rows = stage(binned(frame, cuts, ends, identity))
    tries = tries or max(1, round(len(names) ** 0.5))
    feature, cut = (np.full((trees, 2 << depth), -1) for _ in range(2))

    def weigh(ids: np.ndarray, tree: int) -> np.ndarray:
        return poisson_weights(ids, tree, seed) if bootstrap else np.ones(len(ids), np.int32)

    def candidates(tree: int, node: int) -> np.ndarray:
        return np.sort(np.random.default_rng([seed, tree, node]).choice(len(names), min(tries, len(names)), replace=False))

    open_ = {tree: [1] for tree in range(trees)}
    for level in range(depth):
        found = []
        for part in _passes(open_, tries * max(bins) * len(ends)):
            counted = _grids(rows, _Level(bins, len(ends), part, candidates), feature, cut, level, weigh)
            fit = cuts_of(counted, bins, len(ends)).where(
                (F.col("statistic") > 0) & (F.col("n_left") >= min_leaf) & (F.col("n") - F.col("n_left") >= min_leaf)
            )
            order = F.struct("statistic", -F.col("feature"), -F.col("cut"))
            best = fit.groupBy("tree", "node").agg(F.max_by(F.struct("feature", "cut"), order).alias("best"))
            found += best.collect()  # one row per open node
        open_ = {}
        for r in found:
            feature[r.tree, r.node], cut[r.tree, r.node] = r.best.feature, r.best.cut
            open_.setdefault(r.tree, []).extend([2 * r.node, 2 * r.node + 1])
        open_ = {t: sorted(nodes) for t, nodes in open_.items()}
        if not open_:
            break
    hazard = _leaf_hazards(rows, feature, cut, depth, len(ends), bins, weigh)
    return SurvivalForest(tuple(names), tuple(np.asarray(t, float) for t in cuts.values()), np.asarray(ends, float), feature, cut, hazard)


def _passes(open_: Mapping[int, list[int]], each: int) -> Iterator[dict[int, list[int]]]:
    """Open nodes in parts whose counters fit the limit."""
    part: dict[int, list[int]] = {}
    room = max(1, COUNTERS // each)
    for tree, nodes in open_.items():
        for node in nodes:
            if sum(map(len, part.values())) == room:
                yield part
                part = {}
            part.setdefault(tree, []).append(node)
    if part:
        yield part


def _leaf_hazards(rows, feature, cut, depth: int, periods: int, bins: Sequence[int], weigh) -> dict[tuple[int, int], np.ndarray]:
    """Nelson-Aalen per leaf: deaths over rows at risk, added up over the periods."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, deaths = (np.zeros((*feature.shape, periods), np.int64) for _ in range(2))
        for batch in batches:
            ids, period, died = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            packed = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), len(bins))
            for tree in range(len(feature)):
                at = leaves_of(packed, feature[tree], cut[tree], depth)
                weight = weigh(ids, tree)
                np.add.at(n[tree], (at, period), weight)
                np.add.at(deaths[tree], (at, period), weight * died)
        spot = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(s.astype(np.int32)) for s in spot), pa.array(n[spot]), pa.array(deaths[spot])],
            ["tree", "node", "period", "n", "deaths"],
        )

    kinds = "tree int, node int, period int, n long, deaths long"
    summed = rows.mapInArrow(count, kinds).groupBy("tree", "node", "period").agg(F.sum("n").alias("n"), F.sum("deaths").alias("deaths"))
    out: dict[tuple[int, int], np.ndarray] = {}
    # At most trees x 2**depth x periods rows.
    for (tree, node), own in summed.toPandas().groupby(["tree", "node"]):
        n, deaths = np.zeros(periods), np.zeros(periods)
        n[own["period"]], deaths[own["period"]] = own["n"], own["deaths"]
        at_risk = n[::-1].cumsum()[::-1]
        out[int(tree), int(node)] = np.cumsum(deaths / np.maximum(at_risk, 1))
    return out


def predict_survival_forest(model: SurvivalForest, frame: DataFrame) -> DataFrame:
    """Add ``risk`` (mean over trees of the summed cumulative hazard) and ``pred_time`` (mean area under the
    survival curve, in days); the inputs that are no keys are dropped."""
    keep = [c for c in frame.columns if c not in model.inputs]
    risk, life = model.leaf_values()
    depth = int(np.log2(model.feature.shape[1])) - 1
    context = frame.sparkSession.sparkContext
    shared = context.broadcast((model, risk, life))

    @F.pandas_udf("risk double, life double")
    def predicted(values: pd.DataFrame) -> pd.DataFrame:
        forest, risks, lives = shared.value
        bins = forest.bins([values[c].to_numpy() for c in values.columns])
        found = np.zeros((2, len(bins)))
        for tree in range(len(forest.feature)):
            at = leaves_of(bins, forest.feature[tree], forest.cut[tree], depth)
            found += risks[tree, at], lives[tree, at]
        return pd.DataFrame({"risk": found[0], "life": found[1]}) / max(len(forest.feature), 1)

    inputs = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(model.inputs)])
    scored = frame.select(*keep, predicted(inputs).alias("_p"))
    return scored.select(*keep, F.col("_p.risk").alias("risk"), clean_rul(F.col("_p.life")).alias("pred_time"))
