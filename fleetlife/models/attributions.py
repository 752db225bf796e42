"""Shapley values of published trees, path-dependent: why a row has the score it has.

The game: for a set of known inputs a tree goes down both sides of a split on an unknown one, weighted by the
training rows on each side. A leaf pays its value times, for every input on its path, either whether the row
passes that input's splits or the share of training rows that do. So a row's values depend, per leaf, only on
which inputs of the path it passes; the sums over subsets are extended and unwound along the path once for
every pattern that occurs in a batch, not for every row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.contracts import CATEGORY
from fleetlife.models.classifiers import NUMERIC
from fleetlife.session import checkpoint_dir


@dataclass(frozen=True)
class Leaf:
    """A leaf's value, and for every input on its path its nodes' conditions and the share of rows that meet them."""

    value: float
    inputs: np.ndarray
    shares: np.ndarray
    conditions: tuple[tuple[tuple[int, bool], ...], ...]  # per input: (node, left?)


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # of each node, -1 at leaves
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray  # weight of the training rows
    value: np.ndarray
    threshold: np.ndarray
    categories: tuple[np.ndarray | None, ...]  # that go left, for a split by category

    def goes_left(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        """Per inner node, which rows would go left."""
        out = {}
        for node in np.flatnonzero(self.feature >= 0).tolist():
            own = rows[:, self.feature[node]]
            known = self.categories[node]
            out[node] = own <= self.threshold[node] if known is None else np.isin(own, known)
        return out

    def leaves(self) -> Iterator[Leaf]:
        """All leaves that training rows reached; a node without cover shares it evenly."""
        waiting: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while waiting:
            node, path = waiting.pop()
            if self.feature[node] >= 0:
                waiting += [(int(self.left[node]), [*path, (node, True)]), (int(self.right[node]), [*path, (node, False)])]
                continue
            by_input: dict[int, list[tuple[int, bool]]] = {}
            for step in path:
                by_input.setdefault(int(self.feature[step[0]]), []).append(step)
            shares = [np.prod([self._share(*step) for step in own]) for own in by_input.values()]
            yield Leaf(float(self.value[node]), np.array(list(by_input), int), np.array(shares, float), tuple(map(tuple, by_input.values())))

    def _share(self, node: int, left: bool) -> float:
        child = int(self.left[node] if left else self.right[node])
        both = self.cover[self.left[node]] + self.cover[self.right[node]]
        return float(self.cover[child] / both) if both > 0 else 0.5


def path_values(shares: np.ndarray, passes: np.ndarray) -> np.ndarray:
    """Shapley values of the game "product over known inputs of passes, over others of shares", per pattern.

    ``passes`` has one line of 0 and 1 per pattern. ``weights[k]`` sums, over the sets of k of the inputs seen
    so far, the products times k! (m - k)! / (m + 1)!; an input is added by extending them, and taken out
    again, for its own value, by the reverse.
    """
    count, m = passes.shape
    weights = np.zeros((count, m + 1))
    weights[:, 0] = 1.0
    for depth in range(m):
        one, zero = passes[:, depth, None], shares[depth]
        k = np.arange(depth + 1)
        more = np.zeros((count, m + 1))
        more[:, 1 : depth + 2] = one * weights[:, : depth + 1] * (k + 1) / (depth + 2)
        more[:, : depth + 1] += zero * weights[:, : depth + 1] * (depth + 1 - k) / (depth + 2)
        weights = more
    out = np.zeros((count, m))
    for i in range(m):
        one, zero = passes[:, i], shares[i]
        total = np.zeros(count)
        # With a 1 the last weight came from it alone; with a 0 every weight was only scaled.
        held = np.flatnonzero(one > 0)
        carry = weights[held, m].copy()
        for k in range(m - 1, -1, -1):
            own = carry * (m + 1) / (k + 1)
            total[held] += own
            carry = weights[held, k] - zero * own * (m - k) / (m + 1)
        lost = np.flatnonzero(one == 0)
        for k in range(m):
            if zero > 0:
                total[lost] += weights[lost, k] * (m + 1) / (zero * (m - k))
        out[:, i] = total * (one - zero)
    return out


@dataclass(frozen=True)
class TreeEnsemble:
    """Trees with their weights in the explained sum: the raw margin of boosted trees, the probability of a forest."""

    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    inputs: int

    def base(self) -> float:
        """The sum when nothing is known."""
        return sum(w * leaf.value * float(np.prod(leaf.shares)) for t, w in zip(self.trees, self.weights) for leaf in t.leaves())

    def contributions(self, rows: np.ndarray) -> np.ndarray:
        """One line per row, one column per input; with the base they add up to the ensemble's sum."""
        out = np.zeros((len(rows), self.inputs))
        if not len(rows):
            return out
        for tree, weight in zip(self.trees, self.weights):
            left = tree.goes_left(rows)
            for leaf in tree.leaves():
                if not len(leaf.inputs):
                    continue
                passes = np.stack([
                    np.logical_and.reduce([left[node] == side for node, side in own]) for own in leaf.conditions
                ], axis=1)
                patterns, which = np.unique(passes, axis=0, return_inverse=True)
                values = path_values(leaf.shares, patterns.astype(float)) * leaf.value * weight
                out[:, leaf.inputs] += values[which.reshape(-1)]
        return out


def ensemble_of(model: PipelineModel | GBTClassificationModel | RandomForestClassificationModel) -> TreeEnsemble:
    """The node arrays of a fitted model, read from its stored form in the shared folder (a row per node)."""
    trees = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not isinstance(trees, (GBTClassificationModel, RandomForestClassificationModel)):
        raise TypeError(f"no tree model: {type(trees).__name__}")
    boosted = isinstance(trees, GBTClassificationModel)
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    weights = list(trees.treeWeights) if boosted else [1.0 / trees.getNumTrees] * trees.getNumTrees
    found = []
    for _, own in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        stats = np.stack([np.asarray(s, float) for s in own["impurityStats"]])
        cover = stats[:, 0] if boosted else stats.sum(1)
        value = own["prediction"].to_numpy(float) if boosted else stats[:, 1] / np.maximum(stats.sum(1), 1e-300)
        splits = list(own["split"])
        plain = [s["numCategories"] == -1 for s in splits]
        inner = own["leftChild"].to_numpy() >= 0
        feature = np.where(inner, [s["featureIndex"] for s in splits], -1)
        threshold = [float(s["leftCategoriesOrThreshold"][0]) if i and p else 0.0 for i, p, s in zip(inner, plain, splits)]
        sets = tuple(
            np.asarray(s["leftCategoriesOrThreshold"], float) if i and not p else None for i, p, s in zip(inner, plain, splits)
        )
        found.append(Tree(feature, own["leftChild"].to_numpy(), own["rightChild"].to_numpy(), cover, value, np.array(threshold), sets))
    return TreeEnsemble(tuple(found), tuple(weights), trees.numFeatures)


def attributions(model: PipelineModel, prepared: DataFrame, ensemble: TreeEnsemble | None = None) -> DataFrame:
    """``prepared`` with ``contributions`` (an array in the order of the inputs) and ``base``; one Arrow pass."""
    ensemble = ensemble or ensemble_of(model)
    base = ensemble.base()
    shared = prepared.sparkSession.sparkContext.broadcast(ensemble)

    @F.pandas_udf("array<double>")
    def explain(features: pd.Series) -> pd.Series:
        rows = np.stack(features.to_list()) if len(features) else np.empty((0, shared.value.inputs))
        return pd.Series(list(shared.value.contributions(rows)))

    ready = prepared
    for step in model.stages[:-1]:
        ready = step.transform(ready)
    explained = ready.withColumn("contributions", explain(vector_to_array(F.col("features"))))
    return explained.select(*prepared.columns, "contributions").withColumn("base", F.lit(base))


def tree_reasons(
    model: PipelineModel, prepared: DataFrame, top: int = 5, names: Sequence[str] = (CATEGORY, *NUMERIC),
    ensemble: TreeEnsemble | None = None,
) -> DataFrame:
    """``prepared`` with ``top_reasons``: the inputs with the largest contributions, as in ``scoring.top_reasons``.

    Contributions are on the scale of the raw margin. The category has no number as value. Equal
    contributions are in the order of the inputs.
    """
    explained = attributions(model, prepared, ensemble)
    shares = F.array(*[
        F.struct(
            (-F.abs(F.get("contributions", i))).alias("order"),
            F.lit(i).alias("place"),
            F.lit(name).alias("feature"),
            F.round(F.get("contributions", i), 4).alias("contribution"),
            (F.lit(None) if name == CATEGORY else F.round(F.col(name), 3)).cast("double").alias("value"),
        )
        for i, name in enumerate(names)
    ])
    best = F.transform(
        F.slice(F.array_sort(shares), 1, top),
        lambda r: F.struct(r["feature"].alias("feature"), r["contribution"].alias("contribution"), r["value"].alias("value")),
    )
    return explained.withColumn("top_reasons", best).drop("contributions", "base")
