"""Tree attributions against the definition: all subsets of inputs, one tree walk each."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleetlife.models.attributions import Tree, TreeEnsemble, attributions, ensemble_of, path_values, tree_reasons
from fleetlife.session import stage

INPUTS = ["c", "a", "b", "d"]


def expectation(tree, row, known, node=0):
    """What the tree says when only some inputs are known."""
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if tree.feature[node] in known:
        value, sets = row[tree.feature[node]], tree.categories[node]
        goes = value <= tree.threshold[node] if sets is None else value in sets
        return expectation(tree, row, known, left if goes else right)
    parts = [tree.cover[left], tree.cover[right]]
    return sum(p * expectation(tree, row, known, n) for p, n in zip(parts, (left, right))) / sum(parts)


def enumerated(ensemble, row):
    """Shapley values by all 2**p subsets."""
    p = ensemble.inputs
    value = {
        s: sum(w * expectation(t, row, s) for t, w in zip(ensemble.trees, ensemble.weights))
        for k in range(p + 1) for s in map(frozenset, itertools.combinations(range(p), k))
    }
    out = np.zeros(p)
    for s, v in value.items():
        for i in set(range(p)) - s:
            out[i] += math.factorial(len(s)) * math.factorial(p - len(s) - 1) / math.factorial(p) * (value[s | {i}] - v)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for _ in range(400):
        c, a, b, d = float(rng.randrange(5)), rng.random(), rng.random(), rng.random()
        data.append((c, a, b, d, int((c in (1.0, 3.0)) * a + b * d + rng.gauss(0, 0.2) > 0.6)))
    nominal = {"ml_attr": {"type": "nominal", "name": "c", "num_vals": 5}}
    frame = spark.createDataFrame(data, "c double, a double, b double, d double, y int")
    return stage(frame).withColumn("c", F.col("c").alias("c", metadata=nominal))


def fitted(rows, trees):
    return Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features"), trees]).fit(rows)


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_equal_to_enumeration_and_to_the_score(rows, kind):
    trees = (
        GBTClassifier(labelCol="y", maxIter=6, maxDepth=4, stepSize=0.3, seed=1)
        if kind == "boosted"
        else RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=4, seed=1)
    )
    model = fitted(rows, trees)
    ensemble = ensemble_of(model)
    assert any(s is not None for t in ensemble.trees for s in t.categories)  # splits by category occur
    explained = attributions(model, rows, ensemble)
    scored = model.transform(explained).select("*", vector_to_array("rawPrediction").alias("raw"), vector_to_array("probability").alias("p"))
    for r in scored.collect():
        expected = r.raw[1] if kind == "boosted" else r.p[1]
        assert sum(r.contributions) + r.base == pytest.approx(expected, abs=1e-9)
    for r in scored.limit(25).collect():
        assert r.contributions == pytest.approx(enumerated(ensemble, [r.c, r.a, r.b, r.d]), abs=1e-9)


@pytest.mark.parametrize("seed", range(8))
def test_path_values_by_subsets(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 7))
    shares = rng.random(m) * (rng.random(m) > 0.2)
    patterns = (rng.random((5, m)) > 0.5).astype(float)
    for pattern, got in zip(patterns, path_values(shares, patterns)):
        for i in range(m):
            rest, want = [j for j in range(m) if j != i], 0.0
            for k in range(m):
                for s in itertools.combinations(rest, k):
                    product = np.prod([pattern[j] if j in s else shares[j] for j in rest])
                    want += math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * product
            if shares[i] > 0 or pattern[i] > 0:
                assert got[i] == pytest.approx(want * (pattern[i] - shares[i]), abs=1e-12)
            else:
                assert got[i] == 0


def test_one_input_twice_on_a_path():
    """Splits on one input along a path are one condition of the game."""
    tree = Tree(
        np.array([0, 0, -1, -1, -1]), np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]),
        np.array([10.0, 6.0, 2.0, 4.0, 4.0]), np.array([0, 0, 1.0, 5.0, 9.0]), np.array([5.0, 2.0, 0, 0, 0]), (None,) * 5,
    )
    ensemble = TreeEnsemble((tree,), (1.0,), 2)
    got = ensemble.contributions(np.array([[1.0, 0.0], [3.0, 0.0], [8.0, 0.0]]))
    assert ensemble.base() == pytest.approx(0.2 * 1 + 0.4 * 5 + 0.4 * 9)
    assert got[:, 0] == pytest.approx(np.array([1.0, 5.0, 9.0]) - ensemble.base()) and not got[:, 1].any()


def test_reasons(rows):
    model = fitted(rows, GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1))
    whole = attributions(model, rows).collect()
    short = tree_reasons(model, rows, top=2, names=INPUTS).collect()
    for r, s in zip(whole, short):
        assert [x.feature for x in s.top_reasons] == [INPUTS[i] for i in np.argsort(-np.abs(r.contributions), kind="stable")[:2]]
        assert s.top_reasons[0].contribution == round(max(r.contributions, key=abs), 4)
        assert set(s.asDict()) == {*INPUTS, "y", "top_reasons"}
    assert tree_reasons(model, rows.where("a > 2"), names=INPUTS).count() == 0


def test_other_models_are_refused(rows):
    with pytest.raises(TypeError):
        ensemble_of(Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features")]).fit(rows))
