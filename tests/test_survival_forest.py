"""The log-rank forest against a tree grown row by row."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlife.models import bakeoff
from fleetlife.models import survival as sv
from fleetlife.models import survival_forest as sf
from fleetlife.operators.survmetrics import concordance
from fleetlife.session import stage

ENDS = tuple(range(1, 41))


def lives(n, seed, slope=1.0):
    """Two inputs that matter together, one alone, one not at all."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c, d = (float(v) for v in rng.integers(0, 8, 4))
        rate = math.exp(slope * (2.5 * (a > 3 and b > 2) + 0.25 * c) - 3.5)
        life, leave = rng.exponential() / rate, rng.uniform(5, 60)
        rows.append((f"u{i}", i, a, b, c, d, int(max(1, math.ceil(min(life, leave)))), int(life <= leave)))
    return rows


NAMES = "serial_number string, date int, a double, b double, c double, d double, duration int, event int"
CUTS = {name: [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0] for name in "abcd"}


def statistic(days, died, left):
    """Log-rank by going through the days."""
    apart = spread = 0.0
    for t in np.unique(days[died]):
        risk, d = days >= t, (days == t) & died
        y, y1, k, k1 = risk.sum(), (risk & left).sum(), d.sum(), (d & left).sum()
        apart += k1 - k * y1 / y
        if y > 1:
            spread += k * (y1 / y) * (1 - y1 / y) * (y - k) / (y - 1)
    return apart**2 / spread if spread > 1e-12 else 0.0


def brute_tree(x, days, died, depth, least, node=1):
    """Heap number to (input, threshold), or to the cumulative hazard of a leaf."""
    best = None
    if depth:
        for j, name in enumerate("abcd"):
            for k, t in enumerate(CUTS[name]):
                left = x[:, j] <= t
                if min(left.sum(), (~left).sum()) >= least:
                    value = statistic(days, died, left)
                    if value > 0 and (best is None or value > best[0] + 1e-9):
                        best = (value, j, k, left)
    if best is None:
        hazard, total = [], 0.0
        for t in ENDS:
            total += ((days == t) & died).sum() / max((days >= t).sum(), 1)
            hazard.append(total)
        return {node: hazard}
    _, j, k, left = best
    return {
        node: (j, k),
        **brute_tree(x[left], days[left], died[left], depth - 1, least, 2 * node),
        **brute_tree(x[~left], days[~left], died[~left], depth - 1, least, 2 * node + 1),
    }


def test_equals_a_tree_grown_by_rows(spark):
    rows = lives(500, 1)
    frame = stage(spark.createDataFrame(rows, NAMES).repartition(5))
    forest = sf.fit_survival_forest(frame, trees=1, depth=3, min_leaf=30, tries=4, bootstrap=False, ends=ENDS, thresholds=CUTS)
    x = np.array([r[2:6] for r in rows])
    days, died = np.array([r[6] for r in rows]), np.array([r[7] == 1 for r in rows])
    died &= days <= ENDS[-1]
    days = np.minimum(days, ENDS[-1])  # nothing is known beyond the last period
    expected = brute_tree(x, days, died, 3, 30)
    for node, what in expected.items():
        if isinstance(what, tuple):
            assert (forest.feature[0, node], forest.cut[0, node]) == what
        else:
            assert forest.feature[0, node] == -1
            assert forest.hazard[0, node] == pytest.approx(what)
    assert set(forest.hazard) == {(0, node) for node, what in expected.items() if isinstance(what, list)}


def test_table_of_cuts(spark):
    rows = lives(300, 2)
    frame = spark.createDataFrame(rows, NAMES)
    days, died = np.array([r[6] for r in rows]), np.array([r[7] == 1 for r in rows])
    x = np.array([r[2:6] for r in rows])
    table = sf.log_rank_table(frame, CUTS, range(1, 100)).collect()
    assert len(table) == 4 * 7
    for r in table:
        left = x[:, "abcd".index(r.feature)] <= r.threshold
        assert (r.n_left, r.deaths_left) == (left.sum(), (left & died).sum())
        assert r.statistic == pytest.approx(statistic(days, died, left))


def test_forest_ranks_better_than_the_hazard_forest(spark):
    """On lives that depend on two inputs together."""
    train = stage(spark.createDataFrame(lives(3000, 3), NAMES))
    test = stage(spark.createDataFrame(lives(1500, 4), NAMES))
    forest = sf.fit_survival_forest(train, list("abcd"), trees=20, depth=5, min_leaf=40, tries=2)
    ours = sf.predict_survival_forest(forest, test)
    extremes = ours.agg(F.min("pred_time"), F.max("pred_time"), F.count("risk")).first()
    assert 1 <= extremes[0] and extremes[1] <= 400 and extremes[2] == 1500
    reached = concordance(stage(ours), "duration").first().c_index
    named = {"a": "a", "b": "b", "c": "c", "d": "d"}
    padded = lambda df: df.select("*", *[F.lit(0.0).alias(c) for c in sv.INPUTS if c not in named])
    as_inputs = lambda df: padded(df).withColumns(dict(zip(sv.INPUTS[1:5], map(F.col, "abcd"))))
    hazard = sv.fit_hazard_forest(as_inputs(train), 1, trees=20, depth=5)
    theirs = concordance(stage(sv.predict_hazard_forest(hazard, as_inputs(test))), "duration").first().c_index
    assert reached > 0.7 and reached > theirs


def test_does_not_depend_on_partitions(spark):
    frame = spark.createDataFrame(lives(400, 5), NAMES)
    fit = lambda df: sf.fit_survival_forest(df, list("abcd"), trees=4, depth=3, min_leaf=20)
    one, many = fit(frame.coalesce(1)), fit(frame.repartition(7))
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all()
    assert all(np.allclose(one.hazard[k], many.hazard[k]) for k in one.hazard) and set(one.hazard) == set(many.hazard)


def test_passes_hold_the_counters(monkeypatch, spark):
    """Many small passes give the same forest as one."""
    frame = stage(spark.createDataFrame(lives(300, 6), NAMES))
    fit = lambda: sf.fit_survival_forest(frame, list("abcd"), trees=3, depth=3, min_leaf=20, thresholds=CUTS)
    whole = fit()
    monkeypatch.setattr(sf, "COUNTERS", 2 * 8 * len(sf.PERIODS) * 2)
    parts = fit()
    assert (whole.feature == parts.feature).all() and (whole.cut == parts.cut).all()


def test_a_task_sends_one_row_per_node_and_input():
    """However many cells have rows; the counts are those of the rows, weights included."""
    rng = np.random.default_rng(7)
    n, periods = 3000, 40
    bins, period, died = rng.integers(0, 16, (n, 3)).astype(np.uint8), rng.integers(0, periods, n), rng.random(n) < 0.3
    weight = rng.integers(0, 3, n)
    columns = [pa.array(np.arange(n)), pa.array(period, pa.int32()), pa.array(died), pa.array([b.tobytes() for b in bins])]
    batches = pa.Table.from_arrays(columns, ["id", "period", "died", "bins"]).to_batches(1000)
    level = sf._Level([16, 16, 16], periods, {0: [1], 1: [1]}, lambda tree, node: np.array([0, 2]))
    none = np.full((2, 4), -1)
    sent = pa.Table.from_batches(level.count(batches, none, none, 0, lambda ids, tree: weight[ids]))
    assert sent.num_rows == 4
    for row in sent.to_pylist():
        expected = np.zeros((2, 16 * periods), np.int64)
        np.add.at(expected[0], bins[:, row["feature"]].astype(int) * periods + period, weight)
        np.add.at(expected[1], bins[:, row["feature"]].astype(int) * periods + period, weight * died)
        cells = np.frombuffer(row["counts"], np.int32).reshape(-1, 3)
        assert (cells[:, 0] == np.flatnonzero(expected[0])).all()
        assert (cells[:, 1:].T == expected[:, cells[:, 0]]).all()


def test_bootstrap_weights():
    ids = np.arange(200_000)
    w = sf.poisson_weights(ids, 3, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w, sf.poisson_weights(ids, 4, 42))[0, 1]) < 0.02


def test_awkward_rows(spark):
    """Unknown inputs go right; no rows, or none that fail, give a leaf without hazard."""
    rows = [("u", 1, None, 1.0, 1.0, 1.0, 5, 1), ("v", 2, 1.0, 1.0, float("nan"), 1.0, 0, 0), ("v", 2, 1.0, 1.0, 1.0, 1.0, 900, 1)]
    frame = stage(spark.createDataFrame(rows, NAMES))
    forest = sf.fit_survival_forest(frame, trees=2, depth=2, min_leaf=1, ends=ENDS, thresholds=CUTS)
    assert sf.predict_survival_forest(forest, frame).count() == 3
    none = sf.fit_survival_forest(frame.where("duration < 0"), list("abcd"), trees=2, depth=2)
    assert none.hazard == {} and (none.feature == -1).all()
    calm = sf.fit_survival_forest(frame.where("event = 0"), trees=1, depth=2, bootstrap=False, ends=ENDS, thresholds=CUTS)
    assert calm.hazard[0, 1].max() == 0
    assert sf.predict_survival_forest(calm, frame).first().pred_time == 40


def test_in_the_bake_off(spark):
    from fleetlife.plans.registry import _survival

    tables = _survival(spark, "/root/testdata/sf0.001")
    board = bakeoff.run_survival_bakeoff(tables["train"], tables["test"], models=["survival_forest"]).collect()
    assert [(r.model, r.status) for r in board] == [("survival_forest", "ok")]
