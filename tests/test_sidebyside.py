"""Jobs side by side: same results as one after another, failures and late ones stay their own."""

import threading
import time

import pytest

from fleetlife.models import bakeoff, classifiers
from fleetlife.models.sidebyside import Late, side_by_side
from fleetlife.plans.registry import _splits


def test_results_and_failures(spark):
    jobs = {f"n{k}": (lambda k=k: spark.range(k).count()) for k in range(1, 6)}
    jobs["bad"] = lambda: 1 / 0
    found = side_by_side(spark, jobs, workers=3)
    assert {k: v for k, v in found.items() if k != "bad"} == {f"n{k}": k for k in range(1, 6)}
    assert isinstance(found["bad"], ZeroDivisionError)
    assert side_by_side(spark, {}) == {}


@pytest.mark.parametrize("workers", [1, 2])
def test_no_more_at_a_time(spark, workers):
    lock, now, most = threading.Lock(), [0], [0]

    def job():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        with lock:
            now[0] -= 1

    side_by_side(spark, {str(k): job for k in range(5)}, workers)
    assert most[0] == workers


def slow(spark, seconds):
    def wait(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return spark.range(2).repartition(2).mapInArrow(wait, "id long").count()


def test_late_job_is_cancelled(spark):
    """It ends at its limit, though its tasks would go on; the other one is not touched."""
    started = time.monotonic()
    found = side_by_side(spark, {"hangs": lambda: slow(spark, 120), "short": lambda: slow(spark, 1)}, 2, limit_seconds=8)
    assert time.monotonic() - started < 60
    assert isinstance(found["hangs"], Late) and found["short"] == 2
    assert spark.range(7).count() == 7  # the session goes on


def test_same_board_as_serial(spark, monkeypatch):
    splits = _splits(spark, "/root/testdata/sf0.001")
    params = {"boosted_trees": {"maxIter": 2, "maxDepth": 2}, "random_forest": {"numTrees": 3, "maxDepth": 2, "minInstancesPerNode": 5}}
    monkeypatch.setitem(classifiers.CLASSIFIERS, "broken", (lambda categories, params, numeric: 1 / 0, False))
    models = ["boosted_trees", "random_forest", "broken"]
    boards = [
        bakeoff.run_bakeoff(splits, models, params, workers=w).drop("fit_seconds").orderBy("model", "split").collect() for w in (1, 3)
    ]
    assert boards[0] == boards[1] and [r.status for r in boards[0]].count("failed") == 1
