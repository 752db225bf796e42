"""Drift from daily sketches against the exact report, and ranks against their bound."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.contracts import Span
from fleetlife.operators.drift import drift_report
from fleetlife.operators.driftsketch import (
    _shares,
    day_categories,
    day_sketches,
    rank_error,
    sketched_drift_report,
    sketched_numeric_drift,
)
from fleetlife.session import stage

REF, CUR = Span(date(2024, 1, 1), date(2024, 1, 10)), Span(date(2024, 1, 11), date(2024, 1, 20))
FEATURES = ["moved", "same", "zeros", "ties"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(20):
        late = day >= 10
        for i in range(2_000):
            zero = 0.0 if rng.random() < 0.9 else float(rng.integers(1, 50))
            rows.append((date(2024, 1, 1) + timedelta(day), float(rng.normal(0.5 * late)), float(rng.normal()), zero,
                         float(rng.integers(0, 4 + 2 * late)), None if i % 50 == 0 else f"m{i % (3 + late)}"))
    frame = spark.createDataFrame(rows, "date date, moved double, same double, zeros double, ties double, model string")
    return stage(frame.repartition(6))


def test_close_to_the_exact_report(panel):
    exact = {r.feature: r for r in drift_report(panel, REF, CUR, FEATURES, ["model"]).collect()}
    sketched = sketched_drift_report(stage(day_sketches(panel, FEATURES)), stage(day_categories(panel, ["model"])), REF, CUR)
    ours = {r.feature: r for r in sketched.collect()}
    assert set(ours) == set(exact)
    for name, e in exact.items():
        o = ours[name]
        assert o.drifted == e.drifted and o.type == e.type and o.new_categories == e.new_categories
        assert o.psi == pytest.approx(e.psi, abs=0.02)
        if e.ks_stat is not None:
            assert o.ks_stat == pytest.approx(e.ks_stat, abs=2 * rank_error() + 5 / 1000)
    assert ours["model"].psi == exact["model"].psi  # counts are exact


@pytest.mark.parametrize("k", [100, 800])
def test_rank_error(panel, k):
    merged = day_sketches(panel, ["moved"], k).agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n"))
    asked = [i / 20 for i in range(1, 20)]
    row = merged.select("n", F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, asked))).alias("q")).first()
    values = np.sort([r.moved for r in panel.select("moved").collect()])
    assert row.n == len(values)
    off = [abs(np.searchsorted(values, q, "right") / len(values) - a) for a, q in zip(asked, row.q)]
    assert max(off) <= 1.5 * rank_error(k)
    assert rank_error(200) == pytest.approx(0.0133 + 0.0005, abs=1e-4)


def test_shares(spark):
    grid = [0.0] * 400 + [1.0] * 200 + [2.0] * 400
    frame = spark.createDataFrame([(grid, [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0])], "g array<double>, at array<double>")
    row = frame.select(_shares(F.col("g"), F.col("at"), False).alias("less"), _shares(F.col("g"), F.col("at"), True).alias("upto")).first()
    assert row.less == pytest.approx([0, 0, 0.4, 0.4, 0.6, 1]) and row.upto == pytest.approx([0, 0.4, 0.4, 0.6, 1, 1])


def test_few_and_no_values(spark, panel):
    rows = day_sketches(panel.where("date = '2024-01-02'").limit(20).withColumn("none", F.lit(None).cast("double")), ["moved", "none"])
    report = {r.feature: r for r in sketched_numeric_drift(rows, REF, CUR).collect()}
    assert report["moved"].psi is None and report["none"].psi is None and not report["moved"].drifted
    assert day_sketches(panel.where("moved > 99"), ["moved"]).count() == 0
