"""Planted parameters are recovered; jobs run end to end; failures stay isolated."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.contracts import SMART_BIG5, feature_columns, rolling_columns
from fleetlife.functions.labels import clean_rul
from fleetlife.models import bakeoff, classifiers, publish
from fleetlife.models import survival as sv
from fleetlife.operators.rankmetrics import classification_bundle
from fleetlife.operators.scoring import alert_counts, request_features, top_reasons, with_alerts
from fleetlife.operators.survmetrics import censored_rul_loss, concordance
from fleetlife.plans import datasets, monitoring
from fleetlife.session import stage
from fleetlife.sources.testdata import EVENT_SETTINGS as S
from fleetlife.sources.testdata import events_panel

SMALL = {"maxIter": 3, "maxDepth": 3}


# --- planted survival data ---------------------------------------------------------------


def planted(spark, n, seed, draw):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, z = rng.normal(), rng.normal()
        life, leave = draw(rng, x, z), rng.uniform(2, 60)
        rows.append((i, float(x), float(z), int(max(1, math.ceil(min(life, leave)))), int(life <= leave)))
    return stage(spark.createDataFrame(rows, "id int, x double, z double, duration int, event int"))


def test_weibull_recovers_coefficient(spark):
    def life(rng, x, z):
        return math.exp(2 + 0.5 * x + 0.3 * math.log(rng.exponential()))

    model = sv.fit_weibull(planted(spark, 1500, 4, life), ["x"])
    aft = model.stages[-1]
    assert aft.coefficients[0] == pytest.approx(0.5, abs=0.08)
    assert aft.scale == pytest.approx(0.3, abs=0.08)


def test_cox_recovers_coefficients_and_ranks(spark):
    def life(rng, x, z):
        return rng.exponential() * 30 / math.exp(0.7 * x - 0.4 * z)

    frame = planted(spark, 4000, 5, life)
    model = sv.fit_cox(frame, ["x", "z"], penalty=0.0)
    b = model.coefficients / model.deviations
    assert b[0] == pytest.approx(0.7, abs=0.08) and b[1] == pytest.approx(-0.4, abs=0.08)
    predicted = sv.predict_cox(model, frame)
    assert concordance(predicted, "duration").first().c_index > 0.6
    r = predicted.agg(F.min("pred_time"), F.max("pred_time"), F.corr("risk", "pred_time")).first()
    assert 1 <= r[0] and r[1] <= 400 and r[2] < 0


def test_cox_penalty_shrinks(spark):
    frame = planted(spark, 500, 6, lambda rng, x, z: rng.exponential() * 20 / math.exp(x))
    free = sv.fit_cox(frame, ["x"], penalty=0.0).coefficients[0]
    held = sv.fit_cox(frame, ["x"], penalty=1.0).coefficients[0]
    assert 0 < held < free


def test_person_periods(spark):
    rows = spark.createDataFrame([(10, 1), (10, 0), (500, 0), (7, 1), (0, 1)], "duration int, event int")
    got = {
        (r.duration, r.event): (r.n, r.f)
        for r in sv.person_periods(rows).groupBy("duration", "event").agg(F.count("*").alias("n"), F.sum("fails").alias("f")).collect()
    }
    assert got == {(10.0, 1): (2, 1.0), (10.0, 0): (1, 0.0), (500.0, 0): (7, 0.0), (7.0, 1): (1, 1.0), (1.0, 1): (1, 1.0)}


def test_clean_rul(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, 0.2, 500.0, 33.0]
    frame = spark.createDataFrame([(v,) for v in odd], "p double")
    assert [r.r for r in frame.select(clean_rul(F.col("p")).alias("r")).collect()] == [400, 400, 1, 400, 1, 400, 33]


def test_censored_loss(spark):
    rows = [(10.0, 1, 12.0), (10.0, 1, 10.5), (10.0, 0, 4.0), (10.0, 0, 40.0)]
    frame = spark.createDataFrame(rows, "time double, event int, pred_time double")
    r = censored_rul_loss(frame).first()
    assert r.observed_loss == pytest.approx((1.5 + 0.125) / 2) and r.censored_loss == pytest.approx(3.0)


# --- classifiers on planted features -----------------------------------------------------


@pytest.fixture(scope="module")
def planted_splits(spark):
    """Rolling tables whose label follows two of the features and the model."""

    def make(seed, n):
        rng = random.Random(seed)
        rows = []
        for i in range(n):
            values = {c: rng.random() for c in feature_columns() if c != "model"}
            kind = rng.choice("abc")
            push = 3 * values["smart_5_raw"] + 2 * values["smart_5_raw_dev30"] + (kind == "a")
            y = int(push + rng.gauss(0, 0.5) > 4.0)
            rows.append((f"U{i}", kind, *[float(values[c]) for c in feature_columns() if c != "model"], y))
        names = ["serial_number", "model", *[c for c in feature_columns() if c != "model"], "y"]
        types = ["string", "string", *["double"] * 42, "int"]
        frame = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, types)))
        return stage(frame.withColumn("date", F.lit("2024-01-01").cast("date")))

    return {"train": make(1, 600), "val": make(2, 300), "test": make(3, 300)}


def test_bakeoff_beats_chance_and_isolates_failures(spark, planted_splits, tmp_path, monkeypatch):
    monkeypatch.setitem(classifiers.CLASSIFIERS, "broken", (lambda categories, params, numeric: 1 / 0, False))
    params = {"boosted_trees": SMALL, "random_forest": {"numTrees": 10, "maxDepth": 4, "minInstancesPerNode": 5}}
    log = str(tmp_path / "runs")
    board = bakeoff.run_bakeoff(
        planted_splits, ["boosted_trees", "random_forest", "logistic", "broken"], params, log
    ).collect()
    good = [r for r in board if r.status == "ok"]
    assert len(good) == 6 and all(r.roc_auc > 0.7 for r in good)
    bad = [r for r in board if r.status == "failed"]
    assert len(bad) == 1 and bad[0].model == "broken" and "ZeroDivisionError" in bad[0].error
    assert spark.read.parquet(log).count() == 7


def test_search_picks_the_best_trial(planted_splits):
    rows = bakeoff.tune(planted_splits, "boosted_trees", 2, {"maxDepth": ("int", 2, 3), "maxIter": ("int", 2, 4)}).collect()
    best = [r for r in rows if r.is_best]
    assert len(best) == 1 and best[0].val_pr_auc == max(r.val_pr_auc for r in rows)
    assert best[0].test_pr_auc is not None


def test_calibration_is_monotone_and_clipped(scores):
    model = publish.calibrate(scores)
    out = publish.apply_calibration(model, scores.select("score").unionByName(
        scores.sparkSession.createDataFrame([(-5.0,), (9.0,)], "score double")))
    rows = sorted((r.score, r.probability) for r in out.collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(rows, rows[1:]))
    assert rows[0][1] == rows[1][1] and rows[-1][1] == rows[-2][1]


# --- scoring -----------------------------------------------------------------------------


def test_request_vector_by_hand(spark):
    """Three days 3, unknown, 7: the gap is filled with 3, so the mean is 13 / 3."""
    readings = [(3.0, None, 5.0, 0.0, None), (None, 2.0, 5.0, 1.0, None), (7.0, None, 5.0, 0.0, None)]
    kind = ", ".join(f"{c}: double" for c in SMART_BIG5)
    frame = spark.createDataFrame(
        [("m", 2 * 10**12, 40, readings), ("n", 10**12, 1, []), ("n", 10**12, 1, readings[:1])],
        f"model string, capacity_bytes bigint, drive_age_days int, history array<struct<{kind}>>",
    )
    rows = request_features(frame).select(*feature_columns()).collect()
    assert all(v is not None and v == v for r in rows for v in r)
    three, none, one = rows
    assert three.capacity_gb == 2000 and three.smart_5_raw == 7 and three.smart_187_raw == 2
    for width in (7, 14, 30):
        assert three[f"smart_5_raw_rmean_{width}"] == pytest.approx(13 / 3)
        assert three[f"smart_5_raw_rstd_{width}"] == pytest.approx(math.sqrt(16 / 3))
        assert three[f"smart_188_raw_rstd_{width}"] == 0 and three[f"smart_187_raw_rmean_{width}"] == pytest.approx(4 / 3)
    assert three.smart_5_raw_dev30 == pytest.approx(8 / 3)
    assert set(none[3:]) == {0.0}
    assert one.smart_5_raw_rmean_30 == 3 and one.smart_5_raw_rstd_30 == 0


def test_unknown_values_per_model(spark):
    """Boosted trees take unknown readings as 0; the others get the median of the training rows."""
    from fleetlife.operators.encode import codebook

    rng = random.Random(3)
    rows = []
    for i in range(400):
        wear = rng.choice([10.0, 20.0, 30.0])
        rows.append((f"u{i}", "m", 1.0, i, None if i % 4 == 0 else wear, 1.0, 1.0, 1.0, 1.0, int(wear > 15)))
    names = ["serial_number", "model", "capacity_gb", "drive_age_days", *SMART_BIG5, "y"]
    frame = spark.createDataFrame(rows, names)
    book = codebook(frame)
    numeric = classifiers.numeric_inputs(frame.columns)
    assert numeric == names[2:-1]  # the table of one day's readings has no rolling inputs
    kept = classifiers.prepare(frame, book, 1, fill=False, numeric_columns=numeric)
    assert kept.where("smart_5_raw IS NULL").count() == 100
    assert classifiers.prepare(frame, book, 1, numeric_columns=numeric).where("smart_5_raw = 0").count() == 100
    kept = stage(kept)
    forest = classifiers.fit_classifier("random_forest", kept, 1, {"numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 1})
    assert forest.stages[0].surrogateDF.first().smart_5_raw == 20.0
    boosted = classifiers.fit_classifier("boosted_trees", kept, 1, SMALL)
    lone = kept.where("smart_5_raw IS NULL").limit(1)
    zero, median = (lone.withColumn("smart_5_raw", F.lit(v)) for v in (0.0, 20.0))
    of = lambda model, rows: classifiers.score(model, rows).first().score
    assert of(boosted, lone) == of(boosted, zero) != of(boosted, median)
    assert of(forest, lone) == of(forest, median) != of(forest, zero)


def test_category_is_a_reason(spark):
    frame = spark.createDataFrame([(1.0, "bad"), (3.0, "good"), (2.0, None)], "a double, model string")
    rows = top_reasons(frame, {"a": (1.0, 1.0)}, category=("model", {"bad": 2.5, "good": -0.5})).collect()
    assert [[(r.feature, r.contribution) for r in row.top_reasons] for row in rows] == [
        [("model", 2.5), ("a", 0.0)], [("a", 2.0), ("model", -0.5)], [("a", 1.0), ("model", 0.0)]
    ]


def test_alert_rules(spark):
    frame = spark.createDataFrame([(0.95, 300.0), (0.6, 30.0), (0.1, 30.0), (0.1, 75.0), (0.1, 300.0)], "raw_score double, rul_days double")
    rows = with_alerts(frame, 0.9, 0.5).collect()
    assert [r.alert_level for r in rows] == ["critical", "warning", "watch", "ok", "ok"]
    assert [r.models_agree for r in rows] == [False, True, False, False, True]
    assert rows[0].note and rows[2].note and rows[4].note is None
    assert [r.alert_level for r in with_alerts(frame, None, None).collect()][:2] == ["ok", "watch"]
    assert {r.alert_level: r.drives for r in alert_counts(with_alerts(frame, 0.9, 0.5)).collect()}["ok"] == 2


def test_top_reasons_order(spark):
    frame = spark.createDataFrame([(1.0, -4.0, 2.0)], "a double, b double, c double")
    row = top_reasons(frame, {"a": (1.0, 0.0), "b": (1.0, 0.0), "c": (1.0, 0.0)}, top=2).first()
    assert [r.feature for r in row.top_reasons] == ["b", "c"]


# --- whole jobs --------------------------------------------------------------------------


def test_dataset_jobs_write_three_splits(spark, panel, summary, tmp_path):
    written = datasets.dataset_job(panel, summary, str(tmp_path), S, "rolling")
    assert set(written) == {"train", "val", "test"}
    assert dict(written["train"].dtypes)["smart_5_raw_rmean_7"] == "float"
    assert [c for c in written["val"].columns if c in feature_columns()] == feature_columns()
    survival = datasets.dataset_job(panel, summary, str(tmp_path), S, "survival")
    assert survival["test"].where("duration < 0").isEmpty()
    full = datasets.dataset_job(panel, summary, str(tmp_path), S, "full")
    assert full["val"].where("smart_5_raw IS NULL").count() > 0
    labels = datasets.life_history_job(panel, str(tmp_path / "life"), S)
    assert labels.count() == panel.count()


def test_unknown_units_stop_the_job(panel, summary):
    known = summary.where("serial_number <> 'U0-0'")
    with pytest.raises(ValueError):
        datasets.assert_all_known(panel, known)


def test_rolling_columns_order():
    names = rolling_columns(["a"], [2, 3])
    assert names == ["a_rmean_2", "a_rmean_3", "a_rstd_2", "a_rstd_3", "a_dev3"]


def test_publish_score_and_loop(spark, tmp_path):
    big = stage(events_panel(spark, "/root/testdata/sf0.01"))
    from fleetlife.operators.lifecycle import drive_summary

    lives = stage(drive_summary(big))
    artifacts = publish.publish(big, lives, S, params=SMALL)
    assert artifacts.metadata["class_pos"] > 0 and set(artifacts.thresholds) == {"fpr_1pct", "fpr_0_1pct"}
    card = publish.fleet_scorecard(big, lives, S.splits["test"], artifacts)
    rows = card.collect()
    last = S.splits["test"].first
    assert len(rows) == lives.where(F.col("last_date") >= F.lit(last)).count()
    assert all(0 <= r.failure_probability <= 1 and 1 <= r.rul_days <= 400 for r in rows)
    assert {r.alert_level for r in rows} <= {"ok", "watch", "warning", "critical"}

    artifacts.save(str(tmp_path / "store"))
    loaded = publish.Artifacts.load(spark, str(tmp_path / "store"))
    again = publish.fleet_scorecard(big, lives, S.splits["test"], loaded)
    assert again.exceptAll(card).isEmpty()

    calls = []
    calm = monitoring.mlops_loop(big, S, train=lambda *a, **k: calls.append(1))
    assert not calm.decision.retrain and calm.artifacts is None and not calls
    alarm = monitoring.mlops_loop(big, S, pr_auc_current=0.05, pr_auc_reference=0.4, train=lambda *a, **k: artifacts)
    assert alarm.decision.retrain and alarm.artifacts is artifacts
    told = monitoring.mlops_loop(big, S, pr_auc_current=0.05, pr_auc_reference=0.4, retrain_if_needed=False)
    assert told.decision.retrain and told.artifacts is None


def test_survival_forest_beats_chance(spark, panel, summary):
    train = datasets.survival_split(panel, summary, S.splits["train"])
    ready, categories = bakeoff.prepared_splits({"train": train}, fill=True)
    model = sv.fit_hazard_forest(ready["train"], categories, trees=10, depth=4)
    predicted = stage(sv.predict_hazard_forest(model, ready["train"]))
    assert predicted.count() == ready["train"].count()
    assert concordance(predicted, "duration").first().c_index > 0.5
