"""The command line jobs, one after another on one folder."""

import pytest
from pyspark.sql import functions as F

from fleetlife.__main__ import parse, run
from fleetlife.contracts import SMART_BIG5
from fleetlife.plans import jobs, monitoring
from fleetlife.sources.testdata import EVENT_SETTINGS, events_panel

PANEL_COLUMNS = ["date", "serial_number", "model", "capacity_bytes", "failure", *SMART_BIG5]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Day files of the events panel, written as CSV."""
    folder = tmp_path_factory.mktemp("fleet")
    panel = events_panel(spark, "/root/testdata/sf0.01").select(*PANEL_COLUMNS)
    panel.repartition(4).write.option("header", True).csv(str(folder / "landing"))
    return folder


def test_jobs_in_order(spark, root):
    path = str(root)

    def job(*arguments):
        return run(spark, parse([*arguments, "--root", path]))

    audit = job("ingest", "--inputs", str(root / "landing")).first()
    assert audit.quarter == "2024-Q1" and audit.rows == 4006
    totals = jobs.life_history(spark, path, EVENT_SETTINGS).first()
    assert (totals.drives, totals.failed) == (198, 49)
    assert jobs.fleet_report(spark, path, EVENT_SETTINGS).first().total_drive_days == 4006
    assert spark.read.json(f"{path}/reports/label_balance").count() == 3

    rolling = jobs.datasets(spark, path, EVENT_SETTINGS, "rolling")
    assert rolling["train"].where("y = 1").count() > 0
    jobs.datasets(spark, path, EVENT_SETTINGS, "survival")
    sequences = jobs.datasets(spark, path, EVENT_SETTINGS, "sequences")
    types = dict(sequences["val"].dtypes)
    assert types["window"] == "array<array<float>>" and types["dur"] == "float"

    board = jobs.compare_survival(spark, path).collect()
    assert {r.status for r in board} == {"ok"} and len(board) == 4
    assert all(0 <= r.c_index <= 1 and r.rul_mae_days >= 0 for r in board)

    jobs.train_production(spark, path, EVENT_SETTINGS, healthy=100)
    counts = jobs.score_fleet(spark, path, EVENT_SETTINGS)
    assert counts.agg(F.sum("drives")).first()[0] == spark.read.parquet(f"{path}/scorecard").count()

    history = F.sort_array(F.collect_list(F.struct("date", *SMART_BIG5)))
    requests = spark.read.parquet(f"{path}/panel").groupBy("serial_number").agg(
        history.alias("history"),
        F.max("model").alias("model"),
        F.max("capacity_bytes").alias("capacity_bytes"),
        F.count("*").cast("int").alias("drive_age_days"),
    )
    requests.write.parquet(f"{path}/requests")
    scored = jobs.score_requests(spark, path, f"{path}/requests", ["serial_number"])
    assert scored.count() == 198 and scored.where("failure_probability IS NULL OR rul_days IS NULL").isEmpty()

    exact = jobs.watch(spark, path, EVENT_SETTINGS).first()
    assert exact.n_features == 7
    job("sketch-days")
    sketched = jobs.watch(spark, path, EVENT_SETTINGS, sketched=True).first()
    assert (sketched.n_features, sketched.n_drifted) == (exact.n_features, exact.n_drifted)
    assert isinstance(jobs.loop(spark, path, EVENT_SETTINGS), bool)


def test_loop_takes_the_best_settings(spark, root, monkeypatch):
    """What ``search`` has stored arrives at the training that the loop starts."""
    path, told = str(root), {}
    best = [("boosted_trees", 0, '{"maxDepth": 2, "maxIter": 3}', 0.5, True), ("boosted_trees", 1, '{"maxDepth": 9}', 0.1, False)]
    frame = spark.createDataFrame(best, "model string, trial int, params string, val_pr_auc double, is_best boolean")
    frame.write.mode("overwrite").parquet(f"{path}/search/boosted_trees")

    def watched(panel, settings, current=None, **options):
        told.update(options)
        return monitoring.LoopResult(spark.range(1), None, None)

    monkeypatch.setattr(jobs, "mlops_loop", watched)
    assert jobs.loop(spark, path, EVENT_SETTINGS) is False
    assert told == {"params": {"maxDepth": 2, "maxIter": 3}}
