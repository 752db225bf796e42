"""Jobs from folder to folder, for a scheduler or the command line."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.contracts import Settings, feature_columns
from fleetlife.models import bakeoff
from fleetlife.models.publish import Artifacts, fleet_scorecard, publish, score_rows
from fleetlife.operators import eda
from fleetlife.operators.drift import drift_summary, retrain_decision
from fleetlife.operators.driftsketch import day_categories, day_sketches, sketched_drift_report
from fleetlife.operators.lifecycle import fleet_totals
from fleetlife.operators.scoring import alert_counts, request_features
from fleetlife.operators.sequences import sequence_dataset
from fleetlife.plans.datasets import dataset_job, life_history_job, write_table
from fleetlife.plans.monitoring import mlops_loop, monitor
from fleetlife.session import stage
from fleetlife.sources.panel import (
    add_to_panel,
    in_quarters,
    path_exists,
    read_day_files,
    read_header,
    read_panel,
    read_zipped_header,
    read_zipped_quarters,
    with_quarter,
    write_report,
)


def header_of(spark: SparkSession, inputs: Sequence[str]) -> list[str]:
    """Column names of the inputs: of a day file in a folder, or of the first one in an archive."""
    folders = [p for p in inputs if not p.endswith(".zip")]
    return read_header(spark, folders) if folders else read_zipped_header(spark, inputs[0])


def ingest(spark: SparkSession, inputs: Sequence[str], header: Sequence[str], out: str) -> DataFrame:
    """Zip archives and folders of day files, all of them, into the stored panel.

    Returns the audit of the quarters that came in, as they are stored now.
    """
    zipped = [p for p in inputs if p.endswith(".zip")]
    folders = [p for p in inputs if not p.endswith(".zip")]
    parts = [read_zipped_quarters(spark, zipped, header)] if zipped else []
    parts += [read_day_files(spark, folders, header)] if folders else []
    raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    days = stage(raw)  # parsed once
    add_to_panel(days, f"{out}/panel")
    stored = spark.read.parquet(f"{out}/panel")
    touched = [r[0] for r in with_quarter(days.select("date")).select("quarter").distinct().collect()]
    return eda.ingest_audit(in_quarters(stored, touched))


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return read_panel(spark, f"{root}/panel"), spark.read.parquet(f"{root}/drive_summary")


def life_history(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    life_history_job(read_panel(spark, f"{root}/panel"), root, settings)
    return fleet_totals(spark.read.parquet(f"{root}/drive_summary"))


def fleet_report(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """All fleet statistics as small report tables; returns the key figures."""
    labels = spark.read.parquet(f"{root}/labels")
    summary = spark.read.parquet(f"{root}/drive_summary")
    reports = {
        "label_balance": eda.label_balance(labels, settings.horizons),
        "failures_by_month": eda.failures_by_month(labels),
        "model_failure_rates": eda.model_failure_rates(summary, settings.min_drives),
        "rul_histogram": eda.rul_histogram(labels),
        "fleet_kpis": eda.fleet_kpis(summary),
    }
    for name, table in reports.items():
        write_report(table, f"{root}/reports/{name}")
    return reports["fleet_kpis"]


def datasets(spark: SparkSession, root: str, settings: Settings, kind: str) -> dict[str, DataFrame]:
    """Write one dataset kind: big5, full, rolling, survival or sequences."""
    panel, summary = _tables(spark, root)
    if kind != "sequences":
        return dataset_job(panel, summary, f"{root}/datasets", settings, kind)
    written = {}
    for name, span in settings.splits.items():
        path = f"{root}/datasets/sequences/{name}"
        write_table(sequence_dataset(panel, summary, span), path)
        written[name] = spark.read.parquet(path)
    return written


def _read_splits(spark: SparkSession, root: str, kind: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/datasets/{kind}/{n}") for n in ("train", "val", "test")}


def compare_classifiers(
    spark: SparkSession, root: str, settings: Settings | None = None, kind: str = "rolling"
) -> DataFrame:
    """Leaderboard on one dataset kind: rolling, big5 or full."""
    beta = (settings or Settings()).fbeta
    return bakeoff.run_bakeoff(_read_splits(spark, root, kind), log_path=f"{root}/runs/classifiers", beta=beta)


def compare_horizons(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """Leaderboards of the rolling features for each horizon of the settings."""
    panel, summary = _tables(spark, root)
    return bakeoff.run_horizons(panel, summary, settings)


def compare_survival(spark: SparkSession, root: str) -> DataFrame:
    splits = _read_splits(spark, root, "survival")
    return bakeoff.run_survival_bakeoff(splits["train"], splits["test"], log_path=f"{root}/runs/survival")


def search(spark: SparkSession, root: str, model: str, trials: int = 20) -> DataFrame:
    """Search settings of a model and keep the trials; production training uses the best one."""
    results = bakeoff.tune(_read_splits(spark, root, "rolling"), model, trials)
    write_table(results, f"{root}/search/{model}")
    return spark.read.parquet(f"{root}/search/{model}")


def best_settings(spark: SparkSession, root: str, model: str) -> dict[str, Any] | None:
    """The best setting that ``search`` has found for a model, if it was run."""
    path = f"{root}/search/{model}"
    if not path_exists(spark, path):
        return None
    return json.loads(spark.read.parquet(path).where("is_best").first().params)


def train_production(spark: SparkSession, root: str, settings: Settings, healthy: int | None = None) -> Artifacts:
    artifacts = publish(*_tables(spark, root), settings, healthy, best_settings(spark, root, "boosted_trees"))
    artifacts.save(f"{root}/models")
    return artifacts


def score_fleet(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """Write the scorecard of the newest span and the number of units per alert level."""
    artifacts = Artifacts.load(spark, f"{root}/models")
    card = fleet_scorecard(*_tables(spark, root), settings.splits["test"], artifacts)
    write_table(card, f"{root}/scorecard")
    counts = alert_counts(spark.read.parquet(f"{root}/scorecard"))
    write_report(counts, f"{root}/reports/alert_counts")
    return counts


def score_requests(spark: SparkSession, root: str, requests: str, keys: Sequence[str]) -> DataFrame:
    """Score a Parquet table of requests with nested histories."""
    wide = request_features(spark.read.parquet(requests)).select(*keys, *feature_columns())
    return score_rows(wide, Artifacts.load(spark, f"{root}/models"))


def sketch_days(spark: SparkSession, root: str, quarters: Sequence[str] | None = None) -> DataFrame:
    """Write the tables of days from which windows can be compared; all quarters of the panel, or some.

    Returns the days and values in them.
    """
    panel = read_panel(spark, f"{root}/panel")
    panel = in_quarters(panel, quarters) if quarters else panel
    for name, table in (("day_sketches", day_sketches(panel)), ("day_categories", day_categories(panel))):
        writer = with_quarter(table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.option("compression", "zstd").partitionBy("quarter").parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/day_sketches").groupBy("quarter", "feature").agg(F.count("*").alias("days"), F.sum("n").alias("n"))


def watch(spark: SparkSession, root: str, settings: Settings, sketched: bool = False) -> DataFrame:
    """Write the drift report and the decision; returns the decision.

    With ``sketched`` the report comes from the tables of days (see ``sketch_days``), without reading the panel.
    """
    if sketched:
        tables = (spark.read.parquet(f"{root}/{name}") for name in ("day_sketches", "day_categories"))
        report = stage(sketched_drift_report(*tables, settings.splits["train"], settings.splits["test"]))
        decision = retrain_decision(drift_summary(report), None, None, settings.drift_share, settings.pr_auc_drop)
    else:
        report, decision = monitor(read_panel(spark, f"{root}/panel"), settings)
    write_report(report, f"{root}/reports/drift")
    write_report(drift_summary(report), f"{root}/reports/drift_summary")
    return decision


def loop(spark: SparkSession, root: str, settings: Settings) -> bool:
    """Watch, compare the quality of the published models, and publish new ones when needed.

    New models take the best setting that ``search`` has stored, as ``train_production`` does.
    """
    current = Artifacts.load(spark, f"{root}/models")
    tuned = best_settings(spark, root, "boosted_trees")
    result = mlops_loop(read_panel(spark, f"{root}/panel"), settings, current=current, params=tuned)
    write_report(result.report, f"{root}/reports/drift")
    if result.artifacts is not None:
        result.artifacts.save(f"{root}/models")
    return result.artifacts is not None
