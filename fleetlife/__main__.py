"""Command line: ``python -m fleetlife <job> --root FOLDER [--config settings.json] ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from fleetlife.contracts import Settings
from fleetlife.plans import jobs
from fleetlife.session import JOB_CONF, drop_staged

JOBS = [
    "ingest",
    "life-history",
    "fleet-report",
    "datasets",
    "compare-classifiers",
    "compare-horizons",
    "compare-survival",
    "search",
    "train",
    "score-fleet",
    "watch",
    "sketch-days",
    "loop",
]


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fleetlife")
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--root", required=True, help="folder of all tables, shared by the executors")
    parser.add_argument("--config", help="settings as JSON; the published ones by default")
    parser.add_argument("--inputs", nargs="+", default=[], help="ingest: zip archives and folders")
    parser.add_argument("--header", nargs="+", help="ingest: column names, those of the first day file by default")
    parser.add_argument("--kind", default="rolling", help="datasets: big5, full, rolling, survival, sequences")
    parser.add_argument("--model", default="boosted_trees", help="search: model name")
    parser.add_argument("--trials", type=int, default=20)
    parser.add_argument("--sketched", action="store_true", help="watch: from the tables of days")
    parser.add_argument("--healthy", type=int, help="train: number of healthy units, all by default")
    return parser.parse_args(arguments)


def run(spark: SparkSession, options: argparse.Namespace) -> DataFrame | None:
    settings = Settings()
    if options.config:
        text = "\n".join(r.value for r in spark.read.text(options.config, wholetext=True).collect())
        settings = Settings.from_dict(json.loads(text))
    root = options.root
    match options.job:
        case "ingest":
            header = options.header or jobs.header_of(spark, options.inputs)
            return jobs.ingest(spark, options.inputs, header, root)
        case "life-history":
            return jobs.life_history(spark, root, settings)
        case "fleet-report":
            return jobs.fleet_report(spark, root, settings)
        case "datasets":
            jobs.datasets(spark, root, settings, options.kind)
        case "compare-classifiers":
            return jobs.compare_classifiers(spark, root, settings, options.kind)
        case "compare-horizons":
            return jobs.compare_horizons(spark, root, settings)
        case "compare-survival":
            return jobs.compare_survival(spark, root)
        case "search":
            return jobs.search(spark, root, options.model, options.trials)
        case "train":
            jobs.train_production(spark, root, settings, options.healthy)
        case "score-fleet":
            return jobs.score_fleet(spark, root, settings)
        case "watch":
            return jobs.watch(spark, root, settings, options.sketched)
        case "sketch-days":
            return jobs.sketch_days(spark, root)
        case "loop":
            print("published new models" if jobs.loop(spark, root, settings) else "models kept")
    return None


def main() -> None:
    options = parse()
    builder = SparkSession.builder.appName(f"fleetlife {options.job}")
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    table = run(spark, options)
    if table is not None:
        table.show(100, truncate=False)
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
