"""Fit several models, evaluate them on later splits, and rank them in one table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.contracts import FBETA, Settings
from fleetlife.models import survival as sv
from fleetlife.models.classifiers import CLASSIFIERS, fit_classifier, numeric_inputs, prepare, score
from fleetlife.models.search import search
from fleetlife.models.sidebyside import side_by_side
from fleetlife.models.survival_forest import fit_survival_forest, predict_survival_forest
from fleetlife.models.weibull import fit_weibull_ridge, predict_weibull_ridge
from fleetlife.operators.encode import category_means, codebook, ordered_means, with_category_mean
from fleetlife.operators.rankmetrics import average_precision, classification_bundle, rank_curve
from fleetlife.operators.survmetrics import survival_bundle
from fleetlife.plans.datasets import rolling_split
from fleetlife.session import stage

BOARD = (
    "model string, split string, status string, error string, fit_seconds double, n bigint, "
    "positives bigint, pr_auc double, roc_auc double, brier double, fbeta double, "
    "recall_fpr_1pct double, recall_fpr_0_1pct double"
)
SURVIVAL_BOARD = (
    "model string, split string, status string, error string, fit_seconds double, n bigint, "
    "events bigint, c_index double, rul_mae_days double, rul_median_true_days double"
)


#: Classifiers that take the category as an ordered label mean.
NEED_MEANS = {"ordered_boost"}


def prepared_splits(
    splits: Mapping[str, DataFrame], fill: bool = False, means: bool = False
) -> tuple[dict[str, DataFrame], int]:
    """Encode all splits with the categories of train and write them once.

    ``fill`` makes unknown readings 0, for models that take them as they come. With ``means`` rows also get the
    label mean of their category: of earlier rows in train, of all training rows in the others.
    """
    book = codebook(splits["train"])
    categories = book.count()
    numeric = numeric_inputs(splits["train"].columns)
    ready = {name: stage(prepare(df, book, categories, fill, numeric)) for name, df in splits.items()}
    if means:
        table, prior = category_means(ready["train"])
        ready = {
            name: stage(ordered_means(df, prior=prior) if name == "train" else with_category_mean(df, table, prior))
            for name, df in ready.items()
        }
    return ready, categories


def _log(board: DataFrame, path: str | None) -> DataFrame:
    if path is not None:
        board.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
    return board


def _lines(results: Mapping[str, Any], models: Sequence[str], metrics: int) -> list[tuple]:
    """Board lines of all models in order; one without metrics for a model that failed."""
    lines = []
    for name in models:
        found = results[name]
        if isinstance(found, Exception):
            found = [(name, None, "failed", f"{type(found).__name__}: {found}", None, *[None] * metrics)]
        lines += found
    return lines


def run_bakeoff(
    splits: Mapping[str, DataFrame],
    models: Sequence[str] = tuple(CLASSIFIERS),
    params: Mapping[str, Mapping[str, Any]] | None = None,
    log_path: str | None = None,
    beta: float = FBETA,
    workers: int = 2,
    limit_seconds: float | None = None,
) -> DataFrame:
    """Leaderboard of classifiers; a model that fails or is late gets a line with its error.

    ``workers`` models are fitted side by side (see ``sidebyside``); the board is that of one after another.

    ``splits`` are tables of one dataset kind named train, val and test; the inputs are its numeric
    feature columns. Only one row of metrics per model and split reaches the driver.
    """
    spark = splits["train"].sparkSession
    ready, categories = prepared_splits(splits, means=bool(set(models) & NEED_MEANS))

    def one(name: str) -> list[tuple]:
        started = time.monotonic()
        model = fit_classifier(name, ready["train"], categories, (params or {}).get(name))
        seconds = round(time.monotonic() - started, 3)
        found = []
        for split in ("val", "test"):
            m = classification_bundle(score(model, ready[split]), beta=beta).first()
            found.append(
                (name, split, "ok", None, seconds, m.n, m.positives, m.pr_auc, m.roc_auc, m.brier,
                 m.fbeta and m.fbeta.fbeta, m.fpr_1pct.recall, m.fpr_0_1pct.recall)
            )
        return found

    lines = _lines(side_by_side(spark, {n: partial(one, n) for n in models}, workers, limit_seconds), models, 8)
    board = spark.createDataFrame(lines, BOARD)
    return _log(board.orderBy("split", F.col("pr_auc").desc_nulls_last(), "model"), log_path)


def run_horizons(
    panel: DataFrame,
    summary: DataFrame,
    settings: Settings,
    models: Sequence[str] = ("boosted_trees",),
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Leaderboards of the rolling features for each horizon of the settings."""
    boards = []
    for horizon in settings.horizons:
        splits = {
            name: rolling_split(panel, summary, span, horizon, settings.negatives_per_positive if name == "train" else None)
            for name, span in settings.splits.items()
        }
        board = run_bakeoff(splits, models, params, beta=settings.fbeta)
        boards.append(board.withColumn("horizon", F.lit(horizon)))
    return reduce(DataFrame.unionByName, boards)


def run_survival_bakeoff(
    train: DataFrame,
    test: DataFrame,
    models: Sequence[str] = ("weibull", "cox", "hazard_forest", "survival_forest"),
    log_path: str | None = None,
    workers: int = 2,
    limit_seconds: float | None = None,
) -> DataFrame:
    """Leaderboard of remaining-life models on survival tables; fits run side by side as in ``run_bakeoff``.

    Models are fitted to all rows of ``train`` whose outcome is known, and every row of ``test`` is evaluated.
    """
    spark = train.sparkSession
    known = {"train": train.where(F.col("event").isin(0, 1)), "test": test}
    ready, categories = prepared_splits(known, fill=True)
    ready = {name: sv.positive_durations(df) for name, df in ready.items()}
    runs: dict[str, tuple[Callable, Callable]] = {
        "weibull": (fit_weibull_ridge, predict_weibull_ridge),
        "cox": (sv.fit_cox, sv.predict_cox),
        "hazard_forest": (lambda df: sv.fit_hazard_forest(df, categories, all_rows=True), sv.predict_hazard_forest),
        "survival_forest": (fit_survival_forest, predict_survival_forest),
    }

    def one(name: str) -> list[tuple]:
        started = time.monotonic()
        fit, predict = runs[name]
        model = fit(ready["train"])
        seconds = round(time.monotonic() - started, 3)
        scored = stage(predict(model, ready["test"]).select("duration", "event", "risk", "pred_time"))
        m = survival_bundle(scored, time="duration").first()
        return [(name, "test", "ok", None, seconds, m.n, m.events, m.c_index, m.rul_mae_days, m.rul_median_true_days)]

    lines = _lines(side_by_side(spark, {n: partial(one, n) for n in models}, workers, limit_seconds), models, 5)
    board = spark.createDataFrame(lines, SURVIVAL_BOARD)
    return _log(board.orderBy(F.col("c_index").desc_nulls_last(), "model"), log_path)


# Search ranges per model, as (kind, low, high).
SPACES: dict[str, dict[str, tuple[str, float, float]]] = {
    "boosted_trees": {
        "maxDepth": ("int", 3, 8),
        "stepSize": ("log", 0.02, 0.2),
        "maxIter": ("int", 20, 100),
        "subsamplingRate": ("float", 0.6, 1.0),
        "minInstancesPerNode": ("int", 10, 200),
    },
    "ordered_boost": {
        "maxDepth": ("int", 3, 8),
        "stepSize": ("log", 0.02, 0.2),
        "maxIter": ("int", 20, 100),
        "subsamplingRate": ("float", 0.6, 1.0),
    },
    "random_forest": {
        "numTrees": ("int", 50, 200),
        "maxDepth": ("int", 6, 15),
        "minInstancesPerNode": ("int", 10, 200),
    },
    "logistic": {"regParam": ("log", 1e-5, 1e-1), "elasticNetParam": ("float", 0.0, 1.0)},
}


def tune(
    splits: Mapping[str, DataFrame],
    model: str,
    trials: int = 20,
    space: Mapping[str, tuple[str, float, float]] | None = None,
    seed: int = 42,
    random_only: bool = False,
) -> DataFrame:
    """Seeded search for the best average precision on all of val: tree-structured Parzen, or random.

    The best setting is fitted again and evaluated on the whole test split. One line per trial,
    with the test metrics on the best one.
    """
    spark: SparkSession = splits["train"].sparkSession
    ready, categories = prepared_splits(splits, means=model in NEED_MEANS)

    def value(params: dict[str, Any]) -> float | None:
        fitted = fit_classifier(model, ready["train"], categories, params)
        return rank_curve(score(fitted, ready["val"])).agg(average_precision().alias("ap")).first().ap

    tried = search(space or SPACES[model], trials, value, seed, random_only)
    results = [(number, params, reached) for number, (params, reached) in enumerate(tried)]
    best = max(results, key=lambda r: (r[2] is not None, r[2] or 0.0))
    final = fit_classifier(model, ready["train"], categories, best[1])
    test = classification_bundle(score(final, ready["test"])).first()
    lines = [
        (model, n, json.dumps(p, sort_keys=True), v, n == best[0],
         test.pr_auc if n == best[0] else None, test.fpr_1pct.recall if n == best[0] else None)
        for n, p, v in results
    ]
    return spark.createDataFrame(
        lines,
        "model string, trial int, params string, val_pr_auc double, is_best boolean, "
        "test_pr_auc double, test_recall_fpr_1pct double",
    )
