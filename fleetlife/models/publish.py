"""Production training: classifier, remaining life, calibration and alert thresholds together."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.contracts import Settings, Span
from fleetlife.functions.labels import clean_rul
from fleetlife.models.attributions import TreeEnsemble, ensemble_of, tree_reasons
from fleetlife.models.classifiers import fit_classifier, prepare, score
from fleetlife.models.weibull import WeibullModel, fit_weibull_ridge, predict_weibull_ridge
from fleetlife.operators.encode import codebook
from fleetlife.operators.rankmetrics import average_precision, operating_points, rank_curve
from fleetlife.operators.scoring import with_alerts
from fleetlife.plans.datasets import training_frame
from fleetlife.session import stage

#: Parameter: scores are rounded to this many decimals for calibration, which bounds its input at
#: 1,000,001 rows.
CALIBRATION_DECIMALS = 6


@dataclass
class Artifacts:
    """Everything scoring needs."""

    book: DataFrame
    categories: int
    classifier: PipelineModel
    rul: WeibullModel
    calibrator: IsotonicRegressionModel
    thresholds: dict[str, float | None]
    metadata: dict[str, Any]
    nodes: TreeEnsemble | None = None

    def explainer(self) -> TreeEnsemble:
        """The node arrays of the classifier, read once."""
        if self.nodes is None:
            self.nodes = ensemble_of(self.classifier)
        return self.nodes

    def save(self, path: str) -> None:
        self.book.write.mode("overwrite").parquet(f"{path}/codebook")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        text = json.dumps({"thresholds": self.thresholds, "metadata": self.metadata, "rul": self.rul.to_json()})
        spark = self.book.sparkSession
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/metadata"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifacts:
        book = spark.read.parquet(f"{path}/codebook")
        meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
        return cls(
            book,
            book.count(),
            PipelineModel.load(f"{path}/classifier"),
            WeibullModel.from_json(meta["rul"]),
            IsotonicRegressionModel.load(f"{path}/calibrator"),
            meta["thresholds"],
            meta["metadata"],
        )


def calibrate(scores: DataFrame) -> IsotonicRegressionModel:
    """Isotonic map from score to observed rate; values outside the seen range are clipped.

    The last pooling step of the estimator runs in one task, so rows are first averaged per score
    rounded to ``CALIBRATION_DECIMALS``, with their number as weight. Without the rounding that would
    leave the fit unchanged; with it, the map is that of scores with so many decimals.
    """
    cells = (
        scores.where(F.col("y").isNotNull())
        .groupBy(F.round("score", CALIBRATION_DECIMALS).alias("score"))
        .agg(F.avg(F.col("y").cast("double")).alias("y"), F.count("*").cast("double").alias("weight"))
    )
    return IsotonicRegression(featuresCol="score", labelCol="y", weightCol="weight").fit(cells)


def apply_calibration(model: IsotonicRegressionModel, scores: DataFrame) -> DataFrame:
    """Add ``probability``."""
    return model.setFeaturesCol("score").setPredictionCol("probability").transform(scores)


def publish(
    panel: DataFrame,
    summary: DataFrame,
    settings: Settings,
    healthy: int | None = None,
    params: dict[str, Any] | None = None,
) -> Artifacts:
    """Train on the train span; calibrate and set alert thresholds on the validation span."""
    frame = stage(training_frame(panel, summary, settings.splits["train"], settings.horizon, healthy))
    book = codebook(frame)
    categories = book.count()
    train = stage(prepare(frame, book, categories))
    known = train.where(F.col("y").isNotNull())
    classifier = fit_classifier("boosted_trees", known, categories, params)
    rul = fit_weibull_ridge(train)

    later = training_frame(panel, summary, settings.splits["val"], settings.horizon, healthy)
    val = stage(score(classifier, prepare(later, book, categories)).where(F.col("y").isNotNull()))
    calibrator = calibrate(val)
    curve = rank_curve(val)
    points = {r.budget: r.threshold for r in operating_points(curve).collect()}
    totals = train.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"),
    ).first()
    val_totals = curve.agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), average_precision().alias("ap")
    ).first()
    metadata = {
        "horizon": settings.horizon,
        "train_rows": totals.n,
        "class_pos": totals.pos,
        "class_neg": totals.neg,
        "val_pos": val_totals.pos,
        "val_neg": val_totals.neg,
        "val_pr_auc": val_totals.ap,
    }
    return Artifacts(book, categories, classifier, rul, calibrator, points, metadata)


def score_rows(rows: DataFrame, artifacts: Artifacts) -> DataFrame:
    """Full result per feature row: probability, remaining days, alert, agreement of the models, reasons.

    The reasons are those of the classifier whose probability is shown: Shapley values on its raw margin.
    """
    ready = prepare(rows, artifacts.book, artifacts.categories)
    ready = tree_reasons(artifacts.classifier, ready, ensemble=artifacts.explainer())
    ready = ready.withColumnRenamed("top_reasons", "reasons")
    predicted = predict_weibull_ridge(artifacts.rul, ready).drop("risk")
    scored = apply_calibration(artifacts.calibrator, score(artifacts.classifier, predicted))
    named = (
        scored.withColumn("raw_score", F.col("score"))
        .withColumn("failure_probability", F.col("probability"))
        .withColumn("rul_days", clean_rul(F.col("pred_time")))
        .drop("score", "probability", "pred_time")
    )
    limits = artifacts.thresholds
    return with_alerts(named, limits.get("fpr_0_1pct"), limits.get("fpr_1pct"))


def fleet_scorecard(
    panel: DataFrame, summary: DataFrame, span: Span, artifacts: Artifacts
) -> DataFrame:
    """One row per unit of the whole fleet, from its newest day in the span."""
    latest = training_frame(
        panel, summary, span, artifacts.metadata["horizon"], latest_only=True
    ).drop("y", "event", "duration")
    # Scoring drops the inputs, the card shows two of them.
    shown = latest.withColumns(
        {"shown_capacity": F.bround("capacity_gb", 0), "shown_age": F.col("drive_age_days")}
    )
    return score_rows(shown, artifacts).select(
        "serial_number",
        "model",
        F.col("shown_capacity").alias("capacity_gb"),
        F.col("shown_age").alias("drive_age_days"),
        F.bround("failure_probability", 4).alias("failure_probability"),
        F.bround("rul_days", 0).alias("rul_days"),
        "raw_score",
        "alert_level",
        "models_agree",
        "confidence",
        "note",
        "reasons",
    ).orderBy(F.col("failure_probability").desc(), "serial_number")
