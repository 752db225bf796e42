"""Ranking metrics for rare-event scores, computed on distinct scores instead of rows.

Rows with equal scores form one operating point, so results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.contracts import FBETA, FPR_BUDGETS
from fleetlife.operators.prefix import CELLS_PER_BUCKET, running_totals


def rank_curve(
    scores: DataFrame,
    label: str = "y",
    score: str = "score",
    groups: Sequence[str] = (),
    cells_per_bucket: int = CELLS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct score, from the highest down: true and false alarms so far.

    Columns: score, pos, neg, tp, fp (cumulative, including the score itself), p_total, n_total.
    """
    cells = (
        scores.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*groups, F.col(score).alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    totals = running_totals(
        cells, "score", ["pos", "neg"], groups, descending=True, cells_per_bucket=cells_per_bucket
    )
    return totals.select(
        *groups,
        "score",
        "pos",
        "neg",
        F.col("pos_upto").alias("tp"),
        F.col("neg_upto").alias("fp"),
        F.col("pos_total").alias("p_total"),
        F.col("neg_total").alias("n_total"),
    )


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return F.col("tp") / F.nullif(F.col("p_total"), F.lit(0))


def average_precision() -> Column:
    """Step sum of precision over recall gains (not the trapezoid area)."""
    gain = F.col("pos") / F.nullif(F.col("p_total"), F.lit(0))
    return F.sum(gain * _precision())


def roc_auc() -> Column:
    """Share of (positive, negative) pairs in the right order, ties count half."""
    beaten_by = F.col("tp") - F.col("pos") / 2.0
    pairs = F.col("p_total") * F.col("n_total").cast("double")
    return F.sum(F.col("neg") * beaten_by / F.nullif(pairs, F.lit(0.0)))


def recall_at_fpr(max_fpr: float) -> Column:
    """Struct(recall, threshold, fpr): best recall within a false-alarm budget.

    Null fields without positives or negatives. When even the top score exceeds the budget:
    recall 0 at the top score.
    """
    rate = F.col("fp") / F.nullif(F.col("n_total"), F.lit(0))
    within = (rate <= max_fpr) & (F.col("p_total") > 0)
    point = F.struct(_recall().alias("recall"), F.col("score").alias("threshold"), rate.alias("fpr"))
    best = F.max_by(F.when(within, point), F.when(within, F.col("tp") + F.col("fp")))
    usable = (F.max("p_total") > 0) & (F.max("n_total") > 0)
    nothing = F.struct(
        F.lit(0.0).alias("recall"), F.max("score").alias("threshold"), F.lit(0.0).alias("fpr")
    )
    empty = F.lit(None).cast("double")
    undefined = F.struct(empty.alias("recall"), empty.alias("threshold"), empty.alias("fpr"))
    return F.when(usable, F.coalesce(best, nothing)).otherwise(undefined)


def best_fbeta(beta: float = FBETA) -> Column:
    """Struct(fbeta, threshold, precision, recall) of the best threshold, the lowest one on ties."""
    precision, recall = _precision(), _recall()
    denominator = beta * beta * precision + recall
    value = F.when(denominator > 0, (1 + beta * beta) * precision * recall / denominator)
    value = F.coalesce(value, F.lit(0.0))
    point = F.struct(
        value.alias("fbeta"),
        F.col("score").alias("threshold"),
        precision.alias("precision"),
        recall.alias("recall"),
    )
    best = F.max_by(point, F.struct(value, -F.col("score")))
    return F.when(F.max("p_total") > 0, best)


def operating_points(curve: DataFrame, budgets: dict[str, float] = FPR_BUDGETS) -> DataFrame:
    """One row per false-alarm budget: name, recall, threshold, fpr."""
    lines = F.array(
        *[F.struct(F.lit(name).alias("budget"), recall_at_fpr(x).alias("at")) for name, x in budgets.items()]
    )
    return curve.agg(lines.alias("lines")).select(F.inline("lines")).select("budget", "at.*")


def classification_bundle(
    scores: DataFrame,
    label: str = "y",
    score: str = "score",
    beta: float = FBETA,
    groups: Sequence[str] = (),
) -> DataFrame:
    """All metrics of a set of scores, one row (per group)."""
    curve = rank_curve(scores, label, score, groups)
    squared_error = F.col("pos") * (1 - F.col("score")) ** 2 + F.col("neg") * F.col("score") ** 2
    n = F.sum(F.col("pos") + F.col("neg"))
    positives = F.sum("pos")
    bundle = curve.groupBy(*groups).agg(
        n.alias("n"),
        positives.alias("positives"),
        (positives / n).alias("base_rate"),
        average_precision().alias("pr_auc"),
        roc_auc().alias("roc_auc"),
        (F.sum(squared_error) / n).alias("brier"),
        best_fbeta(beta).alias("fbeta"),
        *[recall_at_fpr(x).alias(name) for name, x in FPR_BUDGETS.items()],
    )
    lift = F.when(F.col("base_rate") > 0, F.col("pr_auc") / F.col("base_rate"))
    return bundle.withColumn("pr_auc_lift", lift)


def pr_curve(curve: DataFrame, points: int = 20) -> DataFrame:
    """The precision-recall curve thinned to at most ``points`` steps of recall.

    Each step keeps its lowest threshold.
    """
    step = F.ceil(F.col("tp") * points / F.col("p_total")).cast("int")
    kept = curve.where((F.col("p_total") > 0) & (F.col("tp") > 0)).groupBy(step.alias("step"))
    at = F.max_by(F.struct("score", "tp", "fp", "p_total"), -F.col("score"))
    return (
        kept.agg(at.alias("at"))
        .select("step", "at.*")
        .select(
            "step",
            F.col("score").alias("threshold"),
            F.round(_precision(), 6).alias("precision"),
            F.round(_recall(), 6).alias("recall"),
        )
    )


def calibration_curve(
    scores: DataFrame, label: str = "y", score: str = "score", bins: int = 10
) -> DataFrame:
    """Mean score and observed rate per equal-width score bin."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return (
        scores.where(F.col(label).isNotNull())
        .groupBy(place.alias("bin"))
        .agg(
            F.round(F.avg(score), 6).alias("mean_score"),
            F.round(F.avg(F.col(label).cast("double")), 6).alias("observed_rate"),
            F.count("*").alias("n"),
        )
    )
