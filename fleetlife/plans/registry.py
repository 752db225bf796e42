"""The registered queries: one per operator, on panels derived from the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.contracts import SMART_BIG5, WINDOWS, Span, feature_columns, rolling_columns
from fleetlife.functions.labels import clean_rul
from fleetlife.models import bakeoff, classifiers, publish, survival_forest, weibull
from fleetlife.models.blocks import standardised
from fleetlife.models import survival as sv
from fleetlife.operators import drift, driftsketch, eda, lifecycle, rankmetrics, sampling, scoring, sequences
from fleetlife.operators import survmetrics, windows
from fleetlife.operators.encode import codebook, encode, ordered_means
from fleetlife.plans import datasets, lifestate, monitoring
from fleetlife.session import checkpoint_dir, stage
from fleetlife.sources.testdata import EVENT_SETTINGS, events_panel, formula_scores, lineitem_panel

S = EVENT_SETTINGS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Reference and current years of the lineitem panel.
SPARSE_WINDOWS = (
    Span(date(1995, 1, 1), date(1998, 12, 31)),
    Span(date(1999, 1, 1), date(2001, 12, 31)),
)

#: Fewer and shallower trees than the defaults: the test tables are small.
SMALL_BOOST = {"maxIter": 10}
SMALL_FOREST = {"numTrees": 20, "maxDepth": 6, "minInstancesPerNode": 10}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(frame: DataFrame, digits: int, columns) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.labels(events_panel(spark, sf), S.horizons)


def _lives(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.unit_lives(events_panel(spark, sf))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return formula_scores(_labels(spark, sf))


# --- ingest, life history, fleet statistics ----------------------------------------------


@query
def ingest_audit(spark, sf):
    return eda.ingest_audit(lineitem_panel(spark, sf))


@query
def drive_summary(spark, sf):
    ints = {"event": F.col("event").cast("int")}
    return lifecycle.drive_summary(lineitem_panel(spark, sf)).withColumns(ints)


@query
def drive_summary_as_of(spark, sf):
    summary = lifecycle.drive_summary(events_panel(spark, sf), as_of=S.splits["train"].last)
    return summary.withColumn("event", F.col("event").cast("int"))


@query
def labels(spark, sf):
    narrow = ["failure", "event", *[f"will_fail_within_{n}" for n in S.horizons]]
    return _labels(spark, sf).withColumns({c: F.col(c).cast("int") for c in narrow})


@query
def labels_by_days(spark, sf):
    """The labels again, from three batches of days that come out of order."""
    panel = stage(events_panel(spark, sf))
    root = f"{checkpoint_dir(spark)}/life-{uuid.uuid4().hex}"
    for name, day in (("middle", F.dayofmonth("date").between(9, 20)), ("early", F.dayofmonth("date") < 9), ("late", F.dayofmonth("date") > 20)):
        lifestate.apply_days(spark, root, panel.where(day), name, S.horizons)
    narrow = ["failure", "event", *[f"will_fail_within_{n}" for n in S.horizons]]
    return lifestate.read_labels(spark, root).drop("quarter").withColumns({c: F.col(c).cast("int") for c in narrow})


@query
def fleet_totals(spark, sf):
    return lifecycle.fleet_totals(lifecycle.drive_summary(lineitem_panel(spark, sf)))


@query
def label_balance(spark, sf):
    return eda.label_balance(_labels(spark, sf), S.horizons)


@query
def failures_by_month(spark, sf):
    return eda.failures_by_month(lineitem_panel(spark, sf))


@query
def model_failure_rates(spark, sf):
    return eda.model_failure_rates(lifecycle.drive_summary(lineitem_panel(spark, sf)), S.min_drives)


@query
def fleet_kpis(spark, sf):
    return eda.fleet_kpis(lifecycle.drive_summary(lineitem_panel(spark, sf)))


@query
def rul_histogram(spark, sf):
    return eda.rul_histogram(lifecycle.labels(lineitem_panel(spark, sf), ()))


@query
def active_units(spark, sf):
    return lifecycle.active_units(_lives(spark, sf), S.splits["val"]).select(
        "serial_number", "first_date", "last_date", F.col("event").cast("int").alias("event")
    )


# --- windows -----------------------------------------------------------------------------


@query
def ffill(spark, sf):
    filled = windows.forward_fill(events_panel(spark, sf))
    return rounded(filled, 4, SMART_BIG5).select("serial_number", "date", *SMART_BIG5)


@query
def rolling_mean(spark, sf):
    wide = windows.with_rolling(windows.forward_fill(lineitem_panel(spark, sf)))
    means = [f"{c}_rmean_{w}" for c in SMART_BIG5 for w in WINDOWS]
    return rounded(wide, 6, means).select("serial_number", "date", *means)


@query
def rolling_std(spark, sf):
    wide = windows.with_rolling(windows.forward_fill(lineitem_panel(spark, sf)))
    stds = [f"{c}_rstd_{w}" for c in SMART_BIG5 for w in WINDOWS]
    # Both engines agree to 1e-7 on all values at sf0.01. With six digits a few of the million values of the
    # comparison would still lie on two sides of a rounding edge; with three none does.
    return rounded(wide, 3, stds).select("serial_number", "date", *stds)


@query
def rolling_slope(spark, sf):
    wide = windows.with_slope(windows.forward_fill(events_panel(spark, sf)))
    slopes = [f"{c}_rslope_{w}" for c in SMART_BIG5 for w in WINDOWS]
    return rounded(wide, 6, slopes).select("serial_number", "date", *slopes)


def _rolling_features(name: str) -> Query:
    def run(spark, sf):
        panel = events_panel(spark, sf)
        ratio = S.negatives_per_positive if name == "train" else None
        summary = lifecycle.unit_lives(panel)
        split = datasets.rolling_split(panel, summary, S.splits[name], S.horizon, ratio)
        numbers = ["capacity_gb", *SMART_BIG5, *rolling_columns()]
        return rounded(split, 6, numbers).withColumn("y", F.col("y").cast("int"))

    return run


for _name in ("train", "val", "test"):
    QUERIES[f"rolling_features_{_name}"] = _rolling_features(_name)


@query
def latest_snapshot(spark, sf):
    return windows.latest_snapshot(lineitem_panel(spark, sf)).select(
        "serial_number", "date", "model", "capacity_bytes", *SMART_BIG5
    )


# --- datasets, encoding, sampling --------------------------------------------------------


def _pit_features(name: str) -> Query:
    def run(spark, sf):
        panel = events_panel(spark, sf)
        ratio = S.negatives_per_positive if name == "train" else None
        summary = lifecycle.unit_lives(panel)
        split = datasets.point_in_time_split(panel, summary, S.splits[name], S.horizon, "big5", ratio)
        return split.withColumn("y", F.col("y").cast("int"))

    return run


for _name in ("train", "val", "test"):
    QUERIES["pit_features" if _name == "train" else f"pit_features_{_name}"] = _pit_features(_name)


@query
def split_counts(spark, sf):
    panel = events_panel(spark, sf)
    summary = lifecycle.unit_lives(panel)
    parts = [
        datasets.label_counts(panel, summary, span, S.horizon).select(F.lit(name).alias("split"), "pos", "neg")
        for name, span in S.splits.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _survival_table(name: str) -> Query:
    def run(spark, sf):
        panel = events_panel(spark, sf)
        summary = lifecycle.unit_lives(panel)
        split = datasets.survival_split(panel, summary, S.splits[name], S.survival_ratios[name])
        numbers = ["capacity_gb", *SMART_BIG5, *rolling_columns()]
        return rounded(split, 6, numbers).withColumn("event", F.col("event").cast("int"))

    return run


for _name in ("train", "val", "test"):
    QUERIES["survival_table" if _name == "val" else f"survival_table_{_name}"] = _survival_table(_name)


@query
def ordered_category_means(spark, sf):
    """The label mean of every training row's model over the rows before it in hash order."""
    known = stage(_scores(spark, sf).where(F.col("y").isNotNull()).select("serial_number", "date", "model", "y"))
    return rounded(ordered_means(known), 6, ["category_mean"])


@query
def encode_category(spark, sf):
    panel = events_panel(spark, sf)
    book = codebook(lifecycle.in_span(panel, S.splits["train"]))
    return encode(lifecycle.in_span(panel, S.splits["test"]), book).select(
        "serial_number", "date", "model", "model_code"
    )


@query
def class_weights(spark, sf):
    return eda.class_weights(_scores(spark, sf))


@query
def feature_stats(spark, sf):
    stats = eda.feature_stats(windows.forward_fill(events_panel(spark, sf)), SMART_BIG5)
    return rounded(stats, 6, ["mean", "std"])


@query
def undersample(spark, sf):
    rows = _scores(spark, sf).dropna(subset=["y"])
    return sampling.undersample(rows, S.negatives_per_positive).select(
        "serial_number", "date", F.col("y").cast("int").alias("y")
    )


@query
def cap_negatives(spark, sf):
    rows = _scores(spark, sf).dropna(subset=["y"])
    return sampling.cap_negatives(rows, 700).select(
        "serial_number", "date", F.col("y").cast("int").alias("y")
    )


@query
def sample_n(spark, sf):
    return sampling.sample_n(lineitem_panel(spark, sf), 5000).select("serial_number", "date", "smart_5_raw")


@query
def unit_sample(spark, sf):
    return sampling.unit_sample(_lives(spark, sf), S.splits["test"], healthy=60).select(
        "serial_number", F.col("event").cast("int").alias("event")
    )


@query
def unit_prune(spark, sf):
    panel = events_panel(spark, sf)
    units = sampling.unit_sample(lifecycle.unit_lives(panel), S.splits["test"], healthy=60)
    return sampling.prune_to_units(panel, units).select("serial_number", "date", "model")


@query
def balanced_cap(spark, sf):
    return sampling.balanced_cap(_scores(spark, sf), 1200).select(
        "serial_number", "date", F.col("event").cast("int").alias("event")
    )


# --- drift -------------------------------------------------------------------------------


def _report(spark, sf):
    return drift.drift_report(events_panel(spark, sf), S.splits["train"], S.splits["test"])


@query
def drift_numeric(spark, sf):
    both = drift.two_windows(lineitem_panel(spark, sf), *SPARSE_WINDOWS)
    report = drift.numeric_drift(both, SMART_BIG5)
    return report.drop("new_categories", "type").withColumn("ks_pvalue", F.round("ks_pvalue", 6))


@query
def drift_categorical(spark, sf):
    both = drift.two_windows(events_panel(spark, sf), S.splits["train"], S.splits["test"])
    return drift.categorical_drift(both, ["model"]).select("feature", "psi", "new_categories", "drifted")


@query
def day_sketch_counts(spark, sf):
    """Known values per day and feature in the sketches of the panel."""
    return driftsketch.day_sketches(events_panel(spark, sf)).select("date", "feature", "n")


@query
def day_category_counts(spark, sf):
    return driftsketch.day_categories(events_panel(spark, sf))


@query
def drift_sketched(spark, sf):
    """The drift report from tables of days, within the error of the sketches."""
    panel = events_panel(spark, sf)
    days = stage(driftsketch.day_sketches(panel)), stage(driftsketch.day_categories(panel))
    return driftsketch.sketched_drift_report(*days, S.splits["train"], S.splits["test"])


@query
def drift_report(spark, sf):
    return _report(spark, sf).withColumn("ks_pvalue", F.round("ks_pvalue", 6))


@query
def retrain_decision(spark, sf):
    panel = events_panel(spark, sf)
    scored = formula_scores(lifecycle.labels(panel, S.horizons))
    quality = {
        name: rankmetrics.rank_curve(lifecycle.in_span(scored, S.splits[name])).agg(
            rankmetrics.average_precision()
        ).scalar()
        for name in ("train", "test")
    }
    summary = drift.drift_summary(_report(spark, sf))
    decision = drift.retrain_decision(summary, quality["test"], quality["train"])
    return decision.select(
        "n_features", "n_drifted", "drifted_share", F.size("reasons").alias("n_reasons"),
        F.array_join("reasons", "; ").alias("reasons"), "retrain"
    )


# --- ranking metrics ---------------------------------------------------------------------


@query
def rank_curve(spark, sf):
    return rankmetrics.rank_curve(_scores(spark, sf))


@query
def recall_at_fpr(spark, sf):
    curve = rankmetrics.rank_curve(_scores(spark, sf), score="score_tied")
    budgets = {"0.1%": 0.001, "1%": 0.01, "5%": 0.05, "20%": 0.2}
    return rounded(rankmetrics.operating_points(curve, budgets), 6, ["recall", "threshold", "fpr"])


@query
def recall_at_fpr_degenerate(spark, sf):
    """The last split has no known negatives at the longest horizon: all fields are null."""
    scored = formula_scores(_labels(spark, sf), horizon=max(S.horizons))
    curve = rankmetrics.rank_curve(lifecycle.in_span(scored, S.splits["test"]))
    return rankmetrics.operating_points(curve)


@query
def best_fbeta(spark, sf):
    curve = rankmetrics.rank_curve(_scores(spark, sf))
    best = curve.agg(rankmetrics.best_fbeta().alias("best")).select("best.*")
    return rounded(best, 6, best.columns)


@query
def pr_auc(spark, sf):
    curve = rankmetrics.rank_curve(_scores(spark, sf), score="score_tied")
    return curve.agg(F.round(rankmetrics.average_precision(), 6).alias("pr_auc"))


@query
def roc_auc(spark, sf):
    curve = rankmetrics.rank_curve(_scores(spark, sf), score="score_tied")
    return curve.agg(F.round(rankmetrics.roc_auc(), 6).alias("roc_auc"))


@query
def classification_bundle(spark, sf):
    bundle = rankmetrics.classification_bundle(_scores(spark, sf))
    flat = bundle.select(
        "n", "positives", "base_rate", "pr_auc", "pr_auc_lift", "roc_auc", "brier",
        F.col("fbeta.fbeta").alias("fbeta"), F.col("fbeta.threshold").alias("fbeta_threshold"),
        F.col("fpr_1pct.recall").alias("recall_1pct"), F.col("fpr_0_1pct.recall").alias("recall_0_1pct"),
    )
    return rounded(flat, 6, flat.columns[2:])


@query
def operating_points(spark, sf):
    scored = lifecycle.in_span(_scores(spark, sf), S.splits["val"])
    points = rankmetrics.operating_points(rankmetrics.rank_curve(scored))
    return rounded(points, 6, ["recall", "threshold", "fpr"])


@query
def pr_curve(spark, sf):
    return rankmetrics.pr_curve(rankmetrics.rank_curve(_scores(spark, sf)))


@query
def calibration_curve(spark, sf):
    return rankmetrics.calibration_curve(_scores(spark, sf))


# --- survival metrics --------------------------------------------------------------------


@query
def c_index(spark, sf):
    index = survmetrics.concordance(_scores(spark, sf))
    exact = {c: F.col(c).cast("bigint") for c in ("concordant", "tied", "comparable")}
    return rounded(index.withColumns(exact), 6, ["c_index"])


@query
def rul_error(spark, sf):
    errors = survmetrics.rul_error(_scores(spark, sf))
    return rounded(errors, 6, ["rul_mae_days", "rul_median_true_days"])


@query
def rul_clip(spark, sf):
    """Predictions of any kind, including none, infinite and not-a-number, become usable days."""
    h = F.col("pred_time")
    odd = (
        F.when(h == 1, F.lit(None).cast("double"))
        .when(h == 2, F.lit(float("inf")))
        .when(h == 3, F.lit(float("-inf")))
        .when(h == 4, F.lit(float("nan")))
        .otherwise((h - 20) * 30)
    )
    return _scores(spark, sf).select("serial_number", "date", clean_rul(odd).alias("rul_days"))


@query
def censored_rul_loss(spark, sf):
    loss = survmetrics.censored_rul_loss(_scores(spark, sf))
    return rounded(loss, 6, loss.columns)


@query
def risk_sets(spark, sf):
    weighted = _scores(spark, sf).withColumn("weight", F.exp(F.col("score")))
    return rounded(survmetrics.risk_sets(weighted, "weight"), 6, ["risk_weight"])


# --- sequences ---------------------------------------------------------------------------


def _sequence_anchors(name: str) -> Query:
    def run(spark, sf):
        panel = events_panel(spark, sf)
        life = lifecycle.with_life(panel, lifecycle.unit_lives(panel))
        placed = sequences.with_anchor_place(windows.with_day_number(life), S.splits[name], 3, 2)
        return placed.where("is_anchor").select(
            "serial_number", "date", F.col("event").cast("int").alias("event")
        )

    return run


def _sequences(spark, sf, name: str) -> DataFrame:
    panel = events_panel(spark, sf)
    return sequences.sequence_dataset(panel, lifecycle.unit_lives(panel), S.splits[name])


def _sequence_windows(name: str) -> Query:
    """Windows of all units, flattened: one line per anchor and step of its 30 steps."""

    def run(spark, sf):
        table = _sequences(spark, sf, name)
        steps = table.select("serial_number", "date", "event", "dur", F.posexplode("window").alias("step", "reading"))
        values = [F.round(F.get("reading", i).cast("double"), 2).alias(c) for i, c in enumerate(SMART_BIG5)]
        return steps.select(
            "serial_number", "date", F.col("event").cast("int").alias("event"),
            F.col("dur").cast("int").alias("dur"), "step", *values,
        )

    return run


for _name in ("train", "val", "test"):
    QUERIES["sequence_anchors" if _name == "val" else f"sequence_anchors_{_name}"] = _sequence_anchors(_name)
    QUERIES["sequence_windows" if _name == "test" else f"sequence_windows_{_name}"] = _sequence_windows(_name)


@query
def sequence_stats(spark, sf):
    """Standardisation constants of the sequence inputs, from the training span."""
    return rounded(sequences.reading_stats(_sequences(spark, sf, "train")), 4, ["mean", "std"])


# --- scoring -----------------------------------------------------------------------------


def _card(spark, sf):
    """Formula scores of the newest day of each unit, in the shape of a scorecard."""
    newest = windows.latest_snapshot(_scores(spark, sf))
    days = (F.round(F.col("score") * 1_000_000).cast("long") % 120 + 1).cast("double")
    shown = newest.select(
        "serial_number", "model", F.col("score").alias("raw_score"),
        F.round("score", 4).alias("failure_probability"), days.alias("rul_days"),
    )
    curve = rankmetrics.rank_curve(lifecycle.in_span(_scores(spark, sf), S.splits["val"]))
    points = stage(rankmetrics.operating_points(curve, {"critical": 0.01, "warning": 0.2}))
    critical, warning = (
        points.where(F.col("budget") == name).select("threshold").scalar() for name in ("critical", "warning")
    )
    return scoring.with_alerts(shown, critical, warning)


@query
def fleet_alerts(spark, sf):
    return _card(spark, sf)


@query
def fleet_alert_counts(spark, sf):
    return scoring.alert_counts(_card(spark, sf))


@query
def top_risk(spark, sf):
    return scoring.top_risk(_card(spark, sf)).select(
        "serial_number", "model", "failure_probability", "rul_days", "alert_level"
    )


@query
def risk_histogram(spark, sf):
    return eda.risk_histogram(_scores(spark, sf), "score")


def _requests(spark, sf):
    """One scoring request per unit: its whole history as a nested array, oldest first."""
    panel = events_panel(spark, sf)
    # A unit has one row per day, so its history is bounded by the days of the panel.
    history = F.sort_array(F.collect_list(F.struct("date", *SMART_BIG5)))
    return (
        panel.groupBy("serial_number")
        .agg(
            history.alias("history"),
            F.max_by("model", "date").alias("model"),
            F.max("capacity_bytes").alias("capacity_bytes"),
            F.datediff(F.max("date"), F.min("date")).alias("drive_age_days"),
        )
    )


@query
def request_features(spark, sf):
    wide = scoring.request_features(_requests(spark, sf)).drop("history", "capacity_bytes")
    numbers = ["capacity_gb", *SMART_BIG5, *rolling_columns()]
    return rounded(wide, 6, numbers)


#: A fixed linear score, to check the ordering of reasons without a model.
FIXED_EFFECTS = {
    "smart_5_raw": (0.02, 12.0),
    "smart_187_raw": (0.5, 1.0),
    "smart_188_raw": (-0.03, 20.0),
    "smart_197_raw": (0.01, 25.0),
    "smart_198_raw": (0.04, 30.0),
    "capacity_gb": (0.0001, 8000.0),
}


@query
def top_reasons(spark, sf):
    filled = windows.forward_fill(events_panel(spark, sf)).withColumn("capacity_gb", F.col("capacity_bytes") / 1e9)
    ranked = scoring.top_reasons(filled, FIXED_EFFECTS, top=5)
    lines = ranked.select("serial_number", "date", F.posexplode("top_reasons").alias("place", "reason"))
    return lines.select("serial_number", "date", "place", "reason.*")


# --- models (rows only: iterative fits) --------------------------------------------------


def _splits(spark, sf):
    panel = events_panel(spark, sf)
    summary = lifecycle.unit_lives(panel)
    return {
        name: datasets.rolling_split(
            panel, summary, span, S.horizon, S.negatives_per_positive if name == "train" else None
        )
        for name, span in S.splits.items()
    }


def _survival(spark, sf, whole=False):
    panel = events_panel(spark, sf)
    summary = lifecycle.unit_lives(panel)
    return {
        name: datasets.survival_split(panel, summary, S.splits[name], None if whole else S.survival_ratios[name])
        for name in ("train", "test")
    }


def _published(spark, sf):
    panel = events_panel(spark, sf)
    return publish.publish(panel, lifecycle.unit_lives(panel), S, params=SMALL_BOOST)


@query
def score_split(spark, sf):
    splits = _splits(spark, sf)
    ready, categories = bakeoff.prepared_splits({k: splits[k] for k in ("train", "test")})
    model = classifiers.fit_classifier("boosted_trees", ready["train"], categories, SMALL_BOOST)
    return classifiers.score(model, ready["test"])


@query
def classifier_bakeoff(spark, sf):
    params = {"boosted_trees": SMALL_BOOST, "random_forest": SMALL_FOREST}
    return bakeoff.run_bakeoff(_splits(spark, sf), params=params)


@query
def hyperparameter_search(spark, sf):
    space = {"maxDepth": ("int", 3, 6), "numTrees": ("int", 10, 20), "minInstancesPerNode": ("int", 10, 50)}
    return bakeoff.tune(_splits(spark, sf), "random_forest", trials=3, space=space)


@query
def feature_importance(spark, sf):
    train = {"train": _splits(spark, sf)["train"]}
    ready, categories = bakeoff.prepared_splits(train)
    model = classifiers.fit_classifier("random_forest", ready["train"], categories, SMALL_FOREST)
    return classifiers.feature_importance(model)


def _board(board: DataFrame) -> DataFrame:
    return board.drop("fit_seconds", "error")


@query
def bakeoff_big5(spark, sf):
    """Leaderboard on the readings of the day."""
    panel = events_panel(spark, sf)
    summary = lifecycle.unit_lives(panel)
    splits = {
        name: datasets.point_in_time_split(panel, summary, span, S.horizon, "big5", S.negatives_per_positive if name == "train" else None)
        for name, span in S.splits.items()
    }
    return _board(bakeoff.run_bakeoff(splits, params={"boosted_trees": SMALL_BOOST, "random_forest": SMALL_FOREST}, beta=S.fbeta))


@query
def bakeoff_horizons(spark, sf):
    """Boosted trees on the rolling features for each horizon."""
    panel = events_panel(spark, sf)
    summary = lifecycle.unit_lives(panel)
    return _board(bakeoff.run_horizons(panel, summary, S, params={"boosted_trees": SMALL_BOOST}))


@query
def model_reasons(spark, sf):
    splits = _splits(spark, sf)
    ready, categories = bakeoff.prepared_splits({k: splits[k] for k in ("train", "test")}, fill=True)
    model = classifiers.fit_classifier("logistic", ready["train"], categories)
    ranked = scoring.top_reasons(ready["test"], classifiers.linear_effects(model))
    return ranked.select("serial_number", "date", F.posexplode("top_reasons").alias("place", "reason")).select(
        "serial_number", "date", "place", "reason.*"
    )


@query
def weibull_predictions(spark, sf):
    ready, _ = bakeoff.prepared_splits(_survival(spark, sf), fill=True)
    model = sv.fit_weibull(ready["train"])
    return sv.predict_weibull(model, ready["test"]).select(
        "serial_number", "date", "event", "duration", "risk", "pred_time"
    )


@query
def cox_predictions(spark, sf):
    ready, _ = bakeoff.prepared_splits(_survival(spark, sf), fill=True)
    model = sv.fit_cox(ready["train"])
    return sv.predict_cox(model, ready["test"]).select(
        "serial_number", "date", "event", "duration", "risk", "pred_time"
    )


@query
def hazard_forest_predictions(spark, sf):
    ready, categories = bakeoff.prepared_splits(_survival(spark, sf), fill=True)
    model = sv.fit_hazard_forest(ready["train"], categories)
    return sv.predict_hazard_forest(model, ready["test"]).select(
        "serial_number", "date", "event", "duration", "risk", "pred_time"
    )


#: A point at which the slopes of the life-time model are compared in SQL: intercept, coefficients, ln shape.
SLOPE_POINT = (2.0, 0.3, -0.2, 0.1, 0.05, -0.1, 0.2, 0.15, 0.25)


@query
def weibull_slopes(spark, sf):
    """Mean log-likelihood of the training table and its slopes, per parameter, away from the optimum."""
    table = QUERIES["survival_table_train"](spark, sf)
    ready = sv.positive_durations(table).withColumns({"lived": F.log("duration"), "event": F.col("event").cast("double")})
    rows, _, _ = standardised(stage(ready), CUT_INPUTS, ["lived", "event"])
    rows = stage(rows)
    value, gradient, _ = weibull.likelihood_sums(rows, len(CUT_INPUTS), np.array(SLOPE_POINT))
    n = max(rows.count(), 1)
    names = ["likelihood", "intercept", *CUT_INPUTS, "ln_shape"]
    lines = [(k, round(float(v) / n, 6)) for k, v in zip(names, [value, *gradient])]
    return spark.createDataFrame(lines, "parameter string, mean double")


# --- the halves of model jobs that SQL can check -------------------------------------------


@query
def training_counts(spark, sf):
    """Rows, classes and class weight of production training."""
    panel = events_panel(spark, sf)
    frame = datasets.training_frame(panel, lifecycle.unit_lives(panel), S.splits["train"], S.horizon)
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    counts = frame.agg(F.count("*").alias("train_rows"), pos.alias("class_pos"), neg.alias("class_neg"))
    weights = classifiers.weighted(frame.where(F.col("y").isNotNull())).where("y = 1").agg(F.round(F.max("weight"), 6).alias("weight"))
    return counts.join(F.broadcast(weights))


@query
def prepared_inputs(spark, sf):
    """What the classifiers get of one day's readings: nulls stay, the category is a code from 1, 0 is unseen."""
    splits = {n: QUERIES["pit_features" if n == "train" else f"pit_features_{n}"](spark, sf) for n in ("train", "test")}
    ready, _ = bakeoff.prepared_splits(splits)
    return ready["test"].select("serial_number", "date", *classifiers.numeric_inputs(splits["test"].columns), classifiers.CODE, "y")


@query
def person_period_rows(spark, sf):
    """The rows on which the hazard forest is grown."""
    rows = sv.person_periods(QUERIES["survival_table_train"](spark, sf))
    return rows.select("serial_number", "date", *[F.col(c).cast("int") for c in ("duration", "event", "period", "fails")])


@query
def cox_risk_sums(spark, sf):
    """Per day what a Newton step of the hazard model adds up, at a fixed point."""
    table = sv.positive_durations(QUERIES["survival_table_train"](spark, sf))
    days = table.withColumns({"duration": F.col("duration").cast("int"), "event": F.col("event").cast("int")})
    rows, _, _ = standardised(stage(days), CUT_INPUTS, ["duration", "event"])
    names = [f"x{i}" for i in range(len(CUT_INPUTS))]
    sums = sv.risk_sums(rows, names, np.array(SLOPE_POINT[1:-1]))
    return rounded(sums, 5, [c for c in sums.columns if c not in ("duration", "n", "deaths")])


@query
def calibration_map(spark, sf):
    """The isotonic map at every tied score."""
    scored = _scores(spark, sf).select(F.col("score_tied").alias("score"), "y")
    model = publish.calibrate(scored)
    mapped = publish.apply_calibration(model, scored.where(F.col("y").isNotNull()).select("score").distinct())
    return rounded(mapped.select("score", "probability"), 6, ["probability"])


@query
def scorecard_units(spark, sf):
    """The rows that the scorecard scores: every unit on its newest day of the test span."""
    panel = events_panel(spark, sf)
    rows = datasets.training_frame(panel, lifecycle.unit_lives(panel), S.splits["test"], S.horizon, latest_only=True)
    numbers = ["capacity_gb", *SMART_BIG5, *rolling_columns()]
    # Adding 0 makes a rounded -0.0 a plain 0.
    return rows.select("serial_number", "date", *feature_columns()).withColumns({c: F.round(c, 6) + 0.0 for c in numbers})


#: Inputs whose cuts are compared in SQL, and days up to which lives are followed there.
CUT_INPUTS = [*SMART_BIG5, "drive_age_days", "capacity_gb"]
CUT_DAYS = 40


@query
def log_rank_splits(spark, sf):
    """What the root of a log-rank tree looks at: every cut at a quartile of the training table."""
    table = stage(QUERIES["survival_table_train"](spark, sf))
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    found = table.agg(*[F.percentile(F.col(c).cast("double"), shares).alias(c) for c in CUT_INPUTS]).first()
    thresholds = {c: sorted(set(found[c])) for c in CUT_INPUTS}
    return rounded(survival_forest.log_rank_table(table, thresholds, range(1, CUT_DAYS + 1)), 6, ["threshold", "statistic"])


@query
def survival_forest_predictions(spark, sf):
    ready, _ = bakeoff.prepared_splits(_survival(spark, sf), fill=True)
    model = survival_forest.fit_survival_forest(ready["train"], trees=20, depth=5, min_leaf=20)
    return survival_forest.predict_survival_forest(model, ready["test"]).select(
        "serial_number", "date", "event", "duration", "risk", "pred_time"
    )


@query
def survival_bakeoff(spark, sf):
    """On all rows of both splits, not on the sampled tables."""
    tables = _survival(spark, sf, whole=True)
    return bakeoff.run_survival_bakeoff(tables["train"], tables["test"])


@query
def calibrate(spark, sf):
    scored = _scores(spark, sf)
    model = publish.calibrate(scored)
    return publish.apply_calibration(model, scored.select("serial_number", "date", "y", "score"))


@query
def production_training(spark, sf):
    artifacts = _published(spark, sf)
    noted = {**artifacts.metadata, **artifacts.thresholds}
    lines = [(k, float(v)) for k, v in noted.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(lines, "name string, value double")


@query
def fleet_scorecard(spark, sf):
    panel = events_panel(spark, sf)
    return publish.fleet_scorecard(panel, lifecycle.unit_lives(panel), S.splits["test"], _published(spark, sf))


@query
def score_requests(spark, sf):
    artifacts = _published(spark, sf)
    wide = scoring.request_features(_requests(spark, sf)).drop("history", "capacity_bytes")
    return publish.score_rows(wide.select("serial_number", *feature_columns()), artifacts)


@query
def monitoring_loop(spark, sf):
    """Publish, watch the next window, and train again when drift or quality asks for it."""
    panel = events_panel(spark, sf)
    result = monitoring.mlops_loop(panel, S, current=_published(spark, sf), params=SMALL_BOOST)
    return result.report.select(
        "*",
        F.lit(result.decision.retrain).alias("retrain"),
        F.lit(result.artifacts is not None).alias("retrained"),
    )
