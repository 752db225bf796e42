"""Distribution drift between a reference and a current window, over all their rows.

Both windows are read in one scan. Rows are first counted per (feature, value), so a value that
holds most of the rows is one line before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.contracts import (
    DRIFT_CATEGORICAL,
    DRIFT_NUMERIC,
    DRIFT_SHARE_THRESHOLD,
    MIN_DRIFT_ROWS,
    PR_AUC_DROP_THRESHOLD,
    PSI_BINS,
    PSI_FLOOR,
    PSI_THRESHOLD,
    Span,
    quarter_name,
)
from fleetlife.functions.arrays import count_not_above
from fleetlife.functions.labels import capacity_gb
from fleetlife.operators.prefix import CELLS_PER_BUCKET, quantile_columns, running_totals
from fleetlife.session import stage

COLUMNS = [
    "feature",
    "type",
    "psi",
    "ks_stat",
    "ks_pvalue",
    "edge_count",
    "new_categories",
    "drifted",
]


def _psi_term(ref_share: Column, cur_share: Column) -> Column:
    r = F.greatest(ref_share, F.lit(PSI_FLOOR))
    c = F.greatest(cur_share, F.lit(PSI_FLOOR))
    return (c - r) * F.ln(c / r)


def ks_pvalue(statistic: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value (Kolmogorov series)."""
    effective = n_ref.cast("double") * n_cur / (n_ref + n_cur)
    x = effective * statistic * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * x),
    )
    # Below this point the value is 1 to many digits, and 100 terms no longer suffice.
    return F.when(x < 0.01, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def numeric_drift(
    both: DataFrame,
    features: Sequence[str],
    bins: int = PSI_BINS,
    cells_per_bucket: int = CELLS_PER_BUCKET,
) -> DataFrame:
    """PSI on reference quantiles and the two-sample KS test, for all features in one job.

    ``both`` has the boolean columns in_ref and in_cur. Features with too few known values in
    either window stay in the report without figures (null: too few rows) and do not count as drifted.
    """
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    long = both.select("in_ref", "in_cur", *doubles).unpivot(
        ["in_ref", "in_cur"], list(features), "feature", "value"
    )
    cells = (
        long.where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if("in_ref").alias("n_ref"), F.count_if("in_cur").alias("n_cur"))
    )
    enough = (F.col("n_ref_total") >= MIN_DRIFT_ROWS) & (F.col("n_cur_total") >= MIN_DRIFT_ROWS)
    totals = running_totals(
        cells,
        "value",
        ["n_ref", "n_cur"],
        ["feature"],
        cells_per_bucket=cells_per_bucket,
        group_count=len(features),
    ).where(enough)
    # Read for the edges and again for the bins.
    totals = stage(totals.drop("n_ref_before", "n_cur_before"))

    probabilities = [i / bins for i in range(bins + 1)]
    edges = totals.groupBy("feature").agg(
        F.array_sort(F.array_distinct(F.array(*quantile_columns("value", "n_ref", probabilities)))).alias(
            "edges"
        )
    )
    # The outer edges are open, so only the inner ones decide the bin.
    inner = edges.select(
        "feature",
        F.size("edges").alias("edge_count"),
        F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner"),
    )
    distance = F.abs(
        F.col("n_ref_upto") / F.col("n_ref_total") - F.col("n_cur_upto") / F.col("n_cur_total")
    )
    # One row per feature: broadcast, because a join on the feature would gather all its values.
    per_bin = (
        totals.join(F.broadcast(inner), "feature")
        .withColumn("bin", count_not_above(F.col("inner"), F.col("value"), longest=bins - 1))
        .groupBy("feature", "bin")
        .agg(
            F.sum("n_ref").alias("n_ref"),
            F.sum("n_cur").alias("n_cur"),
            F.max(distance).alias("distance"),
            F.max("edge_count").alias("edge_count"),
            F.max("n_ref_total").alias("ref"),
            F.max("n_cur_total").alias("cur"),
        )
    )
    # Bins that are empty on both sides add nothing, so absent ones need no line.
    term = _psi_term(F.col("n_ref") / F.col("ref"), F.col("n_cur") / F.col("cur"))
    stats = per_bin.groupBy("feature").agg(
        F.when(F.max("edge_count") < 3, 0.0).otherwise(F.sum(term)).alias("psi_raw"),
        F.max("distance").alias("ks_raw"),
        F.max("edge_count").alias("edge_count"),
        F.max("ref").alias("ref"),
        F.max("cur").alias("cur"),
    )
    known = stats.select(
        "feature",
        F.round("psi_raw", 4).alias("psi"),
        F.round("ks_raw", 4).alias("ks_stat"),
        ks_pvalue(F.col("ks_raw"), F.col("ref"), F.col("cur")).alias("ks_pvalue"),
        "edge_count",
        (F.col("psi_raw") > PSI_THRESHOLD).alias("drifted"),
    )
    asked = both.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return asked.join(known, "feature", "left").select(
        "feature",
        F.lit("numeric").alias("type"),
        "psi",
        "ks_stat",
        "ks_pvalue",
        "edge_count",
        F.lit(None).cast("bigint").alias("new_categories"),
        F.coalesce("drifted", F.lit(False)).alias("drifted"),
    )


def category_shares(both: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of each category on both sides; null is a category of its own.

    Grouping both windows together gives the same lines as a null-safe full outer join of two
    frequency tables, with one shuffle and partial counts.
    """
    texts = [F.col(f).cast("string").alias(f) for f in features]
    long = both.select("in_ref", "in_cur", *texts).unpivot(
        ["in_ref", "in_cur"], list(features), "feature", "category"
    )
    return long.groupBy("feature", "category").agg(
        F.count_if("in_ref").alias("n_ref"), F.count_if("in_cur").alias("n_cur")
    )


def categorical_drift(both: DataFrame, features: Sequence[str]) -> DataFrame:
    """PSI over the union of categories, and the number of categories new in the current window."""
    cells = category_shares(both, features)
    totals = cells.groupBy("feature").agg(F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur"))
    is_new = (F.col("n_ref") == 0) & (F.col("n_cur") > 0)
    stats = (
        cells.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(
            F.sum(
                _psi_term(F.col("n_ref") / F.col("ref"), F.col("n_cur") / F.col("cur"))
            ).alias("psi_raw"),
            F.count_if(is_new).alias("new_categories"),
        )
    )
    drifted = (F.col("psi_raw") > PSI_THRESHOLD) | (F.col("new_categories") > 0)
    return stats.select(
        "feature",
        F.lit("categorical").alias("type"),
        F.round("psi_raw", 4).alias("psi"),
        F.lit(None).cast("double").alias("ks_stat"),
        F.lit(None).cast("double").alias("ks_pvalue"),
        F.lit(None).cast("int").alias("edge_count"),
        "new_categories",
        drifted.alias("drifted"),
    )


def two_windows(panel: DataFrame, reference: Span, current: Span) -> DataFrame:
    """Rows of either window from one scan, flagged with in_ref and in_cur."""
    in_ref = F.col("date").between(F.lit(reference.first), F.lit(reference.last))
    in_cur = F.col("date").between(F.lit(current.first), F.lit(current.last))
    if "quarter" in panel.columns:  # skips the folders of all other quarters
        names = [[quarter_name(d) for d in (span.first, span.last)] for span in (reference, current)]
        panel = panel.where(F.col("quarter").between(*names[0]) | F.col("quarter").between(*names[1]))
    return panel.where(in_ref | in_cur).withColumns({"in_ref": in_ref, "in_cur": in_cur})


def drift_report(
    panel: DataFrame,
    reference: Span,
    current: Span,
    numeric: Sequence[str] = tuple(DRIFT_NUMERIC),
    categorical: Sequence[str] = tuple(DRIFT_CATEGORICAL),
) -> DataFrame:
    """One row per feature; numeric and categorical features together."""
    both = two_windows(panel, reference, current)
    if "capacity_gb" in numeric and "capacity_gb" not in panel.columns:
        both = both.withColumn("capacity_gb", capacity_gb())
    report = numeric_drift(both, numeric).select(COLUMNS)
    if categorical:
        report = report.unionByName(categorical_drift(both, categorical).select(COLUMNS))
    return report


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: features, drifted features and their share."""
    n, drifted = F.count("*"), F.count_if("drifted")
    return report.agg(
        n.alias("n_features"),
        drifted.alias("n_drifted"),
        F.round(drifted / F.greatest(n, F.lit(1)), 3).alias("drifted_share"),
    )


def retrain_decision(
    summary: DataFrame,
    pr_auc_current: float | Column | None = None,
    pr_auc_reference: float | Column | None = None,
    share_threshold: float = DRIFT_SHARE_THRESHOLD,
    pr_auc_drop: float = PR_AUC_DROP_THRESHOLD,
) -> DataFrame:
    """Add the decision and its reasons: too many drifted features, or too large a quality drop."""
    now, before = (
        x if isinstance(x, Column) else F.lit(x).cast("double") for x in (pr_auc_current, pr_auc_reference)
    )
    drift_reason = F.when(
        F.col("drifted_share") >= share_threshold,
        F.concat(F.lit("drift in "), F.col("n_drifted"), F.lit(" of "), F.col("n_features"), F.lit(" features")),
    )
    quality_reason = F.when(
        before - now >= pr_auc_drop,
        F.concat(
            F.lit("pr_auc fell from "),
            F.round(before, 3).cast("string"),
            F.lit(" to "),
            F.round(now, 3).cast("string"),
        ),
    )
    reasons = F.array_compact(F.array(drift_reason, quality_reason))
    return summary.withColumn("reasons", reasons).withColumn("retrain", F.size("reasons") > 0)
