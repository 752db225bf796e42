"""Drift between any two windows from a small table per day, without reading the panel again.

A day has a mergeable quantile sketch (KLL) per numeric feature and a count per category. Merged over a window
they stand for its distribution: a sketch's ranks are off by at most ``rank_error(k)`` (with 99 % probability),
whatever the number of rows, and a table of days is a fixed number of kilobytes per feature and day. This is an
option beside ``drift.drift_report``, which reads all rows and is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.contracts import (
    DRIFT_CATEGORICAL,
    DRIFT_NUMERIC,
    MIN_DRIFT_ROWS,
    PSI_BINS,
    PSI_THRESHOLD,
    Span,
)
from fleetlife.functions.labels import capacity_gb
from fleetlife.operators.drift import COLUMNS, _psi_term, ks_pvalue
from fleetlife.operators.lifecycle import in_span

#: Size of a sketch: about 1.3 % of the rank at 200, 0.35 % at 800.
SKETCH_K = 800

#: Ranks by which a merged sketch is written out as a distribution: shares are off by half a step more.
STEPS = 1_000

#: Steps between the values at which the KS statistic compares two distributions.
KS_STEP = 5


def rank_error(k: int = SKETCH_K) -> float:
    """The published bound of the sketch, and half a step: a rank is off by more in one of 100 cases."""
    return 2.296 / k**0.9723 + 0.5 / STEPS


def day_sketches(panel: DataFrame, numeric: Sequence[str] = tuple(DRIFT_NUMERIC), k: int = SKETCH_K) -> DataFrame:
    """(date, feature, n, sketch): known values of every feature and day. Tasks sketch their own rows first."""
    if "capacity_gb" in numeric and "capacity_gb" not in panel.columns:
        panel = panel.withColumn("capacity_gb", capacity_gb())
    sums = []
    for i, c in enumerate(numeric):
        value = F.col(c).cast("double")
        known = F.when(~F.isnan(value), value)
        sums += [F.count(known).alias(f"n{i}"), F.kll_sketch_agg_double(known, k).alias(f"s{i}")]
    days = panel.groupBy("date").agg(*sums)
    lines = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(numeric)
    ])
    return days.select("date", F.explode(lines).alias("_x")).select("date", "_x.*")


def day_categories(panel: DataFrame, categorical: Sequence[str] = tuple(DRIFT_CATEGORICAL)) -> DataFrame:
    """(date, feature, category, n): rows of every category and day; null is a category."""
    texts = [F.col(c).cast("string").alias(c) for c in categorical]
    long = panel.select("date", *texts).unpivot(["date"], list(categorical), "feature", "category")
    return long.groupBy("date", "feature", "category").agg(F.count(F.lit(1)).alias("n"))


def _shares(grid: Column, at: Column, inclusive: bool) -> Column:
    """For each value of ``at`` the share of the distribution that is less (or as large)."""
    held = (lambda q, e: q <= e) if inclusive else (lambda q, e: q < e)
    return F.transform(at, lambda e: F.size(F.filter(grid, lambda q: held(q, e))) / F.lit(float(STEPS)))


def _window(sketches: DataFrame, span: Span, name: str) -> DataFrame:
    """One merged sketch per feature; days without values add nothing."""
    own = in_span(sketches, span).where("n > 0").groupBy("feature")
    return own.agg(F.sum("n").alias(f"n_{name}"), F.kll_merge_agg_double("sketch").alias(name))


def sketched_numeric_drift(sketches: DataFrame, reference: Span, current: Span, bins: int = PSI_BINS) -> DataFrame:
    """PSI and KS per feature with the columns of ``drift.numeric_drift``; features with too few values have no figures."""
    asked = sketches.select("feature").distinct()
    both = asked.join(_window(sketches, reference, "ref"), "feature", "left").join(_window(sketches, current, "cur"), "feature", "left")
    enough = both.where((F.col("n_ref") >= MIN_DRIFT_ROWS) & (F.col("n_cur") >= MIN_DRIFT_ROWS))
    cuts = F.lit([i / bins for i in range(bins + 1)])
    steps = F.lit([(i + 0.5) / STEPS for i in range(STEPS)])
    ranked = enough.select(
        "feature", "n_ref", "n_cur",
        F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("ref", cuts))).alias("edges"),
        *[F.kll_sketch_get_quantile_double(side, steps).alias(side) for side in ("ref", "cur")],
    )
    some = lambda side: F.filter(side, lambda _, i: i % KS_STEP == 0)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    ranked = ranked.withColumns({"inner": inner, "points": F.array_distinct(F.concat(some("ref"), some("cur")))})
    ranked = ranked.withColumns(
        {f"below_{side}": _shares(F.col(side), F.col("inner"), False) for side in ("ref", "cur")}
        | {f"at_{side}": _shares(F.col(side), F.col("points"), True) for side in ("ref", "cur")}
    )

    def shares(below: str) -> Column:
        whole = F.concat(F.array(F.lit(0.0)), F.col(below), F.array(F.lit(1.0)))
        return F.zip_with(F.slice(whole, 2, F.size(whole)), F.slice(whole, 1, F.size(whole) - 1), lambda b, a: b - a)

    terms = F.zip_with(shares("below_ref"), shares("below_cur"), lambda r, c: _psi_term(r, c))
    psi = F.when(F.size("edges") < 3, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t))
    gaps = F.zip_with("at_ref", "at_cur", lambda r, c: F.abs(r - c))
    stats = ranked.select("feature", psi.alias("psi_raw"), F.array_max(gaps).alias("ks_raw"), F.size("edges").alias("edge_count"), "n_ref", "n_cur")
    known = stats.select(
        "feature",
        F.round("psi_raw", 4).alias("psi"),
        F.round("ks_raw", 4).alias("ks_stat"),
        ks_pvalue(F.col("ks_raw"), F.col("n_ref"), F.col("n_cur")).alias("ks_pvalue"),
        "edge_count",
        (F.col("psi_raw") > PSI_THRESHOLD).alias("drifted"),
    )
    return asked.join(known, "feature", "left").select(
        "feature", F.lit("numeric").alias("type"), "psi", "ks_stat", "ks_pvalue", "edge_count",
        F.lit(None).cast("bigint").alias("new_categories"), F.coalesce("drifted", F.lit(False)).alias("drifted"),
    )


def sketched_categorical_drift(counts: DataFrame, reference: Span, current: Span) -> DataFrame:
    """PSI over the union of categories and the number of new ones, from counts per day; exact."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("date").between(F.lit(span.first), F.lit(span.last)), F.col("n"))), F.lit(0)).alias(name)
        for name, span in (("n_ref", reference), ("n_cur", current))
    ]
    cells = counts.groupBy("feature", "category").agg(*sums).where("n_ref + n_cur > 0")
    totals = cells.groupBy("feature").agg(F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur"))
    term = _psi_term(F.col("n_ref") / F.col("ref"), F.col("n_cur") / F.col("cur"))
    stats = cells.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.sum(term).alias("psi_raw"), F.count_if((F.col("n_ref") == 0) & (F.col("n_cur") > 0)).alias("new_categories")
    )
    return stats.select(
        "feature", F.lit("categorical").alias("type"), F.round("psi_raw", 4).alias("psi"), F.lit(None).cast("double").alias("ks_stat"),
        F.lit(None).cast("double").alias("ks_pvalue"), F.lit(None).cast("int").alias("edge_count"), "new_categories",
        ((F.col("psi_raw") > PSI_THRESHOLD) | (F.col("new_categories") > 0)).alias("drifted"),
    )


def sketched_drift_report(sketches: DataFrame, counts: DataFrame | None, reference: Span, current: Span) -> DataFrame:
    """One row per feature, as ``drift.drift_report`` has it, from the tables of days alone."""
    parts = [sketched_numeric_drift(sketches, reference, current)]
    if counts is not None:
        parts.append(sketched_categorical_drift(counts, reference, current))
    return reduce(DataFrame.unionByName, [p.select(COLUMNS) for p in parts])
