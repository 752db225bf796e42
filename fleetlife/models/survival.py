"""Remaining-life models: accelerated failure time, proportional hazards, discrete-time hazard.

All return rows with ``risk`` (higher = sooner) and ``pred_time`` (days in [1, 400]).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from fleetlife.functions.labels import clean_rul
from fleetlife.models.classifiers import CODE, NUMERIC

INPUTS = [CODE, *NUMERIC]


def positive_durations(frame: DataFrame) -> DataFrame:
    """Models need durations of at least one day; the stored tables may hold 0."""
    return frame.withColumn("duration", F.greatest(F.col("duration"), F.lit(1)).cast("double"))


# --- accelerated failure time ------------------------------------------------------------


def fit_weibull(frame: DataFrame, inputs: Sequence[str] = tuple(INPUTS)) -> PipelineModel:
    """Weibull accelerated failure time on (duration, event)."""
    aft = AFTSurvivalRegression(
        featuresCol="features",
        labelCol="duration",
        censorCol="event",
        quantileProbabilities=[0.5],
        quantilesCol="quantiles",
        maxIter=100,
    )
    ready = positive_durations(frame).withColumn("event", F.col("event").cast("double"))
    # Plain numbers: the category code is not expanded for this model.
    plain = ready.withColumn(CODE, F.col(CODE).cast("double")) if CODE in inputs else ready
    return Pipeline(
        stages=[VectorAssembler(inputCols=list(inputs), outputCol="features"), aft]
    ).fit(plain)


def predict_weibull(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Median remaining days; the risk is its negative."""
    keep = frame.columns
    median = F.get(vector_to_array(F.col("quantiles")), 0)
    predicted = model.transform(frame).select(*keep, clean_rul(median).alias("pred_time"))
    return predicted.withColumn("risk", -F.col("pred_time"))


# --- proportional hazards ----------------------------------------------------------------


@dataclass(frozen=True)
class CoxModel:
    """Coefficients on standardised inputs, and the cumulative baseline hazard per day."""

    inputs: tuple[str, ...]
    means: np.ndarray
    deviations: np.ndarray
    coefficients: np.ndarray
    days: np.ndarray
    hazard: np.ndarray
    iterations: int

    def linear_predictor(self):
        terms = [
            (F.col(c).cast("double") - float(m)) * float(b / s)
            for c, m, s, b in zip(self.inputs, self.means, self.deviations, self.coefficients)
        ]
        total = F.lit(0.0)
        for term in terms:
            total = total + term
        return total


def _standardised(frame: DataFrame, inputs: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    stats = frame.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(inputs)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(inputs)],
    ).first()
    means = np.array([stats[f"m{i}"] for i in range(len(inputs))], dtype=float)
    spread = np.array([stats[f"s{i}"] for i in range(len(inputs))], dtype=float)
    spread = np.where(spread > 1e-12, spread, 1.0)
    scaled = frame.select(
        F.col("duration").cast("int").alias("duration"),
        F.col("event").cast("int").alias("event"),
        *[((F.col(c).cast("double") - float(m)) / float(s)).alias(f"x{i}")
          for i, (c, m, s) in enumerate(zip(inputs, means, spread))],
    )
    return scaled, means, spread


def _hazard_by_day(per_day: pd.DataFrame) -> pd.DataFrame:
    """Breslow: deaths over the weight still at risk, accumulated from the shortest duration."""
    at_risk = per_day["w"].to_numpy()[::-1].cumsum()[::-1]
    return per_day.assign(step=per_day["deaths"].to_numpy() / at_risk, at_risk=at_risk)


def risk_sums(scaled: DataFrame, names: Sequence[str], at: np.ndarray) -> DataFrame:
    """Per duration in days: rows, deaths, the sum of weights exp(x b), and the sums of weighted and of dead inputs."""
    eta = F.lit(0.0)
    for name, b in zip(names, at):
        eta = eta + F.col(name) * float(b)
    died = F.col("event") == 1
    return scaled.withColumn("_eta", eta).withColumn("w", F.exp("_eta")).groupBy("duration").agg(
        F.count("*").alias("n"),
        F.count_if(died).alias("deaths"),
        F.sum("w").alias("w"),
        F.sum(F.when(died, F.col("_eta")).otherwise(0.0)).alias("eta"),
        *[F.sum(F.col("w") * F.col(x)).alias(f"w_{x}") for x in names],
        *[F.sum(F.when(died, F.col(x)).otherwise(0.0)).alias(f"d_{x}") for x in names],
    )


def fit_cox(
    frame: DataFrame,
    inputs: Sequence[str] = tuple(INPUTS),
    penalty: float = 1.0,
    max_iter: int = 25,
    tolerance: float = 1e-6,
) -> CoxModel:
    """Cox regression with an L2 penalty (per row, on standardised inputs), Breslow ties.

    Each Newton step is two distributed aggregations: the gradient from sums per duration (whole
    days, so at most a few thousand rows reach the driver whatever the size of the data), and the
    curvature from one weighted cross-product, summed as p x p blocks. ``frame`` should be a
    written table: it is read twice per step.
    """
    p = len(inputs)
    scaled, means, spread = _standardised(positive_durations(frame), inputs)
    names = [f"x{i}" for i in range(p)]
    n, deaths_x = None, None
    beta = np.zeros(p)
    per_day = None
    steps = 0

    def day_sums(at: np.ndarray) -> pd.DataFrame:
        return risk_sums(scaled, names, at).orderBy("duration").toPandas()

    def penalised(sums: pd.DataFrame, at: np.ndarray) -> float:
        table = _hazard_by_day(sums)
        hit = table["deaths"] > 0
        likelihood = sums["eta"].sum() - (table["deaths"][hit] * np.log(table["at_risk"][hit])).sum()
        return float(likelihood - 0.5 * penalty * sums["n"].sum() * at @ at)

    per_day = day_sums(beta)
    value = penalised(per_day, beta)
    n = int(per_day["n"].sum())
    deaths_x = per_day[[f"d_{x}" for x in names]].to_numpy().sum(axis=0)
    for steps in range(1, max_iter + 1):
        table = _hazard_by_day(per_day)
        risk_x = per_day[[f"w_{x}" for x in names]].to_numpy()[::-1].cumsum(axis=0)[::-1]
        mean_x = risk_x / table["at_risk"].to_numpy()[:, None]
        deaths = table["deaths"].to_numpy()[:, None]
        gradient = deaths_x - (deaths * mean_x).sum(axis=0) - penalty * n * beta
        cumulative = table["step"].cumsum().to_numpy()
        days = [int(d) for d in table["duration"]]
        outer = _weighted_cross_product(scaled, names, beta, days, cumulative)
        curvature = outer - (deaths * mean_x).T @ mean_x + penalty * n * np.eye(p)
        direction = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        # Halve the step until the objective does not get worse.
        length = 1.0
        while True:
            trial = beta + length * direction
            sums = day_sums(trial)
            reached = penalised(sums, trial)
            if reached >= value - 1e-9 * abs(value) or length < 1e-4:
                break
            length /= 2
        change = float(np.abs(trial - beta).max())
        beta, per_day, value = trial, sums, reached
        if change < tolerance:
            break
    table = _hazard_by_day(per_day)
    return CoxModel(
        tuple(inputs),
        means,
        spread,
        beta,
        table["duration"].to_numpy(dtype=int),
        table["step"].cumsum().to_numpy(),
        steps,
    )


def _weighted_cross_product(
    scaled: DataFrame, names: list[str], beta: np.ndarray, days: list[int], cumulative: np.ndarray
) -> np.ndarray:
    """Sum over rows of exp(eta) * H(duration) * x x', as one p x p block per task."""
    p = len(names)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            place = np.searchsorted(days, batch["duration"].to_numpy(), side="right") - 1
            weight = np.exp(x @ beta) * np.where(place >= 0, cumulative[place], 0.0)
            total += x.T @ (x * weight[:, None])
        yield pd.DataFrame({"cell": np.arange(p * p), "value": total.ravel()})

    summed = (
        scaled.select("duration", *names)
        .mapInPandas(blocks, "cell int, value double")
        .groupBy("cell")
        .agg(F.sum("value").alias("value"))
        .toPandas()
        .sort_values("cell")
    )
    return summed["value"].to_numpy().reshape(p, p)


def predict_cox(model: CoxModel, frame: DataFrame) -> DataFrame:
    """Partial hazard as risk, and the area under the survival curve as expected days."""
    keep = frame.columns
    widths = np.diff(np.concatenate([[0], model.days]))
    before = np.concatenate([[0.0], model.hazard[:-1]])
    # One entry per observed duration in days.
    steps = F.array(
        *[
            F.struct(F.lit(float(h)).alias("h"), F.lit(float(w)).alias("w"))
            for h, w in zip(before, widths)
        ]
    )
    risk = F.exp(model.linear_predictor())
    scored = frame.withColumn("risk", risk)
    area = F.aggregate(
        steps, F.lit(0.0), lambda acc, s: acc + s["w"] * F.exp(-s["h"] * F.col("risk"))
    )
    return scored.withColumn("pred_time", clean_rul(area)).select(*keep, "risk", "pred_time")


# --- discrete-time hazard (survival forest) ----------------------------------------------

#: Ends of the periods in days; a row is alive, fails or leaves in each period it reaches.
PERIOD_ENDS = [7, 14, 30, 60, 120, 240, 400]


def person_periods(frame: DataFrame) -> DataFrame:
    """One row per period a unit lives into, with ``fails`` = 1 in the period of its failure.

    A censored unit adds only the periods it survives completely. At most seven rows per row.
    """
    starts = [0, *PERIOD_ENDS[:-1]]
    periods = F.array(
        *[
            F.struct(F.lit(i).alias("period"), F.lit(a).alias("start"), F.lit(b).alias("end"))
            for i, (a, b) in enumerate(zip(starts, PERIOD_ENDS))
        ]
    )
    kept = positive_durations(frame)
    spread = kept.withColumn("p", F.explode(periods)).select(*kept.columns, "p.*")
    duration, failed = F.col("duration"), F.col("event").cast("int") == 1
    reached = F.when(failed, duration > F.col("start")).otherwise(duration >= F.col("end"))
    fails = (failed & (duration <= F.col("end"))).cast("double")
    return (
        spread.where(reached)
        .withColumn("fails", fails)
        .withColumn("period", F.col("period").cast("double"))
        .drop("start", "end")
    )


def cuts_of_all_rows(rows: DataFrame, inputs: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Where each input can be cut (a value equal to a cut is below it), from two bounded aggregations of all rows.

    An input with at most ``bins`` values is cut between all of them, others at approximate quantiles.
    """
    shares = [k / bins for k in range(1, bins)]
    value = {c: F.col(c).cast("double") for c in inputs}
    row = rows.agg(
        *[F.approx_count_distinct(x).alias(f"n_{c}") for c, x in value.items()],
        *[F.percentile_approx(x, shares, 10_000).alias(f"q_{c}") for c, x in value.items()],
    ).first()
    # The count of few values is off by a few.
    few = [c for c in inputs if row[f"n_{c}"] <= 1.25 * bins]
    values = rows.agg(*[F.collect_set(value[c]).alias(c) for c in few]).first() if few else {}
    found = {}
    for c in inputs:
        exact = c in few and len(values[c]) <= bins
        found[c] = sorted(values[c])[:-1] if exact else sorted(set(row[f"q_{c}"] or []))
    return found


def _in_bins(cuts: dict[str, list[float]]) -> tuple[list, dict[str, str]]:
    """Stages that put inputs into the bins between their cuts, and the name of each binned input."""
    # A Bucketizer's bin holds its lower end, not the upper one, so that is the next number after the cut.
    upper = {c: np.unique(np.nextafter(np.array(t, float), np.inf)) for c, t in cuts.items()}
    ends = {c: [-np.inf, *u[np.isfinite(u)].tolist(), np.inf] for c, u in upper.items() if np.isfinite(u).any()}
    if not ends:
        return [], {}
    raw, plain = ({c: f"{c}_{name}" for c in ends} for name in ("bucket", "bin"))
    buckets = Bucketizer(splitsArray=list(ends.values()), inputCols=list(ends), outputCols=list(raw.values()))
    # A sum has no metadata: as plain numbers, bins are cut in their order.
    numbers = ", ".join(f"`{raw[c]}` + 0.0D AS `{plain[c]}`" for c in ends)
    return [buckets, SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__")], plain


def fit_hazard_forest(
    frame: DataFrame, categories: int, trees: int = 30, depth: int = 6, all_rows: bool = False
) -> PipelineModel:
    """A random forest on person-periods.

    Spark's forest takes its cuts from about 10,000 sampled rows. With ``all_rows`` inputs are binned first by
    cuts from all rows, and the limit of bins is so high that Spark looks for bins in all rows too.
    """
    rows = person_periods(frame)
    bins = max_bins = max(64, categories + 1)
    binning, name = [], {}
    if all_rows:
        binning, name = _in_bins(cuts_of_all_rows(rows, NUMERIC, bins))
        # Spark samples max_bins**2 rows; the bins of an input are those it has.
        max_bins = max(bins, math.isqrt(rows.count()) + 1)
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="fails",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=20,
        featureSubsetStrategy="sqrt",
        maxBins=max_bins,
        seed=42,
    )
    inputs = [name.get(c, c) for c in [*INPUTS, "period"]]
    return Pipeline(
        stages=[*binning, VectorAssembler(inputCols=inputs, outputCol="features"), forest]
    ).fit(rows)


def predict_hazard_forest(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Survival curve from the period hazards; the area under it is the expected life.

    The periods are scored side by side as columns of the same row, so nothing is shuffled.
    """
    keep = [c for c in frame.columns if c not in INPUTS]
    *binning, assembler, forest = model.stages
    # Bins are the same in all periods.
    scored = PipelineModel(binning).transform(frame)
    by_period = PipelineModel([assembler, forest])
    for i in range(len(PERIOD_ENDS)):
        hazard = F.get(vector_to_array(F.col("probability")), 1).alias(f"_h{i}")
        before = scored.columns
        scored = by_period.transform(scored.withColumn("period", F.lit(float(i)))).select(*before, hazard)
    alive, area = F.lit(1.0), F.lit(0.0)
    for i, (start, end) in enumerate(zip([0, *PERIOD_ENDS[:-1]], PERIOD_ENDS)):
        scored = scored.withColumn(f"_alive{i}", alive * (1.0 - F.col(f"_h{i}")))
        # Deaths are spread evenly over their period.
        area = area + float(end - start) * (alive + F.col(f"_alive{i}")) / 2.0
        alive = F.col(f"_alive{i}")
    return scored.withColumn("pred_time", clean_rul(area)).select(
        *keep, "pred_time", (-F.col("pred_time")).alias("risk")
    )
