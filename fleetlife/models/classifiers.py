"""Failure classifiers as pipelines of distributed estimators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.contracts import CATEGORY, feature_columns
from fleetlife.operators.encode import encode

CODE = "model_index"
NUMERIC = [c for c in feature_columns() if c != CATEGORY]

#: Mean label of a row's category, from ``encode.ordered_means`` on training rows; an input of ``ordered_boost``.
CATEGORY_MEAN = "category_mean"

#: Category codes are shifted by one, because estimators need them to start at 0 (0 = unseen).
UNSEEN_SHIFT = 1


#: Columns of a dataset that are no inputs.
NOT_INPUTS = {"serial_number", "date", "y", "event", "duration", CATEGORY, CATEGORY_MEAN}


def numeric_inputs(columns: Sequence[str]) -> list[str]:
    """Numeric inputs of a dataset: the rolling contract if it has all of it, else what it has."""
    found = [c for c in columns if c not in NOT_INPUTS]
    return NUMERIC if set(NUMERIC) <= set(found) else found


def prepare(
    frame: DataFrame, book: DataFrame, categories: int, fill: bool = True, numeric_columns: Sequence[str] = tuple(NUMERIC)
) -> DataFrame:
    """Encode the category for the estimators and make features doubles.

    With ``fill``, unknown values are 0, as in request scoring. Without, they stay null: each
    classifier then treats them in its own way (0 for boosted trees, the median for the others).
    """
    nominal = {"ml_attr": {"type": "nominal", "name": CODE, "num_vals": categories + UNSEEN_SHIFT}}
    coded = encode(frame, book, CATEGORY, "category_code")
    index = (F.col("category_code") + UNSEEN_SHIFT).cast("double").alias(CODE, metadata=nominal)
    others = [c for c in coded.columns if c not in (*numeric_columns, "category_code")]
    numeric = [F.col(c).cast("double").alias(c) for c in numeric_columns]
    ready = coded.select(*others, *numeric, index)
    return ready.fillna(0.0, subset=list(numeric_columns)) if fill else ready


def weighted(frame: DataFrame, balanced: bool = False) -> DataFrame:
    """Add ``weight``: negatives per positive for positives, or balanced weights for both."""
    counts = frame.agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    n = F.col("pos") + F.col("neg")
    at_least_one = F.lit(1)
    if balanced:
        positive = n / (2.0 * F.greatest("pos", at_least_one))
        negative = n / (2.0 * F.greatest("neg", at_least_one))
    else:
        positive = F.col("neg") / F.greatest("pos", at_least_one)
        negative = F.lit(1.0)
    y = F.col("y") == 1
    return frame.withColumn(
        "weight",
        F.when(y, counts.select(positive).scalar()).otherwise(counts.select(negative).scalar()),
    )


def _known(columns: Sequence[str]) -> list[str]:
    return [f"{c}_known" for c in columns]


def _zeros(columns: Sequence[str]) -> SQLTransformer:
    """Unknown values as 0."""
    filled = ", ".join(f"coalesce(`{c}`, 0.0D) AS `{k}`" for c, k in zip(columns, _known(columns)))
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def _medians(columns: Sequence[str]) -> Imputer:
    """Unknown values as the median of the training rows."""
    return Imputer(strategy="median", inputCols=list(columns), outputCols=_known(columns))


def _boosted(categories: int, params: Mapping[str, Any], numeric: Sequence[str]) -> Pipeline:
    settings = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.8, **params}
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="y",
        weightCol="weight",
        seed=42,
        maxBins=max(64, categories + UNSEEN_SHIFT),
        **settings,
    )
    assembler = VectorAssembler(inputCols=[CODE, *_known(numeric)], outputCol="features")
    return Pipeline(stages=[_zeros(numeric), assembler, trees])


def _ordered_boost(categories: int, params: Mapping[str, Any], numeric: Sequence[str]) -> Pipeline:
    """Boosted trees that get the category as its ordered label mean: one number, however many categories."""
    settings = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.8, "maxBins": 64, **params}
    trees = GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", seed=42, **settings)
    assembler = VectorAssembler(inputCols=[CATEGORY_MEAN, *_known(numeric)], outputCol="features")
    return Pipeline(stages=[_zeros(numeric), assembler, trees])


def _forest(categories: int, params: Mapping[str, Any], numeric: Sequence[str]) -> Pipeline:
    settings = {"numTrees": 100, "maxDepth": 12, "minInstancesPerNode": 50, **params}
    trees = RandomForestClassifier(
        featuresCol="features",
        labelCol="y",
        weightCol="weight",
        seed=42,
        featureSubsetStrategy="sqrt",
        maxBins=max(64, categories + UNSEEN_SHIFT),
        **settings,
    )
    return Pipeline(
        stages=[
            _medians(numeric),
            VectorAssembler(inputCols=[CODE, *_known(numeric)], outputCol="features"),
            trees,
        ]
    )


def _logistic(categories: int, params: Mapping[str, Any], numeric: Sequence[str]) -> Pipeline:
    settings = {"maxIter": 200, "regParam": 1e-4, **params}
    return Pipeline(
        stages=[
            _medians(numeric),
            VectorAssembler(inputCols=_known(numeric), outputCol="numeric"),
            StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True, withStd=True),
            OneHotEncoder(inputCols=[CODE], outputCols=["category"], handleInvalid="keep", dropLast=False),
            VectorAssembler(inputCols=["scaled", "category"], outputCol="features"),
            LogisticRegression(
                featuresCol="features", labelCol="y", weightCol="weight", standardization=False, **settings
            ),
        ]
    )


#: Name -> (pipeline builder, balanced class weights?). Add an entry to add a model.
CLASSIFIERS: dict[str, tuple[Callable[[int, Mapping[str, Any], Sequence[str]], Pipeline], bool]] = {
    "boosted_trees": (_boosted, False),
    "ordered_boost": (_ordered_boost, False),
    "random_forest": (_forest, True),
    "logistic": (_logistic, True),
}


def fit_classifier(
    name: str, prepared: DataFrame, categories: int, params: Mapping[str, Any] | None = None
) -> PipelineModel:
    """Fit on rows with a label; ``prepared`` should be a written table, it is read repeatedly."""
    build, balanced = CLASSIFIERS[name]
    numeric = numeric_inputs([c for c in prepared.columns if c != CODE])
    return build(categories, params or {}, numeric).fit(weighted(prepared, balanced))


def score(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """Add ``score``, the probability of the positive class; other columns stay."""
    used = {*numeric_inputs([c for c in prepared.columns if c != CODE]), CODE, CATEGORY_MEAN}
    keep = [c for c in prepared.columns if c not in used]
    probability = vector_to_array(F.col("probability"))
    return model.transform(prepared).select(*keep, F.get(probability, 1).alias("score"))


def feature_importance(model: PipelineModel, names: Sequence[str] | None = None) -> DataFrame:
    """Importance per input of a tree model, highest first; the inputs are a fixed short list."""
    names = list(names or [CATEGORY, *NUMERIC])
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), F.col("feature"))


def linear_effects(model: PipelineModel) -> dict[str, tuple[float, float]]:
    """Coefficient per original unit and training mean of each numeric input of ``logistic``."""
    scaler, linear = model.stages[2], model.stages[-1]
    deviations, means = scaler.std.toArray(), scaler.mean.toArray()
    coefficients = linear.coefficients.toArray()
    return {
        name: (float(coefficients[i] / deviations[i]) if deviations[i] > 0 else 0.0, float(means[i]))
        for i, name in enumerate(NUMERIC)
    }


def category_effects(model: PipelineModel, known: DataFrame) -> dict[int, float]:
    """Coefficient of each category code of ``logistic``, less the mean over the training rows."""
    coefficients = model.stages[-1].coefficients.toArray()[len(NUMERIC) :]
    counts = {int(r[0]): r[1] for r in known.groupBy(CODE).agg(F.count("*")).collect()}  # one row per category
    total = sum(counts.values())
    mean = sum(coefficients[c] * n for c, n in counts.items() if c < len(coefficients)) / max(total, 1)
    return {c: float(v - mean) for c, v in enumerate(coefficients)}
