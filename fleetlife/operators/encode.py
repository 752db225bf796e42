"""Categories as numbers: codes (the position among the sorted training categories, -1 for unseen or null),
and ordered label means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.functions.hashing import hash_slot
from fleetlife.operators.prefix import running_totals
from fleetlife.session import stage


def codebook(train: DataFrame, column: str = "model") -> DataFrame:
    """Distinct non-null categories with their code, as a written table of known size."""
    distinct = train.where(F.col(column).isNotNull()).select(column).distinct()
    ranked = running_totals(distinct.withColumn("n", F.lit(1).cast("long")), column, ["n"])
    return stage(ranked.select(column, F.col("n_before").cast("int").alias("code")))


def encode(frame: DataFrame, book: DataFrame, column: str = "model", code: str = "model_code") -> DataFrame:
    """Left join with the codebook; Spark broadcasts it while it is below its size threshold."""
    known = book.select(F.col(column).alias("_category"), F.col("code").alias("_code"))
    return (
        frame.join(known, F.col(column) == F.col("_category"), "left")
        .withColumn(code, F.coalesce("_code", F.lit(-1)))
        .drop("_category", "_code")
    )


# --- ordered statistics: what the label was in a row's category, without its own ---

#: Leading bits of the hash order by which a category is split among tasks.
RANGE_BITS = 16


def _parts(column: str) -> dict[str, Column]:
    """The category as two columns without nulls."""
    return {"_none": F.col(column).isNull(), "_category": F.coalesce(F.col(column).cast("string"), F.lit(""))}


def _smoothed(positives: Column, n: Column, prior: Column, weight: float) -> Column:
    return (positives + weight * prior) / (n + weight)


def label_mean(frame: DataFrame, label: str = "y") -> float:
    """The mean label of all rows that have one; 0 without any."""
    return frame.agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0))).first()[0]


def ordered_means(
    frame: DataFrame,
    column: str = "model",
    label: str = "y",
    keys: Sequence[str] = ("serial_number", "date"),
    prior: float | None = None,
    weight: float = 1.0,
    name: str = "category_mean",
) -> DataFrame:
    """Add ``name``: the mean label of the rows of the same category that come before in a hash order.

    The order is that of the hash of ``keys``, so it has nothing to do with the label, and no row sees its own.
    ``prior`` (default: the mean of all labels) counts as ``weight`` rows that come first. Null is a category.
    Rows without a label get a mean and add nothing; rows with equal keys are in the order of their labels.
    A category is cut into ranges of the hash, of which tasks sort one; the sums of earlier ranges are added.
    ``frame`` should be a written table, it is read twice.
    """
    prior = label_mean(frame, label) if prior is None else prior
    y = F.col(label).cast("long")
    rows = frame.withColumns(_parts(column)).withColumn("_slot", hash_slot(*keys))
    rows = rows.withColumn("_range", F.shiftright("_slot", 32 - RANGE_BITS).cast("int"))
    cell = ["_none", "_category", "_range"]
    sums = rows.groupBy(*cell).agg(F.count(label).alias("_n"), F.coalesce(F.sum(y), F.lit(0)).alias("_pos"))
    # At most 2**RANGE_BITS rows per category.
    earlier = Window.partitionBy("_none", "_category").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *cell, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in ("_n", "_pos")]
    )
    inside = Window.partitionBy(*cell).orderBy("_slot", *keys, label).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, cell).withColumns(
        {
            "_n": F.col("_n_offset") + F.count(label).over(inside),
            "_pos": F.col("_pos_offset") + F.coalesce(F.sum(y).over(inside), F.lit(0)),
        }
    )
    mean = _smoothed(F.col("_pos"), F.col("_n"), F.lit(prior), weight)
    return placed.withColumn(name, mean).drop(*cell, "_slot", "_n", "_pos", "_n_offset", "_pos_offset")


def category_means(
    train: DataFrame, column: str = "model", label: str = "y", prior: float | None = None, weight: float = 1.0
) -> tuple[DataFrame, float]:
    """(category, mean) over all labelled rows, for rows that were not trained on; and the prior."""
    prior = label_mean(train, label) if prior is None else prior
    sums = train.withColumns(_parts(column)).groupBy("_none", "_category").agg(
        F.count(label).alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("pos")
    )
    return stage(sums.select("_none", "_category", _smoothed(F.col("pos"), F.col("n"), F.lit(prior), weight).alias("_mean"))), prior


def with_category_mean(
    frame: DataFrame, means: DataFrame, prior: float, column: str = "model", name: str = "category_mean"
) -> DataFrame:
    """Add ``name`` from ``category_means``; an unseen category has the prior."""
    keyed = frame.withColumns(_parts(column)).join(means, ["_none", "_category"], "left")
    return keyed.withColumn(name, F.coalesce("_mean", F.lit(prior))).drop("_none", "_category", "_mean")
