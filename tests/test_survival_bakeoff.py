"""The survival bake-off on all rows: nothing it fits or reports comes from a sample."""

import math

import pytest
from pyspark.sql import functions as F

from fleetlife.models import bakeoff
from fleetlife.models import survival as sv
from fleetlife.plans import datasets, registry
from fleetlife.session import stage
from fleetlife.sources.testdata import EVENT_SETTINGS as S


def with_inputs(frame, **known):
    """All inputs of the models: the given ones, and 0 for the others."""
    zeros = {c: F.lit(0.0) for c in sv.NUMERIC if c not in known}
    return frame.withColumns({**known, **zeros})


def lives(spark, n, censored):
    """The first rows are censored. Unit, day and model differ, so that any sample by key would show."""
    i = F.col("id")
    frame = spark.range(n).select(
        F.concat(F.lit("u"), i).alias("serial_number"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 997).cast("int")).alias("date"),
        F.concat(F.lit("m"), i % 31).alias("model"),
        F.when(i < censored, 0).otherwise(1).cast("tinyint").alias("event"),
        (i % 29).cast("int").alias("duration"),
    )
    return with_inputs(frame, smart_5_raw=(F.xxhash64("serial_number") % 1000).cast("double"))


def test_models_are_fitted_to_all_rows(monkeypatch, spark):
    """However many of them are censored; rows without an outcome can't be fitted to."""
    seen = {}

    def counted(name):
        def fit(df, *_, **__):
            counts = df.groupBy("event").agg(F.count("*"), F.countDistinct("serial_number")).collect()
            seen[name] = {r[0]: tuple(r)[1:] for r in counts}
            raise RuntimeError("seen")

        return fit

    for module, fit, name in (
        (bakeoff, "fit_weibull_ridge", "weibull"),
        (bakeoff.sv, "fit_cox", "cox"),
        (bakeoff.sv, "fit_hazard_forest", "hazard_forest"),
        (bakeoff, "fit_survival_forest", "survival_forest"),
    ):
        monkeypatch.setattr(module, fit, counted(name))
    unknown = lives(spark, 7, 7).withColumn("event", F.lit(None).cast("tinyint"))
    train = lives(spark, 330_500, 330_000).unionByName(unknown)
    board = bakeoff.run_survival_bakeoff(train, lives(spark, 10, 5)).collect()
    assert {r.model: r.error for r in board} == dict.fromkeys(seen, "RuntimeError: seen")
    assert seen == dict.fromkeys(("weibull", "cox", "hazard_forest", "survival_forest"), {0: (330_000, 330_000), 1: (500, 500)})


def test_the_query_takes_whole_splits(monkeypatch, spark, panel, summary, sf):
    given = {}
    monkeypatch.setattr(bakeoff, "run_survival_bakeoff", lambda train, test: given.update(train=train, test=test))
    registry.survival_bakeoff(spark, sf)
    for name, table in given.items():
        whole = datasets.survival_split(panel, summary, S.splits[name])
        keys = ["serial_number", "date", "event", "duration"]
        assert sorted(table.select(keys).collect()) == sorted(whole.select(keys).collect())
    sampled = datasets.survival_split(panel, summary, S.splits["test"], S.survival_ratios["test"])
    assert set(given) == {"train", "test"} and given["test"].count() > sampled.count()


def test_cuts_come_from_all_rows(spark):
    """Values of one row in thousands count; long tails beside a heavy value are set apart from it."""
    n = 20_000
    i = F.col("id")
    frame = spark.range(n).select(
        F.when(i == 17, 5.0).when(i == 4711, 2.0).otherwise(i % 2).alias("few"),
        (i / 1.0).alias("many"),
        F.when(i < n - 50, 0.0).otherwise(i / 1.0).alias("tail"),
        F.lit(3.0).alias("same"),
    )
    cuts = sv.cuts_of_all_rows(frame.repartition(5), ["few", "many", "tail", "same"], 64)
    assert cuts["few"] == [0.0, 1.0, 2.0] and cuts["same"] == []
    assert cuts["many"] == pytest.approx([n * k / 64 for k in range(1, 64)], abs=n / 1000)
    assert cuts["tail"][0] == 0.0
    assert sv.cuts_of_all_rows(frame.where("id < 0"), ["few", "same"], 64) == {"few": [], "same": []}


def test_bins_of_the_hazard_forest(spark):
    """A value equal to a cut is below it, and infinite values have a bin."""
    frame = spark.createDataFrame([(v, 1.0) for v in (-math.inf, -1.0, 0.0, 0.5, 2.0, math.inf)], "a double, b double")
    stages, names = sv._in_bins({"a": [-0.0, 0.0, 2.0, math.inf], "b": []})
    assert names == {"a": "a_bin"}
    for s in stages:
        frame = s.transform(frame)
    assert [r.a_bin for r in frame.collect()] == [0, 0, 0, 1, 1, 2]
    assert not frame.schema["a_bin"].metadata
    assert sv._in_bins({"b": []}) == ([], {})


def test_hazard_forest_of_all_rows(spark):
    """The rows of one value in 500 fail at once; Spark's sample of rows for cuts is all of them."""
    i = F.col("id")
    rare = i % 500 == 41
    frame = spark.range(30_000).select(
        (i % 3).cast("double").alias(sv.CODE),
        F.when(rare, 7.0).otherwise(i % 5).alias("smart_5_raw"),
        (i % 7919).cast("double").alias("smart_188_raw"),
        F.when(rare, 1).otherwise(0).alias("event"),
        F.when(rare, 2).otherwise(50).alias("duration"),
    )
    train = stage(with_inputs(frame, smart_5_raw=F.col("smart_5_raw"), smart_188_raw=F.col("smart_188_raw")))
    model = sv.fit_hazard_forest(train, 3, depth=4, all_rows=True)
    rows = sv.person_periods(train).count()
    assert rows > 64**2 and model.stages[-1].getMaxBins() ** 2 >= rows
    one_each = train.dropDuplicates(["smart_5_raw"]).withColumn("value", F.col("smart_5_raw"))
    found = sv.predict_hazard_forest(model, one_each)
    assert set(found.columns) == {"event", "duration", "value", "risk", "pred_time"}
    risk = {r.value: r.risk for r in found.collect()}
    assert sorted(risk) == [0, 1, 2, 3, 4, 7] and all(risk[7] > risk[v] + 1 for v in range(5))
