"""The censoring-aware training against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.contracts import SMART_BIG5
from fleetlife.models import sequence_rul as sr
from fleetlife.operators.survmetrics import censored_rul_loss, concordance, rul_error
from fleetlife.session import stage

STEPS, READINGS = 4, len(SMART_BIG5)


def windows(n, seed):
    """Life falls with the last value of one reading and the rise of another."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = rng.normal(10, 3, (STEPS, READINGS)).astype(np.float32)
        life = max(1.0, 60 - 3.0 * (w[-1, 0] - 10) - 2.0 * (w[-1, 2] - w[0, 2]) + rng.normal(0, 2))
        leave = rng.uniform(20, 120)
        rows.append((f"u{i}", [[float(v) for v in r] for r in w], bool(life <= leave), float(min(life, leave))))
    return rows


SCHEMA = "serial_number string, window array<array<float>>, event boolean, dur float"


@pytest.fixture(scope="module")
def frame(spark):
    return stage(spark.createDataFrame(windows(1500, 1), SCHEMA).repartition(4))


def test_slopes_are_finite_differences(frame):
    rows = stage(sr.flat_windows(frame))
    rng = np.random.default_rng(5)
    size = STEPS * READINGS
    means, deviations = np.full(size, 10.0), np.full(size, 3.0)
    weights, intercept = rng.normal(0, 2, size), 55.0
    total = sr.loss_sums(rows, weights, intercept, means, deviations).reshape(2, -1)
    again = lambda w, c: sr.loss_sums(rows, w, c, means, deviations).reshape(2, -1)[:, 0]
    for i in (0, 7, size - 1):
        step = np.zeros(size)
        step[i] = 1e-5
        difference = (again(weights + step, intercept) - again(weights - step, intercept)) / 2e-5
        assert total[:, 2 + i] == pytest.approx(difference, rel=1e-4, abs=0.2)
    assert total[:, 1] == pytest.approx((again(weights, intercept + 1e-5) - again(weights, intercept - 1e-5)) / 2e-5, rel=1e-4, abs=0.2)


def test_loss_is_the_metric(frame):
    rows = stage(sr.flat_windows(frame))
    size = STEPS * READINGS
    total = sr.loss_sums(rows, np.zeros(size), 50.0, np.zeros(size), np.ones(size)).reshape(2, -1)
    known = censored_rul_loss(frame.withColumn("pred_time", F.lit(50.0)), time="dur").first()
    failed = frame.where("event").count()
    assert total[0, 0] / failed == pytest.approx(known.observed_loss)
    assert total[1, 0] / (frame.count() - failed) == pytest.approx(known.censored_loss)


def test_learns(spark, frame):
    model = sr.fit_sequence_rul(frame)
    constant = min(
        censored_rul_loss(frame.withColumn("pred_time", F.lit(float(c))), time="dur").first().loss for c in range(20, 121, 5)
    )
    test = stage(sr.predict_sequence_rul(model, spark.createDataFrame(windows(800, 2), SCHEMA)))
    reached = censored_rul_loss(test, time="dur").first().loss
    assert reached < 0.4 * constant and model.loss < 0.4 * constant
    assert concordance(test, "dur").first().c_index > 0.85
    assert rul_error(test, "dur").first().rul_mae_days < 4
    plain = model.weights / model.deviations
    assert plain[-1, 0] == pytest.approx(-3, abs=0.3)
    assert plain[-1, 2] == pytest.approx(-2, abs=0.3) and plain[0, 2] == pytest.approx(2, abs=0.3)
    assert test.columns == ["serial_number", "event", "dur", "pred_time", "risk"]


def test_does_not_depend_on_partitions(frame):
    one, many = sr.fit_sequence_rul(frame.coalesce(1), max_steps=5), sr.fit_sequence_rul(frame.repartition(7), max_steps=5)
    assert one.weights == pytest.approx(many.weights, abs=1e-6) and one.intercept == pytest.approx(many.intercept)


def test_nothing_and_one_kind(spark, frame):
    with pytest.raises(ValueError):
        sr.fit_sequence_rul(frame.where("dur < 0"))
    model = sr.fit_sequence_rul(frame.where("not event"), max_steps=10)
    assert model.loss < 1e-2  # a long life is no shortfall for anyone
    assert sr.predict_sequence_rul(model, frame.where("dur < 0")).count() == 0
