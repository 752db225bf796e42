"""The penalised life-time model against its definition, row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.models import weibull
from fleetlife.models.weibull import WeibullModel, fit_weibull_ridge, predict_weibull_ridge
from fleetlife.session import stage


def lives(n, seed, b=(0.5, -0.3), intercept=2.5, scale=0.4):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        x, z = rng.normal(3.0, 2.0), rng.normal()
        life = math.exp(intercept + b[0] * (x - 3.0) + b[1] * z + scale * math.log(rng.exponential()))
        leave = rng.uniform(5, 80)
        rows.append((float(x), float(z), 1.0, max(1.0, min(life, leave)), int(life <= leave)))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return stage(spark.createDataFrame(lives(4000, 8), "x double, z double, same double, duration double, event int").repartition(4))


def objective(rows, at, penalty):
    """Mean log-likelihood less the penalty, at intercept, coefficients (standardised) and ln shape."""
    x = np.array([r[:2] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    t, died = np.log([r[3] for r in rows]), np.array([r[4] for r in rows])
    k = math.exp(at[-1])
    z = k * (t - at[0] - x @ at[1:-1])
    return float((died * (at[-1] + z - t) - np.exp(z)).mean() - penalty / 2 * (np.array(at[1:-1]) ** 2).sum())


def test_recovers_the_planted_model(frame):
    model = fit_weibull_ridge(frame, ["x", "z", "same"], penalty=0.0)
    b = model.plain()
    assert b["x"] == pytest.approx(0.5, abs=0.03) and b["z"] == pytest.approx(-0.3, abs=0.03)
    assert model.coefficients[2] == pytest.approx(0, abs=1e-6)  # constant inputs have no effect
    assert 1 / model.shape == pytest.approx(0.4, abs=0.03) and model.gradient < 1e-8


def test_optimum_and_gradient(frame):
    """No neighbour is better, and slopes equal finite differences anywhere."""
    rows = [tuple(r) for r in frame.collect()]
    model = fit_weibull_ridge(frame, ["x", "z"], penalty=0.1)
    best = [model.intercept, *model.coefficients, math.log(model.shape)]
    top = objective(rows, best, 0.1)
    for i in range(4):
        for step in (-1e-3, 1e-3):
            assert objective(rows, [*best[:i], best[i] + step, *best[i + 1 :]], 0.1) < top
    ready = frame.select(F.log("duration").alias("lived"), F.col("event").cast("double"), "x", "z")
    scaled, _, _ = weibull.standardised(ready, ["x", "z"], ["lived", "event"])
    at = np.array([2.0, 0.2, 0.1, 0.3])
    value, gradient, curve = weibull.likelihood_sums(scaled, 2, at)
    assert value / len(rows) == pytest.approx(objective(rows, at, 0.0))
    for i in range(4):
        up, down = at.copy(), at.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert gradient[i] / len(rows) == pytest.approx((objective(rows, up, 0) - objective(rows, down, 0)) / 2e-5, abs=1e-6)
        slopes = (weibull.likelihood_sums(scaled, 2, up)[1] - weibull.likelihood_sums(scaled, 2, down)[1]) / 2e-5
        assert curve[i] / len(rows) == pytest.approx(slopes / len(rows), abs=1e-5)


def test_penalty_shrinks_the_inputs_alone(frame):
    free, held, bound = (fit_weibull_ridge(frame, ["x", "z"], penalty=v) for v in (0.0, 0.1, 1e6))
    assert all(abs(a) > abs(b) > 0 for a, b in zip(free.coefficients, held.coefficients))
    assert max(map(abs, bound.coefficients)) < 1e-4 and bound.intercept > 1


def test_predictions(frame):
    model = fit_weibull_ridge(frame, ["x", "z"])
    again = WeibullModel.from_json(model.to_json())
    assert again == model
    out = predict_weibull_ridge(again, frame).collect()
    for r in out[:50]:
        eta = model.intercept + sum(b * (r[c] - m) / s for c, m, s, b in zip(model.inputs, model.means, model.deviations, model.coefficients))
        assert r.pred_time == pytest.approx(min(400, max(1, math.exp(eta) * math.log(2) ** (1 / model.shape))))
        assert r.risk == -r.pred_time


def test_nothing_to_fit(spark, frame):
    with pytest.raises(ValueError):
        fit_weibull_ridge(frame.where("duration < 0"), ["x"])
    with pytest.raises(ValueError):
        fit_weibull_ridge(frame.withColumn("event", F.lit(0)), ["x"])
    with pytest.raises(ArithmeticError):
        fit_weibull_ridge(frame, ["x", "z"], max_steps=1)
