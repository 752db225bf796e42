"""The sequential search on surfaces whose best place is known."""

import math
import random

import pytest

from fleetlife.models.search import STARTUP, Parzen, from_unit, propose, search, to_unit

SPACE = {"depth": ("int", 2, 12), "rate": ("log", 0.001, 1.0), "share": ("float", 0.2, 1.0)}


def hill(p):
    """Best at depth 7, rate 0.05, share 0.6; a ripple makes small steps unreliable."""
    away = ((p["depth"] - 7) / 5) ** 2 + (math.log10(p["rate"] / 0.05) / 1.2) ** 2 + ((p["share"] - 0.6) / 0.4) ** 2
    return math.exp(-away) + 0.01 * math.sin(40 * p["share"])


def test_reaches_in_twenty_trials_what_random_needs_forty_for():
    """In most runs, and on the mean."""
    best = lambda runs: max(v for _, v in runs)
    ours = [best(search(SPACE, 20, hill, seed)) for seed in range(30)]
    random_ = [best(search(SPACE, 40, hill, 1000 + seed, random_only=True)) for seed in range(30)]
    assert sum(ours) / 30 > sum(random_) / 30
    assert sum(a > b for a, b in zip(ours, random_)) > 15


def test_seeded():
    assert search(SPACE, 15, hill, 3) == search(SPACE, 15, hill, 3)
    assert search(SPACE, 15, hill, 3) != search(SPACE, 15, hill, 4)


def test_failed_trials_are_bad():
    """A region that always fails is left."""
    tried = search({"x": ("float", 0.0, 1.0)}, 60, lambda p: None if p["x"] < 0.5 else 1.0, 5)
    late = [p["x"] < 0.5 for p, _ in tried[20:]]
    assert sum(late) < 0.3 * len(late)


@pytest.mark.parametrize("spec", SPACE.values())
def test_scales(spec):
    rng = random.Random(2)
    for _ in range(200):
        value = from_unit(*spec, rng.random())
        assert spec[1] <= value <= spec[2] * (1 + 1e-12)
        assert from_unit(*spec, to_unit(*spec, value)) == pytest.approx(value)
    assert from_unit(*spec, 1.0) == pytest.approx(spec[2]) and from_unit("int", 3, 3, 0.7) == 3


@pytest.mark.parametrize("values", [[], [0.5], [0.0, 0.0, 1.0], [0.1, 0.11, 0.12, 0.9]])
def test_density_sums_to_one(values):
    density = Parzen.of(values)
    steps = 4000
    assert sum(density.density((i + 0.5) / steps) for i in range(steps)) / steps == pytest.approx(1, abs=1e-3)
    rng = random.Random(1)
    assert all(0 <= density.draw(rng) <= 1 for _ in range(200))


def test_first_trials_are_random():
    tried = [({"x": 0.9}, 1.0)] * (STARTUP - 1)
    assert propose({"x": ("float", 0.0, 1.0)}, tried, random.Random(7)) == {"x": random.Random(7).random()}
