"""Tree-structured Parzen search: settings are proposed where good trials are dense and bad ones are not.

After some random trials, the best share of them and the rest are two densities per parameter: mixtures of
normals around the tried values, cut to the range, with a flat part for what was never tried. Values are drawn
from the first density, and the one with the largest ratio of both is tried next. Each trial depends on all
before it; the trials themselves are fitted and scored in Spark.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

#: Random trials before the densities are used.
STARTUP = 6

#: Share of the trials that count as good.
GOOD_SHARE = 0.2

#: Values drawn per parameter and trial.
DRAWS = 32

Space = Mapping[str, tuple[str, float, float]]
Trial = tuple[dict[str, Any], float | None]


def to_unit(kind: str, low: float, high: float, value: float) -> float:
    """A parameter's value on the scale from 0 to 1."""
    if kind == "log":
        return math.log(value / low) / math.log(high / low) if high > low else 0.5
    if kind == "int":
        return (value - low + 0.5) / (high - low + 1)
    return (value - low) / (high - low) if high > low else 0.5


def from_unit(kind: str, low: float, high: float, unit: float) -> Any:
    if kind == "log":
        return low * (high / low) ** unit
    if kind == "int":
        return int(min(high, low + math.floor(unit * (high - low + 1))))
    return low + unit * (high - low)


@dataclass(frozen=True)
class Parzen:
    """A density on [0, 1]: a normal around each point, as wide as the gap to its neighbours, and a flat part."""

    points: tuple[float, ...]
    widths: tuple[float, ...]

    @classmethod
    def of(cls, values: Sequence[float]) -> Parzen:
        points = sorted(values)
        least = 1.0 / min(100, len(points) + 2)
        ends = [0.0, *points, 1.0]
        gaps = [max(ends[i + 1] - ends[i], ends[i + 2] - ends[i + 1]) for i in range(len(points))]
        return cls(tuple(points), tuple(min(1.0, max(least, g)) for g in gaps))

    def density(self, at: float) -> float:
        total = 1.0
        for point, width in zip(self.points, self.widths):
            mass = _normal((1 - point) / width) - _normal(-point / width)
            total += math.exp(-(((at - point) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi) * mass)
        return total / (len(self.points) + 1)

    def draw(self, rng: random.Random) -> float:
        part = rng.randrange(len(self.points) + 1)
        if part == len(self.points):
            return rng.random()
        while True:
            at = rng.gauss(self.points[part], self.widths[part])
            if 0 <= at <= 1:
                return at


def _normal(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def propose(space: Space, trials: Sequence[Trial], rng: random.Random) -> dict[str, Any]:
    """The next setting to try. Trials without a value (failed ones) count as bad."""
    if len(trials) < STARTUP:
        return {name: from_unit(*spec, rng.random()) for name, spec in space.items()}
    ranked = sorted(trials, key=lambda t: -math.inf if t[1] is None else t[1], reverse=True)
    cut = max(2, math.ceil(GOOD_SHARE * len(ranked)))
    out = {}
    for name, spec in space.items():
        good, bad = (Parzen.of([to_unit(*spec, p[name]) for p, _ in part]) for part in (ranked[:cut], ranked[cut:]))
        drawn = [good.draw(rng) for _ in range(DRAWS)]
        out[name] = from_unit(*spec, max(drawn, key=lambda u: math.log(good.density(u)) - math.log(bad.density(u))))
    return out


def search(space: Space, trials: int, value: Callable[[dict[str, Any]], float | None], seed: int = 42,
           random_only: bool = False) -> list[Trial]:
    """All trials in order; the same for the same seed and values."""
    rng, done = random.Random(seed), []
    for _ in range(trials):
        params = propose(space, [] if random_only else done, rng)
        done.append((params, value(params)))
    return done
