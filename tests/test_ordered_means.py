"""Ordered category means by hand, and what they are for: categories that say nothing get no weight."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlife.models import bakeoff, classifiers
from fleetlife.operators import encode
from fleetlife.operators.rankmetrics import classification_bundle
from fleetlife.session import stage

NAMES = "serial_number string, date string, model string, y int"


def slot(*keys):
    return int(hashlib.md5("".join(k or "" for k in keys).encode()).hexdigest()[:8], 16)


def by_hand(rows, prior, weight):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    out = defaultdict(list)
    for own in groups.values():
        n = pos = 0
        for r in sorted(own, key=lambda r: (slot(r[0], r[1]), r[0], r[1], r[3] is not None, r[3] or 0)):
            out[r].append((pos + weight * prior) / (n + weight))
            if r[3] is not None:
                n, pos = n + 1, pos + r[3]
    return {r: sorted(v) for r, v in out.items()}


@pytest.mark.parametrize("bits", [1, 5, 16])
def test_by_hand(spark, bits, monkeypatch):
    """Nulls, the empty category, rows without a label, repeated rows; however a category is cut."""
    monkeypatch.setattr(encode, "RANGE_BITS", bits)
    rng = random.Random(bits)
    rows = [(f"u{rng.randrange(80)}", f"d{i % 7}", rng.choice(["a", "b", "", None]), rng.choice([0, 0, 1, None])) for i in range(400)]
    rows += rows[:9]
    labels = [r[3] for r in rows if r[3] is not None]
    expected = by_hand(rows, sum(labels) / len(labels), 2.0)
    frame = stage(spark.createDataFrame(rows, NAMES).repartition(4))
    got = defaultdict(list)
    for r in encode.ordered_means(frame, weight=2.0).collect():
        got[r.serial_number, r.date, r.model, r.y].append(r.category_mean)
    assert {k: sorted(v) for k, v in got.items()} == {k: pytest.approx(v) for k, v in expected.items()}


def test_of_later_rows(spark):
    train = spark.createDataFrame([("a", "1", "m", 1), ("b", "1", "m", 0), ("c", "1", None, 1), ("d", "1", "n", None)], NAMES)
    means, prior = encode.category_means(train, weight=1.0)
    assert prior == pytest.approx(2 / 3)
    new = spark.createDataFrame([("m",), (None,), ("n",), ("never",)], "model string")
    got = {r.model: r.category_mean for r in encode.with_category_mean(new, means, prior).collect()}
    third = 2 / 3
    assert got == {k: pytest.approx(v) for k, v in {"m": (1 + third) / 3, None: (1 + third) / 2, "n": third, "never": third}.items()}


def test_nothing(spark):
    none = spark.createDataFrame([], NAMES)
    assert encode.ordered_means(none).count() == 0
    assert encode.label_mean(none) == 0.0


def noise(spark, n, seed, categories):
    """A label that one input explains, and a category that says nothing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        wear = rng.random()
        rows.append((f"u{seed}-{i}", "2024-01-01", f"m{rng.randrange(categories)}", wear, int(rng.random() < 0.1 + 0.6 * wear)))
    return stage(spark.createDataFrame(rows, "serial_number string, date string, model string, wear double, y int"))


def test_random_categories_get_no_weight(spark):
    """A plain mean of rare categories holds the row's own label and misleads; the ordered one does not."""
    train, test = noise(spark, 2400, 1, 600), noise(spark, 1200, 2, 600)
    ready, categories = bakeoff.prepared_splits({"train": train, "test": test}, means=True)
    means, prior = encode.category_means(ready["train"])
    plain = encode.with_category_mean(ready["train"].drop("category_mean"), means, prior)
    leak = plain.agg(F.corr("category_mean", "y")).first()[0]
    assert leak > 0.3 and abs(ready["train"].agg(F.corr("category_mean", "y")).first()[0]) < 0.08
    model = classifiers.fit_classifier("ordered_boost", ready["train"], categories, {"maxIter": 15, "maxDepth": 3})
    weights = dict(zip(["category_mean", "wear"], model.stages[-1].featureImportances.toArray()))
    misled = classifiers.fit_classifier("ordered_boost", stage(plain), categories, {"maxIter": 15, "maxDepth": 3})
    believed = dict(zip(["category_mean", "wear"], misled.stages[-1].featureImportances.toArray()))
    assert weights["category_mean"] < believed["category_mean"] - 0.1
    good, bad = (classification_bundle(classifiers.score(m, ready["test"])).first().roc_auc for m in (model, misled))
    assert good > bad + 0.02


def test_telling_categories_are_used(spark):
    rng = random.Random(5)
    rate = {f"m{k}": rng.choice([0.05, 0.9]) for k in range(40)}
    make = lambda n, s: stage(spark.createDataFrame(
        [(f"u{s}-{i}", "2024-01-01", m, rng.random(), int(rng.random() < rate[m])) for i in range(n) for m in [rng.choice(sorted(rate))]],
        "serial_number string, date string, model string, wear double, y int"))
    splits = {"train": make(1500, 1), "val": make(500, 2), "test": make(500, 3)}
    board = bakeoff.run_bakeoff(splits, ["ordered_boost"], {"ordered_boost": {"maxIter": 5, "maxDepth": 3}}).collect()
    assert {r.status for r in board} == {"ok"} and all(r.roc_auc > 0.8 for r in board)
