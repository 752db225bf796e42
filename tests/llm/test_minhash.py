"""MinHash near duplicates and the exact links within groups, against comparing all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.llm import groupverify, hotkeys, minhash
from fleetlife.llm.groupverify import link_forest
from fleetlife.llm.hotkeys import join_groups
from fleetlife.llm.minhash import near_duplicates, plan_for
from fleetlife.session import stage

from .conftest import AWKWARD, Union, brute_components, near_copies


def compare(spark, rows, n, percent, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs, n=n, percent=percent, **options).collect()
    assert len(got) == len(rows)
    component, sizes = brute_components([r for r in rows if r[0] is not None], n, percent)
    own = defaultdict(list)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == (component[r.doc_id] if r.n_shingles else r.doc_id)
        assert r.kept == (r.component_id == r.doc_id)
        own[r.doc_id].append(r.n_shingles)
    assert {k: sorted(v) for k, v in own.items()} == sizes


@pytest.mark.parametrize("n, percent, seed, options", [(2, 80, 1, {}), (4, 85, 2, {}), (1, 60, 3, {"band_rows": 3}), (2, 100, 4, {})])
def test_links(spark, n, percent, seed, options):
    compare(spark, list(enumerate(near_copies(seed))), n, percent, **options)


def test_small_chunks_and_blocks(spark, monkeypatch):
    """Leaders in every chunk, and groups of many blocks, most of which doesn't link."""
    monkeypatch.setattr(minhash, "CHUNK_DOCS", 9)
    monkeypatch.setattr(groupverify, "BLOCK_DOCS", 5)
    monkeypatch.setattr(hotkeys, "LEAST_HOT", 3)
    rows = list(enumerate(near_copies(6, groups=3, copies=50, words=90)))
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    compare(spark, rows, 2, 80)


def test_awkward(spark, awkward, empty):
    compare(spark, AWKWARD, 2, 80)
    assert near_duplicates(awkward).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_duplicates(empty).count() == 0


def test_key_with_several_texts(spark):
    """It connects the sets of its texts."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    compare(spark, [(1, a), (2, a), (2, b), (3, b), (9, b), (4, "alone here")], 2, 80)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_plan(percent):
    plan = plan_for(percent)
    alike = percent / 100
    assert (1 - alike**plan.rows) ** plan.bands <= minhash.MISS
    rng = np.random.default_rng(percent)
    apart = rng.binomial(plan.minima, (1 - alike) / 2, 200_000)
    assert apart.max() <= plan.cut and plan.same < plan.cut < 0.45 * plan.minima


def test_minima_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        common = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64) * np.uint64(2)
        sets = [np.unique(np.append(common, rng.integers(0, 2**63, 1000 - len(common), dtype=np.uint64) * np.uint64(2) + np.uint64(1))) for _ in (0, 1)]
        jaccard = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        signature = minhash.minima(np.repeat([0, 1], [len(s) for s in sets]), np.concatenate(sets), 1000)
        assert (signature[0] == signature[1]).mean() == pytest.approx(jaccard, abs=0.06)
        apart = minhash.distances(*minhash.sketches(signature)) / 1000
        assert apart == pytest.approx((1 - jaccard) / 2, abs=0.06)


def test_followers_and_leaders_keep_candidates():
    """What is close under a key stays connected when followers are replaced by their leader."""
    rng = np.random.default_rng(8)
    plan = plan_for(80)
    width = -(-plan.minima // 8)
    base = rng.integers(0, 256, (3, width), dtype=np.uint8)
    sketch = np.repeat(base, 40, axis=0)
    for i in range(len(sketch)):
        for bit in rng.choice(width * 8, rng.integers(0, 40), replace=False):
            sketch[i, bit // 8] ^= np.uint8(1 << (bit % 8))
    keys = np.full((len(sketch), 1), 4, np.uint64)
    want = Union(range(len(sketch)))
    apart = minhash.distances(sketch[:, None, :], sketch[None, :, :])
    for a, b in zip(*np.nonzero(apart <= plan.cut)):
        want.join(int(a), int(b))
    got = Union(range(len(sketch)))
    for lo, hi in ((0, 60), (60, 120)):  # two chunks
        doc, key, follower, leader = minhash.follow_leaders(keys[lo:hi], sketch[lo:hi], plan)
        for a, b in zip(follower, leader):
            got.join(int(a) + lo, int(b) + lo)
        part = (doc + lo, key)
        rows = part if lo == 0 else tuple(np.concatenate(x) for x in zip(rows, part))
    at, key = rows
    assert len(at) < len(sketch)
    pairs = minhash.close_pairs((key >> np.uint64(1)).astype(np.int64), at, (key & np.uint64(1)).astype(np.int64), sketch[at], plan)
    for a, b in pairs.tolist():
        got.join(a, b)
    for i in range(len(sketch)):
        for j in range(i):
            assert want.find(i) != want.find(j) or got.find(i) == got.find(j)


@pytest.mark.parametrize("seed", range(6))
def test_link_forest(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(6):
        base = rng.sample(range(1000), rng.randint(1, 60))
        for _ in range(6):
            own = set(base)
            for _ in range(rng.choice([0, 1, 3, 12])):
                own.symmetric_difference_update([rng.randrange(1000)])
            sets.append(np.array(sorted(own or {1}), np.uint64))
    percent = rng.choice([50, 80, 100])
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
    label = np.array([i % 9 for i in range(len(sets))]) if seed % 2 else None
    side = np.array([i % 2 for i in range(len(sets))]) if seed % 3 == 0 else None
    want, got = Union(range(len(sets))), Union(range(len(sets)))
    if label is not None:
        for own in (want, got):
            for i in range(len(sets)):
                own.join(i, int(label[i]))
    for i in range(len(sets)):
        for j in range(i):
            if (side is None or side[i] != side[j]) and linked(sets[i], sets[j]):
                want.join(i, j)
    edges = link_forest(sets, percent, label, side)
    for a, b in edges:
        assert linked(sets[a], sets[b])
        got.join(a, b)
    assert [want.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))]
    assert len(edges) < len(sets) and link_forest([], 80) == [] == link_forest(sets[:1], 80)


def test_join_groups(spark):
    """Large groups and small ones, each row with its group once."""
    rng = random.Random(2)
    values = [rng.choice([0, 0, 0, 1, *range(2, 30)]) for _ in range(500)]
    rows = stage(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, k int"))
    groups = stage(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    for least in (1, 20, 1000):
        got = join_groups(rows, groups, ["k"], "n", 500, hot_groups=1000, least_hot=least).collect()
        assert sorted(r.id for r in got) == list(range(500))
        sizes = Counter(values)
        assert all(r.n == sizes[r.k] and values.index(r.k) == r.first for r in got)
