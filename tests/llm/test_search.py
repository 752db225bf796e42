"""Ranked search against scoring every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.llm import lexicalsearch
from fleetlife.llm.lexicalsearch import best_of_lists, search

from .conftest import AWKWARD, LETTERS, LOWER


def terms(text):
    return LETTERS.findall((text or "").translate(LOWER))


def brute_search(docs, queries, k):
    """(query, rank, doc, score) of every query row."""
    held = [(key, Counter(terms(text))) for key, text in docs]
    held = [(key, own, sum(own.values())) for key, own in held if own]
    n, total = len(held), sum(words for _, _, words in held)
    df = Counter(t for _, own, _ in held for t in own)
    out = []
    for name, text in queries:
        scores = []
        for key, own, words in held:
            m = 100 - 50 + (50 * words * n) // total
            score = 0
            for t in set(terms(text)) & set(own):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * own[t]) // (1000 * own[t] + 20 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        for rank, (score, _, _, key) in enumerate(sorted(scores)[:k], 1):
            out.append((name, rank, key, -score))
    return sorted(out, key=repr)


def found(spark, docs, queries, k):
    names = "item_id long, text string"
    frame = search(docs, spark.createDataFrame(queries, names), k=k)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


QUERIES = [
    (1, "alpha beta sigma tau"),
    (2, "the MIT license, and THE apache license"),
    (3, None),
    (4, ""),
    (5, "nothing of it occurs"),
    (6, "12 naïve Über 北京 one ab end line"),
    (6, "one"),
    (None, "word kappa"),
]


def test_awkward(spark, awkward):
    assert found(spark, awkward, QUERIES, 3) == brute_search(AWKWARD, QUERIES, 3)


def random_docs(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 30])))) for i in range(count)]
    docs += [(count + i, docs[3][1] + " w1") for i in range(40)]  # a tie that k cuts
    queries = [(q, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for q in range(30)]
    return docs, queries + [(99, "w1"), (100, docs[3][1])]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_random(spark, k, monkeypatch):
    """Small chunks, reads and blocks, and several tasks."""
    docs, queries = random_docs(k, 400)
    monkeypatch.setattr(lexicalsearch, "BLOCK_BYTES", 900)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    chunks = lexicalsearch._chunks.__globals__
    monkeypatch.setitem(chunks, "CHUNK_BYTES", 1_000)
    monkeypatch.setitem(chunks, "FIRST_READ", 2)
    assert found(spark, frame, queries, k) == brute_search(docs, queries, k)


def test_empty(spark, empty, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert search(awkward, none).count() == 0
    assert found(spark, empty, QUERIES, 5) == []
    assert found(spark, awkward.where("doc_id = 1"), QUERIES, 5) == []


@pytest.mark.parametrize("seed", range(20))
def test_intervals(seed, monkeypatch):
    """What is returned has exact scores and holds the best k with all ties of the last place."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(lexicalsearch, "FIRST_READ", int(rng.integers(1, 5)))
    documents, k = 200, int(rng.integers(1, 30))
    lists, total = [], np.zeros(documents, np.int64)
    for _ in range(rng.integers(0, 6)):
        own = rng.permutation(documents)[: rng.integers(0, documents)]
        impacts = np.sort(rng.integers(1, 6, len(own)))[::-1].astype(np.int64)
        total[own] += impacts
        lists.append((own, impacts))
    floor = int(rng.integers(0, 6))
    docs, scores = best_of_lists(lists, documents, k, floor)
    assert (total[docs] == scores).all()
    last = max(floor, int(np.sort(total)[::-1][k - 1]), 1)
    assert set(np.flatnonzero(total >= last)) <= set(docs.tolist())


def test_reading_stops_early():
    """With a few far ahead, most of long lists is not read."""
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, part):
            if isinstance(part, slice):
                read.append(part.stop)
            return super().__getitem__(part)

    own = np.arange(100_000)
    impacts = np.concatenate([np.full(10, 1_000), np.ones(99_990)]).astype(np.int64)
    docs, _ = best_of_lists([(own.view(Watched), impacts), (own.copy(), impacts)], len(own), 10)
    assert docs.tolist() == list(range(10)) and max(read) < 1_000


def test_other_columns_are_not_read(spark, awkward):
    plan = search(awkward, spark.createDataFrame([(1, "one")], "item_id long, text string"))
    assert plan.columns == ["item_id", "rank", "doc_id", "score"]
    assert plan.select(F.max("rank")).first()[0] == 2
