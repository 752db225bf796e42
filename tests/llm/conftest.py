"""Documents with everything awkward, and plain Python counterparts of the word rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")

#: id, text. Ids and texts can be null; rows are repeated; one text is very long.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Über ÉTÉ naïve 北京 word-word a_b 12"),
    (5, "one"),
    (5, "one"),
    (6, "The MIT License and the Apache\nLicense.\nmit license"),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau"),
    (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau"),
    (9, "line\nline\nother line\n\nline \n"),
    (10, "x" * 70_000),
    (11, "ab " * 40_000 + "end"),
    (None, None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """With columns whose names the operators use themselves."""
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    clashing = ("n_words", "items", "hit_spans", "size", "shard", "copies", "pii", "toxicity", "places", "kept", "_text", "_id")
    return rows.withColumns({c: F.lit("own") for c in clashing}).coalesce(1)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def near_copies(seed, groups=12, copies=6, words=60, vocabulary=400):
    """Random texts, copies of them with some words changed, and exact copies."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    texts = []
    for _ in range(groups):
        base = rng.choices(names, k=rng.randint(1, words))
        for c in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(names)
            texts.append(rng.choice([" ", "  ", "\n"]).join(own))
    rng.shuffle(texts)
    return texts


class Union:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def brute_components(rows, n, percent):
    """Shingle counts and the smallest reachable id, by comparing all pairs."""
    sets = {}
    for key, text in rows:
        w = VISIBLE.findall((text or "").translate(LOWER))
        sets.setdefault(key, []).append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    found = Union(sets)
    flat = [(k, s) for k, own in sets.items() for s in own if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                found.join(a, b)
    return {k: found.find(k) for k in sets}, {k: sorted(map(len, v)) for k, v in sets.items()}
