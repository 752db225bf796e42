"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlife.llm import prefixtrie
from fleetlife.llm.prefixtrie import SpillingQueue, conversation_trie

from .conftest import VISIBLE

SCHEMA = "conv_id long, turn long, role string, text string, words string, depth int, key string"


def brute_trie(rows):
    """Nodes by prefix; turns that tie in their number must be equal."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    members = defaultdict(list)
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = said.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    out = {}
    for path in sorted(members, key=len, reverse=True):
        below = [p for p in out if len(p) == len(path) + 1 and p[:-1] == path]
        convs = sorted(members[path])
        saved = (len(convs) - 1) * len(VISIBLE.findall(path[-1][1])) if path else 0
        ends = ",".join(str(c) for c, last in convs if last)
        out[path] = [convs[0][0], len(path), None, len(convs), len(below), sum(out[p][5] for p in below) or 1,
                     saved + sum(out[p][6] for p in below), hashlib.sha256(ends.encode()).hexdigest()]
        for p in below:
            out[p][2] = convs[0][0]
    return sorted(map(tuple, out.values()), key=lambda r: (r[1], r[0]))


def conversations():
    """Shared first turns, copies, null turns, roles and texts, a repeated row, and a long conversation."""
    rng = random.Random(3)
    rows = []
    for conv in [*range(120), 500, 515, 1021]:
        length = rng.choice([1, 1, 2, 3, 5])
        for turn in range(length):
            text = "same first turn" if turn == 0 and conv % 3 else f"{rng.choice('abc')} word {rng.randrange(2)}"
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(40, None, "user", "before all"), (40, -1, None, None), (41, 7, None, ""), (None, 1, "user", "nobody's")]
    rows += [(60, 9, "user", "twice"), (60, 9, "user", "twice")]
    rows += [(777, t, "user", f"turn {t}\n of  many") for t in range(300)]
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2050) for t in range(4)]
    return rows


def as_rows(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=lambda r: (r[1], r[0]))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, "own", 1, "k") for r in conversations()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def expected():
    return brute_trie(conversations())


def test_trie(table, expected):
    assert as_rows(conversation_trie(table)) == expected


@pytest.mark.parametrize("least, held", [(0, 1), (3, 2), (60, 10)])
def test_shards_and_spills(table, expected, least, held, monkeypatch):
    """However the trie is cut and however little a queue holds, the nodes are the same."""
    monkeypatch.setattr(prefixtrie, "PIECE_BITS", 3)
    turns = prefixtrie.with_shared_heads(prefixtrie.stage(prefixtrie.numbered_turns(table)))
    assert as_rows(prefixtrie.trie(turns, heavy_nodes=10**9, least_heavy=least, held=held)) == expected


def test_heavy_nodes_are_bounded(table, expected):
    """The limit grows with the rows, so that their number doesn't."""
    turns = prefixtrie.with_shared_heads(prefixtrie.stage(prefixtrie.numbered_turns(table)))
    assert as_rows(prefixtrie.trie(turns, heavy_nodes=5, least_heavy=1)) == expected
    limit = -(-turns.count() // 5)
    assert sum(r[3] > limit for r in expected) <= 5


def test_no_conversations(spark, table):
    assert conversation_trie(table.where("conv_id < 0")).count() == 0
    nameless = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie(nameless).count() == 0


def test_turnless(spark):
    """A conversation that takes its head from nowhere and has no more turns of its own ends at the root."""
    conv = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(conv, 0, "user", "lost")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_rows(conversation_trie(frame)) == brute_trie(rows)
    assert as_rows(conversation_trie(frame))[0][:6] == (conv, 0, None, 1, 0, 1)


@pytest.mark.parametrize("held", [1, 2, 7, 1000])
def test_queue(held):
    rng = random.Random(held)
    queue, plain = SpillingQueue(held), []
    for _ in range(3_000):
        if plain and rng.random() < 0.45:
            assert queue.first() == plain[0]
            assert queue.pop() == heapq.heappop(plain)
        else:
            item = (rng.randrange(500), rng.random())
            queue.push(item)
            heapq.heappush(plain, item)
        assert len(queue.heap) <= held
    while plain:
        assert queue.pop() == heapq.heappop(plain)
    assert queue.first() is None


def test_head_lengths(spark):
    rows = spark.range(50).select("id", prefixtrie.head_length(F.col("id"), 3).alias("h")).collect()
    assert all(r.h == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
