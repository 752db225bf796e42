"""Sharding, mixing, near duplicates and repeated strings against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife import session
from fleetlife.llm import components as component_rounds
from fleetlife.llm import groupverify, jaccardjoin, mixing, sharding, sharedkeys, substringdedup, suffixsort
from fleetlife.llm.components import components
from fleetlife.llm.ranks import numbered
from fleetlife.llm.textparts import slices

from .conftest import AWKWARD, VISIBLE, Union, brute_components, near_copies

# --- sharding ---


def test_shards(spark, awkward):
    rows = sharding.shard_table(awkward, [1.0] * 24, [1.0] * 25).collect()
    assert len(rows) == len(AWKWARD)
    expected = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in AWKWARD)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1


def test_weights_and_moves(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    weights = [1.0, 2.0, 0.0, 1.0]
    shares = {r.shard: r["count"] for r in sharding.assign_shards(docs, weights).groupBy("shard").count().collect()}
    assert set(shares) == {0, 1, 3} and abs(shares[1] - 10_000) < 400
    moved = sharding.assign_shards(docs, weights, [*weights, 1.0]).where("shard <> grown_shard")
    assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {4}
    assert abs(moved.count() - 4_000) < 300  # a fifth, as the new shard has a fifth of the weight
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, [0.0])


def test_numbers_do_not_depend_on_cells(spark, monkeypatch):
    rows = spark.range(3_000).select((F.col("id") % 3).alias("g"), F.col("id"))
    place = sharding.draw(F.col("id").cast("string"))
    few = {tuple(r) for r in numbered(rows, ["g"], place, ["id"], "n").collect()}
    monkeypatch.setattr("fleetlife.llm.ranks.ROWS_PER_CELL", 10)
    assert {tuple(r) for r in numbered(rows, ["g"], place, ["id"], "n").collect()} == few
    assert sorted(n for g, _, n in few if g == 1) == list(range(1_000))


# --- mixing ---


def test_reach_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(200):
        sizes = np.array(rng.sample(range(1, 30), rng.randint(1, 5)))
        counts = np.array([rng.randint(0, 4) for _ in sizes])
        budget = rng.randint(0, 60)
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        total, used = mixing.reach(sizes, counts, budget)
        assert total == max(x for x in sums if x <= budget) == int((sizes * used).sum())
        assert (used <= counts).all()


def test_plan_meets_the_target():
    rng = np.random.default_rng(2)
    for target in (0.0, 1.0, 12_345.4, 100_000.0, 250_000.0, 1e9):
        sizes = np.arange(1, 400)
        counts = rng.integers(0, 5, len(sizes))
        whole = int((sizes * counts).sum())
        passes, extra = mixing.plan_source(sizes, counts, target)
        assert (extra <= counts).all() and passes + (extra.max() > 0) <= 3
        assert passes * whole + int((sizes * extra).sum()) == min(round(target), 3 * whole)
    assert mixing.plan_source(np.array([0]), np.array([7]), 0.0)[0] == 0


def test_plan_of_long_documents():
    """Gaps above EXACT_WORDS and documents longer than what greedy taking leaves: still the best sum."""
    sizes, ones = np.array([90_000, 90_001, 90_002]), np.array([1, 1, 1])
    assert int((mixing.plan_source(sizes, ones, 200_000.0)[1] * sizes).sum()) == 180_003
    rng = random.Random(3)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(20_000, 120_000), rng.randint(1, 9))))
        counts = np.array([rng.randint(1, 3) for _ in sizes])
        sums = {0}
        for size, count in zip(sizes.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(count + 1)}
        rest = rng.randrange(max(sums))
        passes, extra = mixing.plan_source(sizes, counts, float(rest))
        assert passes == 0 and (extra >= 0).all() and (extra <= counts).all()
        assert int((extra * sizes).sum()) == max(s for s in sums if s <= rest)


def filled(sizes, weights, most=3):
    """Targets by letting one source after another reach its limit."""
    total, full = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(most * sizes[i] for i in full)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= most * sizes[i]}
        if not over or not free:
            return [most * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_mix(spark):
    rng = random.Random(1)
    sources = ["b", "Ä", None, "a", "á", ""]
    rows = [(i, rng.choice(sources[: 2 + i % 5]), " ".join("w" * rng.randint(0, 40)) or None) for i in range(600)]
    rows += [(None, "b", "x y z"), (3, "b", "one two"), (3, "b", "one two"), (601, "tiny", "just three words")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    totals = defaultdict(int)
    for _, source, text in rows:
        totals[source] += len(VISIBLE.findall(text or ""))
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    targets = dict(zip(names, filled([totals[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    by_size = defaultdict(list)
    for n in names:
        by_size[totals[n]].append(targets[n])
    taken = defaultdict(int)
    for r in got:
        assert any(r.target == pytest.approx(t) for t in by_size[r.source_size])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.target] += r.taken
    for target, words in taken.items():
        same = sum(t == pytest.approx(target) for t in targets.values())
        assert abs(words - same * target) <= same
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0
    wordless = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mix(wordless).collect()] == [0, 0]


# --- near duplicates ---


def compare(spark, rows, n, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccardjoin.link_groups(docs, n=n, percent=percent).collect()
    assert len(got) == len(rows)
    component, sizes = brute_components([r for r in rows if r[0] is not None], n, percent)
    own = defaultdict(list)
    for r in got:
        assert r.component_id == (component[r.doc_id] if r.doc_id is not None else None)
        if r.doc_id is not None:
            own[r.doc_id].append(r.n_shingles)
    assert {k: sorted(v) for k, v in own.items()} == sizes


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3), (2, 100, 4)])
def test_links(spark, n, percent, seed):
    compare(spark, list(enumerate(near_copies(seed))), n, percent)


def test_links_across_blocks(spark, monkeypatch):
    """One group that is far larger than a block, most of which doesn't link."""
    monkeypatch.setattr(groupverify, "BLOCK_DOCS", 7)
    monkeypatch.setattr(sharedkeys, "CHUNK_BYTES", 3_000)
    compare(spark, list(enumerate(near_copies(6, groups=2, copies=60, words=90))), 4, 85)


def test_awkward_links(spark, awkward, empty):
    compare(spark, AWKWARD, 4, 85)
    assert jaccardjoin.link_groups(empty).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for percent in (80, 85, 95):
        for size in (1, 2, 5, 8, 13, 20, 40, 150, 700):
            for _ in range(12):
                base = rng.integers(0, 2**63, size, dtype=np.uint64)
                drop = rng.integers(0, size + 1)
                extra = rng.integers(0, 2**63, rng.integers(0, size + 2), dtype=np.uint64)
                a, b = np.unique(base), np.unique(np.concatenate([base[drop // 8 :], extra[: len(extra) // 8]]))
                if not len(b):
                    continue
                common = len(np.intersect1d(a, b))
                rows = np.repeat([0, 1], [len(a), len(b)])
                own, signs = jaccardjoin.signatures(rows, np.concatenate([a, b]), 2, percent)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert set(signs[own == 0].tolist()) & set(signs[own == 1].tolist())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3)]
    found = Union({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None:
            found.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got and all(found.find(k) == v for k, v in got.items())
    assert {k for e in edges for k in e if None not in e and e[0] != e[1]} == set(got)


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_components_of_hubs_and_chains(spark, monkeypatch, held):
    """A hub with the largest id, a hub with the smallest, a long chain, all repeated and reversed, a few edges at a time."""
    monkeypatch.setattr(component_rounds, "HELD_EDGES", held)
    edges = [(999, k) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 40)] + [(2000 + k, 2001 + k) for k in range(60)]
    random.Random(held).shuffle(edges)
    frame = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long").repartition(3)
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {k: k // 1000 * 1000 for k in {x for e in edges for x in e}}


def test_components_take_few_shuffles(spark, monkeypatch):
    """A round deals rows three times: for the smallest neighbours, for the jumps and for the stars. Stars take one round."""
    plans = []

    def noted(frame):
        plans.append(frame._jdf.queryExecution().sparkPlan().toString())
        return session.stage(frame)

    monkeypatch.setattr(component_rounds, "stage", noted)
    edges = spark.createDataFrame([(k // 10 * 10, k) for k in range(200) if k % 10], "a long, b long")
    assert components(edges).count() == 200
    assert len(plans) == 2
    frame = spark.createDataFrame([(2, 1, False)], "a long, b long, moved boolean")
    plan = component_rounds._dealt_stars(component_rounds._jumped(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3


# --- repeated strings ---


def brute_removal(rows, n=50):
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - n + 1 if key is not None else 0):
            own = data[i : i + n]
            least[own] = min(key, least.get(own, key))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1 if key is not None else 0):
            if least[data[i : i + n]] < key:
                gone[i : i + n] = b"\1" * n
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((repr(key), len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(docs):
    rows = substringdedup.remove_repeats(docs).collect()
    return sorted(
        (repr(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in rows
    )


def repeating(seed, count=80):
    """Texts that share passages of all lengths around the limit, some of them very often."""
    rng = random.Random(seed)
    letters = "abcdefgh é北"
    passages = ["".join(rng.choices(letters, k=rng.choice([30, 49, 50, 51, 60, 120, 400]))) for _ in range(12)]
    texts = []
    for _ in range(count):
        own = ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(3)]
        texts.append(rng.choice(passages[:3]).join(own) + rng.choice(passages) * rng.choice([1, 1, 3]))
    return texts + texts[:6]


@pytest.mark.parametrize("hot,chunk,block", [(20_000, 24 << 20, 1 << 20), (5, 5_000, 2_000)])
def test_repeats(spark, monkeypatch, hot, chunk, block):
    monkeypatch.setattr(substringdedup, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(substringdedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(sharedkeys, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substringdedup, "BLOCK_BYTES", block)
    texts = repeating(hot)
    order = list(range(len(texts)))
    random.Random(8).shuffle(order)
    rows = list(zip(order, texts)) + [(None, texts[0]), (5, texts[1]), (5, texts[2]), (200, "x" * 3_000), (201, "x" * 120), (202, "x" * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removal(docs) == brute_removal(rows)


def test_awkward_repeats(spark, awkward, empty):
    assert removal(awkward) == brute_removal(AWKWARD)
    assert removal(empty) == []


def test_suffix_order():
    rng = np.random.default_rng(3)
    for letters, size in ((2, 400), (1, 120), (200, 900)):
        text = rng.integers(97, 97 + letters, size).astype(np.uint8)
        places = np.flatnonzero(rng.random(size - 50) < 0.7)
        order = suffixsort.sort_suffixes(text, places, 50)
        raw = text.tobytes()
        assert [raw[p : p + 50] for p in order] == sorted(raw[p : p + 50] for p in places)
        same = suffixsort.equal_prefixes(text, order, 50)
        assert same.tolist() == [i > 0 and raw[order[i] : order[i] + 50] == raw[order[i - 1] : order[i - 1] + 50] for i in range(len(order))]


def test_window_keys_follow_the_window():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["q" * 7 + "".join(map(chr, range(40, 120))), "".join(map(chr, range(40, 120))) + "zz"])], ["text"])
    part = next(slices(batch, "text"))
    a, b = (substringdedup.window_keys(part.data[part.offsets[d] : part.offsets[d + 1]]) for d in (0, 1))
    assert (a[7:] == b[: len(a) - 7]).all()


def test_a_block_is_compared_in_little_memory():
    """The sums of a block's cells are kept in 32 bits, and no others of all its sets are made."""
    import tracemalloc

    from fleetlife.llm.groupverify import link_forest

    draw = np.random.default_rng(5)
    sets = [np.sort(draw.integers(0, 1 << 63, 2_500).astype(np.uint64)) for _ in range(200)]
    sets += [np.sort(np.concatenate([s[100:], draw.integers(0, 1 << 63, 100).astype(np.uint64)])) for s in sets[:50]]
    tracemalloc.start()
    edges = link_forest(sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(tuple(sorted(e)) for e in edges) == [(i, 200 + i) for i in range(50)]
    assert peak < len(sets) * 2048 * 10


def test_what_a_chunk_shares_is_sent_in_parts():
    """No batch to the JVM has all slices of a chunk."""
    import pyarrow as pa

    from fleetlife.llm.shingles import shingle_sets

    sent = {}

    class Rows:
        class sparkSession:
            class conf:
                get = staticmethod(lambda *_: "1")

        def select(self, *_):
            return self

        def mapInArrow(self, ask, _):
            sent["ask"] = ask
            return self

        def groupBy(self, _):
            return self

        def applyInArrow(self, answer, _):
            return self

    sharedkeys.shared(Rows(), lambda part: shingle_sets(part, 2), 9)
    texts = [" ".join(f"w{i * 31 + k}" for k in range(400)) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    made = list(sent["ask"](iter([batch])))
    assert max(b.num_rows for b in made) <= 64
    slots = [x for b in made for x, known in zip(b["slice"].to_pylist(), b["known"].to_pylist()) if not known]
    assert len(slots) == len(set(slots)) > 400
