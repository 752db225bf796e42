"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over token windows.

The windows of the benchmark items are hashed into a sorted set, which every task gets. A bitmap of
some bits of each hash rejects most windows of the training texts with one lookup; hash hits are
then verified against the item's words. Hit words are merged into spans.

The set is broadcast only up to ``BLOCK_BYTES`` of item text. A larger benchmark is cut into blocks
by item, and the documents are scanned once for each block (the result so far is written to the
checkpoint folder in between), so no task ever holds more than one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.llm.textparts import Texts, Words, as_lists, put_back, run_hashes, set_aside, slices, with_results
from fleetlife.session import stage

#: Words of a window. An item of fewer words is one window.
WINDOW = 13

#: Item text that is broadcast at a time.
BLOCK_BYTES = 8 << 20

#: A document is contaminated from one hit word in so many words.
HIT_SHARE = 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: Result columns. ``hit_spans``: runs of hit words as word numbers, end exclusive.
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


class WindowSet:
    """The windows of some items by length, for lookup by hash."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: hash, item, first word
        self.names: list[str] = []
        self.spelled: list[list[bytes]] = []
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], ["text"])
        row = 0
        for part in slices(batch, "text"):
            words = part.words("letters")
            hashes = words.hashes()
            for d in range(len(part)):
                name, first, last = items[row + d][0], int(words.first[d]), int(words.first[d + 1])
                n = min(size, last - first)
                if n and name is not None:
                    values = run_hashes(hashes[first:last], n).tolist()
                    found[n] += [(value, len(self.names), k) for k, value in enumerate(values)]
                    self.names.append(name)
                    self.spelled.append([words.word(k) for k in range(first, last)])
            row += len(part)
        self.lengths = {}
        for n, windows in found.items():
            windows.sort()
            hashes = np.array([w[0] for w in windows], np.uint64)
            keys, begin = np.unique(hashes, return_index=True)
            bits = np.zeros(1 << 20, bool)
            bits[keys & np.uint64(len(bits) - 1)] = True
            places = np.array([w[1:] for w in windows], np.int32)
            self.lengths[n] = (keys, bits, np.append(begin, len(windows)), places)

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """Start, length and items of every verified occurrence."""
        hashes = words.hashes()
        for n, (keys, bits, begin, places) in self.lengths.items():
            at, values = words.runs(hashes, n)
            maybe = np.flatnonzero(bits[values & np.uint64(len(bits) - 1)])
            place = np.searchsorted(keys, values[maybe])
            place[place == len(keys)] = 0
            same = keys[place] == values[maybe]
            for start, entry in zip(at[maybe[same]].tolist(), place[same].tolist()):
                own = [words.word(k) for k in range(start, start + n)]
                windows = places[begin[entry] : begin[entry + 1]].tolist()
                items = [self.names[i] for i, k in windows if self.spelled[i][k : k + n] == own]
                if items:
                    yield start, n, items


def _scan(known: WindowSet, part: Texts, earlier: tuple[str, str] | None) -> list:
    words = part.words("letters")
    hit = np.zeros(len(words.starts), bool)
    items: list[set[str]] = [set() for _ in range(len(part))]
    if earlier:
        spans, found = (part.column(c).to_pylist() for c in earlier)
        for d, (own, names) in enumerate(zip(spans, found)):
            items[d].update(names)
            for span in own:
                hit[words.first[d] + span["start"] : words.first[d] + span["end"]] = True
    for start, n, names in known.hits(words):
        hit[start : start + n] = True
        items[int(np.searchsorted(words.first, start, "right")) - 1].update(names)
    starts, ends, counts = true_runs(hit, words.first)
    spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
    return [words.counts().astype(np.int64), as_lists(spans, counts), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]


def true_runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true flags within each row, counted from the row's start; and runs per row."""
    n = len(flags)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = flags[:-1], flags[1:]
    cuts = first[:-1][first[:-1] < n]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    rows = np.searchsorted(first, starts, "right") - 1
    return starts - first[rows], ends - first[rows], np.bincount(rows, minlength=len(first) - 1)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks whose size is bounded; each is read when its turn comes."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    count = int(total // BLOCK_BYTES) + 1
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for k in range(count):
        yield [(r.item, r.text) for r in rows.where(part == k).toLocalIterator()]


def scan_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` and ``items`` (ids as strings, sorted).

    Null and empty texts have no words and no hits; items without words or without an id match
    nothing; repeated rows are judged one by one; an empty benchmark gives empty results. Columns
    of ``docs`` other than those three pass through.
    """
    context = docs.sparkSession.sparkContext
    out, earlier = docs, None
    for block in _blocks(benchmark, item, item_text):
        if earlier:
            out = stage(out)
        known = context.broadcast(WindowSet(block, window))
        scan = lambda part, known=known, earlier=earlier: _scan(known.value, part, earlier)
        out = with_results(out, text, RESULT, scan) if not earlier else _again(out, text, scan)
        earlier = ("hit_spans", "items")
    return out


def _again(df: DataFrame, text: str, scan) -> DataFrame:
    """A further block: the former results are read under other names and replaced."""
    older = [f"_earlier_{f.name}" for f in RESULT]
    renamed = df.withColumnsRenamed({f.name: o for f, o in zip(RESULT, older)})
    again = lambda part: scan(_renamed(part, dict(zip(older, (f.name for f in RESULT)))))
    return with_results(renamed, text, RESULT, again).drop(*older)


def _renamed(part: Texts, names: dict[str, str]) -> Texts:
    batch = part.batch.rename_columns([names.get(c, c) for c in part.batch.schema.names])
    return Texts(batch, part.data, part.offsets)


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(hits: Column, words: Column, share: int = HIT_SHARE) -> Column:
    return (hits > 0) & (hits * share >= words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents; their columns are unchanged."""
    free, moved = set_aside(docs, [f.name for f in RESULT])
    scanned = scan_benchmark(free, benchmark, moved.get(text, text), **options)
    return put_back(scanned.where(~is_contaminated(n_hit(), F.col("n_words"))), docs, moved)


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """The scanned documents with the words of their hit spans cut out of the text.

    The characters between two removed words go as well; others stay as they are.
    """

    def cut(part: Texts) -> list:
        words = part.words("letters")
        spans = part.column("hit_spans").to_pylist()
        out = []
        for d, own in enumerate(spans):
            keep, at, first = [], int(part.offsets[d]), int(words.first[d])
            for s in own:
                keep.append(part.data[at : words.starts[first + s["start"]]].tobytes())
                at = int(words.ends[first + s["end"] - 1])
            keep.append(part.data[at : part.offsets[d + 1]].tobytes())
            out.append(b"".join(keep).decode("utf-8", "replace"))
        return [pa.array(out, pa.string(), mask=part.column(text).is_null().to_numpy(zero_copy_only=False))]

    whole = scanned.withColumn("_whole", F.col(text))
    return with_results(whole.withColumnRenamed(text, "_old"), "_whole", [T.StructField(text, T.StringType())],
                        lambda p: cut(_renamed(p, {"_old": text}))).drop("_whole", "_old")
