"""Ranked lexical search by NRA ("no random access") over impact-sorted postings.

A term's impact in a document is fixed by corpus statistics, so each list of postings is read from its
highest impact down. What has been read of a document is the lower end of its score; with the impacts at
which the unread lists stand for terms not seen yet, it is the upper end. Reading goes on until no document
that could still be among the best k is open: neither its membership, nor a tie at the last place, nor its
score. Scores are integers, so intervals close exactly.

The documents are dealt to tasks as they are stored, and a task indexes a chunk of them at a time: its lists,
their intervals and the best k so far are all it holds. The k-th best score of a task's earlier chunks bounds
the later ones from the start. A task sends k rows a query at most; they are merged in two steps of windows.
Queries are broadcast in blocks of bounded size, for each of which the documents are read twice: for the
statistics and for the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.llm.textparts import Texts, slices
from fleetlife.session import stage

#: Query text that is broadcast at a time.
BLOCK_BYTES = 8 << 20

#: Text that a task indexes at a time.
CHUNK_BYTES = 32 << 20

#: Postings read from each list in the first round; every round reads twice as many.
FIRST_READ = 128

#: Parts in which a query's rows are merged first.
MERGE_PARTS = 64

#: Stands for the id of a document without one, and comes before all others in ties.
NO_ID = -(1 << 63)

FOUND = "query int, doc long, score long"


@dataclass
class Vocabulary:
    """The terms of some queries, in the order of their hashes, and each query's term numbers."""

    hashes: np.ndarray
    lengths: np.ndarray  # of the term in bytes
    bits: np.ndarray  # of the hashes, to reject most other words by one lookup
    queries: list[np.ndarray]

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Vocabulary:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        hashes, lengths, queries = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
        for part in slices(batch, "text"):
            words = part.words("letters")
            own = words.hashes()
            hashes.append(own)
            lengths.append(words.ends - words.starts)
            queries += [np.unique(own[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
        known, first = np.unique(np.concatenate(hashes), return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[known & np.uint64(len(bits) - 1)] = True
        return cls(known, np.concatenate(lengths)[first], bits, [np.searchsorted(known, q) for q in queries])

    def postings(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, term numbers and occurrences of the terms in a slice of texts; and every row's words."""
        words = part.words("letters")
        hashes = words.hashes()
        maybe = np.flatnonzero(self.bits[hashes & np.uint64(len(self.bits) - 1)]) if len(self.hashes) else []
        if not len(maybe):
            none = np.empty(0, np.int64)
            return none, none, none, words.counts()
        term = np.searchsorted(self.hashes, hashes[maybe])
        term[term == len(self.hashes)] = 0
        same = (self.hashes[term] == hashes[maybe]) & (self.lengths[term] == (words.ends - words.starts)[maybe])
        pairs = words.rows()[maybe[same]] * len(self.hashes) + term[same]
        pairs, times = np.unique(pairs, return_counts=True)
        return pairs // len(self.hashes), pairs % len(self.hashes), times, words.counts()


@dataclass
class Statistics:
    """Documents with a term, all their terms, and the documents of each vocabulary term."""

    documents: int
    terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term."""
        n = 2 * self.documents + 2
        return np.array([math.floor(1000 * math.log(n / (2 * df + 1))) for df in self.holding.tolist()], np.int64)

    def impacts(self, weights: np.ndarray, times: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A term's part of the score of a document of so many words that holds it so many times."""
        damping = 100 - 50 + (50 * words * self.documents) // max(self.terms, 1)
        return weights * ((1_000_000_000 * times) // (1000 * times + 20 * damping))


def statistics(docs: DataFrame, vocabulary: Broadcast, text: str = "text") -> Statistics:
    """Counts over all documents; every task adds its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        holding, documents, terms = np.zeros(len(known.hashes), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, text):
                _, term, _, words = known.postings(part)
                holding += np.bincount(term, minlength=len(holding))
                documents, terms = documents + int((words > 0).sum()), terms + int(words.sum())
        held = np.flatnonzero(holding)
        names = np.concatenate([[-2, -1], held]).astype(np.int64)
        sums = np.concatenate([[documents, terms], holding[held]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], ["name", "n"])

    # One row per vocabulary term, whose number BLOCK_BYTES bounds.
    rows = docs.select(text).mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()
    found = {r.name: r.n for r in rows}
    holding = np.array([found.get(i, 0) for i in range(len(vocabulary.value.hashes))], np.int64)
    return Statistics(found.get(-2, 0), found.get(-1, 0), holding)


def best_of_lists(
    lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, floor: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of all that can be among the best ``k`` by their sums over the lists, ties included.

    A list has documents (0 to ``documents`` - 1, once each) and impacts above 0, highest first. Documents
    that score less than ``floor`` are left out.
    """
    lists = [own for own in lists if len(own[0])]
    lower = np.zeros(documents, np.int64)
    seen = np.zeros((documents, len(lists)), bool)
    beaten = np.zeros(documents, bool)
    standing = np.array([impacts[0] for _, impacts in lists], np.int64)
    read, step = 0, FIRST_READ
    while True:
        for t, (own, impacts) in enumerate(lists):
            now = own[read : read + step]
            lower[now] += impacts[read : read + step]
            seen[now, t] = True
            standing[t] = impacts[read + step] if read + step < len(own) else 0
        read, step = read + step, 2 * step
        unread = int(standing.sum())  # the most that an unseen document can have
        alive = np.flatnonzero((lower > 0) & ~beaten)
        low = lower[alive]
        high = low + unread - seen[alive] @ standing
        if len(alive) >= k:
            floor = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]))
        kept = high >= floor
        beaten[alive[~kept]] = True
        open_ = kept & (high > low)
        if not open_.any() and (unread < floor or not unread):
            return alive[kept], low[kept]


class Best:
    """The best k of one query so far, in order: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.docs, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int:
        """What a further document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.append(self.docs, docs), np.append(self.scores, scores)
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]


def _chunks(batches: Iterator[pa.RecordBatch], known: Vocabulary, key: str, text: str):
    """Ids, words of each row, and (row, term, times) postings, a chunk of documents at a time."""
    rows, parts, size, first = [], [], 0, 0
    for batch in batches:
        for part in slices(batch, text):
            row, term, times, words = known.postings(part)
            ids = part.column(key).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            rows.append((ids.astype(np.int64), words))
            parts.append((row + first, term, times))
            first, size = first + len(part), size + len(part.data)
            if size >= CHUNK_BYTES:
                yield *_joined(rows), *_joined(parts)
                rows, parts, size, first = [], [], 0, 0
    if rows:
        yield *_joined(rows), *_joined(parts)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
           query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_key, rank, key, score): the ``k`` documents with the highest score above 0 for each query row.

    Equal scores are ranked by ascending ``key``; a document without a key comes before all others of its
    score. Null and empty texts have no terms: such documents are not counted and never found, such queries
    find nothing. Repeated documents have a rank each, repeated queries a result each. Terms are compared by
    a 64-bit hash and their length. Other columns are not read.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    asked = queries.select(F.col(query_key).alias("_key"), F.col(query_text).alias("_text"))
    asked = asked.withColumn("_size", F.coalesce(F.octet_length("_text"), F.lit(0)) + 8)
    asked = stage(asked.withColumn("_at", F.monotonically_increasing_id()))
    blocks = int((asked.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]) // BLOCK_BYTES) + 1
    part = F.pmod(F.xxhash64("_at"), F.lit(blocks))
    results = []
    for block in range(blocks):
        own = asked.where(part == block).collect()  # BLOCK_BYTES of text
        known = context.broadcast(Vocabulary.of([r["_text"] for r in own]))
        best = _merged(_searched(rows, known, statistics(rows, known, "_text"), k), k)
        names = spark.createDataFrame([(i, r["_key"]) for i, r in enumerate(own)], f"query int, `{query_key}` {_kind(asked)}")
        shown = best.join(F.broadcast(names), "query").select(
            query_key, "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias(key), "score"
        )
        results.append(stage(shown) if blocks > 1 else shown)
    return reduce(DataFrame.union, results)


def _kind(asked: DataFrame) -> str:
    return asked.schema["_key"].dataType.simpleString()


def _searched(rows: DataFrame, vocabulary: Broadcast, stats: Statistics, k: int) -> DataFrame:
    """The best ``k`` documents per query and task."""
    weights = stats.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        best = [Best(k) for _ in known.queries]
        for ids, words, row, term, times in _chunks(batches, known, "_doc", "_text"):
            impacts = stats.impacts(weights[term], times, words[row])
            order = np.lexsort((row, -impacts, term))
            order = order[impacts[order] > 0]
            row, impacts = row[order], impacts[order]
            ends = np.searchsorted(term[order], np.arange(len(weights) + 1))
            for own, terms in zip(best, known.queries):
                lists = [(row[ends[t] : ends[t + 1]], impacts[ends[t] : ends[t + 1]]) for t in terms]
                found, scores = best_of_lists(lists, len(ids), k, own.floor())
                own.add(ids[found], scores)
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.docs) for b in best])
        columns = [query, *(np.concatenate([np.empty(0, np.int64), *own]) for own in zip(*((b.docs, b.scores) for b in best)))]
        columns = columns if best else [query, np.empty(0, np.int64), np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "doc", "score"])

    return rows.mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query of all tasks, first within parts of the tasks."""
    order = [F.desc("score"), F.asc("doc")]
    parts = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    for keys, name in ((["query", "_part"], "_rank"), (["query"], "rank")):
        parts = parts.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return parts.select("query", "rank", "doc", "score")
