"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings (first four and six bytes, for inflected and compound forms), hashed
into ``2**HASH_BITS`` slots. Slots that occur in toxic and other labelled documents at clearly different
rates are the features: counts come from all training rows, summed per slot over all tasks. The machine
learns a weight for each slot and, by a few factors per slot, for each pair of slots, so that words that
are only toxic together count together. Training is Spark's distributed one; scoring is one pass over
whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.llm.sharding import DRAW_BITS, draw
from fleetlife.llm.textparts import Texts, as_lists, slices, span_hashes, splitmix, with_results
from fleetlife.session import bound_batches, stage

HASH_BITS = 20

#: Beginnings of words that are terms of their own, in bytes.
PREFIXES = (4, 6)

#: Slots chosen as features, and the labelled documents a slot must occur in at least.
FEATURES = 2048
MIN_DOCUMENTS = 5

#: Labelled rows used for training, at most about this many, chosen by a hash of the id. Only this
#: bounded table of ids and labels is broadcast.
MAX_LABELLED = 100_000

FACTORS = 4
ITERATIONS = 80
STEP = 0.1

#: A document is rejected from this score.
REJECT = 0.7

_RANGES = 64  # slot ranges in which counts are summed


def slots(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distinct slots of the terms of each row, in the order of rows."""
    words = part.words("letters")
    rows = words.rows()
    keys = [words.hashes()]
    owners = [rows]
    for n in PREFIXES:
        long = words.ends - words.starts > n
        starts = words.starts[long]
        keys.append(span_hashes(part.data, starts, starts + n) + np.uint64(n))
        owners.append(rows[long])
    slot = (splitmix(np.concatenate(keys)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    pairs = np.unique(np.concatenate(owners).astype(np.int64) << HASH_BITS | slot)
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


@dataclass(frozen=True)
class FactorMachine:
    """``feature[slot]``: number of the slot's feature or -1. Weights and factors by feature."""

    feature: np.ndarray
    intercept: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, part: Texts) -> np.ndarray:
        rows, slot = slots(part)
        known = self.feature[slot]
        rows, known = rows[known >= 0], known[known >= 0]
        n = len(part)
        margin = self.intercept + np.bincount(rows, self.weights[known], n)
        for f in range(self.factors.shape[1]):
            own = self.factors[known, f]
            margin += 0.5 * (np.bincount(rows, own, n) ** 2 - np.bincount(rows, own * own, n))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def is_held_out(key: Column) -> Column:
    """Every third document by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Texts and labels of the training documents. An id with several labels has the highest one."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("label"))
    count = known.count()
    if count > MAX_LABELLED:
        limit = int(MAX_LABELLED / count * (1 << DRAW_BITS))
        known = known.where(draw(F.lit("label"), F.col("_key").cast("string")) < limit)
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), F.col("_id") == F.col("_key"))


def _slot_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each slot, other ones and toxic ones. The result has a fixed size."""
    bound_batches(rows.sparkSession)
    size = 1 << HASH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int32)  # a task's documents
        for batch in batches:
            for part in slices(batch, "_text"):
                label = part.ids("label")
                own, slot = slots(part)
                for k in (0, 1):
                    np.add.at(total[k], slot[(label[own] > 0.5) == bool(k)], 1)
        for k in range(_RANGES):
            cut = total[:, k * size // _RANGES : (k + 1) * size // _RANGES]
            if cut.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([cut.astype(np.int64).tobytes()])], ["range", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
        return pa.table({"range": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()])})

    parts = rows.mapInArrow(count, "range long, counts binary").groupBy("range").applyInArrow(add, "range long, counts binary")
    out = np.zeros((2, size), np.int64)
    for row in parts.toLocalIterator():  # 2 x 2**HASH_BITS numbers in all
        k = row["range"]
        out[:, k * size // _RANGES : (k + 1) * size // _RANGES] = np.frombuffer(row["counts"], np.int64).reshape(2, -1)
    return out[0], out[1]


def choose_slots(other: np.ndarray, toxic: np.ndarray, n_other: int, n_toxic: int) -> np.ndarray:
    """The slots with the largest chi-squared statistic of presence against label."""
    n, have = n_other + n_toxic, other + toxic
    expected = have * (n_toxic / max(n, 1))
    spread = expected * (1 - n_toxic / max(n, 1)) * (1 - have / max(n, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where((have >= MIN_DOCUMENTS) & (spread > 0), (toxic - expected) ** 2 / spread, 0.0)
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(best[chi[best] > 0])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> FactorMachine:
    """A factorization machine from the training part of the labelled documents.

    Without labelled rows of both kinds it scores everything by their share (0 without any).
    """
    # Tasks import this module to score; Spark ML (and pandas with it) would stay in each of their workers.
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import CountVectorizerModel

    rows = stage(_training_rows(docs, labels, key, text, label))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("label") > 0.5).alias("toxic")).count().collect()}
    n_other, n_toxic = counts.get(False, 0), counts.get(True, 0)
    feature = np.full(1 << HASH_BITS, -1, np.int32)
    chosen = choose_slots(*_slot_counts(rows), n_other, n_toxic) if n_other and n_toxic else np.empty(0, np.int64)
    feature[chosen] = np.arange(len(chosen), dtype=np.int32)
    if not len(chosen):
        share = n_toxic / max(n_other + n_toxic, 1)
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return FactorMachine(feature, float(odds), np.zeros(1), np.zeros((1, FACTORS)))

    def terms(part: Texts) -> list:
        own, slot = slots(part)
        known = feature[slot]
        own, known = own[known >= 0], known[known >= 0]
        return [as_lists(pa.array(known).cast(pa.string()), np.bincount(own, minlength=len(part)))]

    field = T.StructField("terms", T.ArrayType(T.StringType()))
    vectors = with_results(rows, "_text", [field], terms).select("label", "terms")
    counter = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(chosen))], "terms", "features")
    prepared = stage(counter.setBinary(True).transform(vectors).select("label", "features"))
    machine = FMClassifier(
        factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=1e-4, seed=7, solver="adamW", miniBatchFraction=1.0
    ).fit(prepared.coalesce(8))
    return FactorMachine(feature, float(machine.intercept), machine.linear.toArray(), machine.factors.toArray())


def score(docs: DataFrame, machine: FactorMachine, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1. Null and empty texts have no terms: the intercept's score.

    A column ``toxicity`` of the input is replaced, other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a few megabytes, fixed by HASH_BITS
    field = T.StructField("toxicity", T.DoubleType())
    return with_results(docs, text, [field], lambda part: [shared.value.scores(part)])
