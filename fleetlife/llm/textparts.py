"""Whole texts inside Arrow tasks: words, their 64-bit hashes, and result columns beside a row.

A task never holds more than one slice of an Arrow batch in expanded form: a slice ends after
``SLICE_BYTES`` of text, or after one document if that is longer. Hashes are computed over pieces
of a quarter of a megabyte, so a very long document costs memory by its words, not eight times its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.session import bound_batches

SLICE_BYTES = 1 << 18
PIECE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)


def splitmix(values: np.ndarray) -> np.ndarray:
    """A well-known 64-bit mixer: each output bit depends on all input bits."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``letters``: digits, letters and all beyond ASCII (upper case
    counts as its lower case); ``visible``: all but ASCII white space."""
    member = np.zeros(256, bool)
    if kind == "letters":
        for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
            member[ord(low) : ord(high) + 1] = True
        member[0x80:] = True
    else:
        member[:] = True
        member[[0x20, *range(0x09, 0x0E)]] = False
    return member


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


WORD_BYTES = {kind: _classes(kind) for kind in ("letters", "visible")}
LOWER = _lower_table()
_VALUE = splitmix(LOWER.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
_EXACT_VALUE = splitmix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    base = _INVERSE if inverse else int(_BASE)
    if n <= PIECE_BYTES + 1:
        return _powers(base, PIECE_BYTES + 1)[:n]
    return _powers.__wrapped__(base, n)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    table = _VALUE if fold_case else _EXACT_VALUE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * powers(b - a), out=sums[1:])
        at = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[at]) * powers(b - a + 1, inverse=True)[at]
        i = j
    return splitmix(out)


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` consecutive values (as many as there are starts)."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _BASE
        out += values[k : k + count]
    return splitmix(out)


@dataclass
class Texts:
    """A slice of consecutive rows: the UTF-8 bytes of their texts (null: none) one after another."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray  # of each row's bytes, one more than rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def ids(self, name: str) -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)

    def words(self, kind: str) -> Words:
        return Words(self, kind)


class Words:
    """The words of a slice of texts. ``first[d]`` is the number of the first word of row ``d``."""

    def __init__(self, texts: Texts, kind: str):
        self.texts = texts
        inside = WORD_BYTES[kind][texts.data]
        n = len(inside)
        self.starts = self.ends = np.empty(0, np.int64)
        if n:
            before = np.empty(n, bool)
            before[0], before[1:] = False, inside[:-1]
            cuts = texts.offsets[:-1]
            cuts = cuts[cuts < n]
            before[cuts] = False
            self.starts = np.flatnonzero(inside & ~before)
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, inside[1:]
            after[cuts[cuts > 0] - 1] = False
            self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.texts)), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.texts.data, self.starts, self.ends)

    def word(self, at: int) -> bytes:
        """The lower-cased bytes of a word."""
        return LOWER[self.texts.data[self.starts[at] : self.ends[at]]].tobytes()

    def runs(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of ``n`` words that stay within a row."""
        values = run_hashes(hashes, n)
        last = np.repeat(self.first[1:], self.counts())[: len(values)]
        at = np.flatnonzero(np.arange(len(values)) + n <= last)
        return at, values[at]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[Texts]:
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(content, np.uint8) if content else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        own = offsets[row : end + 1]
        yield Texts(batch.slice(row, end - row), whole[own[0] : own[-1]], own - own[0])
        row = end


def with_results(
    df: DataFrame, text: str, fields: Sequence[T.StructField], compute: Callable[[Texts], Sequence], keep_text: bool = True
) -> DataFrame:
    """Each row with the columns ``fields``, which ``compute`` makes for a slice of rows.

    As with ``withColumn``, a result replaces an input column of the same name; all other columns
    pass through; without ``keep_text`` all but the text. Nothing is shuffled.
    """
    bound_batches(df.sparkSession)
    taken = {f.name.lower() for f in fields} | (set() if keep_text else {text.lower()})
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *fields])
    names, kept_names = schema.names, [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept_names), *made], names)

    return df.mapInArrow(run, schema)


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that have one of the names (in any case) renamed, and the new names."""
    taken = {n.lower() for n in names}
    moved = {c: f"_aside_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(moved), moved


def put_back(df: DataFrame, like: DataFrame, moved: dict[str, str]) -> DataFrame:
    """The columns of ``like``, under their own names."""
    return df.select(*[F.col(moved.get(c, c)).alias(c) for c in like.columns])


def as_lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Consecutive values as one list per row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
