"""Which documents share a key with another one, when there are many keys per document.

A task takes documents a chunk at a time. Keys that several documents of the chunk have are known to be
shared at once; beyond that, a chunk sends each of its keys once, for the smallest document that has it,
packed into a few bytes. So a key that a third of all documents have costs one entry per chunk, not per
document, and what a task of the second step gets is a slice of the key space whose size doesn't depend
on how often single keys occur. Keys are cut to their slice and 48 further bits: a rare false match only
makes a candidate more, and callers check candidates exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlife.llm.textparts import Texts, as_lists, slices
from fleetlife.session import bound_batches

#: Text of a chunk.
CHUNK_BYTES = 24 << 20

#: Text whose keys make up one slice of the key space.
SLICE_TEXT = 16 << 20

#: Rows (of one slice each) that a chunk sends at once.
SENT_SLICES = 64

_PACKED = "slice int, first long, keys binary, docs binary, known boolean"
FOUND = "doc_id long, found array<long>"

KeysOf = Callable[[Texts], tuple[np.ndarray, np.ndarray]]


#: Slices there are at least, so that rows per document and slice don't grow with the number of slices.
LEAST_SLICES = 256


def slice_bits(total_bytes: int, tasks: int) -> int:
    """Bits of the slice number: enough slices for the text, and for all tasks to have some."""
    return (max(int(total_bytes // SLICE_TEXT), 2 * tasks, LEAST_SLICES) - 1).bit_length()


def key_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys cut to the bits that are compared."""
    low = np.uint64(64 - bits - 48)
    return keys >> low << low


def _chunks(batches: Iterator[pa.RecordBatch], doc: str, text: str, keys_of: KeysOf, chunk_bytes: int):
    """Document ids and keys, a chunk of documents at a time."""
    docs, keys, size = [], [], 0
    for batch in batches:
        for part in slices(batch, text):
            rows, own = keys_of(part)
            docs.append(part.ids(doc).astype(np.int64)[rows])
            keys.append(own)
            size += len(part.data)
            if size >= chunk_bytes:
                # Its pieces are let go while the chunk is worked on.
                whole = [np.concatenate(keys), np.concatenate(docs)]
                docs, keys, size = [], [], 0
                yield whole.pop(), whole.pop()
    if docs:
        yield np.concatenate(docs), np.concatenate(keys)


def _sorted_pairs(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, document) pairs in order."""
    order = np.lexsort((docs, keys))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[new], keys[new]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and the length of each."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(keys)))


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0, each in as few bytes as the largest needs: first the width, then a plane per byte."""
    values = np.ascontiguousarray(values.astype(np.uint64))
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width, 0]) + len(values).to_bytes(6, "little") + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width, count = data[0], int.from_bytes(data[2:8], "little")
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=8).reshape(width, count).T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _lists(docs: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
    """One row per document with its distinct values."""
    docs, values = _sorted_pairs(values, docs)[::-1]
    begin, sizes = _groups(docs)
    if not len(begin):
        return None
    return pa.RecordBatch.from_arrays([pa.array(docs[begin]), as_lists(pa.array(values), sizes)], ["doc_id", "found"])


def shared(
    docs: DataFrame, keys_of: KeysOf, bits: int, doc: str = "doc_id", text: str = "text", leaders: bool = False,
    chunk_bytes: int | None = None,
) -> DataFrame:
    """(doc_id, found) rows: the keys that a document shares with others, or with ``leaders`` documents.

    The key space is cut into ``2**bits`` slices. ``found`` holds keys (see ``key_bits``) as signed longs. With
    ``leaders`` it holds the smallest document of the chunk or of all chunks that has a common key, so
    that the pairs (doc_id, found) connect all documents with a common key. A document can have several
    rows. ``doc`` holds longs without nulls. Callers with many keys per document take smaller chunks.
    """
    bound_batches(docs.sparkSession)
    chunk = chunk_bytes or CHUNK_BYTES
    low = np.uint64(64 - bits - 48)
    cut = np.uint64(64 - bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        for own, keys in _chunks(batches, doc, text, keys_of, chunk):
            own, keys = _sorted_pairs(own, key_bits(keys, bits))
            begin, sizes = _groups(keys)
            rows: list[tuple] = []
            many = np.repeat(sizes > 1, sizes)
            if many.any():
                found = np.repeat(own[begin], sizes)[many] if leaders else keys[many].view(np.int64)
                known = _lists(own[many], found)
                spread = int(known["doc_id"][0].as_py()) & ((1 << bits) - 1)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, known.schema) as writer:
                    writer.write_batch(known)
                rows.append((spread, 0, sink.getvalue().to_pybytes(), b"", True))
            asker, key = own[begin], keys[begin]
            slot = (key >> cut).astype(np.int64)
            rest = (key & ((np.uint64(1) << cut) - np.uint64(1))) >> low
            first = int(asker.min()) if len(asker) else 0
            at, sizes = _groups(slot)
            for a, n in zip(at.tolist(), sizes.tolist()):
                own_docs = pack(asker[a : a + n] - first)
                rows.append((int(slot[a]), first, pack_sorted(rest[a : a + n]), own_docs, False))
            del own, keys, asker, key, slot, rest
            # A batch goes to the JVM as a whole: a part of the slices at a time.
            for a in range(0, len(rows), SENT_SLICES):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[a : a + SENT_SLICES]), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "first", "keys", "docs", "known"])

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, own, keys = np.uint64(key[0].as_py()), [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["known"]:
                    yield from pa.ipc.open_stream(row["keys"])
                    continue
                keys.append(unpack_sorted(row["keys"]))
                own.append(unpack(row["docs"]).astype(np.int64) + row["first"])
        if not keys:
            return
        own, keys = _sorted_pairs(np.concatenate(own), np.concatenate(keys))
        begin, sizes = _groups(keys)
        many = np.repeat(sizes > 1, sizes)
        whole = keys[many] << low | slot << cut
        found = np.repeat(own[begin], sizes)[many] if leaders else whole.view(np.int64)
        answered = _lists(own[many], found)
        if answered is not None:
            yield answered

    asked = docs.select(doc, text).mapInArrow(ask, _PACKED)
    return asked.groupBy("slice").applyInArrow(answer, FOUND)
