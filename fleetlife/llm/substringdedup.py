"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

Which suffixes can share their first ``length`` bytes at all? Those whose window of that many bytes has the
same smallest gram hash (of the 20-byte grams in it): equal windows have equal grams. So the suffixes of the
corpus fall into buckets by that hash, and only buckets with several documents matter. Runs of windows with
the same smallest gram move together, as one piece of text. A task gets some buckets and sorts one block of
them at a time: the cover sample is ranked first, ties of any length are resolved by its ranks, and suffixes
that agree in ``length`` bytes become neighbours. The smallest document of such a run keeps the bytes.

Copies are settled before anything is sorted: whole texts by checksum, pieces by hash, so a group of copies
sends one text per chunk of documents. A bucket that very many documents share (a common phrase) is cut by
window instead of by gram, for all documents alike, and again each window goes out once per chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.llm.sharedkeys import _groups, key_bits, pack, pack_sorted, shared, slice_bits, unpack, unpack_sorted
from fleetlife.llm.suffixsort import equal_prefixes, sort_suffixes
from fleetlife.llm.textparts import _EXACT_VALUE, PIECE_BYTES, Texts, as_lists, powers, slices, span_hashes, splitmix, with_results
from fleetlife.session import stage

#: Bytes of a repeated string, and of the grams that name its bucket.
LENGTH = 50
GRAM = 20

#: Text that is sorted at a time.
BLOCK_BYTES = 1 << 20

#: Text of pieces that a task collects before it sends them.
CHUNK_BYTES = 8 << 20

#: A bucket of more documents than this is cut by window.
HOT_DOCUMENTS = 20_000

#: A place in a text has so many bits.
_PLACE_BITS = 40

_BOUND = "slice int, first long, docs binary, starts binary, windows binary, keys binary, size long, text binary, known boolean"
_CODEC = "zstd"
_COVERED = "doc_id long, starts array<long>, ends array<long>"


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` bytes from each place of one text."""
    count = len(data) - n + 1
    out = np.empty(max(count, 0), np.uint64)
    for a in range(0, count, PIECE_BYTES // 2):
        b = min(a + PIECE_BYTES // 2, count)
        own = data[a : b + n - 1]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_EXACT_VALUE[own] * powers(len(own)), out=sums[1:])
        out[a:b] = (sums[n:] - sums[:-n]) * powers(b - a, inverse=True)
    return splitmix(out)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while 2 * have <= n:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = n - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_keys(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of ``length`` bytes the smallest hash of its grams."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    return sliding_min(gram_hashes(data, gram), length - gram + 1)


def _bucket_keys(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    rows, keys = [], []
    for d in range(len(part)):
        own = window_keys(part.data[part.offsets[d] : part.offsets[d + 1]])
        if len(own):
            own = np.unique(own[np.concatenate([[True], own[1:] != own[:-1]])])
            rows.append(np.full(len(own), d))
            keys.append(own)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def gather(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of a text one after another; index arrays are made for a megabyte at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    i = 0
    while i < len(starts):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
        own = np.arange(int(ends[j - 1]) - done)
        out[done : ends[j - 1]] = text[own + np.repeat(starts[i:j] - (ends[i:j] - sizes[i:j] - done), sizes[i:j])]
        i = j
    return out


class Pieces:
    """Runs of windows: document, place of the first window, number of windows, bucket, and their text."""

    def __init__(self, docs, starts, windows, keys, text: np.ndarray):
        self.docs, self.starts, self.windows, self.keys, self.text = docs, starts, windows, keys, text
        self.at = np.concatenate([[0], np.cumsum(windows + LENGTH - 1)])

    def __len__(self) -> int:
        return len(self.docs)

    def take(self, which: np.ndarray) -> Pieces:
        columns = (self.docs, self.starts, self.windows, self.keys)
        text = gather(self.text, self.at[which], self.windows[which] + LENGTH - 1)
        return Pieces(*(c[which] for c in columns), text)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.text, self.at[:-1], self.at[1:], fold_case=False)

    def ends(self) -> np.ndarray:
        return self.starts + self.windows + LENGTH - 1

    def without_copies(self) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray]:
        """The smallest document's pieces of each text, by bucket; and what that settles: documents, starts, ends.

        A document can have the same piece at several places, and keeps all of them.
        """
        hashes = self.hashes()
        order = np.lexsort((self.starts, self.docs, hashes, self.windows, self.keys))
        k, h, w = self.keys[order], hashes[order], self.windows[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        leader = np.repeat(self.docs[order[new]], np.diff(np.append(np.flatnonzero(new), len(order))))
        gone = order[self.docs[order] > leader]
        return self.take(order[self.docs[order] == leader]), self.docs[gone], self.starts[gone], self.ends()[gone]


def _pieces_of(data: np.ndarray, doc: int, wanted: np.ndarray, hot: np.ndarray, bits: int, mark: int) -> Iterator[tuple]:
    """The runs of windows of one text whose bucket is wanted: the columns of Pieces."""
    keys = key_bits(window_keys(data), bits)
    begin, sizes = _groups(keys)
    own = np.isin(keys[begin], wanted)
    for which, single in ((own & ~np.isin(keys[begin], hot), False), (own & np.isin(keys[begin], hot), True)):
        starts, windows = begin[which], sizes[which]
        if not len(starts):
            continue
        if single:
            starts = np.arange(int(windows.sum())) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
            windows = np.ones(len(starts), np.int64)
            key = key_bits(gram_hashes(data, LENGTH)[starts], bits)
        else:
            key = keys[starts]
        yield np.full(len(starts), doc), starts + mark, windows, key, gather(data, starts, windows + LENGTH - 1)


def _flush(parts: list[tuple], bits: int) -> pa.RecordBatch:
    pieces, *settled = Pieces(*(np.concatenate(c) for c in zip(*parts))).without_copies()
    rows = []
    if len(settled[0]):
        known = _covered(*settled)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, known.schema) as writer:
            writer.write_batch(known)
        spread = int(settled[0][0]) & ((1 << bits) - 1)
        rows.append((spread, 0, sink.getvalue().to_pybytes(), b"", b"", b"", 0, b"", True))
    slot = (pieces.keys >> np.uint64(64 - bits)).astype(np.int64)
    first = int(pieces.docs.min())
    begin, sizes = _groups(slot)
    for a, n in zip(begin.tolist(), sizes.tolist()):
        numbers = (pack(x[a : a + n]) for x in (pieces.docs - first, pieces.starts, pieces.windows))
        text = pieces.text[pieces.at[a] : pieces.at[a + n]].tobytes()
        packed = pa.compress(text, _CODEC, asbytes=True)
        rows.append((int(slot[a]), first, *numbers, pack_sorted(pieces.keys[a : a + n]), len(text), packed, False))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.binary(), pa.bool_()]
    names = ["slice", "first", "docs", "starts", "windows", "keys", "size", "text", "known"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _covered(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Byte ranges, one row per document."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    begin, sizes = _groups(docs)
    lists = (as_lists(pa.array(x.astype(np.int64)), sizes) for x in (starts, ends))
    return pa.RecordBatch.from_arrays([pa.array(docs[begin].astype(np.int64)), *lists], ["doc_id", "starts", "ends"])


def sort_block(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows in the block that also start in a smaller document: documents, starts, ends."""
    of = np.repeat(np.arange(len(pieces)), pieces.windows)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(pieces.windows) - pieces.windows, pieces.windows)
    places = pieces.at[of] + inside
    owner = np.full(len(pieces.text), -1, np.int64)
    owner[places] = np.arange(len(of))
    order = sort_suffixes(pieces.text, places, LENGTH)
    new = np.flatnonzero(~equal_prefixes(pieces.text, order, LENGTH))
    docs = pieces.docs[of[owner[order]]]
    least = np.repeat(np.minimum.reduceat(docs, new), np.diff(np.append(new, len(order))))
    gone = np.sort(owner[order[docs > least]])
    if not len(gone):
        return (np.empty(0, np.int64),) * 3
    # Neighbouring windows of a piece become one range.
    cut = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (of[gone[1:]] != of[gone[:-1]])])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(gone)) - 1
    piece = of[gone[first]]
    starts = pieces.starts[piece] + inside[gone[first]]
    return pieces.docs[piece], starts, pieces.starts[piece] + inside[gone[last]] + LENGTH


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["known"]:
                yield from pa.ipc.open_stream(row["docs"])
                continue
            docs, starts, windows = (unpack(row[c]).astype(np.int64) for c in ("docs", "starts", "windows"))
            text = np.frombuffer(pa.decompress(row["text"], row["size"], _CODEC), np.uint8)
            parts.append((docs + row["first"], starts, windows, unpack_sorted(row["keys"]), text))
    if not parts:
        return
    pieces, *settled = Pieces(*(np.concatenate(c) for c in zip(*parts))).without_copies()
    parts.clear()
    if len(settled[0]):
        yield _covered(*settled)
    # Buckets with one document have nothing to compare. The others, a block of text at a time.
    begin, sizes = _groups(pieces.keys)
    several = np.maximum.reduceat(pieces.docs, begin) > np.minimum.reduceat(pieces.docs, begin)
    begin, sizes = begin[several], sizes[several]
    weight = np.cumsum(pieces.at[begin + sizes] - pieces.at[begin])
    k = 0
    while k < len(begin):
        done = int(weight[k - 1]) if k else 0
        end = max(k + 1, int(np.searchsorted(weight, done + BLOCK_BYTES, "right")))
        which = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[k:end].tolist(), sizes[k:end].tolist())])
        found = sort_block(pieces.take(which))
        if len(found[0]):
            yield _covered(*found)
        k = end


RESULT = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType()),
]


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs from overlapping or touching ranges."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[cut], ends[np.append(np.flatnonzero(cut)[1:], len(starts)) - 1]


def _mark(data: np.ndarray, again: bool | None) -> int:
    """Bits above all places in a text that tell texts with the same id apart, if there are any."""
    return (zlib.crc32(data) & 0x3FFFFF) << _PLACE_BITS if again else 0


def _is_copy(data: np.ndarray, copies: list[str] | None) -> bool:
    return bool(copies) and len(data) >= LENGTH and hashlib.md5(data).hexdigest() in copies


def _cut(part: Texts) -> list:
    runs, counts, kept = [], [], []
    columns = (part.column(c).to_pylist() for c in ("_again", "_copies", "_starts", "_ends"))
    for d, (again, copies, starts, ends) in enumerate(zip(*columns)):
        data = part.data[part.offsets[d] : part.offsets[d + 1]]
        mark = _mark(data, again)
        if _is_copy(data, copies):
            starts, ends = [mark], [mark + len(data)]
        if starts:
            a, b = np.array(starts, np.int64), np.array(ends, np.int64)
            own = a >> _PLACE_BITS == mark >> _PLACE_BITS
            a, b = _merged(a[own] - mark, b[own] - mark) if own.any() else (a[:0], b[:0])
            at = np.append(0, b)
            kept.append(b"".join(data[x:y].tobytes() for x, y in zip(at.tolist(), [*a.tolist(), len(data)])))
            runs.append((a, b))
            counts.append(len(a))
        else:
            kept.append(data.tobytes())
            counts.append(0)
    a, b = (np.concatenate([r[k] for r in runs]) if runs else np.empty(0, np.int64) for k in (0, 1))
    spans = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"])
    return [np.diff(part.offsets), as_lists(spans, np.array(counts, np.int64)), pa.array(kept, pa.binary())]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key`` (a long), ``n_bytes``, ``removed`` byte runs and the ``kept`` bytes.

    Removed is every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a
    smaller key, as the input stands. Null and empty texts have no bytes. Rows without a key neither lose
    bytes nor make others lose them. Rows with the same key don't affect each other, and each of their texts
    loses its own bytes. Other columns are dropped.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    named = rows.where(F.col("_id").isNotNull())
    sums = stage(named.where(F.length("_text") > 0).select("_id", F.octet_length("_text").alias("_n"), F.md5(F.col("_text").cast("binary")).alias("_md5")))
    bits = slice_bits(sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = sums.groupBy("_md5").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    copies = sums.join(first, "_md5").where("_id > _first").select("_id", "_md5").distinct()
    found = stage(shared(named, _bucket_keys, bits, "_id", "_text"))
    each = found.select(F.explode("found").alias("_key"))
    busy = stage(each.groupBy("_key").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > HOT_DOCUMENTS).select("_key"))
    hot = np.array([r[0] for r in busy.toLocalIterator()], np.int64).view(np.uint64)
    shared_hot = spark.sparkContext.broadcast(np.sort(hot))  # total keys / HOT_DOCUMENTS numbers at most

    several = sums.groupBy("_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_id")
    kinds = {"_keys": "array<long>", "_md5": "string", "_again": "boolean"}

    def given(frame: DataFrame, **own) -> DataFrame:
        return frame.select("_id", *[own.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])

    known = given(found.withColumnRenamed("doc_id", "_id"), _keys=F.col("found"))
    known = known.union(given(copies, _md5=F.col("_md5"))).union(given(several, _again=F.lit(True)))
    info = known.groupBy("_id").agg(
        F.flatten(F.collect_list("_keys")).alias("_keys"),
        F.collect_set("_md5").alias("_copies"),
        F.coalesce(F.bool_or("_again"), F.lit(False)).alias("_again"),
    )
    info = stage(info)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = part.ids("_id")
                columns = (part.column(c) for c in ("_keys", "_copies", "_again"))
                for d, (keys, gone, again) in enumerate(zip(*columns)):
                    data = part.data[part.offsets[d] : part.offsets[d + 1]]
                    wanted = keys.values
                    if wanted is None or not len(wanted) or _is_copy(data, gone.as_py()):
                        continue
                    wanted = wanted.to_numpy(zero_copy_only=False).view(np.uint64)
                    mark = _mark(data, again.as_py())
                    for found in _pieces_of(data, int(ids[d]), wanted, shared_hot.value, bits, mark):
                        parts.append(found)
                        size += len(found[-1])
                if size >= CHUNK_BYTES:
                    yield _flush(parts, bits)
                    parts, size = [], 0
        if parts:
            yield _flush(parts, bits)

    # Both joins read the same exchange of the texts.
    dealt = named.join(info.withColumnRenamed("_id", "_i"), F.col("_id") == F.col("_i"), "left").drop("_i")
    buckets = dealt.select("_id", "_text", "_keys", "_copies", "_again").mapInArrow(pieces, _BOUND).groupBy("slice")
    covered = buckets.applyInArrow(_sort_buckets, _COVERED)
    spans = covered.groupBy(F.col("doc_id").alias("_i")).agg(
        F.flatten(F.collect_list("starts")).alias("_starts"), F.flatten(F.collect_list("ends")).alias("_ends")
    )
    gone = info.where((F.size("_copies") > 0) | F.col("_again")).select(F.col("_id").alias("_c"), "_copies", "_again")
    judged = named.join(spans, F.col("_id") == F.col("_i"), "left").join(gone, F.col("_id") == F.col("_c"), "left")
    judged = judged.select("_id", "_text", "_again", "_copies", "_starts", "_ends")
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in judged.schema.fields[2:]}
    nameless = rows.where(F.col("_id").isNull()).withColumns(nothing).select(judged.columns)
    judged = judged.union(nameless)
    return with_results(judged, "_text", RESULT, _cut).select(F.col("_id").alias(key), *[f.name for f in RESULT])
