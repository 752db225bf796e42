"""License scan: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by how often they occur in the whole corpus, rare ones first. A block that holds at
least the share t of a template's n tokens holds one of the template's n - ceil(t n) + 1 rarest (prefix
filter). Such a block must have enough tokens (length filter), and enough of them must follow the first
common token in either list (positional filter); what is left is counted exactly. No block that meets
the threshold is missed.

Blocks are overlapping runs of words: each run of ``BLOCK // 2`` words lies within one block. The template
side is a fixed list of a few kilobytes, so it is what every task gets; the documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.llm.textparts import Texts, as_lists, slices, with_results

#: Words of a block; the next one starts half a block later. No template may be longer than half.
BLOCK = 256


@dataclass(frozen=True)
class Template:
    """``phrase``: all tokens are needed, and the words must then stand in this order side by side."""

    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False


# The base phrases, and the wording of common license notices.
TEMPLATES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
    T.StructField(
        "blocks",
        T.ArrayType(
            T.StructType(
                [
                    T.StructField("label", T.StringType()),
                    T.StructField("first_word", T.LongType()),
                    T.StructField("containment", T.DoubleType()),
                ]
            )
        ),
    ),
]


def _vocabulary(templates: Sequence[Template]) -> tuple[list[list[int]], list[bytes], np.ndarray]:
    """The words of each template as token numbers; the tokens; their hashes (token k has hash k)."""
    batch = pa.RecordBatch.from_arrays([pa.array([t.text for t in templates], pa.string())], ["text"])
    numbers: dict[bytes, int] = {}
    hashes: list[int] = []
    rows: list[list[int]] = []
    for part in slices(batch, "text"):
        words = part.words("letters")
        values = words.hashes()
        for d in range(len(part)):
            row = []
            for k in range(words.first[d], words.first[d + 1]):
                spelled = words.word(k)
                if spelled not in numbers:
                    numbers[spelled] = len(numbers)
                    hashes.append(int(values[k]))
                row.append(numbers[spelled])
            rows.append(row)
    return rows, list(numbers), np.array(hashes, np.uint64)


class _Lookup:
    """Token numbers of word hashes; -1 for words that no template has."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[hashes & np.uint64(0xFFFF)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, np.int32)
        maybe = np.flatnonzero(self.bits[values & np.uint64(0xFFFF)])
        place = np.searchsorted(self.keys, values[maybe])
        place[place == len(self.keys)] = 0
        same = self.keys[place] == values[maybe]
        out[maybe[same]] = self.order[place[same]]
        return out


def token_frequencies(docs: DataFrame, hashes: np.ndarray, text: str = "text") -> np.ndarray:
    """How often each token occurs in all documents: one row per task and token, then summed."""
    lookup = _Lookup(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for part in slices(batch, text):
                found = lookup(part.words("letters").hashes())
                total += np.bincount(found[found >= 0], minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes))), pa.array(total)], ["token", "n"])

    counted = docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(len(hashes), np.int64)
    for row in counted.collect():  # one row per template token
        out[row.token] = row.n
    return out


class _Index:
    """Templates with their tokens in corpus order, and the prefix tokens that lead to them."""

    def __init__(self, templates: Sequence[Template], frequencies: np.ndarray):
        self.templates = templates
        self.rows, self.spelled, hashes = _vocabulary(templates)
        self.lookup = _Lookup(hashes)
        order = np.lexsort((np.arange(len(hashes)), frequencies))
        self.rank = np.empty(len(hashes), np.int64)
        self.rank[order] = np.arange(len(hashes))
        self.sets, self.needed, self.by_token = [], [], {}
        for k, (template, row) in enumerate(zip(templates, self.rows)):
            tokens = sorted(set(row), key=lambda t: self.rank[t])
            needed = max(ceil(template.threshold * len(tokens) - 1e-9), 1)
            self.sets.append({t: i for i, t in enumerate(tokens)})
            self.needed.append(needed)
            for t in tokens[: len(tokens) - needed + 1]:
                self.by_token.setdefault(t, []).append(k)
        self.leads = np.zeros(len(hashes) + 1, bool)  # the last stands for -1
        self.leads[list(self.by_token)] = True

    def overlap(self, template: int, tokens: list[int]) -> int:
        """Common tokens of a template and a block's token list (in corpus order), or 0 if too few."""
        places, needed = self.sets[template], self.needed[template]
        if len(tokens) < needed:  # length filter; tokens outside all templates can't count anyway
            return 0
        common = 0
        for j, token in enumerate(tokens):
            i = places.get(token)
            if i is not None:
                common += 1
                if common + min(len(places) - 1 - i, len(tokens) - 1 - j) < needed:  # positional filter
                    return 0
        return common if common >= needed else 0


def _scan(index: _Index, part: Texts) -> list:
    words = part.words("letters")
    found = index.lookup(words.hashes())
    lead = np.flatnonzero(index.leads[found])
    half = BLOCK // 2
    places: list[list[dict]] = [[] for _ in range(len(part))]
    blocks: list[list[dict]] = [[] for _ in range(len(part))]
    rows = np.searchsorted(words.first, lead, "right") - 1
    wanted: dict[tuple[int, int], set[int]] = {}
    for at, d in zip(lead.tolist(), rows.tolist()):
        b = (at - int(words.first[d])) // half
        for block in (b - 1, b) if b else (b,):
            wanted.setdefault((d, block), set()).update(index.by_token[int(found[at])])
    starts: list[set[tuple[int, str]]] = [set() for _ in range(len(part))]
    for (d, block), templates in wanted.items():
        first = int(words.first[d]) + block * half
        own = found[first : min(first + BLOCK, int(words.first[d + 1]))]
        tokens = sorted(set(own[own >= 0].tolist()), key=lambda t: index.rank[t])
        for k in sorted(templates):
            common = index.overlap(k, tokens)
            if not common:
                continue
            template = index.templates[k]
            if template.phrase:
                for at in _phrase(own, index.rows[k]):
                    spelled = [words.word(first + at + i) for i in range(len(index.rows[k]))]
                    if spelled == [index.spelled[t] for t in index.rows[k]]:
                        starts[d].add((block * half + at, template.label))
            else:
                share = common / len(index.sets[k])
                blocks[d].append({"label": template.label, "first_word": block * half, "containment": share})
    for d, own in enumerate(starts):
        places[d] = [{"label": label, "word": at} for at, label in sorted(own)]
    kinds = [f.dataType for f in RESULT]
    return [words.counts().astype(np.int64), _lists(places, kinds[1]), _lists(blocks, kinds[2])]


def _phrase(tokens: np.ndarray, phrase: list[int]) -> list[int]:
    n = len(tokens) - len(phrase) + 1
    if n <= 0:
        return []
    fits = np.ones(n, bool)
    for i, token in enumerate(phrase):
        fits &= tokens[i : i + n] == token
    return np.flatnonzero(fits).tolist()


def _lists(rows: list[list[dict]], kind: T.ArrayType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    inner = to_arrow_type(kind.elementType)
    return as_lists(pa.array([x for row in rows for x in row], inner), np.array([len(r) for r in rows], np.int64))


def scan_licenses(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` of phrases and ``blocks`` that contain a template.

    Null and empty texts have no words; templates must be shorter than half a block. Results replace
    columns of the same names, other columns pass through. The corpus is read twice: for the token
    frequencies, and for the join.
    """
    rows, _, hashes = _vocabulary(templates)
    if max(len(r) for r in rows) > BLOCK // 2 or not all(rows):
        raise ValueError("a template must have 1 to half a block of words")
    index = _Index(templates, token_frequencies(docs, hashes, text))
    return with_results(docs, text, RESULT, lambda part: _scan(index, part))
