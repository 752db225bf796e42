"""Word shingles of a slice of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from fleetlife.llm.textparts import Texts, splitmix


def shingle_sets(part: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct runs of ``n`` words of each row, in order.

    A row of fewer words, but not none, has the run of all its words.
    """
    words = part.words("visible")
    hashes = words.hashes()
    at, values = words.runs(hashes, n)
    rows = np.searchsorted(words.first, at, "right") - 1
    for length in range(1, n):
        short = np.flatnonzero(words.counts() == length)
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for k in range(length):
                own = own * np.uint64(0x9E3779B97F4A7C15) + hashes[words.first[short] + k]
            rows, values = np.append(rows, short), np.append(values, splitmix(own + np.uint64(length)))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def set_keys(rows: np.ndarray, values: np.ndarray, count: int) -> list[np.ndarray]:
    """Size of each row's set and 128 bits that identify it. ``rows`` and ``values`` as ``shingle_sets`` has them."""
    keys = []
    for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        total = np.zeros(count, np.uint64)
        np.add.at(total, rows, splitmix(values ^ np.uint64(seed)))
        keys.append(splitmix(total).view(np.int64))
    return [np.bincount(rows, minlength=count).astype(np.int64), *keys]
