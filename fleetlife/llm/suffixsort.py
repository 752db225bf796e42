"""Suffix order of a block of text by a difference cover, in numpy.

{1, 2} is a difference cover modulo 3: for any two places some shift below 3 brings both to places whose
remainder is 1 or 2. The suffixes at those places (the cover sample) are ranked first; every other
comparison then needs two bytes and two ranks at most, however long the suffixes agree.
"""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes (at most 8) from each place as a number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | text[at + k]
    return out


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def sample_ranks(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Ranks of the sample suffixes by their first ``depth`` bytes or more; by place, 0 elsewhere.

    Names of six bytes are doubled: a place and the one after it in steps of 6, 12, ... have the same
    remainder, so only ranks of sample places are ever needed. ``text`` has zeros beyond ``size``.
    """
    places = np.flatnonzero(np.arange(size) % 3 != 0)
    ranks = np.zeros(len(text), np.uint64)
    ranks[places] = _ranks(_words(text, places, 6)) + np.uint64(1)
    known = 6
    while known < depth:
        ahead = np.minimum(places + known, len(text) - 1)
        ranks[places] = _ranks(ranks[places] << np.uint64(32) | ranks[ahead]) + np.uint64(1)
        known *= 2
    return ranks


def sort_suffixes(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the text from there, by ``depth`` bytes at least."""
    size = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    ranks = sample_ranks(padded, size, depth)
    groups = [places[places % 3 == r] for r in range(3)]
    byte, rank_bits = np.uint64(8), np.uint64(32)

    def one(at: np.ndarray) -> np.ndarray:  # a byte, then a sample rank: for remainders 0 and 1
        return padded[at] << rank_bits | ranks[at + 1]

    def two(at: np.ndarray) -> np.ndarray:  # two bytes, then a sample rank: for remainders 0 and 2
        return (padded[at] << byte | padded[at + 1]) << rank_bits | ranks[at + 2]

    # Ranks are by a limited depth, and either key looks a byte further: ties are put in its order.
    zero = groups[0][np.lexsort((two(groups[0]), one(groups[0])))]
    first = groups[1][np.lexsort((one(groups[1]), ranks[groups[1]]))]
    second = groups[2][np.lexsort((two(groups[2]), ranks[groups[2]]))]
    sample = np.concatenate([first, second])
    sample = sample[np.argsort(ranks[sample], kind="stable")]
    # Where the others stand among the sample: by remainder, each with the shift that suits both.
    before = np.searchsorted(one(first), one(zero)) + np.searchsorted(two(second), two(zero))
    out = np.empty(len(places), np.int64)
    at = before + np.arange(len(zero))
    taken = np.zeros(len(places), bool)
    taken[at] = True
    out[at] = zero
    out[~taken] = sample
    return out


def equal_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of the order has the same first ``depth`` bytes as the one before it."""
    same = np.ones(len(order), bool)
    same[:1] = False
    now, before = order[1:], order[:-1]
    for k in range(depth):
        left = np.flatnonzero(same[1:]) if k % 8 == 0 else left
        same[1 + left] &= text[now[left] + k] == text[before[left] + k]
    return same
