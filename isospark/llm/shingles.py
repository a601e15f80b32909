"""Word shingles as hashes, and their exact likeness."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd

SHINGLE, LIKENESS = 5, 0.8
#: Words whose hashes a Python worker keeps, about, and how long they may be.
KEEP, LONGEST = 1 << 16, 32
_kept: dict[bytes, int] = {}
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray, factor: np.uint64 = _MIX[1]) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * factor
    return h ^ (h >> np.uint64(27))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word; those that are kept are not hashed again."""
    new = list(set(words).difference(_kept))
    if not new:
        return np.fromiter(map(_kept.__getitem__, words), np.uint64, len(words))
    made = dict(zip(new, pd.util.hash_array(np.array([x.decode("utf-8", "replace") for x in new], object), categorize=False).tolist(), strict=True))
    out = np.fromiter((made[w] if w in made else _kept[w] for w in words), np.uint64, len(words))
    if len(_kept) > KEEP:
        _kept.clear()
    _kept.update(islice(((w, h) for w, h in made.items() if len(w) <= LONGEST), KEEP))
    return out


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words, lower-cased A-Z; of all words where there are fewer; none where there are none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = h * _MIX[0] + w[k : len(w) - size + 1 + k]
    return mixed(h)


def jaccard(one: np.ndarray, other: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard likeness of two sets, sorted and each value once; 0.0 without a comparison where their sizes keep it under `least`."""
    if min(len(one), len(other)) < least * max(len(one), len(other)):
        return 0.0
    if not len(one) and not len(other):
        return 1.0
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both)
