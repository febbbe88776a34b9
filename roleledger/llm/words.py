"""Words, word hashes and shingle hashes of whole texts, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text: ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased if asked for."""
    words = (text or "").encode()
    words = (words.lower() if lower else words).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> SHIFT)) * MULTIPLIER
    return values ^ (values >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every ``width`` neighbouring words; the whole sequence if there are fewer; none without words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    out = np.full(count, width, np.uint64)
    for i in range(width):
        out = mixed(out ^ hashes[i : i + count])
    return out
