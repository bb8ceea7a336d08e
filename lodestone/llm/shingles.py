"""Sets of five-word shingles as 64-bit hashes, and MinHash samples of them, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix, utf8, word_hashes

WORDS = 5
_random = np.random.Generator(np.random.PCG64(5))
_PLACE = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its distinct shingles' hashes (sorted, row after row), the row's edges, and two hashes of its word sequence.

    Texts of fewer than WORDS words have their whole sequence as one shingle; those without words have none.
    """
    words, first = word_hashes(*utf8(array))
    rows, n = len(array), np.diff(first)
    owner = np.repeat(np.arange(rows), n)
    place = (np.arange(len(words)) - np.repeat(first[:-1], n)).astype(np.uint64)
    sequence = np.zeros((2, rows), np.uint64)
    for i, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        np.add.at(sequence[i], owner, mix(words ^ (place * np.uint64(c) + np.uint64(i))))
    h = np.zeros(len(words), np.uint64)
    for i in range(min(WORDS, len(words))):
        h[: len(words) - i] += words[i:] * _PLACE[i]
    whole = np.repeat(n, n) - place.astype(np.int64) >= WORDS
    h, by = mix(h[whole]), owner[whole]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    h, by = np.append(h, sequence[0][short]), np.append(by, short)
    order = np.lexsort((h, by))
    h, by = h[order], by[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (by[1:] != by[:-1])) if len(h) else np.zeros(0, bool)
    return h[keep], np.searchsorted(by[keep], np.arange(rows + 1)), sequence[0], sequence[1]


def minhash(hashes: np.ndarray, edges: np.ndarray, samples: int) -> np.ndarray:
    """samples x rows of 32-bit minima; rows without shingles have the largest value."""
    out = np.full((samples, len(edges) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(edges))
    if not len(full):
        return out
    random = np.random.Generator(np.random.PCG64(11))
    factors = random.integers(0, 2**31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    terms = random.integers(0, 2**32, samples, dtype=np.uint32)
    starts, x = edges[:-1][full], (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(samples):
        out[i, full] = np.minimum.reduceat(x * factors[i] + terms[i], starts)
    return out
