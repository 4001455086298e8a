"""Hashes of word runs."""

from __future__ import annotations

import numpy as np

from kerbside.llm.common import WORDS_PER_SHINGLE
from kerbside.llm.hashing import mix

FACTORS = mix(np.arange(11, 11 + WORDS_PER_SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles_of(words: np.ndarray, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The hash of every run of ``size`` words; a shorter text is one run."""
    size = min(size, len(words))
    if not size:
        return words[:0]
    stop = len(words) - size + 1
    total = words[:stop] * FACTORS[0]
    for k in range(1, size):
        total += words[k : k + stop] * FACTORS[k]
    return mix(total)
