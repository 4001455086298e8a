"""Hashes of runs of symbols, for whole arrays at once."""

from __future__ import annotations

import numpy as np


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


BASE = int(mix(np.array([977], np.uint64))[0]) | 1
INVERSE = pow(BASE, -1, 1 << 64)
POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first powers of an odd base, modulo 2 to the 64th."""
    known = POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base))
        steps[0] = 1
        known = POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of code times power up to every place: runs are read off as differences."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the runs, wherever they stand."""
    return (sums[stops] - sums[starts]) * powers(INVERSE, len(sums))[starts]
