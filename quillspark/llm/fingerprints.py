"""64-bit fingerprints of any substrings of a buffer, by sums over its beginnings."""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(400))
_VALUE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that a worker keeps; those of longer buffers are made each time.
KEPT = 1 << 20


def _power(n: int, back: bool = False) -> np.ndarray:
    found = _powers[back]
    if len(found) < n:
        steps = np.full(n, _BACK if back else _BASE, np.uint64)
        steps[0] = 1
        found = np.multiply.accumulate(steps, out=steps)
        _powers[back] = found[:KEPT].copy()
    return found[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(len(data)), out=sums[1:])
    return sums


def prints(sums: np.ndarray, at: np.ndarray, size) -> np.ndarray:
    """Fingerprints of the strings of `size` bytes (a number or one to each place) that start at the places `at`."""
    found = (sums[at + size] - sums[at]) * _power(len(sums), True)[at]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))
