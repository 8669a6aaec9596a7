"""Words of whole batches as 64-bit hashes, computed on the UTF-8 bytes with numpy.

A word hash is a sum of random values per byte times powers of an odd number, then mixed; upper-case
A-Z count as lower case. Different words collide with a probability of about 2**-60 a pair.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 21

#: Bytes of words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Bytes of words made of ASCII digits, ASCII letters and all that is not ASCII.
LETTERED = np.zeros(256, bool)
LETTERED[48:58] = LETTERED[65:91] = LETTERED[97:123] = LETTERED[128:] = True

_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _ODD)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end)."""
    inside = kind[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word; worked off in steps, so that memory doesn't grow with the batch."""
    out = np.empty(len(starts), np.uint64)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _STEP, "right")) - 1)
        sizes, at = ends[i:j] - starts[i:j], total[i:j] - total[i]
        place = np.arange(total[j] - total[i]) - np.repeat(at, sizes)
        value = byte_values[data[np.repeat(starts[i:j], sizes) + place]] * _power(int(sizes.max()))[place]
        out[i:j] = mixed(np.add.reduceat(value, at))
        i = j
    return out


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that tells upper from lower case."""
    return word_hashes(data, starts, ends, _CASED)


_MULTIPLIERS = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _MULTIPLIERS[k]
    return mixed(total)
