"""Character n-grams of whole batches as slots of a hashed table, computed on code points with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sitegauge.llm.words import mixed

_random = np.random.default_rng(4711)
_ODD = _random.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (A-Z lower-cased) and the offset of each text."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])[offsets]
    return np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes), at


def gram_slots(codes: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the text of each n-gram and its slot, in ``slots`` (a power of two); grams stay within a text."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    value = (codes.astype(np.uint64) + np.uint64(1)) * _ODD[15]
    value ^= value >> np.uint64(29)
    total = np.zeros(len(codes), np.uint64)
    for k in range(max(sizes)):
        total = total[: len(codes) - k] + value[k:] * _ODD[k] if len(codes) >= k else total[:0]
        if k + 1 in sizes and len(total):
            whole = owner[: len(total)] == owner[k:]
            yield owner[: len(total)][whole], (mixed(total[whole] + np.uint64(k)) >> np.uint64(20)).astype(np.int64) & (slots - 1)


def present(codes: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], slots: int, feature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, ordered. ``feature`` maps slots to features, -1: not one; without it slots are the features."""
    width = slots if feature is None else int(feature.max(initial=0)) + 1
    seen = []
    for owner, slot in gram_slots(codes, at, sizes, slots):
        if feature is not None:
            slot = feature[slot]
            ok = slot >= 0
            owner, slot = owner[ok], slot[ok]
        seen.append(owner.astype(np.int64) * width + slot)
    flat = np.concatenate(seen) if seen else np.zeros(0, np.int64)
    n = (len(at) - 1) * width
    if n <= 32 * len(flat):  # marking is faster than sorting where the table is not too sparse
        marks = np.zeros(n, bool)
        marks[flat] = True
        flat = np.flatnonzero(marks)
    else:
        flat = np.unique(flat)
    return flat // width, flat % width
