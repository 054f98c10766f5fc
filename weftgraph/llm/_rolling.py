"""Rabin-Karp hashes of all windows of a sequence, and content-chosen anchors, vectorised.

Hashes are polynomials over 64-bit unit values modulo 2**64 with an odd base, read
from prefix sums, so the hash of any stretch costs two lookups.  Unit values are
random, and hashes are mixed before use.
"""

from __future__ import annotations

import numpy as np

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BYTES = [np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bits of a position inside a block; the rest of an anchor key is hash.
PLACE = 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) <= n:
        base = BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        size = max(n + 1, 1 << 16)
        held = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (base, inverse))
        _POWERS[which] = held
    return held


class Rolling:
    """Hashes of stretches of one sequence of 64-bit units."""

    def __init__(self, units: np.ndarray, which: int = 0):
        up, self.down = _powers(len(units), which)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all stretches of ``width`` units."""
        n = len(self.sums) - 1 - width
        if n < 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[: n + 1]) * self.down[: n + 1])


def byte_units(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTES[which][data]


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    edge = np.flatnonzero(np.diff((~WHITE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def word_units(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return Rolling(byte_units(data, which), which).of(start, end) | np.uint64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in turn, by minima from block edges."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_groups(units: np.ndarray, second: np.ndarray, end_of: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Groups of neighbouring windows that share an anchor.

    The anchor of a window is its ``gram``-unit part of least hash, the leftmost of
    equals: it depends on the window's content alone, so equal windows have equal
    anchors at equal offsets.  ``end_of`` is the end of each unit's document;
    windows stay inside it.  Returns, per group, the anchor's hash, the hash of
    all units that its windows cover (with the anchor's place), the first window's
    start and the number of windows.
    """
    n = len(units) - window + 1
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 0:
        return empty
    if len(units) >= 1 << PLACE:
        parts = []
        step = (1 << PLACE) - window
        for a in range(0, n, step):  # blocks overlap by a window less one, so each window is in just one
            b = min(len(units), a + step + window - 1)
            h, c, s, k = anchor_groups(units[a:b], second[a:b], end_of[a:b] - a, window, gram)
            parts.append((h, c, s + a, k))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    grams = Rolling(units, 0).every(gram)
    place = np.uint64((1 << PLACE) - 1)
    keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keys, window - gram + 1) & place).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + window <= end_of[:n])
    if not len(starts):
        return empty
    anchor = anchor[starts]
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, at = starts[head], anchor[head]
    count = np.diff(np.r_[head, len(starts)])
    cover = Rolling(second, 1).of(first, first + count + window - 1)
    cover = mix(cover + (at - first).astype(np.uint64) * BASES[0] + count.astype(np.uint64) * BASES[1])
    return grams[at], cover, first, count
