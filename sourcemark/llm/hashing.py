"""Hashes of the words of many texts at once, straight from the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text hashed in one go; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20

_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


# Anything but ASCII white space is part of a word.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = max(count, PIECE_BYTES)
            up, down = (np.full(size, b, dtype=np.uint64) for b in (_BASE, _INVERSE))
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:count], self.down[:count]


_powers = _Powers()


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds of each text in them), a few megabytes at a time."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE_BYTES, side="right")) - 1)
        last = min(last, len(texts))
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_hashes(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, with A-Z as a-z; and the bounds of each text's words among them."""
    count = len(data)
    if count == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    inside = letters[data]
    before = np.empty(count, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    edges = bounds[:-1][bounds[:-1] < count]
    before[edges] = False
    after = np.empty(count, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after)
    up, down = _powers.of(count)
    sums = np.cumsum(_FOLDED[data] * up, dtype=np.uint64)
    total = sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix(total * down[starts]), np.searchsorted(starts, bounds)


_FOLDED = _TABLE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
