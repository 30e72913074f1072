"""Words and their hashes for whole Arrow batches of text, by numpy.

A batch is one byte buffer with document offsets. Words are runs of bytes other than ASCII white space
(0x20, 0x09-0x0D); a word never crosses from one document into the next. A word's 64-bit value is a
polynomial over its bytes, read off two prefix sums, so no Python object is made per word.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about this many bytes; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (two multiply-xorshift rounds); 0 stays 0."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES = [_Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F)]
_GRAMS = [_Powers(0x9FB21C651E98DF25), _Powers(0xA0761D6478BD642F)]
_TABLES = [mix(np.arange(1, 257, dtype=_U) * _U(seed)) | _U(1) for seed in (0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9)]


class Words:
    """The words of a slice of documents: ``start``/``end`` byte offsets, ``doc`` row and per-row counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = _LOWER[data] if lower else data
        self.offsets, self.rows = offsets, len(offsets) - 1
        inside = ~_SPACE[self.data]
        n = len(inside)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        before[heads] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.rows + 1))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One 64-bit value per word; ``which`` picks one of two independent families."""
        n = len(self.data)
        up, down = _BYTES[which].get(n + 1)
        prefix = np.zeros(n + 1, _U)
        np.cumsum(_TABLES[which][self.data] * up[:n], out=prefix[1:])
        return mix((prefix[self.end] - prefix[self.start]) * down[self.start])

    def grams(self, values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Values of all runs of ``size`` words by starting word; see :meth:`complete` for which are real."""
        n = len(values)
        if n < size:
            return np.zeros(0, _U)
        up, down = _GRAMS[which].get(n + 1)
        prefix = np.zeros(n + 1, _U)
        np.cumsum(values * up[:n], out=prefix[1:])
        return mix((prefix[size:] - prefix[:-size]) * down[:n - size + 1])

    def complete(self, size: int) -> np.ndarray:
        """True where the run of ``size`` words that starts here stays within one document."""
        if len(self.doc) < size:
            return np.zeros(0, bool)
        return self.doc[size - 1:] == self.doc[:len(self.doc) - size + 1]


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows with about ``limit`` bytes; null reads as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    rows = len(text)
    if not rows:
        return
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + rows + 1]
    buffer = text.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield at, to, data[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
        at = to


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out
