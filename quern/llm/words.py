"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(n, _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


@dataclass
class Words:
    """Words of a run of texts: word k is data[start[k]:end[k]], of text doc[k]; the words of text i are first[i]:first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    text_start: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits a word: a polynomial in a fixed odd base over the bytes, from its last byte, mixed with the length."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(n), out=total[1:])
        # (total[end] - total[start]) / base^start; division is a product with the base's inverse.
        inverse = _inverse_powers(n + 1)
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_INVERSES = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        p = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = 1
        _INVERSES = np.multiply.accumulate(p)
    return _INVERSES[:n]


def stretch_hashes(h: np.ndarray) -> Callable[[int, int], int]:
    """A function of (a, b): 64 bits of the words h[a:b] in their order, equal for equal stretches wherever they stand."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h)), out=total[1:])
    inverse = _inverse_powers(len(h) + 1)
    return lambda a, b: (int(total[b]) - int(total[a])) * int(inverse[a]) & MASK


def words_of(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """data: bytes of texts end to end; text i is bounds[i]:bounds[i + 1]."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~space[data]
    starts = inside[1:-1] & ~inside[:-2]
    cut = bounds[1:-1][bounds[1:-1] < n]
    starts[cut] = inside[1:-1][cut]
    ends = inside[1:-1] & ~inside[2:]
    before = cut[cut > 0] - 1
    ends[before] = inside[1:-1][before]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, start, end, doc, first, bounds[:-1])


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    kind, width = (np.int64, 8) if pa.types.is_large_string(texts.type) else (np.int32, 4)
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * width)
    return offsets.astype(np.int64), np.frombuffer(texts.buffers()[2] or b"", np.uint8)


def chunks(texts: pa.Array, lower: str | None = "ascii", most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, bounds) of runs of about `most` bytes; a null text is empty.

    lower: `ascii` lower-cases A-Z, `unicode` every letter, one code point for one.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets, raw = _parts(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        if lower == "unicode":
            bounds, data = _parts(pc.utf8_lower(texts.slice(i, j - i)))
        else:
            bounds, data = offsets[i : j + 1], raw
        data = data[bounds[0] : bounds[-1]]
        yield i, j, _LOWER[data] if lower == "ascii" else data, bounds - bounds[0]
        i = j
