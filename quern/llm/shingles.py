"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quern.llm.words import chunks, mix, words_of


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, hashes, bounds): the distinct n-word shingles of text i are hashes[bounds[i]:bounds[i + 1]], ascending.

    Words are runs of anything but blank, tab, line feed, vertical tab, form
    feed and carriage return; A-Z are lower-cased. A text of fewer than n words
    is one shingle of all of them; one without words has none.
    """
    for i, j, data, bounds in chunks(texts):
        w = words_of(data, bounds)
        h, size = w.hashes(), np.diff(w.first)
        count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
        total = int(count.sum())
        at = np.repeat(w.first[:-1] - (np.cumsum(count) - count), count) + np.arange(total)
        doc = np.repeat(np.arange(j - i), count)
        end = w.first[doc + 1]
        s = np.full(total, n, np.uint64)
        short = bool((size < n).any())
        for k in range(n):
            x = at + k
            if not short:
                s = (s ^ h[x]) * np.uint64(0x9E3779B97F4A7C15)
            elif len(h):
                s = np.where(x < end, (s ^ h[np.minimum(x, len(h) - 1)]) * np.uint64(0x9E3779B97F4A7C15), s)
            s ^= s >> np.uint64(29)
        s = mix(s)
        # Sorts of single texts are many times faster than one of all by text and hash.
        edges = [0, *np.cumsum(count).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            s[a:b].sort()
        new = np.ones(total, bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[new], doc[new]
        yield i, j, s, np.searchsorted(doc, np.arange(j - i + 1))
