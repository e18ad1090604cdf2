"""Benchmark passages in documents, up to edits, by CGK embedding and bit sampling.

Texts are words (runs of letters and digits, lower-cased). The CGK random
walk reads a window word by word: at each step it writes the word it stands on
and moves on or stays by a random bit of that word, so windows at a small edit
distance become strings at a small Hamming distance. A repetition has its own
walk and samples some of its places; equal samples make a candidate. Items are
indexed from each of their words, documents read from each stride-th word, so
an occurrence is met many times, whatever its offset. Short items have shorter
walks, read from every word; WALKS states both, and the test of recall holds
them to TARGET_RECALL. Of items of fewer than MIN_WORDS words either half is
looked up: one edit leaves one of them as it was. Items of fewer than
EDITED_WORDS are looked up whole.
A candidate fixes an item-sized window of the document, where the least edit
distance of the item to any part decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import bounded_batches
from quern.llm.words import chunks, stretch_hashes, words_of

TARGET_RECALL = 0.95
#: Items of fewer words aren't walked but looked up by their halves.
MIN_WORDS = 8
#: Items of fewer words are found unedited only; from here up to MIN_WORDS with one edit at most.
EDITED_WORDS = 5
#: By the least words of an item, the longest first: steps of a walk, places sampled, every how many words of a document one begins, repetitions.
WALKS = ((20, 12, 8, 3, 6), (MIN_WORDS, 7, 5, 1, 4))
#: The share of an item's words that may be edited.
MAX_EDITS = 0.2
#: Items that are searched for in one pass over the documents; more take more passes.
BLOCK_ITEMS = 20_000
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Walk:
    steps: np.ndarray  # odd multipliers whose top bit moves the walk
    places: np.ndarray  # sampled places
    stride: int
    keys: np.ndarray  # sorted
    owners: np.ndarray  # item of a key
    offsets: np.ndarray  # its word there
    bitmap: np.ndarray


@dataclass
class Index:
    words: list[np.ndarray]  # word hashes of each item
    ids: list[int]
    walks: list[Walk]


def _walk(symbols: np.ndarray, at: np.ndarray, steps: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled key of the window from each of `at`, and the last word it read."""
    at = at.copy()
    key = np.zeros(len(at), np.uint64)
    last = len(symbols) - 1
    for j, m in enumerate(steps):
        x = symbols[np.minimum(at, last)]
        if places[j]:
            key = (key ^ x) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(32)
        if j + 1 < len(steps):
            at += ((x * m) >> np.uint64(63)).astype(np.int64) if m else 1
    return key, at


def build(items: list[tuple[int, str | None]], seed: int = 7) -> Index:
    """items: (id, text). Repeated items are kept; null ones and those without words match nothing."""
    items = [(i, t) for i, t in items if i is not None]
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
    for i, _, data, bounds in chunks(pa.array([t for _, t in items], pa.string()), "unicode"):
        w = words_of(data, bounds, _BREAK)
        h = w.hashes()
        for d in range(len(bounds) - 1):
            hashes[i + d] = h[w.first[d] : w.first[d + 1]]
    rng = np.random.default_rng(seed)
    out = Index(hashes, [i for i, _ in items], [])

    def add(own: list[int], steps: np.ndarray, places: np.ndarray, stride: int, starts: tuple[int, ...] = ()) -> None:
        """A walk from each word of the items, or from `starts` alone."""
        flat = np.concatenate([hashes[k] for k in own])
        size = np.array([len(hashes[k]) for k in own], np.int64)
        owner, end = np.repeat(np.array(own, np.int64), size), np.repeat(np.cumsum(size), size)
        offset = np.arange(len(flat)) - (end - np.repeat(size, size))
        key, last = _walk(flat, np.arange(len(flat)), steps, places)
        inside = np.flatnonzero((last < end) & (np.isin(offset, starts) | (not starts)))
        order = inside[np.argsort(key[inside], kind="stable")]
        bitmap = np.zeros(1 << 20, bool)
        bitmap[key[order] >> np.uint64(44)] = True
        out.walks.append(Walk(steps, places, stride, key[order], owner[order], offset[order], bitmap))

    most = None
    for least, count, samples, stride, repeats in WALKS:
        own = [k for k, h in enumerate(hashes) if least <= len(h) and (most is None or len(h) < most)]
        most = least
        for _ in range(repeats if own else 0):
            steps = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            places = np.zeros(count, bool)
            places[rng.choice(count, samples, replace=False)] = True
            add(own, steps, places, stride)
    for n in range(1, MIN_WORDS):
        own = [k for k, h in enumerate(hashes) if len(h) == n]
        part = n if n < EDITED_WORDS else n // 2
        if own:  # a walk that never stays
            add(own, np.zeros(part, np.uint64), np.ones(part, bool), 1, tuple({0, n - part}))
    return out


def edits_within(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, first word, last word + 1) of the part of window nearest to item, if within `most`; the first of equals."""
    n = len(window)
    cost = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    place = np.arange(n + 1)
    for k, x in enumerate(item.tolist()):
        up, diag = cost + 1, cost[:-1] + (window != np.uint64(x))
        now, begin = up.copy(), start.copy()
        better = diag < now[1:]
        now[1:] = np.where(better, diag, now[1:])
        begin[1:] = np.where(better, start[:-1], begin[1:])
        # A word of the window left out costs 1: the least of now[i] + (j - i) over i <= j.
        shifted = now - place
        least = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == least, place, 0))
        cost, start = least + place, begin[source]
        if k >= most and cost.min() > most:
            return None
    j = int(np.argmin(cost))
    return (int(cost[j]), int(start[j]), j) if cost[j] <= most else None


def _matches(index: Index, w, max_edits: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (edits, first word, last word + 1), in words of the run."""
    h = w.hashes()
    size = np.diff(w.first)
    wanted: set[tuple[int, int, int]] = set()
    for walk in index.walks:
        if not len(h) or not len(walk.keys):
            continue
        counts = -(-size // walk.stride)
        at = np.repeat(w.first[:-1] - walk.stride * (np.cumsum(counts) - counts), counts) + walk.stride * np.arange(int(counts.sum()))
        key, last = _walk(h, at, walk.steps, walk.places)
        maybe = np.flatnonzero(walk.bitmap[key >> np.uint64(44)])
        maybe = maybe[last[maybe] < w.first[w.doc[at[maybe]] + 1]]
        left = np.searchsorted(walk.keys, key[maybe], "left")
        right = np.searchsorted(walk.keys, key[maybe], "right")
        n = right - left
        k = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = np.repeat(at[maybe], n)
        doc, item = w.doc[place], walk.owners[k]
        wanted.update(zip(doc.tolist(), item.tolist(), (place - walk.offsets[k]).tolist(), strict=True))
    # Stretches of the same words in the same order, as in lines that repeat, are refused once.
    same_as = stretch_hashes(h)
    refused: set[tuple[int, int, int]] = set()
    sets = {i: frozenset(index.words[i].tolist()) for _, i, _ in wanted}
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for d, i, start in sorted(wanted):
        item = index.words[i]
        most = int(max_edits * len(item))
        if len(item) < MIN_WORDS:
            most = min(most, 1) if len(item) >= EDITED_WORDS else 0
        # Starts that an earlier window already had with room for all its edits.
        if (old := found.get((d, i))) and (old[0] == 0 or start <= done[d, i]):
            continue
        a, b = max(int(w.first[d]), start - most), min(int(w.first[d + 1]), start + len(item) + most)
        same = (i, b - a, same_as(a, b))
        if same in refused:
            continue
        bag = sets[i].intersection(h[a:b].tolist())
        got = edits_within(item, h[a:b], most) if len(sets[i]) - len(bag) <= most else None
        if not got:
            refused.add(same)
        else:
            if old is None or got[0] < old[0]:
                found[d, i] = (got[0], a + got[1], a + got[2])
            done[d, i] = start + most
    return found


def search(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, similarity, start, end: the best window for each document and item that it holds.

    start and end are code points of the document's text. Documents without a
    match, null and empty texts give no rows; repeated rows give repeated rows;
    items of five to seven words may have one edit, shorter ones none;
    null item ids and texts are ignored. The benchmark is read by the driver,
    in blocks of BLOCK_ITEMS items that tasks get with their code. No shuffle.
    """
    narrow = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for i, _, data, bounds in chunks(batch.column(1), "unicode"):
                    w = words_of(data, bounds, _BREAK)
                    for (d, k), (edits, a, b) in _matches(index, w, max_edits).items():
                        text = data[bounds[d] : bounds[d + 1]]
                        heads = (text & 0xC0) != 0x80
                        start, end = int(w.start[a] - bounds[d]), int(w.end[b - 1] - bounds[d])
                        rows.append({"doc_id": batch.column(0)[i + d].as_py(), "item_id": index.ids[k], "edits": edits, "similarity": 1 - edits / len(index.words[k]), "start": int(heads[:start].sum()), "end": int(heads[:end].sum())})
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

        part = narrow.mapInArrow(run, "doc_id long, item_id long, edits int, similarity double, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    items = benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    block: list[tuple[int, str | None]] = []
    some = False
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) >= BLOCK_ITEMS:
            yield build(block)
            block, some = [], True
    if block or not some:
        yield build(block)


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item. No shuffle."""
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, bounds in chunks(batch.column(batch.schema.get_field_index(text_col)), "unicode"):
                    for d, _ in _matches(index, words_of(data, bounds, _BREAK), max_edits):
                        clean[i + d] = False
                yield batch.filter(pa.array(clean))

        docs = bounded_batches(docs).mapInArrow(run, docs.schema)
    return docs
