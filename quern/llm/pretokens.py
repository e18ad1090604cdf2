"""Ids of texts under a public BPE vocabulary file, by way of each distinct pre-token.

The library's pre-tokenizer cuts a text by a fixed pattern and its model looks
at one piece at a time, so the ids of a text are those of its pieces end to
end. Pieces repeat, so each is encoded by the library once for a worker.
Texts with characters for which the pattern here has not been held against the
library's are encoded whole by the library.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

from collections.abc import Iterator

import numpy as np
import regex

from quern.llm.words import Words, chunks

#: Fixed value: the pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters for which both agree on letters, digits and spaces (test_pretokens holds them against each other).
KNOWN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞€一-龥]*")
#: Bytes of text whose pieces are looked up at once.
RUN = 2 << 20
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 800_000


#: Classes of a byte: white space, letter, digit, anything else, or not settled here.
SPACE, LETTER, DIGIT, OTHER, UNSETTLED = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of ASCII bytes and of the code points that take two bytes."""

    def kind(c: str) -> int:
        if not KNOWN.fullmatch(c):
            return UNSETTLED
        return next((k for k, rx in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}")) if regex.fullmatch(rx, c)), OTHER)

    one = np.full(256, UNSETTLED, np.uint8)
    one[:128] = [kind(chr(c)) for c in range(128)]
    return one, np.array([kind(chr(c)) if c > 127 else UNSETTLED for c in range(2048)], np.uint8)


def pieces_of(data: np.ndarray, bounds: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces that BYTE_LEVEL cuts, which tile the texts, and which texts it is not settled for."""
    n = len(data)
    kind = one[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    lead = lead[lead + 1 < n]
    kind[lead] = two[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    kind[lead + 1] = kind[lead]
    odd = np.flatnonzero((kind == UNSETTLED) | (data == 0x27))  # an apostrophe may begin a contraction
    unsettled = np.zeros(len(bounds) - 1, bool)
    unsettled[np.searchsorted(bounds, odd, "right") - 1] = True
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begin = run.copy()
    space = kind == SPACE
    # The last white space before anything else stands alone, or if it is a blank begins the next piece.
    tail = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n else np.zeros(0, np.int64)
    begin[tail] = True
    blank = tail[data[tail] == 0x20]
    begin[blank + 1] = False
    return np.flatnonzero(begin), unsettled


class Cached:
    """Ids of texts; what a piece encodes to is kept by the piece's 64-bit hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)).encode() or rb"(?!)")
        self.one, self.two = _classes()
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _room(self, kept: int, ids: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while kept > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        """Letters are encoded many pieces at a time, laid so that the pattern cuts them apart again; word_ids tell whose ids are whose."""
        groups: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, p in enumerate(pieces):
            groups[0 if p[0] == " " and p[1:].isalpha() else 1 if p.isalpha() else 2].append(k)
        for own, glue, step in zip(groups, ("", "\n", 0), (1, 2, 0), strict=True):
            for at in range(0, len(own), 2000):
                part = own[at : at + 2000]
                if step:
                    e = self.library.encode(glue.join(pieces[k] for k in part), add_special_tokens=False)
                    ids, owner = np.asarray(e.ids, np.uint32), np.asarray(e.word_ids)
                    first = np.searchsorted(owner, np.arange(len(part)) * step)
                    count = np.searchsorted(owner, np.arange(len(part)) * step, "right") - first
                else:
                    found = [e.ids for e in self.library.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False)]
                    count = np.array([len(x) for x in found])
                    ids, first = np.array([i for x in found for i in x], np.uint32), np.cumsum(count) - count
                kept = len(self.place)
                self._room(kept + len(part), len(ids))
                self.ids[self.used : self.used + len(ids)] = ids
                self.first[kept : kept + len(part)], self.count[kept : kept + len(part)] = first + self.used, count
                self.used += len(ids)
                self.place.update(zip((hashes[k] for k in part), range(kept, kept + len(part)), strict=True))

    def _run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts end to end, and how many each text has."""
        starts, unsettled = pieces_of(data, bounds, self.one, self.two)
        if self.added.search(raw := data.tobytes()):
            for m in self.added.finditer(raw):
                unsettled[np.searchsorted(bounds, m.start(), "right") - 1] = True
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(bounds, starts, "right") - 1
        if unsettled.any():
            mine = ~unsettled[doc]
            starts, ends, doc = starts[mine], ends[mine], doc[mine]
        hashes, where, back = np.unique(Words(data, starts, ends, doc, bounds, bounds).hashes(), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(self.place) + len(keys) > REMEMBERED:
            self._forget()
        new = [k for k, h in enumerate(keys) if h not in self.place]
        if new:
            at = where[new]
            self._learn([keys[k] for k in new], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        place = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[back]
        first, count = self.first[place], self.count[place]
        begin = np.cumsum(count) - count
        ids = self.ids[np.repeat(first - begin, count) + np.arange(int(count.sum()))] if len(count) else np.zeros(0, np.uint32)
        per_doc = np.bincount(doc, count, len(bounds) - 1).astype(np.int64)
        if not unsettled.any():
            return ids, per_doc
        cuts, parts = np.cumsum(per_doc) - per_doc, []
        for d in range(len(bounds) - 1):
            if unsettled[d]:
                got = self.library.encode_batch_fast([raw[bounds[d] : bounds[d + 1]].decode()], add_special_tokens=False)[0]
                parts.append(np.asarray(got.ids, np.uint32))
            else:
                parts.append(ids[cuts[d] : cuts[d] + per_doc[d]])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, last text + 1, ids end to end, ids of each text) of an Arrow array of strings; a null text is empty."""
        for i, j, data, bounds in chunks(texts, None, RUN):
            yield i, j, *self._run(data, bounds)


_by_path: dict[str, Cached] = {}


def cached(path: str) -> Cached:
    if path not in _by_path:
        _by_path[path] = Cached(path)
    return _by_path[path]
