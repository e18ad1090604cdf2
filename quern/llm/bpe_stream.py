"""BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge list is proper when every merge comes after those that make its parts.
Then merging is the same as applying the rules once each, in order, and what
follows a place in the text can change tokens before it only so far: a rule
(u, v) that applies in one continuation and not in another moves the border of
what is certain left by |u|, and only if v can begin at the border. `lookahead`
sums that over the rules in order. Tokens that end that far before the end of
what has been read are certain and are emitted; the rest is held, so memory
does not grow with the piece.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import batched

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pretokens import KNOWN
from quern.llm.shared import bounded_batches

#: Symbols read beyond the lookahead before tokens are emitted.
STRIDE = 4096
#: Characters of a text that are worked on at once, up to the next space.
STRETCH = 1 << 15
#: Pieces longer than this are merged by a heap.
SHORT = 48
#: Distinct pieces that a worker remembers, of at most MEMO_LENGTH characters each.
REMEMBERED, MEMO_LENGTH = 200_000, 64


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a file, symbols as ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.vocab, self.suffix = vocab, suffix or ""
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        for rank, (u, v) in enumerate(pairs):
            self.rules.setdefault((vocab[u], vocab[v]), (rank, vocab[u + v]))
        self.lookahead = self._lookahead(pairs)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int | None:
        """Symbols that must follow a token for it to be certain; None if the list isn't proper."""
        size = {t: max(1, len(t.removesuffix(self.suffix)) if self.suffix else len(t)) for t in self.vocab}
        used: set[str] = set()
        border: dict[str, int] = {}
        for u, v in pairs:
            w = u + v
            if w in used:
                return None
            used |= {u, v}
            moved = border.get(v, 1) + size[u]
            border[w] = max(border.get(w, 1), border.get(u, 1), moved)
            border[u] = max(border.get(u, 1), moved)
        return max(border.values(), default=1)

    def merge(self, ids: list[int]) -> list[int]:
        return self._few(ids) if len(ids) <= SHORT else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        get, none = self.rules.get, (1 << 60, 0)
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none or best[0] == none[0]:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rules.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := get((new, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[after[i]]))
            if (p := before[i]) >= 0 and (r := get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, r[1], ids[p], new))
        return [x for x in ids if x >= 0]


class PieceEncoder:
    """The transducer: feed() symbols of one piece, in any portions, then close()."""

    def __init__(self, merges: Merges, names: list[str], length: list[int]):
        self.merges, self.names, self.length, self.held = merges, names, length, ""

    def feed(self, symbols: str) -> list[int]:
        self.held += symbols
        look = self.merges.lookahead
        if look is None or len(self.held) < look + STRIDE:
            return []
        sure, out, at = len(self.held) - look, [], 0
        for t in self.merges.merge([self.merges.vocab[c] for c in self.held]):
            if at + self.length[t] > sure:
                break
            at += self.length[t]
            out.append(t)
        self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        if not self.held:
            return []
        vocab, suffix = self.merges.vocab, self.merges.suffix
        ids = [vocab[c] for c in self.held[:-1]] + [vocab[self.held[-1] + suffix]]
        self.held = ""
        return self.merges.merge(ids)


class TextDecoder:
    """Ids to text a few at a time: bytes that don't end a character are held until it ends; broken ones become U+FFFD."""

    def __init__(self, byte_of: dict[str, int], names: list[str]):
        self.byte_of, self.names = byte_of, names
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(bytes(self.byte_of[c] for i in ids for c in self.names[i]))

    def close(self) -> str:
        return self.state.decode(b"", final=True)


class Bpe:
    """A tokenizer file with BPE over the byte alphabet: word pieces by its own pattern, each through the transducer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (model["vocab"] | added).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.length = [len(t.removesuffix(self.merges.suffix)) if self.merges.suffix else len(t) for t in self.names]
        self.added = added
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        split = next(p for p in pre["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.alphabet = [byte_alphabet()[b] for b in range(256)]
        self.seen: dict[str, tuple[bytes, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        """Normalised pieces, as text. Characters beyond KNOWN are left to the library's own normaliser and pattern."""
        if KNOWN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return self.find(text.replace("Σ", "σ").lower())
        spelled = {c: b for b, c in enumerate(self.alphabet)}
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(spelled[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def piece_ids(self, piece: str) -> Iterator[int]:
        machine = PieceEncoder(self.merges, self.names, self.length)
        for k in range(0, len(piece), STRIDE):
            yield from machine.feed("".join(map(self.alphabet.__getitem__, piece[k : k + STRIDE].encode())))
        yield from machine.close()

    def _coded(self, piece: str) -> tuple[bytes, bytes]:
        ids = list(self.piece_ids(piece))
        pair = np.array(ids, "<u4").tobytes(), " ".join([self.names[i] for i in ids]).encode()
        if len(piece) <= MEMO_LENGTH:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[piece] = pair
        return pair

    def stream(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers, and the spelling of their tokens in UTF-8 with a space between, a stretch at a time.

        A stretch ends at a space, which no piece holds and which nothing after
        it changes; a piece longer than STRIDE is passed through the transducer
        on its own. What is held doesn't grow with the text.
        """
        get, coded, at = self.seen.get, self._coded, 0
        while at < len(text):
            end = text.find(" ", at + STRETCH) if len(text) - at > STRETCH else -1
            # A mark after a space would be its own.
            while end >= 0 and end + 1 < len(text) and unicodedata.combining(text[end + 1]):
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            part_of, at = text[at:end], end
            ids, words = [], []
            for k, part in enumerate(self.cut.split(part_of) if self.cut else [part_of]):
                if k % 2:
                    ids.append(self.added[part].to_bytes(4, "little"))
                    words.append(part.encode())
                    continue
                for p in self.pieces(part) if part else ():
                    if len(p) > STRIDE:
                        if ids:
                            yield b"".join(ids), b" ".join(words)
                        ids, words = [], []
                        for some in batched(self.piece_ids(p), STRIDE):
                            yield np.array(some, "<u4").tobytes(), " ".join([self.names[x] for x in some]).encode()
                        continue
                    a, b = get(p) or coded(p)
                    ids.append(a)
                    words.append(b)
            if ids:
                yield b"".join(ids), b" ".join(words)

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """All ids and the text they decode to: the file has no decoder, so its tokens stand spelled out with a space between."""
        parts = list(self.stream(text))
        return b"".join(a for a, _ in parts), b" ".join(b for _, b in parts)

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of ids, and the SHA-256 of them and of the decoded text, stretch by stretch."""
        count, ids, words = 0, hashlib.sha256(), hashlib.sha256()
        for a, b in self.stream(text):
            if count:
                words.update(b" ")
            count += len(a) // 4
            ids.update(a)
            words.update(b)
        return count, ids.hexdigest(), words.hexdigest()


_by_path: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _by_path:
        _by_path[path] = Bpe(path)
    return _by_path[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """doc_id, n_tokens, and ids_sha256 and decoded_sha256, or without digests the `ids` (bytes) and the `decoded` text.

    One row for each row of docs, repeated ids included; a null text is empty:
    no ids, and the empty text. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        for batch in batches:
            counts, a, b = [], [], []
            for t in batch.column(1):
                if digests:
                    n, ids, text = coder.digests(t.as_py() or "")
                else:
                    ids, text = coder.encode_decode(t.as_py() or "")
                    n, text = len(ids) // 4, text.decode()
                counts.append(n)
                a.append(ids)
                b.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string() if digests else pa.binary()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {kind}")
