"""Token counts of sections and fields from one encoding of the whole document.

A document is encoded once. Its tokens are consecutive byte spans; a section is
a span too, and the tokens of a section come from an interval join of the two
sorted lists, by binary search. A token that crosses a border is allocated by
an explicit rule:

start   to every section that holds its first byte
end     to every section that holds its last byte
split   to each section in the share of its bytes that lie inside
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pretokens import cached

RULES = ("start", "end", "split")
_lengths: dict[str, np.ndarray] = {}


def token_bytes(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for."""
    if path not in _lengths:
        library = cached(path).library
        added = {i: len(t.content.encode()) for i, t in library.get_added_tokens_decoder().items()}
        vocab = library.get_vocab(with_added_tokens=True)
        table = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            table[i] = added.get(i, len(t))
        _lengths[path] = table
    return _lengths[path]


def join_spans(ends: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section [a, b), and how many cross one of its borders. Token k is ends[k - 1]:ends[k]."""
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    some = (b > a) & (last > first)
    at = np.minimum(first, max(0, len(ends) - 1))
    end_at = np.clip(last - 1, 0, max(0, len(ends) - 1))
    if not len(ends):
        return np.zeros(len(a)), np.zeros(len(a), np.int64)
    over_a, over_b = some & (starts[at] < a), some & (ends[end_at] > b)
    crossing = np.where(some, over_a.astype(np.int64) + (over_b & ~(over_a & (at == end_at))), 0)
    if rule == "start":
        n = np.searchsorted(starts, b, "left") - np.searchsorted(starts, a, "left")
    elif rule == "end":
        n = np.searchsorted(ends, b, "right") - np.searchsorted(ends, a, "right")
    else:
        size = np.maximum(1, ends - starts)
        whole = np.concatenate((np.zeros(1), np.arange(1, len(ends) + 1, dtype=float)))

        def upto(x: np.ndarray) -> np.ndarray:
            k = np.minimum(np.searchsorted(ends, x, "right"), len(ends) - 1)
            return np.where(x >= ends[-1], float(len(ends)), whole[k] + np.maximum(0, x - starts[k]) / size[k])

        n = upto(b) - upto(a)
    return np.where(b > a, n, 0).astype(float), crossing


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(data == 10) + 1
    if len(cuts) and cuts[-1] == len(data):
        cuts = cuts[:-1]
    a = np.concatenate((np.zeros(1, np.int64), cuts))
    return a, np.concatenate((cuts, np.array([len(data)], np.int64)))


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "start", sections: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: one row for each section.

    sections: (doc_id, section, start, end) in code points, end exclusive; they
    may overlap, and rows for ids that docs lacks give nothing. Without it the
    sections are the lines, each with its line end, from 0; then the counts of
    a document under `start` and `end` add up to all its tokens. n_tokens is a
    double, as `split` gives shares. A null text is empty; an empty text has
    one empty line. Repeated rows of docs give repeated rows, rows with a null
    id have a null doc_id. An empty table gives no rows; other columns of docs,
    whatever their names, take no part.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if sections is not None:
        lists = sections.select(F.col("doc_id").cast("long").alias("_of"), F.struct(*[F.col(c).cast("long").alias(c) for c in ("section", "start", "end")]).alias("s")).groupBy("_of").agg(F.sort_array(F.collect_list("s")).alias("sections"))
        narrow = narrow.join(lists, F.col("doc_id") == F.col("_of")).select("doc_id", "text", "sections")

    given = sections is not None  # the tasks don't get the table itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, size = cached(tokenizer), token_bytes(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for i, j, all_ids, counts in coder.encode(batch.column(1)):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column(1).to_pylist()]
                keys = part.column(0).to_pylist()
                cuts = np.cumsum(counts) - counts
                for k, (key, text) in enumerate(zip(keys, texts, strict=True)):
                    data = np.frombuffer(text.encode(), np.uint8)
                    ends = np.cumsum(size[all_ids[cuts[k] : cuts[k] + counts[k]]])
                    heads = None if len(data) == len(text) else np.flatnonzero((data & 0xC0) != 0x80)
                    if not given:
                        a, b = _lines(data)
                        names = np.arange(len(a))
                        ca, cb = (a, b) if heads is None else (np.searchsorted(heads, a), np.searchsorted(heads, b))
                    else:
                        rows = part.column(2)[k].as_py() or []
                        names, ca, cb = (np.array([r[c] for r in rows], np.int64) for c in ("section", "start", "end"))
                        ca, cb = np.clip(ca, 0, len(text)), np.clip(cb, 0, len(text))
                        at = heads if heads is not None else np.arange(len(data))
                        at = np.append(at, len(data))
                        a, b = at[ca], at[cb]
                    n, crossing = join_spans(ends, a, b, rule)
                    for column, x in zip(out, (np.full(len(a), -1 if key is None else key), names, ca, cb, n, crossing), strict=True):
                        column.append(x)
                    if key is None:
                        out[0][-1] = np.ma.masked_all(len(a), np.int64)
                    held += len(a)
            if held:
                cols = [np.ma.concatenate(out[0]) if any(np.ma.isMaskedArray(x) for x in out[0]) else np.concatenate(out[0]), *(np.concatenate(x) for x in out[1:])]
                keys_out = pa.array(np.ma.getdata(cols[0]).astype(np.int64), mask=np.ma.getmaskarray(cols[0]))
                yield pa.RecordBatch.from_arrays([keys_out, *(pa.array(x.astype(np.int64)) for x in cols[1:4]), pa.array(cols[4]), pa.array(cols[5].astype(np.int64))], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return narrow.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens double, n_crossing long")
