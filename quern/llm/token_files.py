"""Token ids in files of Simple-8b words.

A file is a byte string: a header, the documents' ids and lengths, the word
offset of every block, then 64-bit words. A block holds BLOCK ids (the last of
a file fewer) and starts on a word of its own, so blocks decode apart from each
other and all at once. Each word has a 4-bit selector over 60 bits that says
how many ids it packs and in how many bits each. Selector 0 escapes: the next
word is one id as it is, for ids of 60 bits and more. Selector 1 is a run of
zeros. A word may reach past the end of its block; what lies beyond is padding.

Files travel as rows of a Parquet table, one file a row, so that any store that
Spark reaches can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.order import positions
from quern.llm.pretokens import cached
from quern.llm.shared import fresh_path

#: Fixed values of the coding: ids in a word and bits of each, by selector; 0 is the escape, 1 a run of zeros.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 512
#: A file is closed after the run of texts in which it reaches so many ids.
FILE_IDS = 1 << 20
MAGIC = b"QS8B"
_ROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end) of unsigned 64-bit values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    reach = int(COUNT.max())
    v = np.zeros((blocks, BLOCK + reach), np.uint64)
    held = np.full(blocks, BLOCK)
    if n % BLOCK:
        held[-1] = n % BLOCK
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    v[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = np.frexp(v.astype(np.float64))[1].astype(np.int16)  # rounding up at 2^53 and more costs a bit at most
    rows, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):
        # More ids a word from one selector to the next, in fewer bits: the last that fits is the best.
        most = bits[rows, at]
        s = np.where(most > BITS[15], 0, 15)
        k = np.flatnonzero(s)
        most, seen = most[k], 1
        for t in range(14, 0, -1):
            r, p = rows[k], at[k]
            for j in range(seen, int(COUNT[t])):
                most = np.maximum(most, bits[r, p + j])
            seen = int(COUNT[t])
            fits = most <= BITS[t]
            k, most = k[fits], most[fits]
            if not len(k):
                break
            s[k] = t
        steps.append((rows, at, s))
        at = at + COUNT[s]
        go = at < held[rows]
        rows, at = rows[go], at[go]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    row, pos, sel = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(row, kind="stable")
    row, pos, sel = row[order], pos[order], sel[order]
    size = np.where(sel == 0, 2, 1)
    out_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(16):
        if not len(k := np.flatnonzero(sel == s)):
            continue
        if s == 0:
            words[out_at[k] + 1] = v[row[k], pos[k]]
            continue
        word = np.full(len(k), s << 60, np.uint64)
        if BITS[s]:
            for j in range(COUNT[s]):
                word |= v[row[k], pos[k] + j] << np.uint64(j * BITS[s])
        words[out_at[k]] = word
    offsets = np.zeros(blocks + 1, np.int64)
    np.cumsum(np.bincount(row, size, blocks), out=offsets[1:])
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values that pack() was given; all blocks at once."""
    blocks = len(offsets) - 1
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    for b in np.unique(block[sel == 0]):  # only ids of 60 bits and more
        k = int(offsets[b])
        while k < offsets[b + 1]:
            if sel[k] == 0:
                raw[k + 1] = True
                k += 1
            k += 1
    count = np.where(raw, 0, COUNT[sel])
    total = np.cumsum(count) - count
    start = total - total[np.minimum(offsets[:-1], max(0, len(words) - 1))][block] if len(words) else total
    out = np.zeros((blocks, BLOCK + int(COUNT.max())), np.uint64)
    for s in range(16):
        k = np.flatnonzero((sel == s) & ~raw)
        if not len(k) or s == 1:
            continue
        if s == 0:
            out[block[k], start[k]] = words[k + 1]
            continue
        low = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNT[s]):
            out[block[k], start[k] + j] = (words[k] >> np.uint64(j * BITS[s])) & low
    return out[:, :BLOCK].reshape(-1)[:n]


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    null = np.array([x is None for x in doc_ids], np.uint8)
    known = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join((MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(offsets) - 1), known.tobytes(), null.tobytes(), np.asarray(lengths, "<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks = struct.unpack_from("<QQQ", data, 4)
    at = 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    known, null, lengths, offsets = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", blocks + 1)
    words = take("<u8", int(offsets[-1]))
    return [None if z else x for x, z in zip(known.tolist(), null.tolist(), strict=True)], lengths, unpack(words, offsets.astype(np.int64), n)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id, and writes files to `path` in ascending order of the id.

    Null and empty texts are the end id alone. Rows with the same id follow
    each other by text; null ids come first. An empty table gives no files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = cached(tokenizer), TaskContext.get().partitionId(), 0
        keys, lengths, parts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal keys, lengths, parts, held, seq
            ids = np.concatenate(parts)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(keys), "n_ids": len(ids), "data": to_file(keys, lengths, ids)}], _ROW)
            keys, lengths, parts, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, ids, counts in coder.encode(batch.column(1)):
                keys += names[i:j]
                lengths += (counts + 1).tolist()
                parts.append(np.insert(ids, np.cumsum(counts), end_id))
                held += len(parts[-1])
                if held >= FILE_IDS:
                    yield closed()
        if keys:
            yield closed()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = narrow.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(encode, "part int, seq int, n_docs long, n_ids long, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, reduce=None, extra: str = "ids binary") -> DataFrame:
    """doc_id, part, seq, start (inside the file), n_tokens, and the ids as little-endian unsigned 32-bit integers.

    reduce: a function of those bytes whose value (of the type in `extra`) is returned in their place.
    """
    kinds = [("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64())]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, lengths, ids = from_file(batch.column("data")[k].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                body = memoryview(ids.astype("<u4").tobytes())
                found = [bytes(body[4 * a : 4 * b]) if reduce is None else reduce(body[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                m = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([batch.column("part")[k].as_py()] * m, pa.int32()), pa.array([batch.column("seq")[k].as_py()] * m, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(found)], names=[*[c for c, _ in kinds], extra.split()[0]])

    files = spark.read.parquet(path).select("part", "seq", "data")
    return files.mapInArrow(decode, f"doc_id long, part int, seq int, start long, n_tokens long, {extra}")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all read back from the files that it writes.

    start counts the ids of all documents before it in ascending order of the id.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    rows = read_token_files(spark, path, zlib.crc32, "ids_crc32 long")
    files = positions(spark.read.parquet(path).select("part", "seq", "n_ids"), ["part", "seq"], ("n_ids",))
    starts = files.select(F.col("part").alias("_p"), F.col("seq").alias("_s"), "_before_n_ids")
    joined = rows.join(starts, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))
    return joined.select("doc_id", (F.col("start") + F.col("_before_n_ids")).alias("start"), "n_tokens", "ids_crc32")
