"""Exact deduplication by polynomial fingerprints that compose, and a comparison chunk by chunk.

The bytes b[0], b[1], ... of a text are digits of a polynomial modulo the prime
2^61 - 1: H = sum of b[i] * r^i, for two fixed r. A text is cut into chunks of
CHUNK bytes that are hashed on their own, in as many tasks as there are; a
chunk's hash is shifted by r^(bytes before it), so that the hash of the whole
is the plain sum of its chunks' hashes, in whatever order they arrive.

Texts of equal length and equal hashes form a group. Every text of a group is
then held, chunk by chunk, against the one that would stay; only texts of
groups of two and more travel, and no task sees more than a chunk of either. A
group is spread over ceil(size / SPREAD) shares, each with its own copy of the
representative. Texts that differ in spite of equal fingerprints form a group
of their own in the next round, until a round finds no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import bounded_batches, discard, written

PRIME = (1 << 61) - 1
#: Any two numbers below the prime would do; a collision costs a round, not a wrong result.
BASES = (1_000_003_000_000_000_019, 777_777_777_777_777_743)
CHUNK = 1 << 16
#: Chunks of texts longer than this are dealt out to other tasks before they are hashed.
HUGE = 1 << 20
#: Texts of a group that are compared with one copy of the representative.
SPREAD = 64
#: Repeated fingerprints up to which they go to all executors (about 150 bytes each); beyond, texts are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that are hashed in one step.
_RUN = 1 << 20
_KEY = ["n_bytes", "h1", "h2", "level"]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 ... base^(n-1) modulo PRIME, as their lower 32 bits and the rest."""
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base % PRIME
    return out & np.uint64(0xFFFFFFFF), out >> np.uint64(32)


_tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def chunk_hashes(pieces: pa.Array, before: list[int]) -> list[list[int]]:
    """For each base, the hash of every piece (binary, of any length) shifted by the bytes before it."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    most = max(1, int(np.diff(offsets).max(initial=0)))
    room = 1 << (most - 1).bit_length()
    if room not in _tables:
        _tables[room] = [_powers(r, room) for r in BASES]
    out: list[list[int]] = [[] for _ in BASES]
    a = 0
    while a < len(pieces):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _RUN, "right")) - 1)
        starts, size = offsets[a:b], np.diff(offsets[a : b + 1])
        digits = data[offsets[a] : offsets[b]].astype(np.uint64)
        place = np.arange(offsets[a], offsets[b]) - np.repeat(starts, size)
        filled = np.flatnonzero(size)
        for k, (low, high) in enumerate(_tables[room]):
            sums = np.zeros((2, b - a), np.uint64)
            if len(filled):  # a digit times 32 bits, summed over a chunk, stays below 2^64
                for row, half in enumerate((low, high)):
                    sums[row, filled] = np.add.reduceat(digits * half[place], starts[filled] - offsets[a])
            for lo, hi, shift in zip(sums[0].tolist(), sums[1].tolist(), before[a:b], strict=True):
                h = (hi << 32) + lo
                out[k].append((h * pow(BASES[k], shift, PRIME) if shift else h) % PRIME)
        a = b
    return out


def combine(left: int, right: int, left_bytes: int, base: int) -> int:
    """The hash of two stretches set end to end, of the hashes of both."""
    return (left + right * pow(base, left_bytes, PRIME)) % PRIME


def _chunked(data: Column, n: Column, chunk: int) -> Column:
    count = F.greatest(F.ceil(n / chunk), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * chunk + 1, F.lit(chunk)))


def _chunk_prints(docs: DataFrame, chunk: int, huge: int, bits: int) -> DataFrame:
    """One row a chunk: doc_id, _row, n_bytes, x, sha, n_chunks, h1, h2, the hashes shifted to the chunk's place."""
    rows = docs.select("doc_id", "data", F.monotonically_increasing_id().alias("_row"), F.length("data").cast("long").alias("n_bytes"), F.xxhash64("data").alias("x"), F.sha2("data", 256).alias("sha"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [c * chunk for c in batch.column("chunk").to_pylist()]
            h = chunk_hashes(batch.column("piece"), before)
            mask = (1 << bits) - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *[pa.array([v & mask for v in part], pa.int64()) for part in h]], names=[*batch.schema.names[:6], "h1", "h2"])

    def cut(part: DataFrame, branch: int) -> DataFrame:
        pieces = part.select("doc_id", (F.col("_row") * 2 + branch).alias("_row"), "n_bytes", "x", "sha", F.posexplode(_chunked(F.col("data"), F.col("n_bytes"), chunk)).alias("chunk", "piece"))
        count = F.greatest(F.ceil(F.col("n_bytes") / chunk), F.lit(1)).cast("int").alias("n_chunks")
        return pieces.select("doc_id", "_row", "n_bytes", "x", "sha", count, "chunk", "piece")

    pieces = cut(rows.filter(F.col("n_bytes") <= huge), 0).unionByName(cut(rows.filter(F.col("n_bytes") > huge), 1).repartition("_row", "chunk"))
    return bounded_batches(pieces).mapInArrow(hashed, "doc_id long, _row long, n_bytes long, x long, sha string, n_chunks int, h1 long, h2 long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, huge: int = HUGE, bits: int = 61) -> DataFrame:
    """doc_id, _row, n_bytes, x, sha, h1, h2 for every row of docs: the fingerprint is (n_bytes, h1, h2).

    Null texts count as empty; an empty text has zero hashes. _row tells rows
    apart, repeated ones too. bits, for tests, weakens the hashes of chunks.
    The chunks' rows are written to the shared folder.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    chunks = written(_chunk_prints(narrow, chunk, huge, bits), "chunk-prints")
    whole = ["doc_id", "_row", "n_bytes", "x", "sha"]
    joined = lambda h: (F.sum(F.col(h).cast("decimal(20,0)")) % F.lit(PRIME).cast("decimal(20,0)")).cast("long").alias(h)
    several = chunks.filter("n_chunks > 1").groupBy(*whole).agg(joined("h1"), joined("h2"))
    return chunks.filter("n_chunks = 1").select(*whole, "h1", "h2").unionByName(several)


def _groups(prints: DataFrame, slots: int) -> DataFrame:
    """For each fingerprint, text hash x and slot: the group's size n and its row of the largest id (keep_id, keep_row, keep_sha).

    Sizes and largest ids are first taken within a slot, so that a hot group's rows meet in no task.
    """
    top = F.max(F.struct("doc_id", "_row", "sha")).alias("top")
    part = prints.groupBy(*_KEY, "x", _slot(slots)).agg(F.count(F.lit(1)).alias("n"), top)
    whole = part.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top")).select(*[F.col(k).alias(f"_{k}") for k in _KEY], "n", F.col("top.doc_id").alias("keep_id"), F.col("top._row").alias("keep_row"), F.col("top.sha").alias("keep_sha"))
    return part.drop("n", "top").join(whole, [F.col(k) == F.col(f"_{k}") for k in _KEY]).drop(*[f"_{k}" for k in _KEY])


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "sha"), F.lit(slots)).cast("int").alias("slot")


def _differing(docs: DataFrame, known: DataFrame, slots: int, chunk: int, most: int) -> DataFrame:
    """(fingerprint, doc_id, sha) of texts that differ from their group's representative in some chunk.

    Texts are picked by their hash x, so a text may also be held against a
    group that isn't its own; the caller keeps rows of the group alone.
    """
    texts = docs.withColumns({"_x": F.xxhash64("data"), "_n": F.length("data").cast("long"), "sha": F.sha2("data", 256)})
    fields = [*_KEY, "x", "n", "keep_id", "keep_sha"]
    asked = known.filter("n > 1").select(*fields).distinct()
    if asked.count() <= most:
        met = texts.join(F.broadcast(asked), (F.col("_x") == F.col("x")) & (F.col("_n") == F.col("n_bytes")))
    else:
        by_slot = known.filter("n > 1").select(*fields, F.col("slot").alias("_s"))
        met = texts.withColumn("_slot", _slot(slots)).join(by_slot, (F.col("_x") == F.col("x")) & (F.col("_n") == F.col("n_bytes")) & (F.col("_slot") == F.col("_s")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))
    shares = F.ceil(F.col("n") / SPREAD).cast("int")
    cut = lambda d, *more: d.select(*_KEY, *more, F.posexplode(_chunked(F.col("data"), F.col("n_bytes"), chunk)).alias("chunk", "piece"))
    own = cut(met.filter(~stays), "doc_id", "sha", F.pmod(F.xxhash64("doc_id", "sha"), shares).cast("int").alias("share"))
    first = cut(met.filter(stays), "n").groupBy(*_KEY, "n", "chunk").agg(F.first("piece").alias("kept_piece"))
    copies = first.select(*[F.col(k).alias(f"_{k}") for k in _KEY], F.col("chunk").alias("_chunk"), "kept_piece", F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share"))
    same = [F.col(k) == F.col(f"_{k}") for k in [*_KEY, "chunk", "share"]]
    return own.join(copies, same, "left").filter(~F.col("piece").eqNullSafe(F.col("kept_piece"))).select(*_KEY, "doc_id", "sha").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, huge: int = HUGE, bits: int = 61, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs: of equal texts the row of the largest id stays.

    Texts are equal when their bytes are; a null text counts as empty, so null
    and empty texts are one group. Null ids sort below all others. Rows that
    repeat an id and its text count each, and one of them stays. Whole texts
    are compared, of any length. An empty table gives no rows. Other columns
    of docs, whatever their names, take no part.
    """
    spark = docs.sparkSession
    slots = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    prints = fingerprints(docs, id_col, text_col, chunk, huge, bits).withColumn("level", F.lit(0))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    row = [*_KEY, "doc_id", "sha"]
    while True:
        known = written(_groups(prints, slots), "groups")
        apart = _differing(narrow, known, slots, chunk, broadcast_rows)
        named = apart.select(*[F.col(c).alias(f"_{c}") for c in row])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "doc_id" else F.col(c) == F.col(f"_{c}") for c in row]
        found = written(prints.select(*row).distinct().join(named, same, "left_semi"), "apart")
        if found.isEmpty():
            discard(found)
            break
        named = found.select(*[F.col(c).alias(f"_{c}") for c in row])
        prints = written(prints.join(named, same, "left").withColumn("level", F.col("level") + F.when(F.col("_sha").isNotNull(), 1).otherwise(0)).select(*prints.columns), "prints")
        discard(known, found)
    keys = [*_KEY, "x", "slot"]
    of_group = known.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "keep_id", "keep_row")
    met = prints.withColumn("slot", _slot(slots)).join(of_group, [F.col(k) == F.col(f"_{k}") for k in keys])
    return met.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), (F.col("_row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
