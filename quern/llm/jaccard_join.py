"""Exact Jaccard join of documents on word shingles, as components.

Copies are one point. In Jaccard space unrelated documents are all at distance 1
from each other and from any pivot, so the space is first cut into pieces in
which distances differ. Shingles have a global order, rare ones first by a
sketch of how many documents hold them; two sets of similarity t share one of
the first n - ceil(t n) + 1 of either, so those shingles, by windows of set
size, are buckets in which all links lie.

In these pieces `regions.region_components` works: pivots, Voronoi regions of
the nearest pivot, windows by the triangle inequality that replicate boundary
documents, recursion, all on measured distances. What a document is measured
against is dealt to tasks by pivot and slice of SLICE documents, so no pivot's
documents meet in one task. Small regions are joined in a task by the same
means: distances from the pivot, windows of the radius, then bit sketches that
can't exclude a link, then the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.regions import LEAF, distinct_buckets, region_components, relabel
from quern.llm.shared import bounded_batches, discard, written
from quern.llm.shingles import shingle_sets
from quern.llm.words import mix

#: Counters of the sketch, a bounded table however large the corpus, and those that travel in one row.
SKETCH_BITS, BLOCK_BITS = 22, 16
#: Rows of ids up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Documents that one task measures against a pivot in one go.
SLICE = 1000
#: Distance from a pivot within which its Voronoi region lies.
BALL = 0.5
#: Bits by which sets are compared before their members are.
PARITY = 1024
#: Most bits of a set's parity, which grows with the set below.
MOST_PARITY = 1 << 16


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Documents by hash slot of their shingles, over all documents; a task counts up to 255 of a slot."""
    blocks, width = 1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks * width, np.uint32)
        for batch in batches:
            for _, _, h, _ in shingle_sets(batch.column(0), n):
                np.add.at(total, _slots(h), np.uint32(1))
        rows = np.minimum(total, 255).astype(np.uint8).reshape(blocks, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, np.zeros(width, np.uint32)) + np.frombuffer(c, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    parts = texts.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary")
    out = np.zeros((blocks, width), np.uint16)
    # One row a block, 8 MB in all, by one job; toLocalIterator() would run one for each partition.
    for block in parts.toArrow().to_batches():
        for k, c in zip(block.column(0).to_pylist(), block.column(1), strict=True):
            out[k] = np.frombuffer(c.as_buffer(), np.uint16)
    return out.reshape(-1)


def _names(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """128 bits that name each set: two sums of its members' mixed hashes."""
    sums = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9F3B):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums


def _parities(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set which hash slots hold an odd number of its members, of at least two slots a member up to MOST_PARITY, a power of two."""
    size = np.diff(bounds)
    bits = np.full(len(size), 64)
    for _ in range(6, MOST_PARITY.bit_length() - 1):
        bits = np.where(bits < 2 * size, 2 * bits, bits)
    at = np.append(0, np.cumsum(bits))
    slot = np.repeat(at[:-1], size) + (h & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(slot, minlength=at[-1]) & 1).astype(bool), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])


def _prefixes(texts: DataFrame, n: int, part: int, whole: int, sketch) -> DataFrame:
    """id, row, n, s1, s2 (the set's name), parity, tokens: the shingles whose buckets the document is in. sketch: a broadcast.

    A token is 16 bits of its slot's count and 48 of the shingle's hash, so tokens are ordered as numbers. Shingles that
    share a token share a bucket, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, bounds in shingle_sets(batch.column(2), n):
                size = np.diff(bounds)
                every = (sketch.value[_slots(h)].astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
                need = np.where(size > 0, size + (-part * size) // whole + 1, 0)
                edges = bounds.tolist()
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    every[a:b].sort()
                place = np.arange(len(h)) - np.repeat(bounds[:-1], size)
                tokens = every[place < np.repeat(need, size)]
                offsets = np.zeros(j - i + 1, np.int32)
                np.cumsum(need, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64)))
                own = [batch.column(k).slice(i, j - i) for k in (0, 1)]
                columns = [*own, pa.array(size.astype(np.int64)), *map(pa.array, _names(h, bounds)), _parities(h, bounds), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n", "s1", "s2", "parity", "tokens"])

    return texts.select("id", "row", "text").mapInArrow(run, "id long, row long, n long, s1 long, s2 long, parity binary, tokens array<long>")


def _buckets(points: DataFrame, part: int, whole: int) -> DataFrame:
    """(bucket, id): any two points that link share one."""
    held = points.select(F.posexplode("tokens").alias("place", "bucket"), F.col("key").alias("id"), "n")
    # A shingle of one document links nothing, nor does one of two whose sizes are too far apart.
    own = Window.partitionBy("bucket")
    held = held.withColumns({"c": F.count(F.lit(1)).over(own), "least": F.min("n").over(own), "most": F.max("n").over(own)})
    shared = held.filter((F.col("c") > 2) | ((F.col("c") == 2) & (part * F.col("most") <= whole * F.col("least"))))
    # Windows of size, the distance from the empty set: a link's sizes are in one stratum or in neighbouring ones.
    # The smaller of a pair shares one of its first n - ceil(2t / (1 + t) n) + 1, so a document goes to the stratum
    # of larger ones with those alone.
    stratum = F.floor(F.log(F.col("n").cast("double")) / math.log(whole / part + 1e-9)).cast("int")
    as_smaller = F.col("place") < F.col("n") - F.ceil(2 * part * F.col("n") / (part + whole) - 1e-6) + 1
    strata = F.array_compact(F.array(stratum, F.when(as_smaller, stratum + 1)))
    kept = shared.select("bucket", "id", F.explode(strata).alias("k"))
    return written(kept.select(F.xxhash64("bucket", "k").alias("bucket"), "id"), "buckets")


def _possible(size: list[int], parity: list[bytes], part: int, whole: int) -> list[int]:
    """Places of the sets of which sizes and parities don't exclude that they link with another."""
    bits = 8 * min(map(len, parity))
    folded = []
    for p in parity:
        x, b = int.from_bytes(p, "little"), 8 * len(p)
        while b > bits:  # the parity of twice as many slots, folded, is that of half
            b //= 2
            x = (x >> b) ^ (x & ((1 << b) - 1))
        folded.append(x)
    # A link's sets differ in at most (1 - t) / (1 + t) of their members together, and in no fewer members than bits.
    if len(size) == 2:
        return [0, 1] if (whole + part) * (folded[0] ^ folded[1]).bit_count() <= (whole - part) * (size[0] + size[1]) else []
    table = np.frombuffer(b"".join(x.to_bytes(bits // 8, "little") for x in folded), np.uint64).reshape(len(size), -1)
    n, hit = np.array(size), np.zeros(len(size), bool)
    for i in range(len(size) - 1):
        differ = np.bitwise_count(table[i + 1 :] ^ table[i]).sum(axis=1, dtype=np.int64)
        near = (whole + part) * differ <= (whole - part) * (n[i + 1 :] + n[i])
        near &= (part * n[i + 1 :] <= whole * n[i]) & (part * n[i] <= whole * n[i + 1 :])
        hit[i + 1 :] |= near
        hit[i] |= near.any()
    return np.flatnonzero(hit).tolist()


def _plausible(buckets: DataFrame, points: DataFrame, part: int, whole: int) -> DataFrame:
    """(bucket, id) of buckets (bucket, id, n) without members that can't link with any other of theirs; n: the bucket's members.

    The share of documents that meet another by chance grows with the table, so
    they are parted here, by a tenth of their texts' bytes and less. Buckets of
    more than LEAF members stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sizes, parities = None, [], [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for b, key, size, parity in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != at:
                    out += [(at, ids[k]) for k in _possible(sizes, parities, part, whole)] if len(ids) > 1 else []
                    at, ids, sizes, parities = b, [], [], []
                ids.append(key)
                sizes.append(size)
                parities.append(parity)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["bucket", "id"])
        out = [(at, ids[k]) for k in _possible(sizes, parities, part, whole)] if len(ids) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["bucket", "id"])

    sets = points.select(F.col("key").alias("_k"), F.col("n").alias("size"), "parity")
    small = buckets.filter(F.col("n") <= LEAF).select("bucket", "id").join(sets, F.col("id") == F.col("_k"))
    dealt = small.select("bucket", "id", "size", "parity").repartition("bucket").sortWithinPartitions("bucket")
    kept = dealt.mapInArrow(run, "bucket long, id long")
    return written(kept.unionByName(buckets.filter(F.col("n") > LEAF).select("bucket", "id")), "plausible")


def _joined(few: DataFrame, many: DataFrame, on, rows: int | None = None) -> DataFrame:
    """many joined with few, which is broadcast while its rows (at most `rows`, else counted) are at most BROADCAST_IDS."""
    return many.join(F.broadcast(few) if (few.count() if rows is None else rows) <= BROADCAST_IDS else few, on)


def _measured(pairs: DataFrame, own: DataFrame, n: int, part: int, whole: int) -> DataFrame:
    """(a, b, d, link) of pairs (a, b) of own (id, s1, text): their sets' Jaccard distance. Texts travel, as they are smaller than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            b, dealt, member, a, name = (batch.column(k).to_numpy() for k in range(5))
            for i, j, h, bounds in shingle_sets(batch.column(5), n):
                right = _names(h, bounds)[0] == name[i:j]  # another row may have the same 64 bits
                turn = np.flatnonzero(np.append(True, (b[i + 1 : j] != b[i : j - 1]) | (dealt[i + 1 : j] != dealt[i : j - 1])))
                for x, y in zip(turn.tolist(), [*turn[1:].tolist(), j - i], strict=True):
                    here = (int(b[i + x]), int(dealt[i + x]))
                    at, pivot = (here, np.zeros(0, np.uint64)) if here != at else (at, pivot)
                    while x < y and not member[i + x]:
                        pivot = h[bounds[x] : bounds[x + 1]].copy() if right[x] else pivot
                        x += 1
                    if x == y or not len(pivot):
                        continue
                    size = np.diff(bounds[x : y + 1])
                    found = h[bounds[x] : bounds[y]]
                    k = np.searchsorted(pivot, found)
                    k[k == len(pivot)] = 0
                    both = np.append(0, np.cumsum(pivot[k] == found))
                    both = both[bounds[x + 1 : y + 1] - bounds[x]] - both[bounds[x:y] - bounds[x]]
                    either = size + len(pivot) - both
                    out = [a[i + x : i + y], b[i + x : i + y], 1 - both / np.maximum(either, 1), whole * both >= part * either]
                    ok = right[x:y]
                    yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in out], names=["a", "b", "d", "link"])

    pairs = written(pairs, "pairs")
    per = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("_s")).select(F.col("b").alias("_b"), "_s")
    dealt = pairs.join(per, F.col("b") == F.col("_b")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("_s")).alias("slice"))
    # Up to one row a pivot and slice beside one a pair.
    pivots = dealt.select("b", "slice").distinct().select(F.col("b").alias("a"), "b", "slice", F.lit(0).alias("member"))
    wanted = dealt.withColumn("member", F.lit(1)).unionByName(pivots)
    rows = _joined(wanted, own, F.col("id") == F.col("a"), 2 * pairs.count()).select("b", "slice", "member", "a", "s1", "text")
    sorted_ = rows.repartition("b", "slice").sortWithinPartitions("b", "slice", "member", "a")
    out = written(sorted_.mapInArrow(run, "a long, b long, d double, link boolean"), "measured")
    discard(pairs)
    return out


def _sketches(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PARITY bits a set: which hash slots hold an odd number of its members. Two sets differ in at least as many members as bits."""
    sets = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    odd = np.bincount(sets * PARITY + (h & np.uint64(PARITY - 1)).astype(np.int64), minlength=(len(bounds) - 1) * PARITY) & 1
    return np.packbits(odd.astype(bool).reshape(-1, PARITY), axis=1).view(np.uint64)


def _ties(sets: list[np.ndarray], ids: np.ndarray, component: np.ndarray, main: np.ndarray, part: int, whole: int) -> list[tuple[int, int]]:
    """Links that tie the components of a region's members together; the first member is its pivot."""
    size = np.array([len(x) for x in sets])
    bounds = np.append(0, np.cumsum(size))
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    sketch = _sketches(every, bounds)
    label = np.unique(component, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def common(y: int, others: np.ndarray) -> np.ndarray:
        """Members that the set y has in common with each of some others."""
        wanted = np.zeros(len(sets), bool)
        wanted[others] = True
        held = wanted[owner]
        k = np.searchsorted(sets[y], every[held])
        k[k == size[y]] = 0
        return np.bincount(owner[held], sets[y][k] == every[held], len(sets))[others].astype(np.int64)

    def tie(y: int, others: np.ndarray, both: np.ndarray) -> None:
        for x in others[whole * both >= part * (size[others] + size[y] - both)].tolist():
            if label[x] != label[y]:
                links.append((int(ids[x]), int(ids[y])))
                label[label == label[x]] = label[y]

    rest = np.arange(1, len(sets))
    both = common(0, rest)
    gap = np.append(0.0, 1 - both / (size[rest] + size[0] - both))
    tie(0, rest, both)
    radius = 1 - part / whole + 1e-9
    seen = np.zeros(len(sets), bool)
    seen[0] = True
    for y in np.flatnonzero(~main & ~seen).tolist():
        seen[y] = True
        near = ~seen & (label != label[y]) & (np.abs(gap - gap[y]) <= radius)
        near &= (part * size <= whole * size[y]) & (part * size[y] <= whole * size)
        others = np.flatnonzero(near)
        # A link's sets differ in at most (1 - t) / (1 + t) of their members together.
        differ = np.bitwise_count(sketch[others] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        others = others[(whole + part) * differ <= (whole - part) * (size[others] + size[y])]
        if len(others):
            tie(y, others, common(y, others))
    return links


def _region_links(rows: DataFrame, own: DataFrame, n: int, part: int, whole: int) -> DataFrame:
    """Links (a, b) that tie the components of each region of rows (region, id, component, main, degree), a bounded number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, names = None, [], []

        def links() -> pa.RecordBatch:
            found = []
            if len(sets) > 1:
                ids, component, main = (np.array(c) for c in zip(*names, strict=True))
                found = _ties(sets, ids, component, main, part, whole)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            region, key, component, main, name = (batch.column(k).to_pylist() for k in range(5))
            for i, j, h, bounds in shingle_sets(batch.column(5), n):
                right = _names(h, bounds)[0]
                for k in range(i, j):
                    if region[k] != at:
                        yield links()
                        at, sets, names = region[k], [], []
                    # Another row may have the same 64 bits.
                    if right[k - i] == name[k] and (not names or names[-1][0] != key[k]):
                        sets.append(h[bounds[k - i] : bounds[k - i + 1]].copy())
                        names.append((key[k], component[k], main[k]))
        yield links()

    rows = written(rows.select("region", F.col("id").alias("key"), "component", "main", "degree"), "joins")
    full = _joined(rows, own, F.col("id") == F.col("key"))
    dealt = full.repartition("region").sortWithinPartitions("region", F.desc("degree"), "key")
    return dealt.select("region", "key", "component", "main", "s1", "text").mapInArrow(run, "a long, b long")


def similar_components(
    docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of docs.

    Two documents link when whole * |A and B| >= part * |A or B| for their sets
    of distinct n-word shingles. component_id is the smallest id that links
    reach; class_id the smallest id with an equal set. Documents without words
    (null and empty texts) have no shingles and are alone. Rows with the same
    id are one document in several texts: links of any of them count. Rows with
    a null id belong to the component of their text, and name none. An empty
    table gives an empty result; other columns of docs play no part.
    """
    spark = docs.sparkSession
    texts = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("id", "text"))
    sketch = spark.sparkContext.broadcast(_sketch(texts, n))
    rows = written(_prefixes(texts, n, part, whole, sketch), "rows")
    sketch.destroy()
    # Rows with an id first, for the name of a class; the points' keys are fixed by writing them.
    first = F.min(F.struct(F.col("id").isNull(), "id", "row", "parity", "tokens")).alias("first")
    points = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(first)
    points = points.select(F.monotonically_increasing_id().alias("key"), "n", "s1", "s2", "first.row", "first.parity", "first.tokens")
    points = written(points, "points")
    sets = points.select("key", *[F.col(c).alias(f"_{c}") for c in ("n", "s1", "s2")])
    same = (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2"))
    members = written(rows.select("id", "row", "n", "s1", "s2").join(sets, same, "left").select("id", "row", "n", "key"), "members")
    discard(rows)
    every = _buckets(points, part, whole)
    once = distinct_buckets(every)
    buckets = _plausible(once, points, part, whole)
    discard(every, once)
    met = buckets.select(F.col("id").alias("_m")).distinct()
    wanted = points.select("key", F.col("row").alias("_row"), "s1").join(met, F.col("key") == F.col("_m"), "left_semi")
    wanted = written(wanted, "wanted")
    own = _joined(wanted, texts.filter(F.col("text").isNotNull()), F.col("row") == F.col("_row"))
    own = own.select(F.col("key").alias("id"), "s1", "text")
    if members.groupBy("row").count().filter("count > 1").limit(1).count():  # rows alike in id and text
        own = own.dropDuplicates(["id", "s1"])
    own = written(own, "texts")
    discard(wanted)
    radius = 1 - part / whole
    measure = lambda pairs: _measured(pairs, own, n, part, whole)
    join = lambda rows: _region_links(rows, own, n, part, whole)
    labels = region_components(buckets, measure, join, radius, max(radius, BALL))
    discard(buckets, own)
    several = members.filter("id is not null and key is not null").groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    several = several.filter("a <> b").select(F.col("id").alias("_i"), "b")
    if several.limit(1).count():
        one = members.filter("key is not null").join(several, F.col("id") == F.col("_i"))
        labels = relabel(labels, one.select(F.col("key").alias("a"), "b").distinct())
    ids = members.filter("key is not null").groupBy("key").agg(F.min("id").alias("class_id"))
    step = labels.select(F.col("id").alias("_l"), F.col("component").alias("_c"))
    named = ids.join(step, F.col("key") == F.col("_l"), "left").select("key", "class_id", F.coalesce("_c", "key").alias("_c"))
    named = written(named, "classes")
    least = named.groupBy("_c").agg(F.min("class_id").alias("component_id")).withColumnRenamed("_c", "_k")
    full = named.join(least, F.col("_c") == F.col("_k")).select(F.col("key").alias("_key"), "class_id", "component_id")
    out = members.join(full, F.col("key") == F.col("_key"), "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("class_id", "id").alias("class_id"),
    )
