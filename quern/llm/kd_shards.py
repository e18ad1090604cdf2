"""K-d tree sharding of documents: weighted medians along the widest metadata dimension.

All nodes of a level are split at once. A node that must become k leaves is cut
so that floor(k/2)/k of its weight falls left, along the dimension in which it
is widest. Every row has a 63-bit key in that dimension (31 bits of the scaled
value, 32 bits of a hash of the row), so a hot source or a constant column can
still be cut anywhere. The cut is found by histograms over the key, each round
finer inside the bin that holds the cut; only histogram rows, bounded by nodes
times bins, leave the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.order import positions
from quern.llm.shared import local_rows, written

BINS = 2048
#: A cut may miss its weight by this share of one leaf.
SLACK = 0.001
MAX_LEAVES = 1 << 20


@dataclass
class Node:
    first: int  # its first shard
    leaves: int
    weight: int
    low: int = 0
    high: int = 0
    left: int = 0  # weight that is surely left of low
    dim: int = 0
    cut: int | None = None


def _key(dims: list[Column], dim: Column) -> Column:
    """The row's key in the dimension that its node is split along."""
    value = F.lit(0).cast("long")
    for i, d in enumerate(dims):
        value = F.when(dim == i, d).otherwise(value)
    return F.shiftleft(value, 32) + F.col("_tie")


def _splits(rows: DataFrame, nodes: list[Node], dims: list[str]) -> None:
    """Sets dim and cut of each node: keys below the cut go left."""
    spark = rows.sparkSession
    by_first = {n.first: n for n in nodes}
    spans = rows.filter(F.col("_k") > 1).groupBy("_node").agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(dims) for p, f in (("lo", F.min), ("hi", F.max))]).collect()
    for r in spans:
        n = by_first[r["_node"]]
        n.dim = max(range(len(dims)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
        n.low, n.high = r[f"lo{n.dim}"] << 32, (r[f"hi{n.dim}"] + 1) << 32
    open_nodes = [n for n in nodes if n.high]
    while open_nodes:
        # One row a node; nodes are fewer than leaves, which MAX_LEAVES bounds.
        frame = local_rows(spark, [(n.first, n.dim, n.low, n.high, max(1, -(-(n.high - n.low) // BINS))) for n in open_nodes], "_at int, _dim int, _low long, _high long, _width long")
        keyed = rows.join(F.broadcast(frame), rows["_node"] == frame["_at"]).withColumn("_key", _key([F.col(c) for c in dims], F.col("_dim")))
        hist = (
            keyed.filter("_key >= _low and _key < _high")
            .groupBy("_node", ((F.col("_key") - F.col("_low")) / F.col("_width")).cast("int").alias("_bin"))
            .agg(F.sum("_w").alias("w"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
        )
        upto = Window.partitionBy("_node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        goal = local_rows(spark, [(n.first, n.weight * (n.leaves // 2) / n.leaves - n.left) for n in open_nodes], "_goal_at int, _goal double")
        found = hist.withColumn("before", F.coalesce(F.sum("w").over(upto), F.lit(0))).join(F.broadcast(goal), F.col("_node") == F.col("_goal_at"))
        # The bin that holds the goal: one row a node.
        found = found.filter("before < _goal and before + w >= _goal").select("_node", "w", "lo", "hi", "before", "_goal").collect()
        for r in found:
            n = by_first[r["_node"]]
            if r["lo"] == r["hi"] or r["w"] <= SLACK * n.weight / n.leaves:
                n.cut = r["hi"] + 1 if r["before"] + r["w"] - r["_goal"] <= r["_goal"] - r["before"] else r["lo"]
            else:
                n.low, n.high, n.left = r["lo"], r["hi"] + 1, n.left + r["before"]
        hit = {r["_node"] for r in found}
        open_nodes = [n for n in open_nodes if n.cut is None and n.first in hit]


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    shards: the number of leaves, or target_bytes: leaves are as many as it
    takes. The law is `bytes`: each leaf gets close to the same bytes, as far
    as whole rows allow. size is the UTF-8 bytes of the text plus 8; a null
    text counts none. Dimensions: id, source and lang (each where the
    table has it); size is none, as leaves of long rows alone can't be equal. slot numbers a shard's rows from 0 by id. Null ids sort
    first; rows alike in all columns keep separate slots; an empty table gives
    no rows; with fewer rows than shards some shards stay empty.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    label = {c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) for c in ("source", "lang") if c in docs.columns}
    narrow = docs.select(F.col(id_col).alias("_id"), size.alias("size"), crc.alias("text_crc32"), *[v.alias(f"_{c}") for c, v in label.items()])
    narrow = written(narrow, "kd-rows")
    span = narrow.agg(F.min("_id").alias("a"), F.max("_id").alias("b"), F.sum("size").alias("total")).first()
    total = span["total"] or 0
    leaves = shards or max(1, math.ceil(total / target_bytes))
    if leaves > MAX_LEAVES:
        raise ValueError(f"{leaves} leaves; the tree is held by the driver, up to {MAX_LEAVES}")
    top = float(1 << 31)
    width = max(1, (span["b"] or 0) - (span["a"] or 0) + 1)
    scaled = lambda c: F.greatest(F.lit(0), F.least(F.lit((1 << 31) - 1), F.floor(c).cast("long")))
    dims = {"_d0": scaled((F.coalesce(F.col("_id"), F.lit(span["a"] or 0)) - (span["a"] or 0)) / width * top)}
    dims |= {f"_d{i + 1}": F.shiftright(F.col(f"_{c}"), 1) for i, c in enumerate(label)}
    tie = F.pmod(F.xxhash64("_id", "text_crc32", "size"), F.lit(1 << 32))
    rows = narrow.select("_id", "size", "text_crc32", F.col("size").alias("_w"), tie.alias("_tie"), *[v.alias(k) for k, v in dims.items()], F.lit(0).alias("_node"), F.lit(leaves).alias("_k"))
    level = [Node(0, leaves, total)]
    while any(n.leaves > 1 for n in level):
        inner = [n for n in level if n.leaves > 1]
        _splits(rows, inner, list(dims))
        cuts = local_rows(rows.sparkSession, [(n.first, n.leaves // 2, n.dim, n.cut if n.cut is not None else n.high) for n in inner], "_at int, _half int, _dim int, _cut long")
        joined = rows.join(F.broadcast(cuts), rows["_node"] == cuts["_at"], "left")
        right = F.coalesce(_key([F.col(c) for c in dims], F.col("_dim")) >= F.col("_cut"), F.lit(False))
        moved = joined.select("_id", "size", "text_crc32", "_w", "_tie", *dims, F.when(right, F.col("_node") + F.col("_half")).otherwise(F.col("_node")).alias("_node"), F.when(F.col("_half").isNull(), F.col("_k")).when(right, F.col("_k") - F.col("_half")).otherwise(F.col("_half")).alias("_k"))
        rows = written(moved, "kd-level")
        weight = {r["_node"]: r["w"] for r in rows.groupBy("_node").agg(F.sum("_w").alias("w")).collect()}  # one row a node
        level = [m for n in level for m in ((Node(n.first, n.leaves // 2, 0), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2, 0)) if n.leaves > 1 else (n,))]
        for n in level:
            n.weight = weight.get(n.first, 0)
    placed = positions(rows.select(F.col("_node").alias("shard"), "_id", "text_crc32", "size"), ["shard", "_id", "text_crc32"])
    counts = rows.groupBy("_node").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_node").alias("_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), placed["shard"] == starts["_at"]).select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_pos") - F.col("_start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
