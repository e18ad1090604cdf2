"""Connected components: alternating large-star and small-star steps on an edge table, until a task can hold what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import discard, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step: nodes hang their neighbours (larger ones, or small: smaller ones and themselves) onto their least neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_u"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["_u"])
    if small:  # edges run from the larger end to the smaller
        moved = joined.select(F.col("b").alias("x"), "m").unionByName(joined.select(F.col("a").alias("x"), "m"))
    else:
        moved = joined.filter("b > a").select(F.col("b").alias("x"), "m").unionByName(joined.filter("a > m").select(F.col("a").alias("x"), "m"))
    return moved.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


#: Edges up to which one task joins them (some 20 MB); more are first shrunk by rounds of stars.
TASK_EDGES = 200_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of edges between a and b, nodes ascending."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # Each root hangs itself under the least root that an edge of its tree leads to; then all pointers are cut short.
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(k).to_numpy() for k in (0, 1)] for batch in batches]
        if parts:
            found = least_reached(*[np.concatenate(c) for c in zip(*parts, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, in_task: bool = True) -> DataFrame:
    """(id, component) of every node of the edges (a, b), longs: the least id that it reaches. Loops and repeats do no harm.

    Each round is written to the shared folder, as is the result. The number of rounds grows with
    the logarithm of the longest path. in_task: TASK_EDGES edges and fewer are joined by one task, in Python.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    sign = None
    if in_task and now.count() <= TASK_EDGES:
        out = written(_in_one_task(now), "labels")
        discard(now)
        return out
    while True:
        got = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        if (got["n"], got["h"]) == sign or not got["n"]:
            break
        sign, before = (got["n"], got["h"]), now
        now = written(_stars(_stars(now, small=False), small=True), "cc")
        discard(before)
    ends = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    out = written(ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "labels")
    discard(now)
    return out
