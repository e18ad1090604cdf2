"""A Merkle tree over the rows of a dataset: a manifest that proves each row, with one tree for each group.

Rows get their place within their group from ranges of the order (row numbers
inside a range, moved by what earlier ranges hold). A level takes nodes of one
tree, numbered from 0, to their parents by floor-dividing the number by the
fanout and hashing the sorted children. A job takes as many levels at once as
keep a block of at most BLOCK nodes; blocks are groups of a bounded size,
whatever the size of a tree. On the way down each block joins the siblings
that its parent has collected, once for all its nodes, so the joins of all
levels together cost little more than the leaves themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.order import places_within
from quern.llm.shared import discard, written

#: Nodes of a block, at most: its levels are computed by one task.
BLOCK = 256
FANOUT = 2
_PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts set end to end."""
    return F.sha2(F.concat(*parts), 256)


def _field(c: Column) -> Column:
    """A value behind its length in UTF-8 bytes, or a dash for null."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*columns: Column) -> Column:
    return digest(*[_field(c) for c in columns])


def _parents(x: Column, fanout: int) -> Column:
    last = F.ceil(F.size(x) / fanout).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(x, i * fanout + 1, F.lit(fanout)), ""), 256))


class Forest:
    """The levels of one tree for each group, in blocks. nodes: tree, n (the tree's leaves), idx, hash and further columns."""

    def __init__(self, nodes: DataFrame, fanout: int, payload: list[str]) -> None:
        self.fanout, self.payload = fanout, payload
        self.levels = next(k for k in range(64, 0, -1) if fanout**k <= max(BLOCK, fanout))
        self.powers = [fanout**k for k in range(63) if fanout**k < 1 << 62]
        most = nodes.agg(F.max("n").alias("n")).first()["n"] or 1
        height = sum(p < most for p in self.powers)
        self.steps = max(1, -(-height // self.levels))
        self.blocks: list[DataFrame] = []
        tops = []
        for s in range(self.steps):
            block = written(self._folded(nodes, s), "merkle")
            self.blocks.append(block)
            up = block.select("tree", "n", F.col("block").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("hash"))
            tops.append(up.filter(self._height() <= (s + 1) * self.levels).select("tree", "hash", F.lit(s).alias("step")))
            nodes = up.filter(self._height() > (s + 1) * self.levels)
        self.roots = reduce(DataFrame.unionByName, tops)

    def _height(self) -> Column:
        """Levels above the leaves: how many powers of the fanout are less than their number."""
        return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in self.powers]), lambda p: p < F.col("n")))

    def _folded(self, nodes: DataFrame, step: int) -> DataFrame:
        """A row a block: its members by number, and the hashes of its levels from its members up to its top."""
        more = self.payload if step == 0 else []
        member = F.struct("idx", "hash", *more)
        blocks = nodes.groupBy("tree", "n", F.floor(F.col("idx") / self.fanout**self.levels).cast("long").alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
        count = F.least(F.greatest(self._height() - step * self.levels, F.lit(0)), F.lit(self.levels))
        rounds = F.slice(F.sequence(F.lit(1), F.lit(self.levels)), F.lit(1), count)
        base = F.array(F.transform("members", lambda m: m["hash"]))
        levels = F.aggregate(rounds, base, lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1), self.fanout))))
        return blocks.withColumn("levels", levels)

    def paths(self, above: DataFrame, carried: list[str]) -> DataFrame:
        """For every leaf: tree, its further columns, hash, path (its siblings from the bottom up, then above's path) and above's carried columns.

        above: tree, step, path and carried columns, a row a tree.
        """
        start = lambda s: above.filter(F.col("step") == s).select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_idx"), F.col("path").alias("_path"), *carried)
        upper = start(self.steps - 1)
        for s in reversed(range(self.steps)):
            block = self.blocks[s].join(upper, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_idx")))
            power = F.array(*[F.lit(p).cast("int") for p in self.powers[: self.levels]])

            def siblings(o: Column, power: Column = power) -> Column:
                def at(level: Column, j: Column) -> Column:
                    place = F.floor(o / F.element_at(power, j + 1)).cast("int")
                    inside = F.pmod(place, F.lit(self.fanout))
                    return F.struct(
                        F.array_join(F.slice(level, place - inside + 1, inside), "").alias("before"),
                        F.array_join(F.slice(level, place + 2, F.lit(self.fanout) - inside - 1), "").alias("after"),
                    )

                return F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), at)

            more = self.payload if s == 0 else []
            nodes = F.transform("members", lambda m, o: F.struct(m["idx"].alias("idx"), m["hash"].alias("hash"), *[m[c].alias(c) for c in more], F.concat(siblings(o), F.col("_path")).alias("path")))
            open_ = block.select("tree", *carried, F.inline(nodes))
            if s:
                upper = open_.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), *carried).unionByName(start(s - 1))
        return open_


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of its path."""
    return F.aggregate(path, start, lambda acc, s: digest(s["before"], acc, s["after"]))


def manifest(rows: DataFrame, columns: list[str], group: str, order: str, tampered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """order's column, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    columns: what a leaf hashes, in this order; group: the column with a tree
    of its own for each value, null too; order: the column by which a tree's
    leaves ascend, nulls first and equals by their hash; tampered: columns to
    be replaced before the check. A tree of one leaf has it as subroot; one
    group alone has its subroot as root. Null values are told apart from empty
    and zero-length ones; rows alike in all columns are leaves of their own.
    Columns that aren't named take no part. An empty table gives no rows.
    """
    new = tampered or {}
    cols = [F.col(c) for c in columns]
    changed = [new.get(c, F.col(c)) for c in columns]
    differs = reduce(lambda a, b: a | b, [~new[c].eqNullSafe(F.col(c)) for c in new], F.lit(False))
    tree = F.when(F.col(group).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(group).cast("string")))
    leaf = rows.select(tree.alias("tree"), F.col(order).alias("_order"), leaf_hash(*cols).alias("hash"), F.when(differs, leaf_hash(*changed)).alias("tampered"))
    placed = places_within(leaf, "tree", ["_order", "hash"]).withColumnRenamed("_place", "idx").withColumnRenamed("_size", "n")
    forest = Forest(placed, fanout, ["_order", "tampered"])
    subroots = written(forest.roots, "subroots")
    top_leaves = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash", F.col("step").alias("last"))
    top = Forest(places_within(top_leaves, "tree", ["name"]).withColumnRenamed("_place", "idx").withColumnRenamed("_size", "n"), fanout, ["name", "last"])
    root = top.roots.first()
    over = top.paths(top.roots.select("tree", "step", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root")), ["root"])
    above = over.select(F.col("name").alias("tree"), F.col("last").alias("step"), "path", F.col("hash").alias("subroot"))
    above = written(above, "above")
    discard(subroots, *top.blocks)
    out = forest.paths(above, ["subroot"])
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = fold(F.coalesce("tampered", "hash"), F.col("path"))
    whole = F.lit(root["hash"] if root else None).cast("string")
    return out.select(F.col("_order").alias(order), F.col("hash").alias("leaf"), "subroot", whole.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
