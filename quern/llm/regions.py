"""Exact components of a metric space: pivots, Voronoi regions, windows of the triangle inequality, recursion.

Input are buckets: (bucket, id) such that any two items within `radius` share a
bucket. Far items share none, so a bucket is a piece of the space in which
distances differ and pivots tell something; it is the first region. Its most
connected member is its first pivot.

First every item is measured against the most connected pivot that it meets.
Items within the radius of a pivot are linked to it, and a bucket whose members
are all in one component is done. The open buckets of one pivot become a region,
and all regions are treated by one rule, at every level:

* a region of at most LEAF members is joined by a task, given by the caller;
* one of which k blocks of half a leaf would be made is joined by tasks of two
  blocks each, if that sends its members to no more tasks than the level has
  pivots a region. Two blocks of the largest component aren't compared;
* in a larger one pivots are chosen, FAN times as many as a level before, those
  outside the region's largest component first, and all members are measured
  against them; items within the radius of a pivot are linked to it;
* a member lies in the Voronoi region of its nearest pivot, in a ring of a
  radius' width around it, if that pivot is within `ball`, else in the outer
  region of those that no ball holds;
* two linked items differ by the radius at most in their distance from any
  pivot. So a member is replicated to the rings beside its own distance around
  every pivot, and to the outer region if no pivot is nearer than ball - radius;
  those of the largest component needn't be;
* the pivots leave, as all their pairs are known, and the new regions that hold
  more than one component go to the next level. But where distances tell so
  little that the new regions would take more rows to join than the old one,
  that one is joined by blocks.

So every linked pair is compared, or in one component already. Pivots leave each
region at each level, and a level's regions of up to FAN^level blocks are
joined, so the recursion ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import discard, written

#: A level's pivots per region, as a multiple of those of the level before.
FAN = 8
#: Members that one task joins, about: up to so many a region is one task's, a larger one is cut into blocks of half as many.
LEAF = 1000
_EPS = 1e-9


def relabel(labels: DataFrame | None, edges: DataFrame, in_task: bool = True) -> DataFrame:
    """(id, component) of linked items after more edges (a, b) between items."""
    if labels is None:
        return components(edges, in_task)
    of = lambda side: labels.select(F.col("id").alias(f"_{side}"), F.col("component").alias(f"_c{side}"))
    named = edges.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    merged = components(named.select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")), in_task)
    step = merged.select(F.col("id").alias("_old"), F.col("component").alias("_new"))
    moved = labels.join(step, F.col("component") == F.col("_old"), "left")
    old = moved.select("id", F.coalesce("_new", "component").alias("component"))
    fresh = merged.join(labels.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    out = written(old.unionByName(fresh), "labels")
    discard(labels, merged)
    return out


def _distinct(buckets: DataFrame) -> DataFrame:
    """(bucket, id, n) without buckets of one member and with one of those with the same members; n: the bucket's members."""
    signs = (F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2"))
    size = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *signs).filter("n > 1")
    once = size.groupBy("n", "s1", "s2").agg(F.min("bucket").alias("_b")).select("_b", "n")
    return buckets.join(once, F.col("bucket") == F.col("_b")).select("bucket", "id", "n")


def distinct_buckets(buckets: DataFrame) -> DataFrame:
    """_distinct(), written."""
    return written(_distinct(buckets), "members")


def merged_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, id, degree) of distinct_buckets; degree: members that an item meets."""
    degree = F.sum("n").over(Window.partitionBy("id")).alias("degree")
    return written(_distinct(buckets).select("bucket", "id", degree), "met")


def _open(rows: DataFrame, by: str, labels: DataFrame) -> DataFrame:
    """rows (with id and `by`) of the groups that hold several components, with `component`, `main`: whether it is the group's largest, `size` and `most`: the members of the group and of that."""
    step = labels.select(F.col("id").alias("_l"), F.col("component").alias("_c"))
    named = rows.join(step, F.col("id") == F.col("_l"), "left").withColumn("component", F.coalesce("_c", "id")).drop("_l", "_c")
    per = named.groupBy(by, "component").agg(F.count(F.lit(1)).alias("_n")).groupBy(by)
    most = per.agg(F.max_by("component", F.struct("_n", "component")).alias("_m"), F.sum("_n").alias("size"), F.max("_n").alias("most"), F.count(F.lit(1)).alias("_k"))
    held = named.join(most.filter("_k > 1").select(F.col(by).alias("_by"), "_m", "size", "most"), F.col(by) == F.col("_by"))
    return held.withColumn("main", F.col("component") == F.col("_m")).drop("_by", "_m")


def _linked(found: DataFrame) -> DataFrame:
    return found.filter("link").select("a", "b")


def _block_counts() -> tuple[Column, Column]:
    """Blocks of a region's members outside its largest component, and of those in it, by `size` and `most`."""
    half = max(1, LEAF // 2)
    return F.ceil((F.col("size") - F.col("most")) / half), F.ceil(F.col("most") / half)


def _sent() -> Column:
    """Rows that dealt() makes of a region, by `size` and `most`."""
    rest, main = _block_counts()
    return F.when(F.col("size") <= LEAF, F.col("size")).otherwise((F.col("size") - F.col("most")) * (rest + main - 1) + F.col("most") * rest)


def dealt(rows: DataFrame) -> DataFrame:
    """rows of regions (region, id, component, main, degree, size, most) as regions of LEAF members at most, about.

    Of a larger region any two blocks are one, but for two of its largest component.
    """
    rest, main = _block_counts()
    at = F.xxhash64("id", F.lit(2))
    own = F.when(F.col("main"), rest + F.pmod(at, main)).otherwise(F.pmod(at, rest))
    last = F.when(F.col("main"), rest).otherwise(rest + main) - 1
    others = F.array_except(F.sequence(F.lit(0).cast("long"), last), F.array(own))
    pairs = F.transform(others, lambda x: F.xxhash64("region", F.least(x, own), F.greatest(x, own)))
    to = F.when(F.col("size") <= LEAF, F.array("region")).otherwise(pairs)
    return rows.select(F.explode(to).alias("region"), "id", "component", "main", "degree")


def _pivots(rows: DataFrame, k: int) -> DataFrame:
    """(_r, pivot, place): k members of each region, those outside its largest component first, then the most connected."""
    order = Window.partitionBy("region").orderBy("main", F.desc("degree"), "id")
    chosen = rows.select("region", "id", "degree", "main").withColumn("place", F.row_number().over(order))
    return chosen.filter(F.col("place") <= k).select(F.col("region").alias("_r"), F.col("id").alias("pivot"), "place")


def _parting(parts: DataFrame, big: DataFrame) -> DataFrame:
    """(region, id, degree, whole): parts (parent, region, id, degree) of the regions that take fewer rows to join by parts than whole, else the region's own rows."""
    half = max(1, LEAF // 2)
    k = F.when(F.col("n") <= LEAF, F.lit(1)).otherwise(F.ceil(F.col("n") / half) - 1)
    cost = parts.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("parent").agg(F.sum(F.col("n") * k).alias("cost"))
    whole = big.groupBy("region").agg(F.first(_sent()).alias("sent"))
    worse = whole.join(cost, F.col("region") == F.col("parent")).filter("cost >= sent").select(F.col("region").alias("_w"))
    kept = parts.join(worse, F.col("parent") == F.col("_w"), "left_anti").select("region", "id", "degree", F.lit(False).alias("whole"))
    return kept.unionByName(big.join(worse, F.col("region") == F.col("_w"), "left_semi").select("region", "id", "degree", F.lit(True).alias("whole")))


def region_components(
    buckets: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    join: Callable[[DataFrame], DataFrame],
    radius: float,
    ball: float,
    in_task: bool = True,
) -> DataFrame:
    """(id, component) of the items that have a link.

    measure(pairs) gives (a, b, d, link) for distinct pairs (a, b) of items,
    where b is the side that repeats, in a table that is written; link says
    whether d, a metric, is at most radius. join(rows) gives links (a, b) that
    tie the components of each region together; rows are (region, id,
    component, main, degree), at most LEAF a region, about; main marks a
    component of which no pairs need be compared. ball should be below the
    distance of unrelated items by a radius. in_task as for components().
    """
    met = merged_buckets(buckets)
    tops = met.groupBy("bucket").agg(F.max_by("id", F.struct("degree", "id")).alias("region"), F.max("degree").alias("rank"))
    rows = met.join(tops.withColumnRenamed("bucket", "_b"), F.col("bucket") == F.col("_b")).drop("_b")
    rows = written(rows, "rows")
    discard(met)
    homes = rows.groupBy("id").agg(F.max_by("region", F.struct("rank", "region")).alias("b"))
    found = measure(homes.filter("id <> b").select(F.col("id").alias("a"), "b"))
    labels = relabel(None, _linked(found), in_task)
    now = _open(rows, "bucket", labels).groupBy("region", "id").agg(F.max("degree").alias("degree"), F.lit(False).alias("whole"))
    now = written(_open(now, "region", labels), "level")
    discard(found, rows)
    level, width = 1, radius + _EPS
    while True:
        ready = F.col("whole") | (F.col("size") <= LEAF) | (_sent() <= F.col("size") * FAN**level)
        links = join(dealt(now.filter(ready)))
        big = now.filter(~ready).drop("component")
        if not big.limit(1).count():
            labels = relabel(labels, links, in_task)
            discard(now)
            return labels
        star = big.join(_pivots(big, FAN**level), F.col("region") == F.col("_r")).drop("_r")
        star = written(star, "star")
        found = measure(star.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
        labels = relabel(labels, links.unionByName(_linked(found)), in_task)
        got = found.select(F.col("a").alias("_a"), F.col("b").alias("_p"), "d")
        near = star.join(got, (F.col("id") == F.col("_a")) & (F.col("pivot") == F.col("_p")), "left")
        ring = F.floor(F.col("d") / width).cast("int")
        # At most FAN^level distances a row: what the level chose as pivots.
        each = near.groupBy("region", "id", "degree", "main").agg(
            F.max(F.col("id") == F.col("pivot")).alias("gone"),
            F.min(F.struct("d", "place", ring.alias("ring"))).alias("nearest"),
            F.collect_list(F.when(F.col("d") <= ball + width, F.struct("place", ring.alias("ring")))).alias("within"),
        )
        each = each.filter(~F.col("gone"))
        part = lambda place, ring: F.struct(place.alias("place"), ring.alias("ring"))
        beyond = part(F.lit(0), F.lit(0))
        home = F.when(F.col("nearest.d") <= ball, part(F.col("nearest.place"), F.col("nearest.ring"))).otherwise(beyond)
        rings = F.flatten(F.transform("within", lambda w: F.array(*[part(w["place"], w["ring"] + k) for k in (-1, 0, 1)])))
        outer = F.when(F.col("nearest.d") > ball - width, F.array(beyond)).otherwise(F.filter(F.array(beyond), lambda _: F.lit(False)))
        visits = F.when(F.col("main"), F.array(home)).otherwise(F.array_distinct(F.concat(F.array(home), rings, outer)))
        parts = each.select("region", "id", "degree", F.explode(visits).alias("part"))
        parts = parts.select(F.col("region").alias("parent"), F.xxhash64("region", "part.place", "part.ring").alias("region"), "id", "degree")
        parts, done = written(parts, "parts"), now
        now = written(_open(_parting(parts, big), "region", labels), "level")
        discard(star, found, parts, done)
        level += 1
