"""Digests of a set of files that merge by prefix: one key for a snapshot, and its changes without reading all of both.

A file belongs to the bucket of the first hex digits of its path's hash. A
bucket's digest covers its files in order; a prefix's digest covers those of
the sixteen prefixes that are one digit longer. Buckets hold BUCKET files on
average, whatever directory they are in, so no task sees more than a few of
those; the root is the key. Two snapshots are compared from the root down,
and only files of buckets whose digests differ are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.inventory import snapshot_changes
from quern.plans import views
from quern.registry import query
from quern.sources.folders import kept

BUCKET = 64


def depth_for(files: int) -> int:
    """Digits of a bucket: as few as keep BUCKET files in it on average."""
    depth = 0
    while BUCKET * 16**depth < files:
        depth += 1
    return depth


def digest_tree(files: DataFrame, depth: int) -> DataFrame:
    """level, prefix, digest, files: from the buckets (level `depth`) up to the root (level 0, an empty prefix).

    files: (path, hash). Equal rows count; null paths and hashes are told from
    empty ones. Without files there are no rows.
    """
    bucket = F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, depth)
    line = F.concat(F.coalesce(F.concat(F.lit("="), "path"), F.lit("-")), F.lit("\n"), F.coalesce(F.concat(F.lit("="), "hash"), F.lit("-")))
    level = kept(files.groupBy(bucket.alias("prefix")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("files")), "digests")
    out = level.select(F.lit(depth).alias("level"), "prefix", "digest", "files")
    for d in range(depth - 1, -1, -1):
        # Sixteen children at most.
        told = F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat(c["prefix"], c["digest"]))
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sha2(F.array_join(told, "\n"), 256).alias("digest"), F.sum("files").alias("files"))
        out = out.unionByName(level.select(F.lit(d).alias("level"), "prefix", "digest", "files"))
    return kept(out, "digests")


def changed_since(old: DataFrame, new: DataFrame, old_tree: DataFrame | None = None, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, change) of new, deleted and changed files, and new's tree, to be kept for the next time.

    old_tree: old's tree as kept, where there is one; both have as many digits.
    """
    depth = old_tree.agg(F.max("level")).first()[0] if old_tree is not None else depth_for(files if files is not None else new.count())
    depth = depth or 0
    mine = digest_tree(new, depth)
    theirs = old_tree if old_tree is not None else digest_tree(old, depth)
    other = None
    for d in range(depth + 1):
        a = mine.filter(F.col("level") == d).select("prefix", F.col("digest").alias("a"))
        b = theirs.filter(F.col("level") == d).select("prefix", F.col("digest").alias("b"))
        if other is not None:  # only below what differs
            above = other.withColumnRenamed("prefix", "_p")
            a, b = (x.join(above, F.substring("prefix", 1, d - 1) == F.col("_p"), "left_semi") for x in (a, b))
        other = a.join(b, "prefix", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
    other = kept(other, "differs")
    inside = lambda f: f.withColumn("prefix", F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, depth)).join(other, "prefix", "left_semi").select("path", "hash")
    return snapshot_changes(inside(old), inside(new)).filter("change <> 'same'"), mine


@query("WITH RECURSIVE " + views.SQL["files"] + """,
d AS (SELECT CAST(len(list_filter(range(16), lambda p: 64 * pow(16, p) < n)) AS INTEGER) AS depth FROM (SELECT count(*) AS n FROM files)),
buckets AS (SELECT depth AS level, substr(sha256(path), 1, depth) AS prefix, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM (SELECT path, '=' || path || chr(10) || '=' || hash AS line FROM files) JOIN d ON true GROUP BY 1, 2),
up AS (SELECT level, prefix, digest, n FROM buckets
 UNION ALL SELECT DISTINCT level - 1, substr(prefix, 1, level - 1), sha256(string_agg(prefix || digest, chr(10) ORDER BY prefix) OVER w), CAST(sum(n) OVER w2 AS BIGINT) FROM up WHERE level > 0
  WINDOW w AS (PARTITION BY substr(prefix, 1, level - 1) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), w2 AS (PARTITION BY substr(prefix, 1, level - 1)))
SELECT n AS files, digest AS key FROM up WHERE level = 0""")
def snapshot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).select("path", "hash")
    return digest_tree(f, depth_for(f.count())).filter("level = 0").select("files", F.col("digest").alias("key"))


@query("""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM old_files o FULL JOIN new_files n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash OR o.path IS NULL OR n.path IS NULL""", "snapshots")
def snapshot_changes_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_since(*views.snapshots(spark, sf_dir))[0]
