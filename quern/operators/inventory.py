"""File inventories, snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.constraints import glob_regex, parse, predicate
from quern.functions.text import dirname, is_test_go, is_test_inventory, is_test_python, is_test_search, is_test_ts
from quern.plans import views
from quern.registry import query

#: Suffixes that have a language.
SUFFIXES = {".js": "javascript", ".jsx": "javascript", ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript"}


def excluded(path: Column, names: tuple[str, ...] = (), parts: tuple[str, ...] = (), patterns: tuple[str, ...] = (), minified: bool = True) -> Column:
    """A whole file name, any part of the path, a prefix or shell pattern, or a minified file."""
    tests = [F.element_at(F.split(path, "/"), -1).isin(*names)] if names else []
    if parts:
        tests.append(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, parts))))
    tests += [path.startswith(p) | path.rlike(glob_regex(p)) for p in patterns]
    if minified:
        tests.append(path.rlike(r"\.min\.(js|css)$"))
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def suffix_language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in SUFFIXES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(path, r"(\.[^./]+)$", 1))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of every path in one of the snapshots only or with another hash."""
    o = old.select(F.col("path").alias("_p"), F.col("hash").alias("_h"))
    j = o.join(new.select("path", "hash"), F.col("_p") == F.col("path"), "full_outer")
    change = F.when(F.col("_p").isNull(), "new").when(F.col("path").isNull(), "deleted").when(~F.col("_h").eqNullSafe(F.col("hash")), "changed").otherwise("same")
    return j.select(F.coalesce("path", "_p").alias("path"), change.alias("change"))


def incremental(stored: DataFrame, present: DataFrame) -> DataFrame:
    """The stored index after an update: rows of vanished and changed paths go, present ones of new and changed paths come."""
    changes = snapshot_changes(stored, present)
    touched = changes.filter("change <> 'same'").select(F.col("path").alias("_p"))
    fresh = present.join(changes.filter("change in ('new', 'changed')").select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_semi")
    return stored.join(touched, F.col("path") == F.col("_p"), "left_anti").unionByName(fresh)


@query("SELECT path, language, hash, size_bytes, line_count, is_test FROM files", "files")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("path", "language", "hash", "size_bytes", "line_count", "is_test")


@query("SELECT language, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY language", "files")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes"))


@query("SELECT split_part(path, '/', 1) AS top, count(*) AS files, count(*) FILTER (WHERE is_test) AS tests, CAST(sum(line_count) AS BIGINT) AS lines FROM files GROUP BY 1 ORDER BY files DESC, top LIMIT 20", "files")
def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).withColumn("top", F.split("path", "/")[0])
    return f.groupBy("top").agg(F.count(F.lit(1)).alias("files"), F.count_if("is_test").alias("tests"), F.sum("line_count").alias("lines")).orderBy(F.desc("files"), "top").limit(20)


@query("""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash IS DISTINCT FROM n.hash THEN 'changed' ELSE 'same' END AS change
FROM old_files o FULL JOIN new_files n ON o.path = n.path""", "snapshots")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(*views.snapshots(spark, sf_dir))


@query("SELECT path, hash FROM new_files", "snapshots")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental(*views.snapshots(spark, sf_dir))


@query("""SELECT CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash IS DISTINCT FROM n.hash THEN 'changed' ELSE 'same' END AS change, count(*) AS n
FROM old_files o FULL JOIN new_files n ON o.path = n.path GROUP BY 1""", "snapshots")
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(*views.snapshots(spark, sf_dir)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT path FROM files WHERE regexp_matches(path, '^(?s:.*doc_.*7)$') AND starts_with(path, 'src1')", "files")
def dsl_filter_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).filter(predicate(parse("*doc_*7"), F.col("path")) & F.col("path").startswith("src1")).select("path")


@query("SELECT path, size_bytes FROM files WHERE size_bytes < 2048 AND size_bytes >= 100", "files")
def dsl_filter_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).filter(predicate(parse("size:<2kb size:>=100b"), F.col("path"), size=F.col("size_bytes"))).select("path", "size_bytes")


@query("SELECT path FROM files WHERE NOT starts_with(path, 'tests/') AND NOT regexp_matches(path, '^(?s:.*/de/.*)$')", "files")
def dsl_filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).filter(predicate(parse("!tests/ !*/de/*"), F.col("path"))).select("path")


@query("SELECT o_orderkey AS id FROM orders WHERE epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(o_orderdate) < 90 * 86400")
def dsl_filter_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    age = F.unix_timestamp(F.lit("1998-08-02 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.filter(predicate(parse("mtime:<90d"), F.lit(""), age_seconds=age)).select(F.col("o_orderkey").alias("id"))


@query("SELECT CASE WHEN strpos(path, '/') > 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, count(*) AS files FROM files GROUP BY 1", "files")
def directory_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).groupBy(dirname(F.col("path")).alias("directory")).agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT count(*) FILTER (WHERE starts_with(path, 'tests/') OR contains(path, '/test_')) AS inventory, count(*) FILTER (WHERE contains(lower(path), 'test') OR contains(lower(path), 'spec')) AS search,
count(*) FILTER (WHERE starts_with(path, 'tests/') OR contains(path, '/tests/') OR regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\\.py$')) AS python, count(*) FILTER (WHERE regexp_matches(path, '\\.(test|spec)\\.[jt]sx?$') OR contains(path, '__tests__/')) AS ts, count(*) FILTER (WHERE ends_with(path, '_test.go')) AS go FROM files""", "files")
def test_path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return views.files(spark, sf_dir).agg(*[F.count_if(f(p)).alias(n) for n, f in (("inventory", is_test_inventory), ("search", is_test_search), ("python", is_test_python), ("ts", is_test_ts), ("go", is_test_go))])


@query("SELECT path FROM files WHERE NOT (list_has_any(string_split(path, '/'), ['fr', 'src3']) OR starts_with(path, 'tests/src1') OR regexp_matches(path, '^(?s:.*doc_.5)$'))", "files")
def exclusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).filter(~excluded(F.col("path"), parts=("fr", "src3"), patterns=("tests/src1", "*doc_?5"))).select("path")


@query("""SELECT path, line_count, CAST(n AS BIGINT) AS rank FROM (SELECT path, line_count, row_number() OVER (ORDER BY line_count DESC, path) AS n FROM files WHERE line_count >= 30) WHERE n <= 200""", "files")
def large_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = views.files(spark, sf_dir).filter("line_count >= 30").select("path", "line_count").orderBy(F.desc("line_count"), "path").limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("line_count"), "path")).cast("long"))


@query("""SELECT coalesce(a.path, b.path) AS path, list_filter([CASE WHEN a.path IS NOT NULL THEN 'git' END, CASE WHEN b.path IS NOT NULL THEN 'index' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT path FROM files WHERE doc_id % 5 = 0) a FULL JOIN (SELECT path FROM files WHERE doc_id % 3 = 0) b ON a.path = b.path""", "files")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    a, b = f.filter("doc_id % 5 = 0").select(F.col("path").alias("a")), f.filter("doc_id % 3 = 0").select(F.col("path").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("path"), F.array_compact(F.array(F.when(F.col("a").isNotNull(), "git"), F.when(F.col("b").isNotNull(), "index"))).alias("reasons"))
