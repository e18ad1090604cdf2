"""Changes to stored tables as new tables, and ordered selections: nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import views
from quern.registry import query

#: Fixed value: parts of a name that tell nothing of what a test is about.
COMMON_PARTS = ("src", "tests", "test", "py", "python")


def without_parents(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children whose parent isn't among `gone`: what a cascade leaves."""
    return children.join(gone.select(key).distinct(), key, "left_anti")


def replaced(stored: DataFrame, fresh: DataFrame, scope: str) -> DataFrame:
    """stored with all rows of the scopes that `fresh` tells of replaced by its own."""
    return stored.join(fresh.select(scope).distinct(), scope, "left_anti").unionByName(fresh)


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with `column` as the last change of each key says. changes: (key, at, column); of equal times the greatest value."""
    last = changes.groupBy(F.col(key).alias("_k")).agg(F.max_by(column, F.struct("at", column)).alias("_new"))
    return rows.join(last, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_new", column)).drop("_k", "_new")


def counted(stored: DataFrame, uses: DataFrame, key: str, name: str) -> DataFrame:
    """stored with `name`: how often a log of uses tells of the key. The log is appended to, the counter is read from it."""
    n = uses.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return stored.join(n, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def unexpired(stored: DataFrame, expires: str, now: Column) -> DataFrame:
    """What a clean-up leaves: rows without an end, or whose end is yet to come."""
    return stored.filter(F.col(expires).isNull() | (F.col(expires) > now))


def first_seen(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The `most` distinct keys that come first, in order of their first row."""
    at = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_at"))
    return at.orderBy("_at", key).limit(most).select(key)


def last_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, value of its last row, and `place`: that of its first row, the order of the result."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.min(F.struct(*order)).alias("place"))


def bounded(rows: DataFrame, order: list, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """The first rows, and a row that tells how many there are and how many were left out; the caller keeps the whole."""
    total = F.count(F.lit(1))
    return rows.orderBy(*order).limit(most), rows.agg(total.alias("total"), F.greatest(total - most, F.lit(0)).alias("omitted"))


def test_terms(value: Column) -> Column:
    """Distinct parts of a query, path or symbol, first ones first; parts with underscores also by their pieces."""
    parts = F.filter(F.split(value, "[^A-Za-z0-9_]+"), lambda p: (p != "") & ~p.isin(*COMMON_PARTS))
    pieces = lambda p: F.when(p.contains("_"), F.filter(F.split(p, "_"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), pieces(p)))))


def source_range(lines: DataFrame, start: int, end: int, cap: int) -> DataFrame:
    """path, start_line, end_line, source: lines from start to end, `cap` at most."""
    last = min(end, start + max(cap, 1) - 1)
    got = lines.filter(F.col("line_no").between(start, last)).groupBy("path")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return got.agg(text.alias("source")).select("path", F.lit(start).alias("start_line"), F.lit(last).alias("end_line"), "source")


def recall_of(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """query, expected, hits, recall: how many of a query's expected keys were found. Both have `query` and the keys."""
    here = found.select("query", *keys).distinct().withColumn("_hit", F.lit(1))
    j = expected.join(here, ["query", *keys], "left").groupBy("query").agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("hits"))
    return j.withColumn("recall", F.round(F.col("hits") / F.col("expected"), 6))


@query("SELECT path, line_no, text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = l.path AND f.size_bytes > 3000)", "files lines")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = views.files(spark, sf_dir).filter("size_bytes > 3000")
    return without_parents(views.lines(spark, sf_dir), gone, "path").select("path", "line_no", "text")


@query("SELECT scope, id FROM findings WHERE scope <> 'BUILDING' UNION ALL SELECT scope, id FROM findings WHERE scope = 'BUILDING' AND status = 'open'", "findings")
def baseline_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of one scope anew, the others as they were."""
    f = views.findings(spark, sf_dir).select("scope", "id", "status")
    return replaced(f, f.filter("scope = 'BUILDING' and status = 'open'"), "scope").select("scope", "id")


@query("SELECT f.id, coalesce(c.flag, f.status) AS status FROM findings f LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_returnflag)) AS flag FROM lineitem GROUP BY 1) c ON f.id = c.l_orderkey", "findings")
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("status"))
    return updated(views.findings(spark, sf_dir).select("id", "status"), changes, "id", "status")


@query("SELECT p_partkey AS k, count(event_id) AS retrievals FROM part LEFT JOIN ev ON ev.k = p_partkey GROUP BY 1", "events")
def retrieval_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return counted(stored, views.events(spark, sf_dir), "k", "retrievals")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' OR o_orderdate > DATE '1995-06-17'")
def expired_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders stand for results without an end."""
    ends = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("date"))
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ends.alias("expires"))
    return unexpired(o, "expires", F.lit("1995-06-17").cast("date")).select("id")


@query("SELECT k FROM (SELECT k, min(struct_pack(t := ts, e := event_id)) AS f FROM ev GROUP BY k) ORDER BY f, k LIMIT 12", "events")
def first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(views.events(spark, sf_dir), "k", ["ts", "event_id"], 12)


@query("SELECT session_id, arg_max(event_type, (ts, event_id)) AS event_type, min(struct_pack(t := ts, e := event_id)).e AS first_event FROM ev GROUP BY session_id", "events")
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = last_wins(views.events(spark, sf_dir), "session_id", "event_type", ["ts", "event_id"])
    return e.select("session_id", "event_type", F.col("place.event_id").alias("first_event"))


@query("SELECT language, median(line_count) AS middle FROM files GROUP BY language", "files")
def median_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).groupBy("language").agg(F.median("line_count").alias("middle"))


@query("SELECT (SELECT count(*) FROM findings WHERE status = 'open') AS total, greatest((SELECT count(*) FROM findings WHERE status = 'open') - 25, 0) AS omitted, id FROM (SELECT id FROM findings WHERE status = 'open' ORDER BY confidence DESC, id LIMIT 25)", "findings")
def bounded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, rest = bounded(views.findings(spark, sf_dir).filter("status = 'open'"), [F.desc("confidence"), "id"])
    return head.select("id").crossJoin(F.broadcast(rest))  # rest is one row


@query("SELECT path, list_filter(string_split_regex(path, '[^A-Za-z0-9_]+'), lambda p: p <> '' AND p NOT IN ('src', 'tests', 'test', 'py', 'python'))[1:2] AS first_terms, list_contains(list_filter(string_split(regexp_extract(path, '[^/]*$'), '_'), lambda p: p <> ''), 'doc') AS of_doc FROM files", "files")
def term_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = test_terms(F.col("path"))
    return views.files(spark, sf_dir).select("path", F.slice(terms, 1, 2).alias("first_terms"), F.array_contains(terms, "doc").alias("of_doc"))


@query("SELECT path, CAST(2 AS INTEGER) AS start_line, CAST(4 AS INTEGER) AS end_line, string_agg(text, chr(10) ORDER BY line_no) AS source FROM lines WHERE line_no BETWEEN 2 AND 4 GROUP BY path", "lines")
def source_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_range(views.lines(spark, sf_dir), 2, 9, 3)


@query("SELECT severity AS query, count(*) AS expected, count(*) FILTER (WHERE l_orderkey IS NOT NULL) AS hits, round(count(*) FILTER (WHERE l_orderkey IS NOT NULL) / count(*), 6) AS recall FROM findings LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON id = l_orderkey WHERE status = 'resolved' GROUP BY severity", "findings")
def expected_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir)
    passed = views.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    expected = f.filter("status = 'resolved'").select(F.col("severity").alias("query"), "id")
    return recall_of(expected, f.select(F.col("severity").alias("query"), "id").join(passed, "id"), ["id"])
