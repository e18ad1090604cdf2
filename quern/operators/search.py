"""Search over paths, contents and markers; ranking signals; collapsing matches onto symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import smart_case
from quern.plans import views
from quern.registry import query

HALF_LIFE = 7 * 86400


def innermost(hits: DataFrame, spans: DataFrame, line: str = "line_no") -> DataFrame:
    """hits (path, line, ...) with the name and span of the smallest symbol around the line; equal sizes: the later start.

    The join has the path as its key and the span as a residual filter.
    """
    s = spans.select(F.col("path").alias("_p"), F.col("name").alias("symbol"), "start_line", "end_line")
    j = hits.join(s, (F.col("path") == F.col("_p")) & F.col(line).between(F.col("start_line"), F.col("end_line")), "left")
    best = F.struct((F.col("start_line") - F.col("end_line")).alias("tight"), "start_line", "symbol", "end_line")
    keys = hits.columns
    return j.groupBy(*keys).agg(F.max(F.when(F.col("symbol").isNotNull(), best)).alias("b")).select(*keys, F.col("b.symbol").alias("symbol"), F.col("b.start_line").alias("start_line"), F.col("b.end_line").alias("end_line"))


def latest_start(hits: DataFrame, spans: DataFrame, line: str = "line_no") -> DataFrame:
    """hits with the symbol around the line that starts last; on purpose not the smallest."""
    s = spans.select(F.col("path").alias("_p"), F.col("name").alias("symbol"), "start_line", "end_line")
    j = hits.join(s, (F.col("path") == F.col("_p")) & F.col(line).between(F.col("start_line"), F.col("end_line")), "left")
    return j.groupBy(*hits.columns).agg(F.max_by("symbol", F.struct("start_line", "symbol")).alias("symbol"), F.max("start_line").alias("start_line"))


def rank_boost(changed: Column, git: Column, frecency: Column, recent: Column, quality: Column) -> Column:
    """What the signals add to a match's score."""
    on = lambda c, w: F.when(c, F.lit(float(w))).otherwise(F.lit(0.0))
    return on(changed, 25) + on(git, 20) + 30.0 * F.least(frecency, F.lit(5.0)) + on(recent, 15) + quality


def decayed(weight: Column, age_seconds: Column) -> Column:
    """A weight that halves each week; the future doesn't add."""
    return weight * F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0)) / HALF_LIFE)


def path_score(path: Column, needle: str) -> Column:
    """0-100: a path that contains the needle is a full match; the rest is for the fuzzy operator."""
    return F.when(smart_case(path, needle), F.lit(100.0))


_PATH = "SELECT path, CAST(100 - (row_number() OVER (ORDER BY score DESC, path) - 1) AS BIGINT) AS rank, score FROM (SELECT path, 100.0::DOUBLE AS score FROM files WHERE contains(lower(path), 'src1/de')) ORDER BY score DESC, path LIMIT 20"


@query(_PATH, "files")
def path_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = views.files(spark, sf_dir).select("path", path_score(F.col("path"), "src1/de").alias("score")).filter("score is not null")
    top = hits.orderBy(F.desc("score"), "path").limit(20)
    return top.select("path", (100 - (F.row_number().over(Window.orderBy(F.desc("score"), "path")) - 1)).cast("long").alias("rank"), "score")


_HITS = "hits AS (SELECT path, line_no FROM lines WHERE contains(lower(text), 'license'))"
_INNER = """inner_hits AS (SELECT path, line_no, symbol, start_line, end_line FROM (SELECT h.path, h.line_no, s.name AS symbol, s.start_line, s.end_line, row_number() OVER (PARTITION BY h.path, h.line_no ORDER BY s.end_line - s.start_line, s.start_line DESC, s.name DESC) AS r
FROM hits h LEFT JOIN symbols s ON h.path = s.path AND h.line_no BETWEEN s.start_line AND s.end_line) WHERE r = 1)"""


def _license_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).filter(smart_case(F.col("text"), "license")).select("path", "line_no")


@query(f", {_HITS} SELECT path, line_no FROM hits ORDER BY path, line_no LIMIT 100", "lines")
def content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license_hits(spark, sf_dir).orderBy("path", "line_no").limit(100)


@query(f", {_HITS} SELECT path, count(*) AS matches FROM hits GROUP BY path", "lines")
def content_search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license_hits(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("matches"))


@query(f", {_HITS} SELECT DISTINCT path FROM hits", "lines")
def content_search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license_hits(spark, sf_dir).select("path").distinct()


@query(f", {_HITS}, {_INNER} SELECT path, symbol, count(*) AS matches, min(line_no) AS first_line FROM inner_hits GROUP BY path, symbol", "lines symbols")
def content_search_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = innermost(_license_hits(spark, sf_dir), views.symbols(spark, sf_dir))
    return hits.groupBy("path", "symbol").agg(F.count(F.lit(1)).alias("matches"), F.min("line_no").alias("first_line"))


@query(f", {_HITS}, {_INNER} SELECT path, line_no, symbol, start_line, end_line FROM inner_hits", "lines symbols")
def enclosing_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return innermost(_license_hits(spark, sf_dir), views.symbols(spark, sf_dir))


@query(f""", {_HITS} SELECT path, line_no, symbol, start_line FROM (SELECT h.path, h.line_no, s.name AS symbol, s.start_line, row_number() OVER (PARTITION BY h.path, h.line_no ORDER BY s.start_line DESC, s.name DESC) AS r
FROM hits h LEFT JOIN symbols s ON h.path = s.path AND h.line_no BETWEEN s.start_line AND s.end_line) WHERE r = 1""", "lines symbols")
def enclosing_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_start(_license_hits(spark, sf_dir), views.symbols(spark, sf_dir))


def multi_search(lines: DataFrame, patterns: dict[str, float]) -> DataFrame:
    """path, score, reasons, snippet_line: per path the best pattern's score, all patterns that hit, and the best hit's first line.

    One scan of the lines; a hit's score and line stay together.
    """
    hit = F.array_compact(F.array(*[F.when(smart_case(F.col("text"), p), F.struct(F.lit(float(w)).alias("w"), F.lit(p).alias("p"))) for p, w in patterns.items()]))
    rows = lines.select("path", "line_no", F.explode(hit).alias("h"))
    return rows.groupBy("path").agg(F.max("h.w").alias("score"), F.sort_array(F.collect_set("h.p")).alias("reasons"), F.min_by("line_no", F.struct(-F.col("h.w"), "line_no")).alias("snippet_line"))


@query("""SELECT path, max(w) AS score, list_sort(list(DISTINCT p)) AS reasons, arg_min(line_no, (-w, line_no)) AS snippet_line FROM (
SELECT path, line_no, 'license' AS p, 80.0::DOUBLE AS w FROM lines WHERE contains(lower(text), 'license') UNION ALL SELECT path, line_no, 'apache', 60.0 FROM lines WHERE contains(lower(text), 'apache') UNION ALL SELECT path, line_no, '@mail', 90.0 FROM lines WHERE contains(lower(text), '@mail')) GROUP BY path""", "lines")
def multi_content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_search(views.lines(spark, sf_dir), {"license": 80, "apache": 60, "@mail": 90})


@query(f"SELECT k AS path_key, round(sum(tokens * pow(0.5, greatest(epoch(TIMESTAMP '{views.NOW}') - epoch(ts), 0) / 604800.0)), 6) AS frecency FROM ev GROUP BY k", "events")
def frecency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.unix_timestamp(F.lit(views.NOW).cast("timestamp")) - F.col("ts").cast("timestamp").cast("double")
    return views.events(spark, sf_dir).groupBy(F.col("k").alias("path_key")).agg(F.round(F.sum(decayed(F.col("tokens"), age)), 6).alias("frecency"))


@query(f"SELECT DISTINCT k AS path_key FROM ev WHERE ts > TIMESTAMP '{views.NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{views.NOW}'", "events")
def recent_query_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(views.NOW).cast("timestamp_ntz")
    return views.events(spark, sf_dir).filter((F.col("ts") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now)).select(F.col("k").alias("path_key")).distinct()


@query(f""", fr AS (SELECT k, sum(tokens * pow(0.5, greatest(epoch(TIMESTAMP '{views.NOW}') - epoch(ts), 0) / 604800.0)) / 1000.0 AS f FROM ev GROUP BY k),
b AS (SELECT path, line_count, doc_id, contains(lower(path), 'src1') AS hit FROM files)
SELECT path, round(100.0 + CASE WHEN doc_id % 7 = 0 THEN 25.0 ELSE 0.0 END + CASE WHEN doc_id % 11 = 0 THEN 20.0 ELSE 0.0 END + 30.0 * least(coalesce(f, 0.0), 5.0) + CASE WHEN doc_id % 5 = 0 THEN 15.0 ELSE 0.0 END + CASE WHEN line_count >= 30 THEN -3.0 ELSE 2.0 END, 6) AS score,
list_filter([CASE WHEN doc_id % 7 = 0 THEN 'changed' END, CASE WHEN doc_id % 11 = 0 THEN 'git' END, CASE WHEN f > 0 THEN 'frecency' END, CASE WHEN doc_id % 5 = 0 THEN 'recent' END], lambda x: x IS NOT NULL) AS reasons FROM b LEFT JOIN fr ON fr.k = doc_id % 100 WHERE hit""", "files events")
def search_with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.unix_timestamp(F.lit(views.NOW).cast("timestamp")) - F.col("ts").cast("timestamp").cast("double")
    fr = views.events(spark, sf_dir).groupBy("k").agg((F.sum(decayed(F.col("tokens"), age)) / 1000.0).alias("f"))
    hits = views.files(spark, sf_dir).filter(smart_case(F.col("path"), "src1"))
    j = hits.join(fr, F.col("doc_id") % 100 == F.col("k"), "left")
    changed, git, recent = (F.col("doc_id") % n == 0 for n in (7, 11, 5))
    boost = rank_boost(changed, git, F.coalesce("f", F.lit(0.0)), recent, F.when(F.col("line_count") >= 30, -3.0).otherwise(2.0))
    reasons = F.array_compact(F.array(F.when(changed, "changed"), F.when(git, "git"), F.when(F.col("f") > 0, "frecency"), F.when(recent, "recent")))
    return j.select("path", F.round(100.0 + boost, 6).alias("score"), reasons.alias("reasons"))


def markers(lines: DataFrame, weights: dict[str, float], wanted: str = "") -> DataFrame:
    """path, line_no, marker, note, score: lines with one of the marker words; 80, what the marker adds, and for `wanted` 15 if the path and 20 if the line has it.

    Lines of which neither does are left out.
    """
    rx = rf"\b({'|'.join(weights)})\b:?\s*(.*)"
    marker = F.regexp_extract("text", rx, 1)
    added = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("marker")), F.lit(0.0))
    in_path, in_line = (smart_case(F.col(c), wanted) if wanted else F.lit(False) for c in ("path", "text"))
    score = 80.0 + added + F.when(in_path, 15.0).otherwise(0.0) + F.when(in_line, 20.0).otherwise(0.0)
    hit = lines.withColumn("marker", marker).filter("marker <> ''").filter(in_path | in_line | F.lit(not wanted))
    return hit.select("path", "line_no", "marker", F.trim(F.substring(F.regexp_extract("text", rx, 2), 1, 60)).alias("note"), score.alias("score"))


@query("""SELECT path, line_no, marker, trim(substr(regexp_extract(text, '\\b(Licensed|token|idiot)\\b:?\\s*(.*)', 2), 1, 60)) AS note, CAST(80.0 + CASE marker WHEN 'Licensed' THEN 12.0 WHEN 'token' THEN 10.0 ELSE 8.0 END + CASE WHEN contains(lower(path), 'src1') THEN 15.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'src1') THEN 20.0 ELSE 0.0 END AS DOUBLE) AS score
FROM (SELECT *, regexp_extract(text, '\\b(Licensed|token|idiot)\\b:?\\s*(.*)', 1) AS marker FROM lines) WHERE marker <> '' AND (contains(lower(path), 'src1') OR contains(lower(text), 'src1'))""", "lines")
def marker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers(views.lines(spark, sf_dir), {"Licensed": 12.0, "token": 10.0, "idiot": 8.0}, "src1")


_TERMS = ("src1", "doc", "license")


@query("""SELECT path, CAST(40.0 + 35.0 * p + 20.0 * coalesce(l, 0) AS DOUBLE) AS score FROM (SELECT path, CAST(contains(lower(path), 'src1') AS INT) + CAST(contains(lower(path), 'doc') AS INT) + CAST(contains(lower(path), 'license') AS INT) AS p FROM files WHERE is_test) f
LEFT JOIN (SELECT path AS lp, count(DISTINCT t) AS l FROM (SELECT path, unnest(['src1', 'doc', 'license']) AS t, lower(text) AS x FROM lines) WHERE contains(x, t) GROUP BY path) ON path = lp WHERE p > 0 OR l > 0""", "files lines")
def test_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = sum((F.lower("path").contains(t).cast("int") for t in _TERMS), F.lit(0))
    f = views.files(spark, sf_dir).filter("is_test").select("path", hits.alias("p"))
    per_line = views.lines(spark, sf_dir).filter(F.col("path").startswith("tests/")).groupBy(F.col("path").alias("lp")).agg(*[F.max(F.lower("text").contains(t)).cast("int").alias(f"t{i}") for i, t in enumerate(_TERMS)])
    j = f.join(per_line.select("lp", sum((F.col(f"t{i}") for i in range(len(_TERMS))), F.lit(0)).alias("l")), F.col("path") == F.col("lp"), "left")
    return j.filter("p > 0 or l > 0").select("path", (40.0 + 35.0 * F.col("p") + 20.0 * F.coalesce("l", F.lit(0))).alias("score"))


@query("SELECT path, line_no, text AS snippet FROM (SELECT path, line_no, string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS text, contains(lower(text), 'license') AS hit FROM lines) WHERE hit", "lines")
def snippet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(-2, 1)
    hits = _license_hits(spark, sf_dir).select(F.col("path").alias("_p")).distinct()
    near = views.lines(spark, sf_dir).join(hits, F.col("path") == F.col("_p"), "left_semi")
    return near.withColumn("snippet", F.array_join(F.collect_list("text").over(w), "\n")).filter(smart_case(F.col("text"), "license")).select("path", "line_no", "snippet")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%r_ng%' ORDER BY p_name, p_partkey LIMIT 11 OFFSET 10")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more row than the page of ten tells whether there are more."""
    return views.table(spark, sf_dir, "part").filter(F.lower("p_name").like("%r_ng%")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).orderBy("name", "id").offset(10).limit(11)


@query("SELECT path, caller, call_text, site, line FROM call_edges WHERE lower(call_text) LIKE '%blue_b%' ORDER BY call_text, site, line, caller LIMIT 50", "call_edges")
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.call_edges(spark, sf_dir).filter(F.lower("call_text").like("%blue_b%")).orderBy("call_text", "site", "line", "caller").limit(50)


@query("SELECT caller, count(*) AS calls, CAST(CASE WHEN count(*) > 1 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM call_edges WHERE path = 'Brand#11' GROUP BY caller", "call_edges")
def find_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.call_edges(spark, sf_dir).filter("path = 'Brand#11'").groupBy("caller").agg(F.count(F.lit(1)).alias("calls")).select("caller", "calls", F.when(F.col("calls") > 1, 0.6).otherwise(0.4).alias("confidence"))


@query("SELECT caller, call_text, count(*) AS calls FROM call_edges WHERE lower(caller) LIKE '%1%' AND path NOT IN ('Brand#11', 'Brand#12') GROUP BY ALL", "call_edges")
def find_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = ("Brand#11", "Brand#12")
    return views.call_edges(spark, sf_dir).filter(F.lower("caller").like("%1%") & ~F.col("path").isin(*stop)).groupBy("caller", "call_text").agg(F.count(F.lit(1)).alias("calls"))
