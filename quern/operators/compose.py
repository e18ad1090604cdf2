"""Tolerant readers and composed answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import certainty, dirname, slug, truncated
from quern.plans import views
from quern.registry import query

def tokens_of(text: str) -> list[str]:
    """Words of a question that count: two letters and more."""
    return [t for t in text.split() if len(t) >= 2]


def any_token(df: DataFrame, column: str, text: str) -> DataFrame:
    """For a question of two words and more: the mean score over its words, misses included, of rows that hit any."""
    tokens = tokens_of(text)
    hit = [F.when(F.lower(column).contains(t.lower()), 100.0).otherwise(0.0) for t in tokens]
    return df.withColumn("score", reduce(lambda a, b: a + b, hit) / len(tokens)).filter("score > 0")


def as_int(value: Column, default: int) -> Column:
    """Numbers in text as whole numbers; booleans and what isn't a number are the default."""
    v = F.trim(value.cast("string"))
    return F.when(F.lower(v).isin("true", "false"), default).otherwise(F.coalesce(F.try_to_number(F.when(v.rlike(r"^[+-]?\d{1,9}$"), v), F.lit("S999999999")).cast("int"), F.lit(default)))


def first_filled(*columns: Column) -> Column:
    """The first of some aliases that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def without_fence(text: Column) -> Column:
    """What is inside a code fence, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def records(payload: Column) -> Column:
    """A JSON payload's records as an array of variants: a list itself, the first of some usual fields, else the whole."""
    v = F.try_parse_json(payload)
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.items", "$.results", "$.matches", "$.symbols", "$.records")]
    return F.coalesce(*lists, F.array(v))


def clipped(text: Column, most: int = 256) -> Column:
    return F.struct(F.substring(text, 1, most).alias("preview"), F.greatest(F.length(text) - most, F.lit(0)).alias("omitted"))


@query("SELECT p_partkey AS id, score FROM (SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'blue') THEN 100.0 ELSE 0.0 END + CASE WHEN contains(lower(p_name), 'ring') THEN 100.0 ELSE 0.0 END)::DOUBLE / 2 AS score FROM part) WHERE score > 0")
def token_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return any_token(views.table(spark, sf_dir, "part"), "p_name", "blue ring a").select(F.col("p_partkey").alias("id"), "score")


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN CAST(k AS INTEGER) ELSE -1 END AS n, coalesce(nullif(CASE WHEN k % 2 = 0 THEN '' ELSE event_type END, ''), 's' || session_id) AS label FROM ev""", "events")
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), F.col("k").cast("string"))).when(F.col("k") % 3 == 1, "true").otherwise("x1")
    return views.events(spark, sf_dir).select("event_id", as_int(raw, -1).alias("n"), first_filled(F.when(F.col("k") % 2 == 0, " ").otherwise(F.col("event_type")), F.concat(F.lit("s"), F.col("session_id").cast("string"))).alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_id", F.explode(records(F.concat(F.lit('{"items": ['), F.col("props"), F.lit("]}")))).alias("r"))
    return e.select("event_id", F.try_variant_get("r", "$.k", "int").alias("k"))


@query("SELECT conv_id, turn, substr(text, 1, 256) AS preview, CAST(greatest(length(text) - 256, 0) AS INTEGER) AS omitted FROM conversations")
def output_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", clipped(F.col("text")).alias("c")).select("conv_id", "turn", "c.preview", "c.omitted")


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) > 200 THEN substr(trim(text), 1, 197) || '...' ELSE trim(text) END AS line FROM conversations")
def truncated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", truncated(without_fence(F.concat(F.lit("```text\n"), F.trim("text"), F.lit("\n```")))).alias("line"))


@query("""SELECT 'pytest ' || string_agg(path, ' ' ORDER BY path) AS command, count(*) AS tests FROM (SELECT DISTINCT t.path FROM files t JOIN files c ON t.language = c.language AND c.doc_id % 97 = 0 WHERE t.is_test)""", "files")
def select_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that belong to what changed, as one command."""
    f = views.files(spark, sf_dir)
    changed = f.filter("doc_id % 97 = 0").select(F.col("language").alias("_l")).distinct()
    t = f.filter("is_test").join(changed, F.col("language") == F.col("_l"), "left_semi").select("path")
    return t.agg(F.concat(F.lit("pytest "), F.array_join(F.sort_array(F.collect_list("path")), " ")).alias("command"), F.count(F.lit(1)).alias("tests"))


@query(""", seeds AS (SELECT path, language, line_count FROM files WHERE contains(lower(path), 'src1') ORDER BY line_count DESC, path LIMIT 5), related AS (SELECT f.path, count(*) AS n FROM files f JOIN seeds s ON f.language = s.language AND f.path <> s.path WHERE NOT f.is_test GROUP BY 1 ORDER BY n DESC, f.path LIMIT 10)
SELECT 'seed' AS part, path, line_count AS weight FROM seeds UNION ALL SELECT 'related', path, n FROM related""", "files")
def task_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to start, and what stands beside it."""
    f = views.files(spark, sf_dir)
    seeds = f.filter(F.lower("path").contains("src1")).orderBy(F.desc("line_count"), "path").limit(5).select("path", "language", "line_count")
    s = seeds.select(F.col("path").alias("_p"), F.col("language").alias("_l"))
    related = f.filter("not is_test").join(F.broadcast(s), (F.col("language") == F.col("_l")) & (F.col("path") != F.col("_p"))).groupBy("path").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "path").limit(10)
    return seeds.select(F.lit("seed").alias("part"), "path", F.col("line_count").alias("weight")).unionByName(related.select(F.lit("related").alias("part"), "path", "weight"))


@query(""", target AS (SELECT src FROM edges ORDER BY w DESC, src LIMIT 1), callers AS (SELECT 'caller' AS kind, e.src AS node, e.w AS weight FROM edges e JOIN target t ON e.dst = t.src ORDER BY e.w DESC, e.src LIMIT 10), callees AS (SELECT 'callee', e.dst, e.w FROM edges e JOIN target t ON e.src = t.src ORDER BY e.w DESC, e.dst LIMIT 10) SELECT * FROM callers UNION ALL SELECT * FROM callees""", "edges")
def refactor_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of the busiest node would touch, ten of a kind."""
    e = views.edges(spark, sf_dir)
    t = F.broadcast(e.orderBy(F.desc("w"), "src").limit(1).select(F.col("src").alias("_t")))
    callers = e.join(t, F.col("dst") == F.col("_t")).orderBy(F.desc("w"), "src").limit(10).select(F.lit("caller").alias("kind"), F.col("src").alias("node"), F.col("w").alias("weight"))
    callees = e.join(t, F.col("src") == F.col("_t")).orderBy(F.desc("w"), "dst").limit(10).select(F.lit("callee").alias("kind"), F.col("dst").alias("node"), F.col("w").alias("weight"))
    return callers.unionByName(callees)


@query("""SELECT f.id, rule_id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS certainty, history FROM findings f JOIN (SELECT l_orderkey, list(l_returnflag ORDER BY l_shipdate, l_linenumber, l_returnflag) AS history FROM lineitem GROUP BY 1) h ON f.id = h.l_orderkey""", "findings")
def explain_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding with its events in order."""
    h = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("history"))
    return views.findings(spark, sf_dir).join(h, F.col("id") == F.col("l_orderkey")).select("id", "rule_id", certainty(F.col("confidence")).alias("certainty"), "history")


@query("SELECT path, line_no, text FROM (SELECT l.path, l.line_no, l.text, row_number() OVER (PARTITION BY l.path ORDER BY l.line_no) AS r FROM lines l WHERE contains(lower(l.text), 'token')) WHERE r <= 3 ORDER BY path, line_no LIMIT 60", "lines")
def hook_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three matches of each file."""
    hits = views.lines(spark, sf_dir).filter(F.lower("text").contains("token"))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).filter("r <= 3").orderBy("path", "line_no").limit(60).select("path", "line_no", "text")


@query("SELECT path, count(*) AS siblings FROM (SELECT a.path FROM (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM files) a JOIN (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM files) b ON a.d = b.d AND a.path <> b.path) GROUP BY path", "files")
def same_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every file, from counts; pairs within a directory aren't made."""
    f = views.files(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("m")).withColumn("d", dirname(F.col("path")))
    n = f.groupBy(F.col("d").alias("_d")).agg(F.sum("m").alias("n"))
    return f.join(n, F.col("d") == F.col("_d")).filter("n > m").select("path", (F.col("m") * (F.col("n") - F.col("m"))).alias("siblings"))


@query("SELECT source AS pack, lower(source) AS slug, count(*) AS n FROM documents GROUP BY ALL")
def pack_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("pack")).agg(F.count(F.lit(1)).alias("n")).withColumn("slug", slug(F.col("pack")))
