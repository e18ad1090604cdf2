"""Session logs, stored results, token accounting, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import TOKEN_RUN, annotation_escape, scrubbed, short_hash, slug, token_estimate_bytes, token_estimate_runs
from quern.plans import views
from quern.registry import query


def session_totals(events: DataFrame) -> DataFrame:
    """One row a session: counters and sums by event type in a single pass, and the share of good retrievals."""
    is_ = lambda t: F.col("event_type") == t
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(is_("view")).alias("retrievals"), F.count_if(is_("error")).alias("errors"), F.count_if(is_("purchase")).alias("resolved"),
        F.round(F.sum(F.when(is_("view"), F.col("tokens")).otherwise(0.0)), 6).alias("view_tokens"), F.round(F.coalesce(F.try_divide(F.count_if(is_("purchase")), F.count_if(is_("view"))), F.lit(0.0)), 6).alias("rate"),
    )


_STATS = """SELECT session_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'view') AS retrievals, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS resolved,
round(sum(CASE WHEN event_type = 'view' THEN tokens ELSE 0.0 END), 6) AS view_tokens, round(coalesce(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 0.0), 6) AS rate FROM ev GROUP BY session_id"""


@query(_STATS, "events")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_totals(views.events(spark, sf_dir))


@query("SELECT session_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, k) AS r FROM (SELECT session_id, k, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1)) WHERE r <= 10", "events")
def repeated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.events(spark, sf_dir).groupBy("session_id", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "k"))).filter("r <= 10").drop("r")


@query("SELECT event_type AS tool, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, tool LIMIT 5", "events")
def top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tool").limit(5)


@query("""SELECT s.session_id, passed, CAST(greatest(coalesce(last_event, TIMESTAMP '1970-01-01'), coalesce(last_run, TIMESTAMP '1970-01-01')) AS TIMESTAMP) AS last_seen FROM (SELECT session_id, max(ts) AS last_event FROM ev GROUP BY 1) s
LEFT JOIN (SELECT session_id, arg_max(event_id, (ts, event_id)) AS passed, max(ts) AS last_run FROM ev WHERE event_type = 'purchase' GROUP BY 1) p ON s.session_id = p.session_id""", "events")
def session_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session the latest passing run and the latest sign of life in either log."""
    e = views.events(spark, sf_dir)
    seen = e.groupBy("session_id").agg(F.max("ts").alias("last_event"))
    runs = e.filter("event_type = 'purchase'").groupBy(F.col("session_id").alias("_s")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("passed"), F.max("ts").alias("last_run"))
    never = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return seen.join(runs, F.col("session_id") == F.col("_s"), "left").select("session_id", "passed", F.greatest(F.coalesce("last_event", never), F.coalesce("last_run", never)).alias("last_seen"))


@query("SELECT event_id, substr(regexp_replace(regexp_replace(lower(trim('Tool ' || event_type || '/' || session_id)), '[^a-z0-9_.:-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug, substr(sha256(props), 1, 16) AS fingerprint FROM ev", "events")
def event_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as slugs; what isn't allowed in the log as a fingerprint."""
    name = F.concat(F.lit("Tool "), F.col("event_type"), F.lit("/"), F.col("session_id").cast("string"))
    return views.events(spark, sf_dir).select("event_id", slug(name).alias("slug"), short_hash(F.col("props"), 16).alias("fingerprint"))


def debounced(events: DataFrame, key: str, value: str, window_seconds: float) -> DataFrame:
    """key, value, started, fired: runs in which the value stays the same for the window; a changed value starts anew."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    e = events.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("_next", F.lead("ts").over(w))
    runs = e.groupBy(key, "_run").agg(F.first(value).alias(value), F.min("ts").alias("started"), F.max(F.coalesce("_next", "ts")).alias("_end"))
    long = F.col("_end").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double") >= window_seconds
    return runs.filter(long).select(key, value, "started")


@query("""SELECT session_id, event_type, started FROM (SELECT session_id, run, any_value(event_type) AS event_type, min(ts) AS started, max(coalesce(nxt, ts)) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT *, CAST(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS INT) AS new, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS nxt FROM ev)) GROUP BY session_id, run) WHERE epoch(e) - epoch(started) >= 86400""", "events")
def debounce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounced(views.events(spark, sf_dir), "session_id", "event_type", 86400)


def even_sample(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """k rows of each key, evenly spread over its order: places round(i (n - 1) / (k - 1)), halves to even; all of fewer."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1), 0).cast("int"))
    return placed.filter((F.col("_n") <= k) | F.array_contains(spread, F.col("_r"))).drop("_r", "_n")


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND contains(lower(text), 'th') ORDER BY conv_id, turn LIMIT 100")
def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").filter((F.col("role") == "user") & F.lower("text").contains("th")).orderBy("conv_id", "turn").limit(100).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 3 OR r IN (0, CAST(round_even((n - 1) / 2.0, 0) AS INT), n - 1)""")
def retrieve_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return even_sample(views.table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 3).select("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN 75 < (SELECT count(*) FROM conversations) THEN 75 END AS next_cursor FROM conversations ORDER BY conv_id, turn LIMIT 25 OFFSET 50")
def retrieve_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    total = c.agg(F.count(F.lit(1)).alias("total"))
    page = c.orderBy("conv_id", "turn").offset(50).limit(25)
    return page.crossJoin(F.broadcast(total)).select("conv_id", "turn", F.when(F.col("total") > 75, 75).alias("next_cursor"))  # total is one row


@query("SELECT count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1995-01-01') AS removed, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1995-01-01') AS kept FROM orders")
def ttl_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return views.table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderdate") <= now).alias("removed"), F.count_if(F.col("o_orderdate") > now).alias("kept"))


@query("SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS records FROM conversations GROUP BY conv_id ORDER BY bytes DESC, conv_id LIMIT 20")
def largest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("records")).orderBy(F.desc("bytes"), "conv_id").limit(20)


@query("SELECT DISTINCT ON (conv_id) conv_id, turn, role FROM conversations ORDER BY conv_id, turn DESC")
def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each id wins."""
    return views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "role"), "turn").alias("x")).select("conv_id", "x.turn", "x.role")


_RUNS = f"list_sum(list_transform(regexp_extract_all(text, '{TOKEN_RUN}'), lambda r: CAST(ceil(length(r) / 4) AS BIGINT)))"


@query(f"SELECT doc_id, CAST(coalesce({_RUNS}, 0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", token_estimate_runs(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) + length(text) - length(replace(text, chr(10), '')) AS tokens FROM documents")
def token_estimates_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", token_estimate_bytes(F.col("text")).alias("tokens"))


@query(f"SELECT lang, round(sum(ours) / sum(naive), 6) AS ratio FROM (SELECT lang, {_RUNS.replace('text', 'substr(text, 1, 200)')} AS ours, {_RUNS} AS naive FROM documents) GROUP BY lang")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("lang", token_estimate_runs(F.substring("text", 1, 200)).alias("ours"), token_estimate_runs(F.col("text")).alias("naive"))
    return d.groupBy("lang").agg(F.round(F.sum("ours") / F.sum("naive"), 6).alias("ratio"))


_SCRUB_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'(?i)(^|[^0-9A-Za-z_])(api[_-]?key|secret|token|password|passwd|pwd|authorization|bearer)[ \t\n\x0B\f\r]*[:=][ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+', '\1\2=[redacted]', 'g'),
'[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[redacted]', 'g'),
'(^|[^0-9A-Za-z_])AKIA[0-9A-Z]{16}\b', '\1[redacted]', 'g'),
'(^|[^0-9A-Za-z_])(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]+', '\1[redacted]', 'g'),
'(^|[^0-9A-Za-z_])gh[posru]_[A-Za-z0-9]{20,}', '\1[redacted]', 'g'),
'(^|[^0-9A-Za-z_])xox[baprs]-[A-Za-z0-9-]+', '\1[redacted]', 'g'),
'(^|[^0-9A-Za-z_])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '\1[redacted]', 'g'),
'(^|[^0-9A-Za-z_])[A-Za-z0-9][A-Za-z0-9+/]{39,}={0,2}\b', '\1[redacted]', 'g'),
'(^|[^0-9A-Za-z_])[0-9a-fA-F]{32,}\b', '\1[redacted]', 'g')"""


@query(f"SELECT doc_id, sha256(clean) AS clean_hash FROM (SELECT doc_id, text, {_SCRUB_SQL} AS clean FROM documents) WHERE clean <> text")
def scrub_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id", "text", scrubbed(F.col("text")).alias("clean"))
    return d.filter("clean <> text").select("doc_id", F.sha2("clean", 256).alias("clean_hash"))


@query(f", t AS (SELECT path, line_count, CAST({_RUNS} AS BIGINT) AS tokens FROM files), c AS (SELECT path, tokens, sum(tokens) OVER (ORDER BY line_count DESC, path ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM t ORDER BY line_count DESC, path LIMIT 50)) SELECT path, tokens, CAST(used AS BIGINT) AS used FROM c WHERE used <= 20000", "files")
def answer_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty first files, as far as the budget goes."""
    top = views.files(spark, sf_dir).orderBy(F.desc("line_count"), "path").limit(50).select("path", "line_count", token_estimate_runs(F.col("text")).alias("tokens"))
    w = Window.orderBy(F.desc("line_count"), "path").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("used", F.sum("tokens").over(w)).filter("used <= 20000").select("path", "tokens", "used")


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_index and one JSON result for each finding; rules count from their first appearance by id."""
    first = findings.groupBy("rule_id").agg(F.min("id").alias("first"))
    index = first.select(F.col("rule_id").alias("_r"), (F.row_number().over(Window.orderBy("first")) - 1).alias("rule_index"))  # one row a rule
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")))
    return findings.join(F.broadcast(index), F.col("rule_id") == F.col("_r")).select("id", "rule_index", result.alias("result"))


@query(""", idx AS (SELECT rule_id AS r, CAST(row_number() OVER (ORDER BY min(id)) - 1 AS INTEGER) AS rule_index FROM findings GROUP BY 1)
SELECT id, rule_index, '{"ruleId":"' || rule_id || '","ruleIndex":' || rule_index || ',"level":"' || CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || rule_id || ' in ' || scope || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file_path || '"},"region":{"startLine":1}}}]}' AS result FROM findings JOIN idx ON rule_id = r""", "findings")
def sarif_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir).withColumn("message", F.concat("rule_id", F.lit(" in "), "scope")).withColumn("line", F.lit(None).cast("int"))
    return sarif_results(f)


@query("SELECT id, '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' file=' || replace(file_path, '#', '%23') || ',line=1::' || replace(rule_id || chr(10) || '100% ' || scope, '%', '%25').replace(chr(10), '%0A') AS annotation FROM (SELECT * FROM findings WHERE status = 'open')".replace("replace(rule_id || chr(10) || '100% ' || scope, '%', '%25').replace(chr(10), '%0A')", "replace(replace(rule_id || chr(10) || '100% ' || scope, '%', '%25'), chr(10), '%0A')").replace("replace(file_path, '#', '%23')", "file_path"), "findings")
def github_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    level: Column = F.when(F.col("severity") == "info", "notice").otherwise(F.col("severity"))
    message = F.concat("rule_id", F.lit("\n100% "), "scope")
    return views.findings(spark, sf_dir).filter("status = 'open'").select("id", F.concat(F.lit("::"), level, F.lit(" file="), annotation_escape(F.col("file_path"), value=True), F.lit(",line=1::"), annotation_escape(message)).alias("annotation"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents) a JOIN (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents) b ON b.doc_id = a.doc_id + 1")
def neighbour_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set score of each document and the next: shared over all words."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", " ", -1)).alias("w"))
    b = d.select((F.col("doc_id") - 1).alias("_d"), F.col("w").alias("v"))
    return d.join(b, F.col("doc_id") == F.col("_d")).select("doc_id", F.round(F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")), 6).alias("jaccard"))
