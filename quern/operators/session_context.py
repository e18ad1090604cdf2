"""What a session has cost and spared: tokens by type of event, most used tools, repeated broad queries, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans import views
from quern.registry import query

#: The first events of a session that count, and how many of each list are told.
EVENTS, LARGEST, TOOLS, REPEATED, WARNINGS = 500, 5, 5, 10, 10
#: Types of events.
CALLED, SUMMARISED, RETRIEVED, REPEATED_QUERY, EXACT, WARNED, RESOLVED = (
    "tool_called",
    "large_result_summarized",
    "result_retrieved",
    "agent_repeated_query",
    "agent_requested_exact_large_result",
    "server_warning_returned",
    "structural_backend_resolved",
)


def _whole(payload: Column, field: str) -> Column:
    """A whole number of the payload; 0 for anything else."""
    v = F.try_variant_get(payload, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(payload, f"$.{field}", "long")).otherwise(0)


def _text(payload: Column, field: str) -> Column:
    return F.nullif(F.try_variant_get(payload, f"$.{field}", "string"), F.lit(""))


def _ranked(rows: DataFrame, by: list[str], order: list, most: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= most)


def context_stats(events: DataFrame, external: str) -> DataFrame:
    """One row a session: counters, sums of tokens, and the lists, each entry a text with its parts set off by colons.

    events: (session_id, created_at, id, event_type, tool_name, payload), the
    payload JSON text. Only a session's first EVENTS events count. external:
    the backend whose share of resolutions is told. Sessions without a name
    are one session.
    """
    first = _ranked(events, ["session_id"], ["created_at", "id"], F.lit(EVENTS)).drop("_r")
    v = F.col("_v")
    of = first.withColumn("_v", F.try_parse_json("payload")).select(
        "session_id", "id", "event_type", F.coalesce(F.nullif("tool_name", F.lit("")), F.lit("unknown")).alias("tool"),
        _whole(v, "raw_tokens").alias("raw"), _whole(v, "returned_tokens").alias("returned"), F.coalesce(F.try_variant_get(v, "$.broad_query", "boolean"), F.lit(False)).alias("broad"),
        F.coalesce(_text(v, "input_fingerprint"), _text(v, "query_fingerprint"), F.lit("unknown")).alias("print"), _whole(v, "retrieval_count").alias("again"),
        F.coalesce(_text(v, "warning_code"), F.lit("unspecified")).alias("code"), _whole(v, "warning_count").alias("warned"), _text(v, "backend_name").alias("backend"),
    )
    is_ = lambda *t: F.col("event_type").isin(*t)
    total = lambda c, *t: F.sum(F.when(is_(*t), c).otherwise(0)).cast("long")
    told = (SUMMARISED, RETRIEVED, EXACT)
    sums = of.groupBy("session_id").agg(
        F.count_if(is_(CALLED)).alias("tool_calls"), F.count_if(is_(SUMMARISED)).alias("summarized_results"), F.count_if(is_(RETRIEVED)).alias("retrievals"),
        total(F.col("raw"), *told).alias("raw_tokens"), total(F.col("returned"), *told).alias("returned_tokens"), total(F.greatest(F.col("raw") - F.col("returned"), F.lit(0)), SUMMARISED).alias("avoided_tokens"),
        F.count_if(is_(RESOLVED)).alias("resolutions"), F.count_if(is_(RESOLVED) & (F.col("backend") == external)).alias("external_resolutions"),
    )
    entry = lambda when, kind, a, b, n: F.when(when, F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), n.cast("long").alias("n")))
    none, one = F.lit(""), F.lit(1)
    entries = F.array_compact(F.array(
        entry(is_(CALLED), "tools", F.col("tool"), none, one), entry(is_(CALLED) & F.col("broad"), "repeated", F.col("tool"), F.col("print"), one),
        entry(is_(REPEATED_QUERY), "repeated", F.col("tool"), F.col("print"), F.greatest("again", one)), entry(is_(WARNED), "warnings", F.col("code"), none, F.greatest("warned", one)),
    ))
    counted = of.select("session_id", F.inline(entries)).groupBy("session_id", "kind", "a", "b").agg(F.sum("n").alias("n")).filter("kind <> 'repeated' or n > 1")
    most = F.when(F.col("kind") == "tools", TOOLS).when(F.col("kind") == "repeated", REPEATED).otherwise(WARNINGS)
    text = F.when(F.col("kind") == "tools", F.col("a")).when(F.col("kind") == "repeated", F.concat_ws(":", "a", "b", "n")).otherwise(F.concat_ws(":", "a", "n"))
    lists = _ranked(counted, ["session_id", "kind"], [F.desc("n"), "a", "b"], most).select("session_id", "kind", "_r", text.alias("text"))
    large = _ranked(of.filter(is_(SUMMARISED)), ["session_id"], [F.desc("raw"), "tool", "print", "id"], F.lit(LARGEST))
    lists = lists.unionByName(large.select("session_id", F.lit("largest").alias("kind"), "_r", F.concat_ws(":", "tool", "print", "raw", "returned").alias("text")))
    named = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("_r", "text")))), lambda x: x["text"]).alias(kind)
    by_session = lists.groupBy(F.col("session_id").alias("_s")).agg(*[named(k) for k in ("tools", "repeated", "warnings", "largest")])
    empty = F.array().cast("array<string>")
    j = sums.join(by_session, F.col("session_id").eqNullSafe(F.col("_s")), "left")
    rate = F.when(F.col("resolutions") > 0, F.round(F.col("external_resolutions") / F.col("resolutions"), 6)).otherwise(0.0)
    return j.select(*sums.columns, rate.alias("external_rate"), *[F.coalesce(k, empty).alias(k) for k in ("tools", "repeated", "warnings", "largest")])


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a log of all seven types, with payloads; the type of an event tells the family, its k the rest."""
    k = F.col("k")
    kind = F.when(F.col("event_type") == "click", F.lit(CALLED)).when(F.col("event_type") == "view", F.lit(SUMMARISED)).when(F.col("event_type") == "purchase", F.when(k < 50, RETRIEVED).otherwise(EXACT)).when(F.col("event_type") == "signup", F.lit(REPEATED_QUERY)).otherwise(F.when(k < 50, WARNED).otherwise(RESOLVED))
    raw, returned = F.col("tokens").cast("int") * 10, k
    text = F.to_json(F.struct(
        raw.alias("raw_tokens"), returned.alias("returned_tokens"), (k % 3 == 0).alias("broad_query"), F.when(k % 4 != 0, F.concat(F.lit("q"), (k % 5).cast("string"))).alias("query_fingerprint"), F.when(k % 2 == 0, F.concat(F.lit("i"), (k % 6).cast("string"))).alias("input_fingerprint"),
        F.when(k % 7 != 0, k % 4).alias("retrieval_count"), F.when(k % 5 != 0, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("warning_code"), (k % 2).alias("warning_count"), F.when(k % 2 == 0, "graph").otherwise("native").alias("backend_name"),
    ))
    e = views.events(spark, sf_dir)
    return e.select("session_id", F.col("ts").alias("created_at"), F.col("event_id").alias("id"), kind.alias("event_type"), F.when(k % 11 != 0, F.concat(F.lit("tool_"), (k % 8).cast("string"))).alias("tool_name"), text.alias("payload"))


@query(""", log AS (SELECT session_id, event_id AS id, CASE event_type WHEN 'click' THEN 'called' WHEN 'view' THEN 'summarised' WHEN 'purchase' THEN CASE WHEN k < 50 THEN 'retrieved' ELSE 'exact' END WHEN 'signup' THEN 'again' ELSE CASE WHEN k < 50 THEN 'warned' ELSE 'resolved' END END AS t,
 coalesce(CASE WHEN k % 11 <> 0 THEN 'tool_' || k % 8 END, 'unknown') AS tool, CAST(trunc(tokens) AS BIGINT) * 10 AS raw, k AS returned, k % 3 = 0 AS broad, coalesce(CASE WHEN k % 2 = 0 THEN 'i' || k % 6 END, CASE WHEN k % 4 <> 0 THEN 'q' || k % 5 END, 'unknown') AS print,
 greatest(coalesce(CASE WHEN k % 7 <> 0 THEN k % 4 END, 0), 1) AS again, coalesce(CASE WHEN k % 5 <> 0 THEN 'w' || k % 3 END, 'unspecified') AS code, greatest(k % 2, 1) AS warned, k % 2 = 0 AS external FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) <= 500),
sums AS (SELECT session_id, count(*) FILTER (WHERE t = 'called') AS tool_calls, count(*) FILTER (WHERE t = 'summarised') AS summarized_results, count(*) FILTER (WHERE t = 'retrieved') AS retrievals, CAST(sum(CASE WHEN t IN ('summarised', 'retrieved', 'exact') THEN raw ELSE 0 END) AS BIGINT) AS raw_tokens,
 CAST(sum(CASE WHEN t IN ('summarised', 'retrieved', 'exact') THEN returned ELSE 0 END) AS BIGINT) AS returned_tokens, CAST(sum(CASE WHEN t = 'summarised' THEN greatest(raw - returned, 0) ELSE 0 END) AS BIGINT) AS avoided_tokens, count(*) FILTER (WHERE t = 'resolved') AS resolutions, count(*) FILTER (WHERE t = 'resolved' AND external) AS external_resolutions FROM log GROUP BY session_id),
tools AS (SELECT session_id, list(tool ORDER BY n DESC, tool)[1:5] AS x FROM (SELECT session_id, tool, count(*) AS n FROM log WHERE t = 'called' GROUP BY ALL) GROUP BY session_id),
repeated AS (SELECT session_id, list(tool || ':' || print || ':' || n ORDER BY n DESC, tool, print)[1:10] AS x FROM (SELECT session_id, tool, print, CAST(sum(CASE WHEN t = 'again' THEN again ELSE 1 END) AS BIGINT) AS n FROM log WHERE t = 'again' OR (t = 'called' AND broad) GROUP BY ALL HAVING n > 1) GROUP BY session_id),
warnings AS (SELECT session_id, list(code || ':' || n ORDER BY n DESC, code)[1:10] AS x FROM (SELECT session_id, code, CAST(sum(warned) AS BIGINT) AS n FROM log WHERE t = 'warned' GROUP BY ALL) GROUP BY session_id),
largest AS (SELECT session_id, list(tool || ':' || print || ':' || raw || ':' || returned ORDER BY raw DESC, tool, print, id)[1:5] AS x FROM log WHERE t = 'summarised' GROUP BY session_id)
SELECT s.*, CAST(CASE WHEN resolutions > 0 THEN round(external_resolutions / resolutions, 6) ELSE 0 END AS DOUBLE) AS external_rate, coalesce(a.x, []) AS tools, coalesce(b.x, []) AS repeated, coalesce(c.x, []) AS warnings, coalesce(d.x, []) AS largest
FROM sums s LEFT JOIN tools a USING (session_id) LEFT JOIN repeated b USING (session_id) LEFT JOIN warnings c USING (session_id) LEFT JOIN largest d USING (session_id)""", "events")  # fmt: skip
def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_stats(session_log(spark, sf_dir), external="graph")
