"""Nested JSON: all its strings with the keys above them, and records filtered by them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.compose import records
from quern.plans import views
from quern.registry import query
from quern.sources.folders import kept

#: Fields that tell of a file, a symbol and a kind.
FILE_FIELDS = ("file", "path", "file_path")
SYMBOL_FIELDS = ("symbol", "name", "qualified_name", "reference_text", "call_text")
KIND_FIELDS = ("type", "kind", "result_type")
#: Levels that a pass descends.
LEVELS = 4
#: Events whose payloads one task makes; an event of some ten bytes in its file makes several hundred.
EVENTS_A_TASK = 20_000


def strings(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, path (the object keys above the string, outermost first), value: every string in a variant, at any depth.

    All rows descend LEVELS levels in one pass, as long as some hold an object
    or a list; a pass is written once. Numbers, booleans and nulls are no strings.
    """
    rest = rows.select(*keys, F.array().cast("array<string>").alias("path"), F.col(payload).alias("v"))
    found = []
    kind = F.schema_of_variant("v")
    holds = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    while True:
        for _ in range(LEVELS):
            # What holds nothing stays as it is; its explosion is a row of nulls.
            outer = rest.select(*keys, F.col("path").alias("_path"), F.col("v").alias("_v"))
            inner = outer.lateralJoin(outer.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
            leaf = F.schema_of_variant("_v") == "STRING"
            path = F.when(F.col("key").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array("key")))
            rest = inner.select(*keys, path.alias("path"), F.when(leaf, F.col("_v")).otherwise(F.col("value")).alias("v")).filter("v is not null")
        # As text: a variant isn't kept in files by all readers.
        told = rest.select(*keys, "path", F.when(kind == "STRING", F.lit("s")).when(holds, F.lit("c")).alias("kind"), F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).when(holds, F.to_json("v")).alias("text"))
        told = kept(told.filter("kind is not null"), "level", deeper=F.col("kind") == "c")
        found.append(told.filter("kind = 's'").select(*keys, "path", F.col("text").alias("value")))
        if not told.counts["deeper"]:
            return reduce(DataFrame.unionByName, found)
        rest = told.filter("kind = 'c'").select(*keys, "path", F.parse_json("text").alias("v"))


def matching(rows: DataFrame, keys: list[str], payload: str, text: str | None = None, file: str | None = None, symbol: str | None = None, kind: str | None = None) -> DataFrame:
    """keys of the records of which some string holds text, some string under a file field holds file, and so on, in any case.

    keys tell records apart. Nothing asked for is met by every record.
    """
    asked = [(text, None), (file, FILE_FIELDS), (symbol, SYMBOL_FIELDS), (kind, KIND_FIELDS)]
    asked = [(n, f) for n, f in asked if n]
    if not asked:
        return rows.select(*keys)

    def hit(needle: str, fields: tuple[str, ...] | None) -> Column:
        inside = F.lower("value").contains(needle.lower())
        return F.bool_or(inside & F.arrays_overlap("path", F.array(*map(F.lit, fields))) if fields else inside)

    met = strings(rows, keys, payload).groupBy(*keys).agg(*[hit(n, f).alias(f"_hit{i}") for i, (n, f) in enumerate(asked)])
    return met.filter(reduce(lambda a, b: a & b, [F.col(f"_hit{i}") for i in range(len(asked))])).select(*keys)


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, record, v: what a tool call may have answered, two records an event: a match deep inside, and a list of names."""
    e = views.events(spark, sf_dir)
    e = e.repartition(max(1, math.ceil(e.count() / EVENTS_A_TASK)), "event_id")
    text = F.format_string('{"items": [{"type": "%s", "at": {"file_path": "src/mod_%s.py", "lines": [1, %s]}, "more": [["deep %s"], {"note": "K%s"}]}, {"name": ["fn_%s", {"x": "in %s"}], "value": %s}]}', "event_type", "k", "k", "event_type", "k", "k", "event_type", "session_id")
    return e.select("event_id", F.posexplode(records(text)).alias("record", "v"))


@query("""SELECT event_id, record, path, value FROM (SELECT event_id, 0 AS record, unnest([{'p': 'type', 'v': event_type}, {'p': 'at.file_path', 'v': 'src/mod_' || k || '.py'}, {'p': 'more', 'v': 'deep ' || event_type}, {'p': 'more.note', 'v': 'K' || k}]) AS s FROM ev
 UNION ALL SELECT event_id, 1, unnest([{'p': 'name', 'v': 'fn_' || k}, {'p': 'name.x', 'v': 'in ' || event_type}]) FROM ev), LATERAL (SELECT s.p AS path, s.v AS value)""", "events")
def payload_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strings(event_payloads(spark, sf_dir), ["event_id", "record"], "v")
    return found.select("event_id", "record", F.array_join("path", ".").alias("path"), "value")


@query("SELECT event_id, 0 AS record FROM ev WHERE event_type = 'click' AND contains('mod_' || k || '.py', 'mod_1')", "events")
def records_by_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the type click, with a file of mod_1."""
    return matching(event_payloads(spark, sf_dir), ["event_id", "record"], "v", file="MOD_1", kind="Click")


@query("SELECT event_id, 1 AS record FROM ev WHERE contains('fn_' || k, 'fn_7') OR contains('in ' || event_type, 'fn_7')", "events")
def records_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a name of fn_7, also one that is a list."""
    return matching(event_payloads(spark, sf_dir), ["event_id", "record"], "v", symbol="FN_7")
