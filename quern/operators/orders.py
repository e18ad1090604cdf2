"""Orders of composed answers: symbol groups, what to keep when an answer is cut, and improvement plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.findings import mapped
from quern.plans import views
from quern.registry import query

#: Places of match types, roles and kinds; others come last.
MATCH_PLACE = {"exact": 0, "partial": 1}
ROLE_PLACE = {"definition": 0, "reference": 1}
KIND_PLACE = {"class": 0, "function": 1, "method": 2, "variable": 3, "module": 4}
LAST, UNKNOWN = 99, "unknown"
#: Groups of an answer, and symbols of a group.
GROUPS, ITEMS = 6, 2
#: Kinds that are kept before all else, ranks of a finding's severity, and other kinds that count as findings.
ALWAYS_KEPT = (
    "error traceback failing_assertion public_api security_finding highest_severity_finding circular_dependency "
    "unreadable_file permission_error environment_error failed_command"
).split()
FINDING_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
FINDING_LIKE, FINDING_PLACE, ORDINARY_PLACE = ("finding", "issue", "smell"), 3, 5


def symbol_groups(found: DataFrame, groups: int = GROUPS, items: int = ITEMS) -> DataFrame:
    """The first `items` symbols of the first `groups` groups; group_count and best_score are those of the whole group.

    found: (match_type, role, path, module, kind, name, line, score). A group is
    a match type, role, path and module, null counting as unknown, and has the
    kind of its symbols, or `mixed`. Groups are counted before the cut; the
    window ranks the symbols of the few groups that are left.
    """
    keys = ["match_type", "role", "path", "module"]
    rows = found.withColumns({k: F.coalesce(k, F.lit(UNKNOWN)) for k in keys}).withColumn("kind", F.coalesce("kind", F.lit(UNKNOWN)))
    kind = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed")
    whole = rows.groupBy(*keys).agg(kind.alias("group_kind"), F.count(F.lit(1)).alias("group_count"), F.max("score").alias("best_score"))
    by_type = [mapped(F.col("match_type"), MATCH_PLACE, LAST), mapped(F.col("role"), ROLE_PLACE, LAST)]
    order = [*by_type, F.desc("best_score"), "path", mapped(F.col("group_kind"), KIND_PLACE, LAST), "module", "match_type", "role"]
    first = whole.orderBy(*order).limit(groups)
    inside = [F.desc("score"), "line", mapped(F.col("kind"), KIND_PLACE, LAST), "name"]
    ranked = rows.join(F.broadcast(first), keys)  # `groups` rows
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*inside))).filter(F.col("place") <= items)


def keep_place(kind: Column, severity: Column) -> Column:
    """The lower, the longer it is kept when an answer is cut."""
    kind, severity = (F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[- ]", "_") for c in (kind, severity))
    ranked = F.when(kind == "finding", mapped(severity, FINDING_RANK, None) + 1)
    other = F.when(kind.isin(*FINDING_LIKE), FINDING_PLACE).otherwise(ORDINARY_PLACE)
    return F.when(kind.isin(*ALWAYS_KEPT), 0).otherwise(F.coalesce(ranked, other))


def keep_order() -> list[Column]:
    """Of rows with kind, severity, title and message: what is kept first."""
    return [keep_place(F.col("kind"), F.col("severity")), F.lower("severity"), F.lower("kind"), F.lower("title"), F.lower("message")]


def plan_order() -> list:
    """Of clusters with deprioritised (only structural findings of tests), roi, scope and rule_id."""
    return [F.col("deprioritised").cast("int"), F.desc("roi"), "scope", "rule_id"]


@query("""SELECT match_type, role, path, module, group_kind, group_count, best_score, name, line, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY match_type, role, path, module ORDER BY score DESC, line, CASE kind WHEN 'function' THEN 1 WHEN 'module' THEN 4 ELSE 99 END, name) AS place
 FROM found JOIN (SELECT match_type, role, path, module, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS group_kind, count(*) AS group_count, max(score) AS best_score
  FROM found GROUP BY match_type, role, path, module ORDER BY match_type = 'partial', role = 'reference', best_score DESC, path, module LIMIT 6) USING (match_type, role, path, module))
WHERE place <= 2""", "files symbols found_symbols")  # fmt: skip
def symbol_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols named after the first block, exactly or in part; those of tests stand for references."""
    s = views.symbols(spark, sf_dir).filter(F.col("name").contains("block_1"))
    found = s.select(
        F.when(F.col("name") == "block_1", "exact").otherwise("partial").alias("match_type"),
        F.when(F.col("path").startswith("tests/"), "reference").otherwise("definition").alias("role"),
        "path", F.replace("path", F.lit("/"), F.lit(".")).alias("module"), "kind", "name", F.col("start_line").alias("line"),
        F.round(7 / F.length("name"), 6).alias("score"),
    )
    return symbol_groups(found).select(
        "match_type", "role", "path", "module", "group_kind", "group_count", "best_score", "name", "line", "place"
    )


@query("""SELECT id, CASE status WHEN 'open' THEN CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 3 ELSE 5 END WHEN 'wontfix' THEN 3 ELSE 0 END AS place FROM findings""", "findings")
def preservation_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings, errors as high ones; the dismissed stand for issues and the resolved for failed commands."""
    kind = F.when(F.col("status") == "open", "finding").when(F.col("status") == "wontfix", "issue").otherwise("failed-command")
    severity = mapped(F.col("severity"), {"error": "High", "warning": "medium"}, "info")
    return views.findings(spark, sf_dir).select("id", keep_place(kind, severity).alias("place"))
