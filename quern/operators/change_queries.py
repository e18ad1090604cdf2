"""Queries that read histories and diffs as text, written by Spark from the tables in the form that git gives them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.history import shares
from quern.plans import views
from quern.registry import query
from quern.sources import repository
from quern.sources.folders import shared_folder


#: Stretches of text a file; packed files aren't split, so they are kept small.
ROWS_A_FILE = 20_000


def _text(rows: DataFrame, name: str) -> str:
    """The folder of packed text files that one column of rows makes, a row a stretch of text."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", ROWS_A_FILE).text(path)
    return path


def log_text(spark: SparkSession, sf_dir: str) -> str:
    """Orders as commits with their parts as files: a log in several files, as of several repositories."""
    paths = views.commit_paths(spark, sf_dir).groupBy("commit_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.lit("src/part_"), "path", F.lit(".py"))))).alias("paths"))
    c = views.commits(spark, sf_dir).join(paths, "commit_id", "left")
    return _text(c.select(F.concat(F.lit("\x00"), F.col("commit_id").cast("string"), F.lit("\x00author "), F.col("author").cast("string"), F.lit("\n\n"), F.coalesce("paths", F.lit("")))), "log")


@query("SELECT CAST(commit_id AS VARCHAR) AS commit_id, 'author ' || author AS author, 'src/part_' || path || '.py' AS path FROM commits JOIN commit_paths USING (commit_id)", "commits commit_paths")
def history_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.read_history(spark, log_text(spark, sf_dir)).select("commit_id", "author", "path")


@query("SELECT 'src/part_' || path || '.py' AS path, CAST(sum(n) AS BIGINT) AS churn, round(max(n) / sum(n), 6) AS top_share, count(*) AS authors FROM (SELECT path, author, count(*) AS n FROM commit_paths JOIN commits USING (commit_id) GROUP BY ALL) GROUP BY path", "commits commit_paths")
def churn_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = repository.read_history(spark, log_text(spark, sf_dir))
    return shares(h).select("path", "churn", F.round("top_share", 6).alias("top_share"), "authors")


def diff_text(spark: SparkSession, sf_dir: str) -> str:
    """Orders as changed files, their line items as hunks from line 10 on for each number: as many lines go as the quantity, as many come as the discount has percent."""
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("gone"), F.round(F.col("l_discount") * 100).cast("int").alias("come"))
    # Numbers are grouped, and text is made of them where it is written.
    side = lambda h, n: F.concat((h["l_linenumber"] * 10).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))
    # Lines of content that look like headers are content all the same.
    hunk = lambda h: F.concat(F.lit("@@ -"), side(h, h["gone"]), F.lit(" +"), side(h, h["come"]), F.lit(" @@ def f():\n"), F.repeat(F.lit("--- a/no.py\n"), h["gone"]), F.repeat(F.lit("+rename to no.py\n"), h["come"]))
    hunks = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "gone", "come"))).alias("hunks"))
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(hunks, F.col("o_orderkey") == F.col("l_orderkey"))
    name = F.concat(F.lit("src/order_"), F.col("o_orderkey").cast("string"), F.lit(".py"))
    old = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("old/order_"), F.col("o_orderkey").cast("string"), F.lit(".py"))).otherwise(name)
    renamed = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("rename from "), old, F.lit("\nrename to "), name, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), name, F.lit("\n"), renamed, F.lit("index 1..2 100644\n--- a/"), old, F.lit("\n+++ b/"), name, F.lit("\n"))
    return _text(o.select(F.regexp_replace(F.concat(head, F.concat_ws("", F.transform("hunks", hunk))), "\n$", "")), "diff")


@query("SELECT 'src/order_' || l_orderkey || '.py' AS path, CASE WHEN o_orderstatus = 'P' THEN 'renamed' ELSE 'changed' END AS change, CAST(l_linenumber * 10 AS INTEGER) AS start, CAST(l_linenumber * 10 + round(l_discount * 100) - 1 AS INTEGER) AS \"end\" FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE round(l_discount * 100) > 0")
def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of a diff since a base, with how their file changed."""
    return repository.changed_lines(repository.read_diff(spark, diff_text(spark, sf_dir)), "change").select("path", "change", "start", "end")
