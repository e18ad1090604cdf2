"""Commit history: co-change, churn, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.related import co_changed
from quern.plans import views
from quern.registry import query
from quern.sources.folders import kept


def churn(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """path, churn, top_share, authors: commits of a path, its busiest author's share, and how many authors it has."""
    c = commits.select(F.col("commit_id").alias("_c"), "author")
    return shares(pairs.join(c, F.col("commit_id") == F.col("_c")))


def shares(history: DataFrame) -> DataFrame:
    """churn of (path, author) rows, one for each commit of a path."""
    per = history.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("path").agg(F.sum("n").alias("churn"), (F.max("n") / F.sum("n")).alias("top_share"), F.count(F.lit(1)).alias("authors"))


def silos(churned: DataFrame, least: int = 5, share: float = 0.8, cap: int = 100) -> DataFrame:
    """Paths of much churn by few: confidence .9 with one author, else .5."""
    hit = churned.filter((F.col("churn") >= least) & (F.col("top_share") >= share))
    return hit.select("path", "churn", F.round("top_share", 6).alias("top_share"), "authors", F.when(F.col("authors") == 1, 0.9).otherwise(0.5).alias("confidence")).orderBy(F.desc("churn"), "path").limit(cap)


_CO = "SELECT a.path, b.path AS other, count(*) AS n FROM commit_paths a JOIN commit_paths b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY ALL"


@query(f", co AS ({_CO}) SELECT path, other, n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, other) AS r FROM co) WHERE r <= 10", "commit_paths")
def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every path, over its whole history."""
    pairs = views.commit_paths(spark, sf_dir).withColumn("ts", F.lit(None).cast("timestamp"))
    return co_changed(kept(pairs, "pairs"), latest=None).select(F.col("path").cast("long").alias("path"), F.col("other").cast("long").alias("other"), "n")


@query("SELECT path, count(*) AS changes FROM commit_paths GROUP BY path", "commit_paths")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.commit_paths(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("changes"))


_CHURN = ", churned AS (SELECT path, CAST(sum(n) AS BIGINT) AS churn, max(n) / sum(n) AS top_share, count(*) AS authors FROM (SELECT path, author, count(*) AS n FROM commit_paths JOIN commits USING (commit_id) GROUP BY ALL) GROUP BY path)"


@query(f"{_CHURN} SELECT path, churn, round(top_share, 6) AS top_share, authors FROM churned", "commits commit_paths")
def author_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn(views.commit_paths(spark, sf_dir), views.commits(spark, sf_dir)).select("path", "churn", F.round("top_share", 6).alias("top_share"), "authors")


@query(f"{_CHURN} SELECT path, churn, round(top_share, 6) AS top_share, authors, CAST(CASE WHEN authors = 1 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM churned WHERE churn >= 5 AND top_share >= 0.1 ORDER BY churn DESC, path LIMIT 100", "commits commit_paths")
def knowledge_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silos(churn(views.commit_paths(spark, sf_dir), views.commits(spark, sf_dir)), share=0.1)
