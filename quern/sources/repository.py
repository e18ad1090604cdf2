"""Readers of source trees, history logs and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.inventory import excluded, suffix_language
from quern.plans.views import line_count

MAX_BYTES = 1_000_000
EXCLUDED_PARTS = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")


def read_tree(spark: SparkSession, root: str, glob: str | None = None, patterns: tuple[str, ...] = (), keep_generic: bool = False) -> DataFrame:
    """path, language, hash, size_bytes, line_count, text of the text files below root.

    The size bound reaches the reader, so larger files aren't read. Files with
    a NUL byte are binary and left out. keep_generic keeps files whose suffix
    has no language.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(root).filter(F.col("length") <= MAX_BYTES)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{base}/", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content").withColumn("language", suffix_language(F.col("path")))
    rows = rows.filter(~excluded(F.col("path"), parts=EXCLUDED_PARTS, patterns=patterns))
    text = F.decode("content", "UTF-8")
    rows = rows.withColumn("text", text).filter(~F.col("text").contains("\x00"))
    rows = rows if keep_generic else rows.filter("language is not null")
    return rows.select("path", "language", F.sha2("content", 256).alias("hash"), "size_bytes", line_count(F.col("text")).alias("line_count"), "modified", "text")


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """One pattern a line; comments and blank lines don't count. A file of settings, read by the driver."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    return [r["v"] for r in rows.collect()]


#: Fixed value: commits of a history that are looked at, the first of the log.
HISTORY_COMMITS = 400
_HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """commit_id, author, paths (a list) from the text of `git log --name-only --format='%x00%H%x00%an'`: header lines start with NUL.

    A row is what stands between two headers, so a log is read by as many
    tasks as its bytes ask for, and no task holds more than a commit at a
    time. A commit without files has an empty list.
    """
    rows = spark.read.text(path, lineSep="\n\x00")
    text = F.regexp_replace("value", "^\x00", "")
    head, body = F.split(F.split(text, "\n")[0], "\x00"), F.slice(F.split(text, "\n"), 2, 1 << 30)
    files = F.array_distinct(F.filter(F.transform(body, lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select(head[0].alias("commit_id"), F.get(head, 1).alias("author"), files.alias("paths")).filter("commit_id <> ''")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """commit_id, author, path: a row for each file of a commit."""
    return read_commits(spark, path).select("commit_id", "author", F.explode("paths").alias("path"))


def latest_commits(spark: SparkSession, path: str, most: int = HISTORY_COMMITS) -> DataFrame:
    """commit_id, author, paths of the first `most` commits of one log: newest first, as a log is."""
    return read_commits(spark, path).limit(most)


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """path, old_path, change, hunks (old_start, old_lines, start, lines) from the text of `git diff -U0`: a row a file.

    Files are cut where a line starts with "diff --git ", so a diff is read by
    many tasks. Names come from the lines that can't be mistaken: renames,
    then the two names of the contents, then the first line.
    """
    text = F.regexp_replace("value", "^diff --git ", "")
    rows = spark.read.text(path, lineSep="\ndiff --git ").select(text.alias("t")).filter("t <> ''")
    # Up to the first hunk: lines of content may look like any of these.
    rows = rows.withColumn("head", F.split("t", "(?m)^@@ ", 2)[0])
    first = F.split("head", "\n")[0]
    named = lambda p: F.nullif(F.regexp_extract("head", p, 1), F.lit(""))
    new = F.coalesce(named(r"(?m)^rename to (.+)$"), named(r"(?m)^\+\+\+ b/(.+?)\t?$"), named(r"(?m)^--- a/(.+?)\t?$"), F.regexp_extract(first, r" b/(.+)$", 1))
    old = F.coalesce(named(r"(?m)^rename from (.+)$"), named(r"(?m)^--- a/(.+?)\t?$"), new)
    kind = F.when(F.col("head").rlike("(?m)^new file mode"), "added").when(F.col("head").rlike("(?m)^deleted file mode"), "deleted").when(F.col("head").rlike("(?m)^rename from "), "renamed").otherwise("changed")
    part = lambda g: F.regexp_extract_all("t", F.lit(_HUNK), F.lit(g))
    number = lambda x: F.when(x == "", 1).otherwise(F.try_to_number(x, F.lit("9999999999")).cast("int"))  # noqa: E731  a hunk of one line has no count
    hunks = F.arrays_zip(*[F.transform(part(g), number).alias(n) for g, n in ((1, "old_start"), (2, "old_lines"), (3, "start"), (4, "lines"))])
    return rows.select(new.alias("path"), old.alias("old_path"), kind.alias("change"), hunks.alias("hunks"))


def changed_lines(diff: DataFrame, *own: str) -> DataFrame:
    """path, columns of the file, start, end: the line ranges of the new state that a diff touches; a hunk that only removes touches none."""
    return diff.select("path", *own, F.explode("hunks").alias("h")).filter("h.lines > 0").select("path", *own, F.col("h.start").alias("start"), (F.col("h.start") + F.col("h.lines") - 1).alias("end"))


def changed_since(diff: DataFrame, status: DataFrame) -> DataFrame:
    """path: what a diff since a base or the working tree's status tells of, each once."""
    return diff.select("path").union(status.select("path")).filter("path <> ''").distinct()


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """path, status of `git status --porcelain` text: renames by their new path, ignored files left out."""
    rows = spark.read.text(path).filter("length(value) > 3 and not startswith(value, '!!')")
    name = F.substring("value", 4, 1 << 20)
    return rows.select(F.when(name.contains(" -> "), F.element_at(F.split(name, " -> "), -1)).otherwise(name).alias("path"), F.when(F.col("value").startswith("??"), "??").otherwise(F.trim(F.substring("value", 1, 2))).alias("status"))


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """path, uncovered_lines of a Cobertura report; several classes of a file are put together, paths outside the tree left out."""
    schema = "_filename string, lines struct<line: array<struct<_number: int, _hits: long>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    lines = rows.select(F.col("_filename").alias("path"), F.explode("lines.line").alias("l")).filter("l._hits = 0")
    safe = ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")
    return lines.filter(safe).groupBy("path").agg(F.sort_array(F.collect_set("l._number")).alias("uncovered_lines"))
