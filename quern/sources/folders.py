"""The session's shared folder, and tables kept in it between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset and all executors are this process, one temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quern-"))


def kept(df: DataFrame, name: str, by: str | None = None, **counts: Column) -> DataFrame:
    """The rows of df, written once and read back: a loop's plan stays short, and lost executors cost no earlier round.

    counts: conditions whose rows are counted on the way, into `counts` of the
    result. A task that ran twice may count twice, so they tell none from some.
    by: a column of few values, none of them null; who reads rows of one reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"
    seen = Observation() if counts else None
    observed = df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]) if counts else df
    observed.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out
    out.kept_at, out.counts = path, {n: seen.get.get(n, 0) for n in counts} if counts else {}
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of kept() that nothing reads any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.kept_at
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
