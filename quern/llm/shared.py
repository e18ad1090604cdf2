"""Tables written between jobs, and the session's shared folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


#: Rows that an Arrow batch of texts holds at most, so that a task's batches stay small beside its share of memory.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_ROWS rows at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > BATCH_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all executors are this process (tests), one temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quern-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.written_at
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a DataFrame, without Python on the executors."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(","))
    return spark.sql(f"select inline(from_json(:rows, 'array<struct<{kind}>>'))", {"rows": text})
