"""Streaming forms of the session statistics and of the debouncer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.sessions import _STATS, session_totals
from quern.plans import views
from quern.registry import ORACLE_SQL, query
from quern.sources.folders import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a file stream in the shape of the events view."""
    schema = views.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select("event_id", "ts", F.col("user_id").alias("session_id"), "event_type", F.col("value").alias("tokens"), F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


def run_to(stream: DataFrame, out: str, state: str, mode: str) -> None:
    """Runs what is there to its end, into a folder of rows; goes on where an earlier run with the same state has stopped."""

    def put(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure replaces its own rows.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs what is there to its end and reads the sink: appended rows, or the last complete result."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    run_to(stream, out, _folder(spark, f"{name}-state"), mode)
    return spark.read.parquet(out).drop("batch")


def debounce(events: DataFrame, window_seconds: float) -> DataFrame:
    """session_id, event_type, started once the same type has stood for the window in a session's events, in the order of arrival."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, started, fired = state.get if state.exists else (None, None, False)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for ts, v in zip(rows["ts"], rows["event_type"], strict=True):
            at = int(ts.to_datetime64().astype("datetime64[us]").astype("int64"))
            if value is not None and not fired and at - started >= window_seconds * 1_000_000:
                out.append((key[0], value, pd.Timestamp(started, unit="us")))
                fired = True
            if v != value:
                value, started, fired = v, at, False
        state.update((value, started, fired))
        yield pd.DataFrame(out, columns=["session_id", "event_type", "started"]).astype({"session_id": "int64", "started": "datetime64[us]"})

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id long, event_type string, started timestamp_ntz", "value string, started long, fired boolean", "append", GroupStateTimeout.NoTimeout)


@query(_STATS, "events")
def stream_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(session_totals(event_stream(spark, sf_dir)), "session-stats", "complete")


@query()
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(debounce(event_stream(spark, sf_dir), 86400), "debounce", "append")


ORACLE_SQL["stream_debounce"] = ORACLE_SQL["debounce_batch"]
