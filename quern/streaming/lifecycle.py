"""The life cycle as streams: stale verifications, claims of a slot, snapshots that are polled.

Each keeps a row of state for a key, in a store that spills to disk, and gives
the same rows whatever batches its input comes in, as long as a key's rows come
in the order of time across batches; within a batch they may be in any order.
Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.plans import views
from quern.registry import query
from quern.sources.folders import kept
from quern.streaming.logs import event_stream, run_available

#: Fixed value: seconds for which a claimed slot stays claimed.
CLAIM_SECONDS = 2
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.groupBy(key).transformWithState(processor, schema, "append", time)


class _Stale(StatefulProcessor):
    """State: the fingerprint last scanned, and the verifications recorded since it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("finding", "fingerprint string, runs long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, runs = self.state.get() or (None, 0)
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if r.fingerprint is None:
                runs += 1
                continue
            if seen is not None and seen != r.fingerprint:
                if runs:
                    yield Row(finding=key[0], seq=r.seq, at=r.at, removed=runs)
                runs = 0
            seen = r.fingerprint
        self.state.update((seen, runs))

    def close(self) -> None:
        pass


def stale_verifications(log: DataFrame) -> DataFrame:
    """finding, seq, at, removed: scans that found another body, and how many verifications no longer vouch for it.

    log: (finding, at, seq, fingerprint) of scans, and of verifications with a
    null fingerprint; of equal times the smaller seq comes first. The first
    scan of a finding makes nothing stale, nor does one that finds the same.
    """
    return _stateful(log, "finding", _Stale(), "finding string, seq long, at long, removed long", "none")


class _Claim(StatefulProcessor):
    """State: when the slot was claimed; a timer clears it, so that keys at rest hold nothing."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        at = claimed = held[0] if held else None
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if at is None or not 0 <= r.at - at < self.micros:
                at = r.at
                yield Row(slot=key[0], seq=r.seq, at=r.at)
        if at != claimed:
            self.state.update((at,))
            self.handle.registerTimer(-(-(at + self.micros) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held and held[0] + self.micros <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def claims(calls: DataFrame, seconds: float = CLAIM_SECONDS, lateness: str = "1 second") -> DataFrame:
    """slot, seq, at of the calls that claim their slot: those not within `seconds` from the claim before.

    calls: (slot, time, at, seq); time is the timestamp that `at` tells in microseconds.
    """
    return _stateful(calls.withWatermark("time", lateness), "slot", _Claim(int(seconds * 1_000_000)), "slot string, seq long, at long", "eventTime")


class _Polled(StatefulProcessor):
    """State: the hash and time of the last sight; a timer tells that a path was in no later poll."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "hash string, at long")

    def _due(self, at: int) -> int:
        return (at + self.micros + self.micros // 2) // 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        for r in sorted(rows, key=lambda r: r.at):
            told = None
            if held and self._due(held[1]) <= r.at // 1000:
                yield Row(path=key[0], change="deleted", at=held[1] + self.micros)
                held = None
            if not held:
                told = "new"
            elif held[0] != r.hash:
                told = "changed"
            if told:
                yield Row(path=key[0], change=told, at=r.at)
            held = (r.hash, r.at)
        self.state.update(held)
        self.handle.registerTimer(self._due(held[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        # A timer of an earlier sight tells nothing.
        if held and self._due(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield Row(path=key[0], change="deleted", at=held[1] + self.micros)

    def close(self) -> None:
        pass


def polled_changes(sights: DataFrame, seconds: float, lateness: str = "1 second") -> DataFrame:
    """path, change, at: what polls of a tree find new, changed and deleted; a path is deleted at the first poll without it.

    sights: (path, hash, time, at), a row for each path of each poll; polls are
    `seconds` apart. A path that is missing is told once the watermark is half
    an interval beyond the poll that should have had it.
    """
    return _stateful(sights.withWatermark("time", lateness), "path", _Polled(int(seconds * 1_000_000)), "path string, change string, at long", "eventTime")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    mark = F.when(F.col("event_type") == "purchase", F.lit(None)).otherwise(F.floor(F.col("k") / 20).cast("string"))
    return e.filter("event_type in ('purchase', 'view', 'click')").select(F.col("session_id").cast("string").alias("finding"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), mark.alias("fingerprint"))


@query(""", log AS (SELECT session_id AS finding, epoch_us(ts) AS tm, event_id AS seq, CASE WHEN event_type <> 'purchase' THEN CAST(k // 20 AS VARCHAR) END AS mark FROM ev WHERE event_type IN ('purchase', 'view', 'click')),
scans AS (SELECT *, lag(mark) OVER (PARTITION BY finding ORDER BY tm, seq) AS before FROM log WHERE mark IS NOT NULL),
turns AS (SELECT finding, tm, seq FROM scans WHERE before <> mark),
placed AS (SELECT l.finding, l.seq, l.mark, t.seq AS turn, sum(CASE WHEN t.seq IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l.finding ORDER BY l.tm, l.seq ROWS UNBOUNDED PRECEDING) AS epoch FROM log l LEFT JOIN turns t ON t.finding = l.finding AND t.seq = l.seq),
runs AS (SELECT finding, epoch + 1 AS epoch, count(*) AS removed FROM placed WHERE mark IS NULL GROUP BY ALL)
SELECT CAST(p.finding AS VARCHAR) AS finding, p.seq, r.removed FROM placed p JOIN runs r USING (finding, epoch) WHERE p.turn IS NOT NULL""", "events")
def stream_stale_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(stale_verifications(_log(spark, sf_dir)), "stale", "append").select("finding", "seq", "removed")


_CLAIMS = """, first AS (SELECT session_id, arg_min(event_id, (ts, event_id)) AS seq, min(ts) AS tm FROM ev GROUP BY session_id),
claimed AS (SELECT session_id, seq, tm FROM first UNION ALL SELECT session_id, n.event_id, n.ts FROM (SELECT c.session_id, (SELECT min(struct_pack(ts := e.ts, event_id := e.event_id)) FROM ev e WHERE e.session_id = c.session_id AND e.ts >= c.tm + INTERVAL 6 HOUR) AS n FROM claimed c) WHERE n IS NOT NULL)
SELECT CAST(session_id AS VARCHAR) AS slot, seq FROM claimed"""


@query("WITH RECURSIVE " + views.SQL["events"] + _CLAIMS)
def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of six hours for each session: the events that claim one."""
    e = event_stream(spark, sf_dir).withColumn("time", F.col("ts").cast("timestamp"))
    calls = e.select(F.col("session_id").cast("string").alias("slot"), "time", F.unix_micros("time").alias("at"), F.col("event_id").alias("seq"))
    return run_available(claims(calls, 6 * 3600), "claims", "append").select("slot", "seq")


@query(""", sights AS (SELECT k AS path, date_trunc('day', ts) AS t, max(event_type) AS hash FROM ev GROUP BY ALL),
near AS (SELECT *, lag(t) OVER w AS before, lag(hash) OVER w AS held, lead(t) OVER w AS after FROM sights WINDOW w AS (PARTITION BY path ORDER BY t))
SELECT CAST(path AS VARCHAR) AS path, CASE WHEN before IS NULL OR t - before > INTERVAL 36 HOUR THEN 'new' ELSE 'changed' END AS change, epoch_us(t) AS micros FROM near WHERE before IS NULL OR t - before > INTERVAL 36 HOUR OR held <> hash
UNION ALL SELECT CAST(path AS VARCHAR), 'deleted', epoch_us(t + INTERVAL 1 DAY) FROM near WHERE after - t > INTERVAL 36 HOUR OR (after IS NULL AND (SELECT max(t) FROM sights) - INTERVAL 1 SECOND >= t + INTERVAL 36 HOUR)""", "events")
def stream_polled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls once a day: the keys that events had that day are the paths, the last of their types the hash.

    The polls themselves are a table that Spark makes of the log, read as a stream.
    """
    e = views.events(spark, sf_dir).select(F.col("k").cast("string").alias("path"), F.date_trunc("day", "ts").cast("timestamp").alias("time"), "event_type")
    polls = kept(e.groupBy("path", "time").agg(F.max("event_type").alias("hash")).select("path", "hash", "time", F.unix_micros("time").alias("at")), "polls")
    sights = spark.readStream.schema(polls.schema).parquet(polls.kept_at)
    return run_available(polled_changes(sights, 86400), "polled", "append").select("path", "change", F.col("at").alias("micros"))
