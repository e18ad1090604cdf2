"""Stateful streams, restarted from their checkpoints, against plain loops over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import lifecycle
from quern.streaming.logs import run_to

DAY = 86_400_000_000


def in_parts(spark, tmp_path, rows, schema, build, sort, parts=4):
    """Runs a stream over files that arrive in two portions, with a stop between, one file a batch."""
    rows = sorted(rows, key=sort)
    cut = [rows[len(rows) * i // parts : len(rows) * (i + 1) // parts] for i in range(parts)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(some):
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        run_to(build(stream), out, state, "append")

    arrive(cut[: parts // 2])
    run()
    arrive(cut[parts // 2 :])
    run()
    return spark.read.parquet(out).drop("batch").collect()


def test_stale_verifications_over_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"f{rng.randrange(12)}", i // 2, i, rng.choice([None, "a", "a", "b"])) for i in range(600)]
    want, seen, runs = [], {}, {}
    for f, at, seq, mark in sorted(rows, key=lambda r: (r[1], r[2])):
        if mark is None:
            runs[f] = runs.get(f, 0) + 1
        else:
            if seen.get(f, mark) != mark:
                want += [(f, seq, at, runs[f])] if runs.get(f) else []
                runs[f] = 0
            seen[f] = mark
    got = in_parts(spark, tmp_path, rows, "finding string, at long, seq long, fingerprint string", lifecycle.stale_verifications, lambda r: (r[1], r[2]))
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_claims_over_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(5)}", 1_700_000_000_000_000 + rng.randrange(300_000_000), i) for i in range(500)]
    want, held = [], {}
    for slot, at, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        if slot not in held or at - held[slot] >= 2_000_000:
            held[slot] = at
            want.append((slot, seq, at))
    build = lambda s: lifecycle.claims(s.withColumn("time", F.timestamp_micros("at")))
    got = in_parts(spark, tmp_path, rows, "slot string, at long, seq long", build, lambda r: (r[1], r[2]))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("parts", [1, 8])
def test_polled_changes_over_a_restart(spark, tmp_path, parts):
    """Polls a day apart; a path that a poll lacks is deleted then, as far as a later poll proves it."""
    rng, start = random.Random(3), 19_700 * DAY
    polls = [{f"p{p}": rng.choice("aab") for p in range(9) if rng.random() < 0.75} for _ in range(16)]
    rows = [(p, h, start + d * DAY) for d, seen in enumerate(polls) for p, h in seen.items()]
    want, before = set(), {}
    for d, seen in enumerate(polls):
        at = start + d * DAY
        want |= {(p, "new" if p not in before else "changed", at) for p, h in seen.items() if before.get(p) != h}
        # The last poll alone doesn't prove it: the watermark must pass half a day beyond.
        want |= {(p, "deleted", at) for p in before if p not in seen and d + 1 < len(polls)}
        before = dict(seen)
    build = lambda s: lifecycle.polled_changes(s.withColumn("time", F.timestamp_micros("at")), 86400)
    got = {tuple(r) for r in in_parts(spark, tmp_path, rows, "path string, hash string, at long", build, lambda r: r[2], max(parts, 2))}
    assert got == want
