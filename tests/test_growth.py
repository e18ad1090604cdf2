import json
import os

import pytest
from pyspark.sql import functions as F

from quern.operators import change_queries, parsing, payloads, related
from quern.queries import QUERIES
from quern.sources import repository

SF = "/root/testdata/sf0.001"


def test_rules_of_a_directive_keep_their_digits(spark):
    files = spark.createDataFrame([("a.py", "x = 1  # quern: ignore[a0, b1, 2c]")], "path string, text string")
    assert parsing.directives(files).first()["rules"] == ["a0", "b1", "2c"]


def test_pairs_are_counted_by_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    rows = [(c, p, None) for c in range(40) for p in range(c % 7, 30, 3)]
    history = spark.createDataFrame(rows, "commit_id long, path long, ts timestamp")
    whole = {tuple(r) for r in related.co_changed(history, latest=None).collect()}
    monkeypatch.setattr(related, "PAIRS_A_TASK", 50)
    some = related.co_changed(history, latest=None)
    assert {tuple(r) for r in some.collect()} == whole
    tasks = sum(len(range(c % 7, 30, 3)) * (len(range(c % 7, 30, 3)) - 1) for c in range(40)) / 50
    assert "hashpartitioning(path#" in some._jdf.queryExecution().executedPlan().toString()
    assert f", {int(-(-tasks // 1))}), REPARTITION_BY_NUM" in some._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["changed_ranges", "churn_from_log"])
def test_logs_and_diffs_are_read_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_logs_are_packed_and_cut(spark, monkeypatch):
    monkeypatch.setattr(change_queries, "ROWS_A_FILE", 100)
    folder = change_queries.diff_text(spark, SF)
    files = [f for f in os.listdir(folder.removeprefix("file://")) if f.startswith("part-")]
    assert len(files) > 5 and all(f.endswith(".gz") for f in files)
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert repository.read_diff(spark, folder).count() == orders


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_levels_are_descended_in_few_passes(spark, monkeypatch, levels):
    held = {"a": ["x", {"b": {"c": ["y", 1, None, {"d": [[["z"]]]}]}}, []], "e": {}, "f": "w"}
    rows = spark.createDataFrame([(1, json.dumps(held)), (2, '"top"'), (3, "7"), (4, "null"), (5, None)], "k int, t string")
    passes, keep = [], payloads.kept
    monkeypatch.setattr(payloads, "kept", lambda *a, **b: passes.append(1) or keep(*a, **b))
    monkeypatch.setattr(payloads, "LEVELS", levels)
    found = payloads.strings(rows.select("k", F.parse_json("t").alias("v")), ["k"], "v")
    wanted = {(1, ("a",), "x"), (1, ("a", "b", "c"), "y"), (1, ("a", "b", "c", "d"), "z"), (1, ("f",), "w"), (2, (), "top")}
    assert {(r["k"], tuple(r["path"]), r["value"]) for r in found.collect()} == wanted
    assert len(passes) <= -(-10 // levels)


def test_payloads_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(payloads, "EVENTS_A_TASK", 20)
    assert payloads.event_payloads(spark, SF).rdd.getNumPartitions() > 5


def test_few_pairs_are_looked_up_by_heavy_keys(spark, monkeypatch):
    rows = [(f"p{i:03}", k) for i in range(60) for k in (f"a{i % 2}", f"b{i % 3}", f"c{i % 4}")]
    keys = spark.createDataFrame(rows, "path string, key string")
    read, keep = [], related.kept
    monkeypatch.setattr(related, "kept", lambda df, name: (out := keep(df, name), read.append(out.count()) if name == "brought" else None)[0])
    traces = spark.createDataFrame([(f"p{i:03}", "frecency") for i in range(0, 60, 7)], "path string, reason string")
    got = related.related({"search_similarity": (keys, keys)}, {}, traces, top=3, light=5).collect()
    held = {p: {k for q, k in rows if q == p} for p, _ in rows}
    for p in held:
        mine = [(-30 - (40 if int(q[1:]) % 7 == 0 else 0), q) for q in held if q != p and held[p] & held[q]]
        assert [r["other"] for r in sorted((r for r in got if r["path"] == p), key=lambda r: (-r["confidence"], r["other"]))] == [q for _, q in sorted(mine)[:3]]
    assert read and read[0] <= 60 * 4
