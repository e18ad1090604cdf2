import pytest
from pyspark.sql import Row

from quern.operators.findings import exclusive_quartiles, outliers, reconcile, running_verdicts

STATUSES = ["open", "in_progress", "needs_review", "regressed", "resolved", "wontfix", "false_positive", "suppressed", "ignored"]


def expected(status, seen, suppressed):
    if seen and suppressed:
        return "suppressed"
    if seen and status is None:
        return "open"
    if seen and status == "suppressed":
        return "open"
    if seen and status == "resolved":
        return "regressed"
    if not seen and status in ("open", "in_progress", "needs_review", "regressed"):
        return "resolved"
    return status


def test_every_status(spark):
    stored, seen, want = [], [], {}
    for s in [None, *STATUSES]:
        for here in (True, False):
            for sup in (True, False):
                if s is None and not here:
                    continue
                k = f"{s}-{here}-{sup}"
                if s is not None:
                    stored.append((k, s))
                if here:
                    seen.append((k, sup))
                want[k] = expected(s, here, sup)
    got = reconcile(spark.createDataFrame(stored, "stable_key string, status string"), spark.createDataFrame(seen, "stable_key string, suppressed boolean")).collect()
    assert {r["stable_key"]: r["after"] for r in got} == want
    for r in got:
        assert r["event"] == ("created" if r["before"] is None else r["after"] if r["before"] != r["after"] else None)


def test_reconcile_nothing(spark):
    a = spark.createDataFrame([], "stable_key string, status string")
    b = spark.createDataFrame([], "stable_key string, suppressed boolean")
    assert reconcile(a, b).collect() == []


@pytest.mark.parametrize("n", [11, 12, 25])
def test_quartiles_are_the_standard_librarys(spark, n):
    import statistics

    values = [((i * 37) % 23) + (100 if i == 3 else 0) for i in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    r = exclusive_quartiles(df, ["g"], "v").first()
    q = statistics.quantiles(values, n=4)
    assert (r["q1"], r["q3"]) == pytest.approx((q[0], q[2]))
    cutoff = q[2] + 1.5 * (q[2] - q[0])
    got = sorted(x["v"] for x in outliers(df, ["g"], "v", 1000).collect())
    assert got == (sorted(v for v in values if v >= cutoff) if n >= 12 else [])


def test_no_outliers_without_spread(spark):
    assert outliers(spark.createDataFrame([("g", 5)] * 20, "g string, v int"), ["g"], "v", 10).collect() == []


def test_verdicts_that_repeat_are_no_change(spark):
    rows = [("a", "2024-01-01 01:00:00", "resolved"), ("a", "2024-01-01 02:00:00", "resolved"), ("b", "2024-01-01 03:00:00", "wontfix"), ("a", "2024-01-02 00:00:00", "wontfix"), ("b", "2024-01-03 00:00:00", "open")]
    df = spark.createDataFrame(rows, "finding string, at string, status string").selectExpr("finding", "cast(at as timestamp) at", "status")
    got = {str(r["day"]): (r["accepted"], r["dismissed"]) for r in running_verdicts(df).collect()}
    assert got == {"2024-01-01": (1, 1), "2024-01-02": (0, 2), "2024-01-03": (0, 1)}


def test_row_imports():
    assert Row


def test_session_context_counts_all_types(spark):
    import json

    from quern.operators.session_context import context_stats

    rows = [
        ("s", 1, 1, "tool_called", "grep", {"broad_query": True, "query_fingerprint": "q1"}),
        ("s", 2, 2, "tool_called", "grep", {"broad_query": True, "query_fingerprint": "q1"}),
        ("s", 3, 3, "tool_called", None, {"broad_query": False}),
        ("s", 4, 4, "large_result_summarized", "read", {"raw_tokens": 90, "returned_tokens": 100, "input_fingerprint": "i"}),
        ("s", 5, 5, "large_result_summarized", "read", {"raw_tokens": 900, "returned_tokens": 100, "query_fingerprint": "q"}),
        ("s", 6, 6, "result_retrieved", "read", {"raw_tokens": 5, "returned_tokens": True}),
        ("s", 7, 7, "agent_repeated_query", "find", {"retrieval_count": 3, "input_fingerprint": "i"}),
        ("s", 8, 8, "agent_repeated_query", "find", {}),
        ("s", 9, 9, "agent_requested_exact_large_result", "read", {"raw_tokens": 7, "returned_tokens": "12"}),
        ("s", 10, 10, "server_warning_returned", "x", {"warning_code": "stale", "warning_count": 2}),
        ("s", 11, 11, "server_warning_returned", "x", {}),
        ("s", 12, 12, "structural_backend_resolved", "x", {"backend_name": "graph"}),
        ("s", 13, 13, "structural_backend_resolved", "x", {"backend_name": "native"}),
        ("s", 14, 14, "something_else", "x", {"raw_tokens": 1000}),
        (None, 1, 20, "tool_called", "a", None),
    ]
    rows += [("long", i, 100 + i, "tool_called", f"t{i % 7}", {}) for i in range(600)]
    df = spark.createDataFrame([(*r[:5], None if r[5] is None else json.dumps(r[5])) for r in rows], "session_id string, created_at int, id int, event_type string, tool_name string, payload string")
    got = {r["session_id"]: r.asDict() for r in context_stats(df, "graph").collect()}
    s = got["s"]
    assert (s["tool_calls"], s["summarized_results"], s["retrievals"]) == (3, 2, 1)
    assert (s["raw_tokens"], s["returned_tokens"], s["avoided_tokens"]) == (90 + 900 + 5 + 7, 200, 800)
    assert s["tools"] == ["grep", "unknown"] and s["repeated"] == ["find:i:3", "grep:q1:2"]
    assert s["warnings"] == ["stale:2", "unspecified:1"] and s["largest"] == ["read:q:900:100", "read:i:90:100"]
    assert (s["resolutions"], s["external_resolutions"], s["external_rate"]) == (2, 1, 0.5)
    # The first 500 events count; the most used are told, ties by name.
    assert got["long"]["tool_calls"] == 500 and got["long"]["tools"] == ["t0", "t1", "t2", "t3", "t4"]
    assert got[None]["tool_calls"] == 1 and got[None]["external_rate"] == 0.0 and got[None]["largest"] == []
