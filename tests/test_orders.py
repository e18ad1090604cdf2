"""Orders of composed answers on rows whose place is known."""

from quern.operators.orders import keep_order, plan_order, symbol_groups


def test_keep_order(spark):
    rows = [
        ("e", "note", "", "b", "x"), ("d", "issue", "high", "a", "x"), ("c", "finding", "medium", "a", "x"),
        ("b", "Finding", "Critical", "a", "x"), ("a", "failing assertion", "", "z", "x"), ("f", "note", "", "B", "y"), ("g", None, None, "a", "x"),
    ]
    got = spark.createDataFrame(rows, "id string, kind string, severity string, title string, message string").orderBy(*keep_order())
    ids = [r.id for r in got.collect()]
    assert ids[:2] == ["a", "b"] and set(ids[2:4]) == {"c", "d"} and ids[-2:] == ["e", "f"]


def test_plan_order(spark):
    rows = [(True, 9.0, "a", "r"), (False, 1.0, "b", "r"), (False, 2.0, "b", "s"), (False, 2.0, "b", "r"), (False, 2.0, "a", "t")]
    got = spark.createDataFrame(rows, "deprioritised boolean, roi double, scope string, rule_id string").orderBy(*plan_order())
    assert [(r.roi, r.scope, r.rule_id) for r in got.collect()] == [(2.0, "a", "t"), (2.0, "b", "r"), (2.0, "b", "s"), (1.0, "b", "r"), (9.0, "a", "r")]


def test_symbol_groups(spark):
    rows = [
        ("partial", "definition", "a", "m", "class", "x", 1, 0.9), ("exact", "reference", "a", "m", "class", "x", 1, 1.0),
        ("exact", "definition", "b", "m", "class", "x", 4, 0.5), ("exact", "definition", "b", "m", "function", "y", 2, 0.5),
        ("exact", "definition", "b", "m", "class", "z", 1, 0.4), (None, None, None, None, None, "n", 1, 1.0),
    ]
    kind = "match_type string, role string, path string, module string, kind string, name string, line int, score double"
    got = symbol_groups(spark.createDataFrame(rows, kind), groups=3).collect()
    best = sorted((r.place, r.name, r.group_kind, r.group_count) for r in got if r.path == "b")
    assert best == [(1, "y", "mixed", 3), (2, "x", "mixed", 3)]
    assert sorted((r.match_type, r.role) for r in got if r.path == "a") == [("exact", "reference"), ("partial", "definition")]
    assert len(got) == 4  # the group of unknowns comes last, beyond the third
    assert symbol_groups(spark.createDataFrame([], kind)).count() == 0
