import os

import pytest
from pyspark.sql import functions as F

from quern.operators import code_queries, parsing, table_sources
from quern.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _tree(spark):
    return {tuple(r) for r in table_sources.source_tree(spark, SF).collect()}


def test_sources_are_made_by_many_tasks(spark, monkeypatch):
    whole = _tree(spark)
    monkeypatch.setattr(table_sources, "PARTS_A_TASK", 20)
    held = {r[0] for r in table_sources.source_tree(spark, SF).select(F.spark_partition_id()).distinct().collect()}
    assert len(held) > 5
    assert _tree(spark) == whole


@pytest.mark.parametrize("suffix", [r"\.py$", r"\.tsx?$", r"\.go$", r"^src/.*\.py$"])
def test_sources_of_a_pattern_are_all_that_match(spark, suffix):
    some = table_sources.source_tree(spark, SF, suffix)
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in table_sources.source_tree(spark, SF).filter(F.col("path").rlike(suffix)).collect()}


def test_facts_of_some_kinds_are_those_of_all():
    files = [os.path.join(os.path.dirname(m.__file__), f) for m in (parsing, code_queries) for f in sorted(os.listdir(os.path.dirname(m.__file__))) if f.endswith(".py")]
    for path in files:
        with open(path) as f:
            text = f.read()
        every = parsing.python_rows(path, text)
        for kind in ("symbol", "import", "reference", "literal", "depth", "fingerprint", "test", "entry"):
            assert parsing.python_rows(path, text, (kind,)) == [r for r in every if r[1] == kind]


def test_long_chains_of_blocks_and_operators_are_facts():
    text = "def f(x):\n    if x == 0:\n        return 0\n" + "".join(f"    elif x == {i}:\n        return {i}\n" for i in range(1, 300)) + "y = " + " + ".join(["f(1)"] * 1500) + "\n"
    rows = parsing.python_rows("a.py", text, ("symbol", "depth", "reference"))
    assert [(r[2], r[4], r[5]) for r in rows if r[1] == "symbol"] == [("f", 1, 601)]
    assert [r[6] for r in rows if r[1] == "depth"] == [300]
    assert sum(r[1] == "reference" for r in rows) == 1500


@pytest.mark.parametrize("name", ["go_references", "typescript_parse", "typescript_references", "go_parse"])
def test_patterns_join_nothing(spark, name):
    """Rows of every file are no side of a join, so the driver broadcasts none."""
    assert "Join" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_lines_that_tell_nothing_stay_in_their_task(spark):
    text = "func A() {\n" + "\tx()\n" * 1000 + "}\n\nfunc B()\n"
    files = spark.createDataFrame([("a.go", text), ("b.go", "")], "path string, text string")
    found = parsing.go_symbols(files)
    assert sorted(tuple(r) for r in found.collect()) == [("a.go", 1, "A", "function", 1002), ("a.go", 1004, "B", "function", 1004)]
    assert parsing.go_symbols(files)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_directives_are_found_in_any_file_that_has_one(spark):
    files = spark.createDataFrame([("a.rb", "x = 1\ny = 2 # quern: ignore[a, b]\n"), ("b.ts", "// quern:ignore"), ("c.py", "quern ignore")], "path string, text string")
    found = parsing.directives(files)
    assert sorted((r["path"], r["line"], r["rules"]) for r in found.collect()) == [("a.rb", 2, ["a", "b"]), ("b.ts", 1, ["*"])]
    # Files without one are not cut into lines.
    assert "contains(text#" in found._jdf.queryExecution().optimizedPlan().toString().lower()
