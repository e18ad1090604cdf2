"""What rules read grows with what they look at, not with all lines; walks of Python trees give what ast gives."""

import ast
import os

from fixed_sources import repository

from quern.operators import parsing, rules
from quern.sources import folders

SF = "/root/testdata/sf0.001"


def test_lines_that_no_rule_looks_at_are_not_written(spark):
    files = spark.createDataFrame([("a.py", "x = 1\n" * 300), ("b.rb", "puts 1\n" * 300 + "puts 'x'\n"), ("c.tsx", "row(1);\n" * 300 + "useState(1);\n"), ("d.go", "")], "path string, text string")
    facts = rules.Facts.of(files)
    assert sorted((r["path"], r["line"]) for r in facts.lines.collect()) == [("b.rb", 301), ("c.tsx", 301)]
    assert sorted((r["path"], r["n"]) for r in facts.sums.collect()) == [("a.py", 300), ("b.rb", 301), ("c.tsx", 301)]
    assert sorted(r["path"] for r in facts.files.collect()) == ["a.py", "b.rb", "c.tsx", "d.go"]


def test_sums_count_lines_as_they_are_cut(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "todo\nx\nFixMe todo\n", "\r\nhack\r\n", "generated by x\nexport a\n  export b\nexports c\n", None, "é\nTODO"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r["path"]: tuple(r)[1:] for r in rules._sums(files).collect()}
    lines = {str(i): (t[:-1] if t.endswith("\n") else t).split("\n") if t else [] for i, t in enumerate(texts)}
    first = lambda hits: hits[0] if hits else None
    for p, cut in lines.items():
        marks = [i + 1 for i, x in enumerate(cut) if any(w in x.upper() for w in rules.MARKERS)]
        made = [i + 1 for i, x in enumerate(cut) if any(w in x.upper() for w in rules.GENERATED)]
        assert got[p] == (len(cut), len(marks), first(marks), len(made), first(made), sum(x.strip().startswith("export ") for x in cut))


def test_facts_of_a_kind_are_read_alone(spark, monkeypatch):
    facts = rules.Facts.of(repository(spark))
    plan = rules.python_deep_nesting(facts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "fact" in plan.split("PartitionFilters: [")[1].split("]")[0]
    folder = facts.python.kept_at.removeprefix("file://") if hasattr(facts.python, "kept_at") else None
    assert folder and folders.kept and any(f.startswith("fact=") for f in os.listdir(folder))


def test_walks_are_those_of_ast():
    with open(parsing.__file__) as f:
        tree = ast.parse(f.read())
    for x in ast.walk(tree):
        assert parsing._children(x) == list(ast.iter_child_nodes(x))
        if isinstance(x, ast.arguments):
            assert parsing._signature(x) == ast.unparse(x)
    assert parsing._nodes(tree) == list(ast.walk(tree))
