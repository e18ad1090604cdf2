"""Source files made of the part table by fixed templates: a dozen files for each part, in four languages.

Names come from the key, numbers of lines and what is in them from the size,
so that columns tell which facts and findings a file must give.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import views

#: The columns that templates and SQL read.
PARTS = """parts AS (SELECT *, 15 * greatest(0, s - 30) AS notes, s + 16 * greatest(0, s - 38) AS body, s + 21 * greatest(0, s - 36) AS calls, s + 10 * greatest(0, s - 36) AS rows_ FROM
(SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, lower(replace(p_brand, '#', '')) AS b FROM part))"""


#: Parts whose files one task makes; the table itself is so small that Spark reads it in one task or a few.
PARTS_A_TASK = 2000


def _lines(template: str, *, k: Column, b: Column) -> Column:
    """A template's text, with {k} and {b} in their places."""
    out: list[Column] = []
    for i, piece in enumerate(template.split("{k}")):
        inner = [F.lit(x) for x in piece.split("{b}")]
        out += ([k] if i else []) + [y for j, x in enumerate(inner) for y in ([b, x] if j else [x])]
    return F.concat(*out)


def source_tree(spark: SparkSession, sf_dir: str, suffix: str = "", size: bool = False) -> DataFrame:
    """path, text of all files, or of those whose path has `suffix`, a pattern; size: with `s`, the part's size.

    Parts are dealt to tasks first, as a part of some 30 bytes makes thousands of bytes of text.
    """
    part = views.table(spark, sf_dir, "part")
    p = part.repartition(max(1, math.ceil(part.count() / PARTS_A_TASK)), "p_partkey").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("int").alias("s"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("b"))
    k, s, b = F.col("k"), F.col("s"), F.col("b")
    t = lambda text: _lines(text, k=k, b=b)
    times = lambda text, n: F.repeat(t(text), n.cast("int"))
    if_ = lambda condition, text: F.when(condition, t(text)).otherwise("")
    # Few files are large ones.
    grown = lambda by, above, base: base + by * F.greatest(s - above, F.lit(0))
    odd, tested, skips = s % 2 == 1, s % 3 == 0, s % 6 == 0
    nested = F.array(*[F.lit("".join(f"{'    ' * (i + 1)}if x:\n" for i in range(d)) + "    " * (d + 1) + "return x\n") for d in range(7)])
    files: list[tuple[str, Column, Column | None]] = [
        ("src/p{k}/core_{k}.py", F.concat(t("from p{k}.extra_{k} import extra_{k}\n\n\ndef main_{k}(values):\n    return extra_{k}(values)\n\n\ndef long_{k}(values):\n    total = 0\n"), times("    total += 1\n", s), F.lit("    return total\n")), None),
        ("src/p{k}/extra_{k}.py", F.concat(F.when(odd, t("import p{k}.core_{k}\n")).otherwise("import os\n"), t("\n\ndef extra_{k}(values):\n"), times("    # TODO later\n", s % 5), t("    return len(values)\n\n\ndef load_{k}():\n    return 1\n\n\ndef save_{k}():\n    return 1\n\n\ndef render_{k}():\n    return 1\n"), times("# note\n", grown(15, 30, F.lit(0)))), None),
        ("src/p{k}/deep_{k}.py", F.concat(t("def deep_{k}(x):\n"), F.element_at(nested, s % 7 + 1)), None),
        ("src/p{k}/shape_{k}.py", F.concat(t("class Shape_{k}:\n"), times("    x = 1\n", grown(16, 38, s))), None),
        ("src/p{k}/imports_{k}.py", times("import os\n", s), None),
        ("src/p{k}/words_{k}.py", F.concat(F.lit("WORDS = ["), times("'literal of {b}', ", s % 8), F.lit("]\n"), if_(s % 10 == 0, "# GENERATED BY a tool\n")), None),
        ("tests/test_core_{k}.py", F.concat(t("from p{k}.core_{k} import main_{k}\n\n\ndef test_main_{k}():\n"), F.when(odd, t("    main_{k}([1])\n")).otherwise(t("    assert main_{k}([1]) == 1\n")), t("\n\ndef test_nothing_{k}():\n    pass\n\n\ndef test_mocked_{k}():\n    m = Mock()\n    n = MagicMock()\n    mock_it(m, n)\n"), if_(skips, "\n\n@skip\ndef test_later_{k}():\n    assert main_{k}([2])\n" * 3)), tested),
        ("web/p{k}/Panel{k}.tsx", F.concat(t("import React from 'react';\nimport { api } from \"./api{k}\";\nexport type Panel{k}Props = {\n"), times("  readonly name: string;\n", s % 12), t("};\nexport function Panel{k}(props) {\n"), times("  const s = useState(1);\n", s), times("  row(1);\n", grown(10, 36, s)), F.lit("  return api(\"{\"); // }\n}\n")), None),
        ("web/p{k}/route.ts", F.concat(F.lit("export async function GET(request) {\n"), times("  call_{k}(request);\n", s), F.lit("}\n"), times("// TODO later\n", s % 4)), None),
        ("web/p{k}/all.ts", F.concat(times("export const one = 1;\n", s % 14), F.when(odd, "").otherwise("const words = ['same text', 'same text'];\n")), None),
        ("web/p{k}/Panel{k}.test.ts", F.concat(F.lit("it('runs', () => {\n  run();\n});\nit('is true', () => {\n  expect(true).toBe(true);\n});\n"), if_(skips, "it.skip('late', () => {\n  expect(1).toBe(1);\n});\n" * 3)), tested),
        ("srv/p{k}/main.go", F.concat(t("package p{k}\n\nimport (\n\t\"fmt\"\n\tos \"os\"\n)\n\ntype Box{k} struct {\n\tname string\n}\n\nfunc (b *Box{k}) Run() {\n"), times("\tlog(\"message of go\")\n", s % 6), t("\tfmt.Println(\"}\")\n}\n\nfunc Serve{k}() {\n"), times("\tfmt.Println(1)\n", grown(21, 36, s)), F.lit("}\n")), None),
        ("lib/p{k}.rb", F.concat(times("# TODO later\n", s % 5), if_(s % 5 == 4, "x = 1 # quern: ignore[generic.todo_cluster]\n"), times("puts 'hello world'\n", s % 7), times("puts 1\n", grown(21, 36, s))), None),
    ]
    files = [x for x in files if re.search(suffix, x[0].replace("{k}", "1"))]
    own = [s.alias("s")] if size else []
    each = [F.when(F.lit(True) if when is None else when, F.struct(t(path).alias("path"), text.alias("text"))) for path, text, when in files]
    return p.select(*own, F.inline(F.array_compact(F.array(*each))))


#: Functions, files and lines of the Python sources, as the templates have them.
PYTHON_SQL = PARTS + """,
functions AS (SELECT 'src/p' || k || '/core_' || k || '.py' AS path, unnest([{'name': 'main_' || k, 'line': 4, 'size': 2}, {'name': 'long_' || k, 'line': 8, 'size': s + 3}]) AS f FROM parts
 UNION ALL SELECT 'src/p' || k || '/extra_' || k || '.py', unnest([{'name': 'extra_' || k, 'line': 4, 'size': s % 5 + 2}, {'name': 'load_' || k, 'line': 8 + s % 5, 'size': 2}, {'name': 'save_' || k, 'line': 12 + s % 5, 'size': 2}, {'name': 'render_' || k, 'line': 16 + s % 5, 'size': 2}]) FROM parts
 UNION ALL SELECT 'src/p' || k || '/deep_' || k || '.py', {'name': 'deep_' || k, 'line': 1, 'size': s % 7 + 2} FROM parts
 UNION ALL SELECT 'tests/test_core_' || k || '.py', unnest([{'name': 'test_main_' || k, 'line': 4, 'size': 2}, {'name': 'test_nothing_' || k, 'line': 8, 'size': 2}, {'name': 'test_mocked_' || k, 'line': 12, 'size': 4}]) FROM parts WHERE s % 3 = 0
 UNION ALL SELECT 'tests/test_core_' || k || '.py', unnest([{'name': 'test_later_' || k, 'line': 19, 'size': 2}, {'name': 'test_later_' || k, 'line': 24, 'size': 2}, {'name': 'test_later_' || k, 'line': 29, 'size': 2}]) FROM parts WHERE s % 6 = 0),
classes AS (SELECT 'src/p' || k || '/shape_' || k || '.py' AS path, 'Shape_' || k AS name, body + 1 AS size FROM parts),
python_files AS (SELECT 'src/p' || k || '/core_' || k || '.py' AS path, s + 10 AS size FROM parts UNION ALL SELECT 'src/p' || k || '/extra_' || k || '.py', 17 + s % 5 + notes FROM parts UNION ALL SELECT 'src/p' || k || '/deep_' || k || '.py', s % 7 + 2 FROM parts
 UNION ALL SELECT path, size FROM classes UNION ALL SELECT 'src/p' || k || '/imports_' || k || '.py', s FROM parts UNION ALL SELECT 'src/p' || k || '/words_' || k || '.py', CASE WHEN s % 10 = 0 THEN 2 ELSE 1 END FROM parts
 UNION ALL SELECT 'tests/test_core_' || k || '.py', CASE WHEN s % 6 = 0 THEN 30 ELSE 15 END FROM parts WHERE s % 3 = 0)"""


def _cutoff(sizes: str) -> str:
    """SQL: third quartile by the exclusive method plus 1.5 spreads of a list's values, nothing where it doesn't apply."""
    place = lambda i: f"CAST(greatest(1, least(n - 1, floor({i} * (n + 1) / 4))) AS BIGINT)"
    q = lambda i: f"(x[{place(i)}] * (4 - ({i} * (n + 1) - 4 * {place(i)})) + x[{place(i)} + 1] * ({i} * (n + 1) - 4 * {place(i)})) / 4.0"
    return f"(SELECT CASE WHEN n >= 12 AND q3 > q1 THEN q3 + 1.5 * (q3 - q1) END FROM (SELECT n, {q(1)} AS q1, {q(3)} AS q3 FROM (SELECT list_sort(list(size)) AS x, count(*) AS n FROM {sizes})))"


def _rule(name: str, severity: str, confidence: float, source: str, message: str, path: str = "path", symbol: str = "NULL", line: str = "NULL") -> str:
    return f"(SELECT '{name}' AS rule_id, {path} AS file_path, CAST({symbol} AS VARCHAR) AS symbol, '{severity}' AS severity, CAST({confidence} AS DOUBLE) AS confidence, CAST({message} AS VARCHAR) AS message, CAST({line} AS INTEGER) AS line FROM {source})"


_SRC = lambda stem: f"'src/p' || k || '/{stem}_' || k || '.py'"
_TEST, _PANEL, _ROUTE, _ALL, _WEBTEST, _GO, _RB = "'tests/test_core_' || k || '.py'", "'web/p' || k || '/Panel' || k || '.tsx'", "'web/p' || k || '/route.ts'", "'web/p' || k || '/all.ts'", "'web/p' || k || '/Panel' || k || '.test.ts'", "'srv/p' || k || '/main.go'", "'lib/p' || k || '.rb'"
_HASH = lambda text: f"substr(sha256({text}), 1, 12)"
_SHAPES = f"""(SELECT path, name, line, count(*) OVER (PARTITION BY shape) AS n, row_number() OVER (PARTITION BY shape ORDER BY path, line) AS r FROM (
SELECT {_SRC('core')} AS path, 'long_' || k AS name, 8 AS line, 'long' || s AS shape FROM parts WHERE s >= 2 UNION ALL SELECT {_SRC('shape')}, 'Shape_' || k, 1, 'class' || s FROM parts WHERE body >= 5
UNION ALL SELECT {_SRC('deep')}, 'deep_' || k, 1, 'deep' || s % 7 FROM parts WHERE s % 7 >= 4 UNION ALL SELECT {_TEST}, 'test_mocked_' || k, 12, 'mocked' FROM parts WHERE s % 3 = 0)) WHERE n >= 2 AND r = 1"""
_DEAD = f"""(SELECT path, f.name AS name, f.line AS line FROM functions WHERE NOT starts_with(path, 'tests/') AND NOT starts_with(f.name, 'extra_') AND NOT (starts_with(f.name, 'main_') AND path IN (SELECT {_SRC('core')} FROM parts WHERE s % 3 = 0)) UNION ALL SELECT path, name, 1 FROM classes ORDER BY path, line LIMIT 200)"""
_PYTESTS = f"""(SELECT path, t FROM (SELECT {_TEST} AS path, unnest(CASE WHEN s % 2 = 1 THEN [{{'k': 'assertion_free', 'n': 'test_main_' || k, 'l': 4}}] ELSE [] END || [{{'k': 'no_op', 'n': 'test_nothing_' || k, 'l': 8}}, {{'k': 'over_mocked', 'n': 'test_mocked_' || k, 'l': 12}}]) AS t FROM parts WHERE s % 3 = 0) ORDER BY path, t.l LIMIT 200)"""
_WEBTESTS = f"""(SELECT path, t FROM (SELECT {_WEBTEST} AS path, unnest([{{'k': 'assertion_free', 'n': 'runs', 'l': 1}}, {{'k': 'no_op', 'n': 'is true', 'l': 4}}]) AS t FROM parts WHERE s % 3 = 0) ORDER BY path, t.l LIMIT 200)"""

#: What the rules must find.
FINDINGS_SQL = "WITH " + PYTHON_SQL + "\n" + "\nUNION ALL ".join([
    _rule("python.large_file", "warning", 0.9, "python_files WHERE size >= 300", "size || ' lines'"),
    _rule("python.large_function", "warning", 0.9, "functions WHERE f.size >= 50", "f.size || ' lines'", symbol="f.name", line="f.line"),
    _rule("python.large_class", "warning", 0.85, "classes WHERE size >= 200", "size || ' lines'", symbol="name", line="1"),
    _rule("python.todo_cluster", "info", 0.9, "parts WHERE s % 5 >= 3", "s % 5 || ' marker lines'", path=_SRC("extra"), line="5"),
    _rule("python.duplicate_literal", "info", 0.85, "parts WHERE s % 8 >= 4", "'literal used ' || s % 8 || ' times'", path=_SRC("words"), symbol=_HASH("'literal of ' || b"), line="1"),
    _rule("python.too_many_imports", "info", 0.75, "parts WHERE s > 20", "s || ' imports'", path=_SRC("imports")),
    _rule("python.deep_nesting", "warning", 0.75, "parts WHERE s % 7 > 4", "'depth ' || s % 7", path=_SRC("deep")),
    *[_rule("python.missing_nearby_test", "info", 0.65, f"parts WHERE {where}", "'no test file for this module'", path=_SRC(stem)) for stem, where in (("core", "s % 3 <> 0"), ("extra", "true"), ("deep", "true"), ("shape", "true"))],
    _rule("python.mixed_responsibilities", "info", 0.55, "parts WHERE 17 + s % 5 + notes >= 300", "'3 kinds of work'", path=_SRC("extra")),
    _rule("python.suspicious_slop_candidate", "info", 0.5, "parts WHERE s % 10 = 0", "'1 generated lines'", path=_SRC("words"), line="2"),
    _rule("python.relative_large_function", "info", 0.6, f"functions WHERE f.size < 50 AND f.size >= {_cutoff('(SELECT f.size AS size FROM functions)')}", "f.size || ' lines, an outlier here'", symbol="f.name", line="f.line"),
    _rule("python.relative_large_file", "info", 0.6, f"python_files WHERE size < 300 AND size >= {_cutoff('python_files')}", "size || ' lines, an outlier here'"),
    _rule("python.relative_large_class", "info", 0.6, f"classes WHERE size < 200 AND size >= {_cutoff('classes')}", "size || ' lines, an outlier here'", symbol="name", line="1"),
    _rule("python.structural_near_duplicate", "info", 0.8, _SHAPES, "'same shape as ' || n - 1 || ' more'", symbol="name", line="line"),
    _rule("python.dead_code_candidate", "info", 0.6, _DEAD, "'not used anywhere'", symbol="name", line="line"),
    _rule("python.import_cycle", "warning", 0.9, f"(SELECT {_SRC('core')} AS path FROM parts WHERE s % 2 = 1 ORDER BY 1 LIMIT 100)", "'cycle of 2'"),
    _rule("python.x", "warning", 0.8, _PYTESTS, "t.k || ' test'", symbol="t.n", line="t.l").replace("'python.x'", "'python.' || t.k || '_test'").replace("CAST(0.8 AS DOUBLE)", "CAST(CASE WHEN t.k = 'over_mocked' THEN 0.7 ELSE 0.8 END AS DOUBLE)"),
    _rule("python.skipped_test_cluster", "info", 0.7, "parts WHERE s % 6 = 0", "'3 skipped tests'", path=_TEST),
    _rule("typescript.x", "warning", 0.7, _WEBTESTS, "t.k || ' test'", symbol="t.n", line="t.l").replace("'typescript.x'", "'typescript.' || t.k || '_test'"),
    _rule("typescript.skipped_test_cluster", "info", 0.7, "parts WHERE s % 6 = 0", "'3 skipped tests'", path=_WEBTEST),
    _rule("typescript.large_component", "warning", 0.8, "parts WHERE s + rows_ + 3 >= 150", "s + rows_ + 3 || ' lines'", path=_PANEL, symbol="'Panel' || k", line="5 + s % 12"),
    _rule("react.too_many_hooks", "info", 0.7, "parts WHERE s > 8", "s || ' hooks'", path=_PANEL, symbol="'Panel' || k", line="5 + s % 12"),
    _rule("react.too_many_props", "info", 0.65, "parts WHERE s % 12 > 8", "s % 12 || ' props'", path=_PANEL),
    _rule("typescript.too_many_exports", "info", 0.65, "parts WHERE s % 14 > 10", "s % 14 || ' exports'", path=_ALL),
    _rule("next.route_handler_too_much", "warning", 0.75, "parts WHERE s + 2 >= 40", "s + 2 || ' lines'", path=_ROUTE, symbol="'GET'", line="1"),
    _rule("typescript.todo_cluster", "info", 0.8, "parts WHERE s % 4 >= 2", "s % 4 || ' marker lines'", path=_ROUTE, line="s + 3"),
    _rule("typescript.duplicate_literal", "info", 0.7, "parts WHERE s % 2 = 0", "'literal used 2 times'", path=_ALL, symbol=_HASH("'same text'"), line="s % 14 + 1"),
    *[_rule("typescript.missing_nearby_test", "info", 0.65, f"parts WHERE {where}", "'no test file beside it'", path=path) for path, where in ((_PANEL, "s % 3 <> 0"), (_ROUTE, "true"), (_ALL, "s % 14 > 0"))],
    _rule("go.large_file", "warning", 0.9, "parts WHERE 17 + s % 6 + calls >= 300", "17 + s % 6 + calls || ' lines'", path=_GO),
    _rule("go.large_function", "warning", 0.9, "parts WHERE calls + 2 >= 50", "calls + 2 || ' lines'", path=_GO, symbol="'Serve' || k", line="16 + s % 6"),
    _rule("go.missing_nearby_test", "warning", 0.6, "parts", "'no test file in the directory'", path=_GO),
    _rule("go.duplicate_literal", "info", 0.8, "parts WHERE s % 6 >= 4", "'literal used ' || s % 6 || ' times'", path=_GO, symbol=_HASH("'message of go'"), line="13"),
    _rule("generic.large_file", "warning", 0.8, "(SELECT *, s % 5 + CASE WHEN s % 5 = 4 THEN 1 ELSE 0 END + s % 7 + calls AS n FROM parts) WHERE n >= 300", "n || ' lines'", path=_RB),
    # The directive's own line holds the letters of a marker, too.
    _rule("generic.todo_cluster", "info", 0.8, "parts WHERE s % 5 >= 3", "s % 5 + CASE WHEN s % 5 = 4 THEN 1 ELSE 0 END || ' marker lines'", path=_RB, line="1"),
    _rule("generic.duplicate_literal", "info", 0.7, "parts WHERE s % 7 >= 4", "'literal used ' || s % 7 || ' times'", path=_RB, symbol=_HASH("'hello world'"), line="s % 5 + CASE WHEN s % 5 = 4 THEN 1 ELSE 0 END + 1"),
])
