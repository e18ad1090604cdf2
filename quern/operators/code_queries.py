"""Queries of parsers and rules over the sources that the part table makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import parsing, rules
from quern.operators.table_sources import FINDINGS_SQL, PARTS, PYTHON_SQL, _SHAPES, source_tree
from quern.registry import query
from quern.sources.folders import kept


def _of(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    return source_tree(spark, sf_dir, suffix)


def _python(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return parsing.python_facts(_of(spark, sf_dir, r"\.py$"), *only)


@query("WITH " + PYTHON_SQL + " SELECT path, f.name AS name, 'function' AS kind, CAST(f.line AS INTEGER) AS line, CAST(f.line + f.size - 1 AS INTEGER) AS end_line FROM functions UNION ALL SELECT path, name, 'class', 1, CAST(size AS INTEGER) FROM classes")
def python_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _python(spark, sf_dir, "symbol").select("path", "name", "kind", "line", "end_line")


@query("WITH " + PARTS + """ SELECT 'src/p' || k || '/core_' || k || '.py' AS path, 'p' || k || '.extra_' || k AS module, 'extra_' || k AS name, CAST(1 AS BIGINT) AS n FROM parts
UNION ALL SELECT 'src/p' || k || '/extra_' || k || '.py', CASE WHEN s % 2 = 1 THEN 'p' || k || '.core_' || k ELSE 'os' END, NULL, 1 FROM parts UNION ALL SELECT 'src/p' || k || '/imports_' || k || '.py', 'os', NULL, s FROM parts WHERE s > 0
UNION ALL SELECT 'tests/test_core_' || k || '.py', 'p' || k || '.core_' || k, 'main_' || k, 1 FROM parts WHERE s % 3 = 0""")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _python(spark, sf_dir, "import")
    return i.groupBy("path", F.col("name").alias("module"), F.col("text").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + PARTS + """ SELECT 'web/p' || k || '/Panel' || k || '.tsx' AS path, CAST(5 + s % 12 AS INTEGER) AS line, 'Panel' || k AS name, 'component' AS kind, CAST(7 + s % 12 + s + rows_ AS INTEGER) AS end_line FROM parts
UNION ALL SELECT 'web/p' || k || '/route.ts', 1, 'GET', 'route', CAST(s + 2 AS INTEGER) FROM parts
UNION ALL SELECT 'web/p' || k || '/all.ts', CAST(i AS INTEGER), 'one', 'function', CAST(least(i + 1, s % 14 + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) FROM (SELECT k, s, unnest(range(1, s % 14 + 1)) AS i FROM parts)""")
def typescript_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.ts_symbols(_of(spark, sf_dir, r"\.tsx?$")).select("path", "line", "name", "kind", "end_line")


@query("WITH " + PARTS + """ SELECT path, r.name AS name, CAST(r.confidence AS DOUBLE) AS confidence, CAST(r.n AS BIGINT) AS n FROM (
SELECT 'web/p' || k || '/Panel' || k || '.tsx' AS path, unnest([{'name': 'react', 'confidence': 1.0, 'n': 1}, {'name': './api' || k, 'confidence': 1.0, 'n': 1}, {'name': 'Panel' || k, 'confidence': 0.4, 'n': 1}, {'name': 'useState', 'confidence': 0.4, 'n': s}, {'name': 'row', 'confidence': 0.4, 'n': rows_}, {'name': 'api', 'confidence': 0.4, 'n': 1}]) AS r FROM parts
UNION ALL SELECT 'web/p' || k || '/route.ts', unnest([{'name': 'GET', 'confidence': 0.4, 'n': 1}, {'name': 'call_' || k, 'confidence': 0.4, 'n': s}]) FROM parts
UNION ALL SELECT 'web/p' || k || '/Panel' || k || '.test.ts', unnest([{'name': 'it', 'confidence': 0.4, 'n': 2}, {'name': 'run', 'confidence': 0.4, 'n': 1}, {'name': 'expect', 'confidence': 0.4, 'n': CASE WHEN s % 6 = 0 THEN 4 ELSE 1 END}, {'name': 'toBe', 'confidence': 0.4, 'n': CASE WHEN s % 6 = 0 THEN 4 ELSE 1 END}, {'name': 'skip', 'confidence': 0.4, 'n': CASE WHEN s % 6 = 0 THEN 3 ELSE 0 END}]) FROM parts WHERE s % 3 = 0) WHERE r.n > 0""")
def typescript_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported modules and calls of each file; the parenthesis in a string and the one in a comment are none."""
    return parsing.ts_references(_of(spark, sf_dir, r"\.tsx?$")).groupBy("path", "name", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + PARTS + """ SELECT 'srv/p' || k || '/main.go' AS path, g.name AS name, g.kind AS kind, CAST(g.line AS INTEGER) AS line, CAST(g.e AS INTEGER) AS end_line FROM (SELECT k, unnest([{'name': 'Box' || k, 'kind': 'struct', 'line': 8, 'e': 10},
{'name': 'Run', 'kind': 'method', 'line': 12, 'e': 14 + s % 6}, {'name': 'Serve' || k, 'kind': 'function', 'line': 16 + s % 6, 'e': 17 + s % 6 + calls}, {'name': 'fmt', 'kind': 'import', 'line': 4, 'e': 4}, {'name': 'os', 'kind': 'import', 'line': 5, 'e': 5}]) AS g FROM parts)""")
def go_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    go = _of(spark, sf_dir, r"\.go$")
    return parsing.go_symbols(go).select("path", "name", "kind", "line", "end_line").unionByName(parsing.go_imports(go).select("path", F.col("module").alias("name"), F.lit("import").alias("kind"), "line", F.col("line").alias("end_line")))


@query("WITH " + PARTS + """ SELECT 'p' || k AS package, r.name AS name, CAST(r.n AS BIGINT) AS n FROM (SELECT k, unnest([{'name': 'import', 'n': 1}, {'name': 'Run', 'n': 1}, {'name': 'log', 'n': s % 6}, {'name': 'Println', 'n': 1 + calls}, {'name': 'Serve' || k, 'n': 1}]) AS r FROM parts) WHERE r.n > 0""")
def go_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    go = _of(spark, sf_dir, r"\.go$")
    return parsing.go_references(go.withColumn("package", parsing.go_package()), "package").groupBy("package", "name").agg(F.count(F.lit(1)).alias("n"))


@query(FINDINGS_SQL)
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run_rules(rules.Facts.of(source_tree(spark, sf_dir), of=lambda pattern: source_tree(spark, sf_dir, pattern)))


@query("WITH " + PARTS + " SELECT n AS members, path, name FROM " + _SHAPES.replace("WHERE n >= 2 AND r = 1", "WHERE r = 1"))
def fingerprint_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes by their first place."""
    first = F.min(F.struct("path", "line", "name")).alias("first")
    return _python(spark, sf_dir, "fingerprint").groupBy("text").agg(F.count(F.lit(1)).alias("members"), first).select("members", "first.path", "first.name")


@query("WITH " + PARTS + """ SELECT 'src/p' || k || '/core_' || k || '.py' AS path, 'main_' || k AS name, 'changed' AS change FROM parts WHERE s % 4 = 0
UNION ALL SELECT 'src/p' || k || '/extra_' || k || '.py', unnest(['load_' || k, 'loaded_' || k]), unnest(['removed', 'added']) FROM parts WHERE s % 9 = 0""")
def api_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after: files of parts of some sizes have another signature, others another name."""
    size = F.col("s")
    old = source_tree(spark, sf_dir, r"^src/.*\.py$", size=True)
    text = F.when(size % 4 == 0, F.regexp_replace("text", r"def main_(\d+)\(values\)", "def main_$1(values, extra=None)")).otherwise(F.col("text"))
    text = F.when(size % 9 == 0, F.regexp_replace(text, "def load_", "def loaded_")).otherwise(text)
    return parsing.public_changes(parsing.python_facts(old, "symbol"), parsing.python_facts(old.withColumn("text", text), "symbol"))


@query("WITH " + PARTS + " SELECT 'lib/p' || k || '.rb' AS path, CAST(5 AS INTEGER) AS line, ['generic.todo_cluster'] AS rules FROM parts WHERE s % 5 = 4")
def inline_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.directives(source_tree(spark, sf_dir))


_CALLS = PARTS + """, calls AS (SELECT 'src/p' || k || '/core_' || k || '.py' AS path, 'main_' || k AS caller, 'extra_' || k AS call_text, 5 AS line, k FROM parts
UNION ALL SELECT 'src/p' || k || '/extra_' || k || '.py', 'extra_' || k, 'len', 5 + s % 5, k FROM parts
UNION ALL SELECT 'tests/test_core_' || k || '.py', c.by, c.call, c.line, k FROM (SELECT k, unnest([{'by': 'test_main_' || k, 'call': 'main_' || k, 'line': 5}, {'by': 'test_mocked_' || k, 'call': 'Mock', 'line': 13}, {'by': 'test_mocked_' || k, 'call': 'MagicMock', 'line': 14}, {'by': 'test_mocked_' || k, 'call': 'mock_it', 'line': 15}]) AS c FROM parts WHERE s % 3 = 0)
UNION ALL SELECT 'tests/test_core_' || k || '.py', 'test_later_' || k, 'main_' || k, unnest([20, 25, 30]), k FROM parts WHERE s % 6 = 0)"""


@query("WITH " + _CALLS + " SELECT path, caller, call_text, CAST(line AS INTEGER) AS line, CAST(1.0 AS DOUBLE) AS confidence FROM calls")
def parsed_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.call_edges(kept(_python(spark, sf_dir, "symbol", "reference"), "facts"))


@query("WITH " + _CALLS + " SELECT call_text AS name, path, caller, CAST(line AS INTEGER) AS line, CAST(1.0 AS DOUBLE) AS confidence FROM calls WHERE call_text IN ('extra_' || k, 'main_' || k)")
def parsed_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = kept(_python(spark, sf_dir, "symbol", "reference"), "facts")
    return parsing.callers_of(parsing.call_edges(facts), facts.filter("fact = 'symbol'").select("name"))
