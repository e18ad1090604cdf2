"""Rules: facts to findings, each a filter or a having and a projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import is_test_go, is_test_python, is_test_ts
from quern.operators import parsing
from quern.operators.findings import outliers
from quern.sources.folders import dropped, kept


@dataclass(frozen=True)
class Thresholds:
    """Where a size or count becomes a finding."""

    file_lines: int = 300
    function_lines: int = 50
    class_lines: int = 200
    todos: int = 3
    ts_todos: int = 2
    literal_count: int = 4
    literal_length: int = 8
    imports: int = 20
    depth: int = 4
    mocks: int = 3
    skips: int = 3
    component_lines: int = 150
    hooks: int = 8
    props: int = 8
    exports: int = 10
    route_lines: int = 40
    relative: bool = True

    @staticmethod
    def strict() -> Thresholds:
        return Thresholds(
            file_lines=70,
            function_lines=25,
            class_lines=60,
            imports=12,
            depth=4,
            todos=3,
            literal_count=3,
            literal_length=4,
            relative=False,
            component_lines=12,
            hooks=1,
            props=3,
            exports=3,
            route_lines=3,
        )


#: Fixed value: verbs of names; three in one file mean mixed responsibilities.
VERBS = ("load", "save", "render", "export", "build", "summarize")
CAP = 200
#: Fixed value: import cycles that are reported, the largest first.
CYCLES = 100


#: Paths of TypeScript and JavaScript, and of all that isn't Python.
TS, OTHERS = r"\.(?:tsx?|jsx?)$", r"(?<!\.py)$"
#: Words that make a line a marker, or a sign of generated code.
MARKERS, GENERATED = ("TODO", "FIXME", "HACK"), ("GENERATED BY", "PLACEHOLDER")


def _sums(files: DataFrame) -> DataFrame:
    """path, lines, lines with marks and the first of them, export lines of each file; only files that hold a mark are cut into lines for it."""
    text = F.col("text")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    n = F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")

    def told(name: str, words: tuple[str, ...]) -> list[Column]:
        upper = F.upper(text)
        marks = F.transform(F.split(upper, "\n", -1), lambda line: parsing.holds(line, *words))
        marks = F.when(parsing.holds(upper, *words), marks)
        return [F.coalesce(F.size(F.filter(marks, lambda m: m)), F.lit(0)).cast("long").alias(name), F.nullif(F.array_position(marks, F.lit(True)), F.lit(0)).cast("int").alias(f"{name}_line")]

    exported = F.when(text.contains("export"), F.size(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"^\s*export\s")))).otherwise(0).cast("long")
    return files.select("path", F.coalesce(n, F.lit(0)).alias("n"), *told("markers", MARKERS), *told("generated", GENERATED), exported.alias("exports"))


def _looked_at() -> Column:
    """Lines outside of Python that a rule below looks at: those with quotes, and in TypeScript hooks, props and tests."""
    text = F.col("text")
    return parsing.holds(text, '"', "'", "`") | (_ts() & (parsing.holds(text, "use", "readonly", "Props", "};") | (is_test_ts(F.col("path")) & parsing.holds(text, "(", "assert"))))


@dataclass
class Facts:
    """What rules read: files (path), the lines that a rule may look at, what each file's lines add up to, facts of Python, symbols of the other languages."""

    files: DataFrame
    lines: DataFrame
    sums: DataFrame
    python: DataFrame
    ts: DataFrame
    go: DataFrame
    at: Thresholds
    table: DataFrame

    @staticmethod
    def of(files: DataFrame, at: Thresholds | None = None, of: Callable[[str], DataFrame] | None = None) -> Facts:
        """Parsed once: every rule reads the same tables, which are written to the shared folder.

        of: the files whose path matches a pattern, where they can be had without the others.
        """
        of = of or (lambda pattern: files.filter(F.col("path").rlike(pattern)))
        sums = kept(_sums(files), "sums")
        lines = kept(parsing.source_lines(of(OTHERS)).filter(_looked_at()), "lines")
        ts, go = kept(parsing.ts_symbols(of(TS)), "ts"), kept(parsing.go_symbols(of(r"\.go$")), "go")
        return Facts(sums.select("path"), lines, sums.filter("n > 0"), kept(parsing.python_facts(of(r"\.py$")), "python", by="fact"), ts, go, at or Thresholds(), sums)

    def release(self) -> None:
        """Deletes what of() has written, once nothing reads it any more."""
        dropped(self.lines, self.table, self.python, self.ts, self.go)


RULES: dict[str, Callable[[Facts], DataFrame]] = {}


def finding(df: DataFrame, rule: str, severity: str, confidence, message, symbol=None, line=None) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(rule).alias("rule_id"), F.col("path").alias("file_path"), as_column(symbol).cast("string").alias("symbol"), F.lit(severity).alias("severity"), as_column(confidence).cast("double").alias("confidence"), as_column(message).cast("string").alias("message"), as_column(line).cast("int").alias("line"))


def rule(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
    RULES[f.__name__] = f
    return f


def run_rules(facts: Facts, names: list[str] | None = None) -> DataFrame:
    """Findings of the named rules, or of all, in the order of the registry."""
    chosen = [n for n in (names or RULES) if facts.at.relative or "relative" not in n]
    return reduce(DataFrame.unionByName, [RULES[n](facts) for n in chosen])


def _is(*suffixes: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col("path").endswith(s) for s in suffixes])


def _ts() -> Column:
    return _is(".ts", ".tsx", ".js", ".jsx")


def _sized(f: Facts, where: Column, name: str, confidence: float = 0.9) -> DataFrame:
    n = f.sums.filter(where & (F.col("n") >= f.at.file_lines))
    return finding(n, name, "warning", confidence, F.concat(F.col("n"), F.lit(" lines")))


def _marked(f: Facts, where: Column, marks: str, least: int, name: str, word: str, confidence: float) -> DataFrame:
    n = f.sums.filter(where & (F.col(marks) >= least))
    return finding(n, name, "info", confidence, F.concat(F.col(marks), F.lit(f" {word} lines")), line=F.col(f"{marks}_line"))


def _repeated(literals: DataFrame, least: int, length: Column, name: str, confidence: float) -> DataFrame:
    n = literals.filter(length).groupBy("path", "literal").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("l")).filter(F.col("n") >= least)
    return finding(n, name, "info", confidence, F.concat(F.lit("literal used "), F.col("n"), F.lit(" times")), symbol=F.substring(F.sha2("literal", 256), 1, 12), line=F.col("l"))


def _text_literals(f: Facts, where: Column) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(r"""(["'`])((?:(?!\1).)+)\1"""), F.lit(2)))
    return f.lines.filter(where).select("path", "line", found.alias("literal"))


def _span(symbols: DataFrame, kinds: list[str], least: int, name: str, confidence: float) -> DataFrame:
    n = symbols.filter(F.col("kind").isin(*kinds)).withColumn("n", F.col("end_line") - F.col("line") + 1).filter(F.col("n") >= least)
    return finding(n, name, "warning", confidence, F.concat(F.col("n"), F.lit(" lines")), symbol=F.col("name"), line=F.col("line"))


def _symbols(f: Facts) -> DataFrame:
    return f.python.filter("fact = 'symbol'")


@rule
def python_large_file(f: Facts) -> DataFrame:
    return _sized(f, _is(".py"), "python.large_file")


@rule
def python_large_function(f: Facts) -> DataFrame:
    return _span(_symbols(f), ["function", "method", "async_function"], f.at.function_lines, "python.large_function", 0.9)


@rule
def python_large_class(f: Facts) -> DataFrame:
    return _span(_symbols(f), ["class"], f.at.class_lines, "python.large_class", 0.85)


@rule
def python_todo_cluster(f: Facts) -> DataFrame:
    return _marked(f, _is(".py"), "markers", f.at.todos, "python.todo_cluster", "marker", 0.9)


@rule
def python_duplicate_literal(f: Facts) -> DataFrame:
    return _repeated(f.python.filter("fact = 'literal'").withColumn("literal", F.col("text")), f.at.literal_count, F.length("literal") >= f.at.literal_length, "python.duplicate_literal", 0.85)


@rule
def python_too_many_imports(f: Facts) -> DataFrame:
    n = f.python.filter("fact = 'import'").groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > f.at.imports)
    return finding(n, "python.too_many_imports", "info", 0.75, F.concat(F.col("n"), F.lit(" imports")))


@rule
def python_deep_nesting(f: Facts) -> DataFrame:
    return finding(f.python.filter((F.col("fact") == "depth") & (F.col("n") > f.at.depth)), "python.deep_nesting", "warning", 0.75, F.concat(F.lit("depth "), F.col("n")))


@rule
def python_missing_nearby_test(f: Facts) -> DataFrame:
    """Files with symbols and no test file that carries their stem; corrected to look at the files there are."""
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    own = _symbols(f).filter(~is_test_python(F.col("path"))).select("path", stem.alias("stem")).distinct()
    tests = f.files.filter(is_test_python(F.col("path"))).select(F.regexp_replace(stem, "^test_|_test$", "").alias("_s")).distinct()
    return finding(own.join(tests, F.col("stem") == F.col("_s"), "left_anti"), "python.missing_nearby_test", "info", 0.65, "no test file for this module")


@rule
def python_mixed_responsibilities(f: Facts) -> DataFrame:
    verb = F.regexp_extract(F.element_at(F.split("name", r"\."), -1), f"^({'|'.join(VERBS)})_", 1)
    v = _symbols(f).select("path", verb.alias("v")).filter("v <> ''").groupBy("path").agg(F.countDistinct("v").alias("n")).filter("n >= 3")
    long = f.sums.select(F.col("path").alias("_p"), F.col("n").alias("lines")).filter(F.col("lines") >= f.at.file_lines)
    return finding(v.join(long, F.col("path") == F.col("_p")), "python.mixed_responsibilities", "info", 0.55, F.concat(F.col("n"), F.lit(" kinds of work")))


@rule
def python_suspicious_slop_candidate(f: Facts) -> DataFrame:
    return _marked(f, _is(".py"), "generated", 1, "python.suspicious_slop_candidate", "generated", 0.5)


@rule
def python_relative_large_function(f: Facts) -> DataFrame:
    s = _symbols(f).filter(F.col("kind").isin("function", "method", "async_function")).select("path", "name", "line", (F.col("end_line") - F.col("line") + 1).alias("size"), F.lit("function").alias("group"))
    return finding(outliers(s, ["group"], "size", f.at.function_lines), "python.relative_large_function", "info", 0.6, F.concat(F.col("size"), F.lit(" lines, an outlier here")), symbol=F.col("name"), line=F.col("line"))


@rule
def python_relative_large_file(f: Facts) -> DataFrame:
    s = f.sums.filter(_is(".py")).select("path", F.col("n").alias("size"), F.lit("file").alias("group"))
    return finding(outliers(s, ["group"], "size", f.at.file_lines), "python.relative_large_file", "info", 0.6, F.concat(F.col("size"), F.lit(" lines, an outlier here")))


@rule
def python_relative_large_class(f: Facts) -> DataFrame:
    s = _symbols(f).filter("kind = 'class'").select("path", "name", "line", (F.col("end_line") - F.col("line") + 1).alias("size"), F.lit("class").alias("group"))
    return finding(outliers(s, ["group"], "size", f.at.class_lines), "python.relative_large_class", "info", 0.6, F.concat(F.col("size"), F.lit(" lines, an outlier here")), symbol=F.col("name"), line=F.col("line"))


@rule
def python_structural_near_duplicate(f: Facts) -> DataFrame:
    p = f.python.filter("fact = 'fingerprint'")
    n = p.groupBy(F.col("text").alias("_t")).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("path", "line")).alias("first")).filter("members >= 2")
    return finding(p.join(n, F.col("text") == F.col("_t")).filter((F.col("path") == F.col("first.path")) & (F.col("line") == F.col("first.line"))), "python.structural_near_duplicate", "info", 0.8, F.concat(F.lit("same shape as "), F.col("members") - 1, F.lit(" more")), symbol=F.col("name"), line=F.col("line"))


@rule
def python_dead_code_candidate(f: Facts) -> DataFrame:
    """Symbols of a module's top level that no reference, import or entry point names."""
    top = _symbols(f).filter((F.col("n") == 0) & ~F.col("name").startswith("__") & ~is_test_python(F.col("path")))
    used = f.python.filter("fact in ('reference', 'entry')").select(F.col("name").alias("_u")).unionByName(f.python.filter("fact = 'import' and text is not null").select(F.col("text").alias("_u"))).distinct()
    return finding(top.join(used, F.col("name") == F.col("_u"), "left_anti").orderBy("path", "line").limit(CAP), "python.dead_code_candidate", "info", 0.6, "not used anywhere", symbol=F.col("name"), line=F.col("line"))


def _import_edges(f: Facts) -> DataFrame:
    from quern.operators.graph import resolve_imports

    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^src/", ""), r"(/__init__)?\.py$", ""), "/", ".")
    modules = f.files.filter(_is(".py")).select(module.alias("module"), "path", F.col("path").alias("position"))
    package = F.regexp_replace("_mod", r"\.?[^.]*$", "")
    imports = f.python.filter("fact = 'import'").withColumn("_mod", module)
    above = F.slice(F.split(package, r"\."), F.lit(1), F.greatest(F.lit(0), F.size(F.split(package, r"\.")) - F.col("n").cast("int") + 1))
    absolute = F.when(F.col("n") > 0, F.concat_ws(".", F.array_join(above, "."), F.nullif(F.col("name"), F.lit("")))).otherwise(F.col("name"))
    return resolve_imports(imports.select(F.col("path").alias("src"), absolute.alias("module"), F.col("text").alias("name")), modules)


@rule
def python_import_cycle(f: Facts) -> DataFrame:
    from quern.operators.graph import strong_components

    e = _import_edges(f)
    scc = strong_components(e.filter("src <> dst"))
    groups = scc.groupBy("component").agg(F.max("size").alias("n")).select(F.col("component").alias("path"), "n")
    loops = e.filter("src = dst").select(F.col("src").alias("path"), F.lit(1).cast("long").alias("n"))
    first = groups.withColumn("loop", F.lit(False)).unionByName(loops.withColumn("loop", F.lit(True))).orderBy(F.desc("n"), "path").limit(CYCLES)
    message = F.when(F.col("loop"), "imports itself").otherwise(F.concat(F.lit("cycle of "), F.col("n")))
    return finding(first, "python.import_cycle", "warning", F.when(F.col("loop"), 0.7).otherwise(0.9), message)


def _test_findings(tests: DataFrame, f: Facts, language: str) -> DataFrame:
    """tests: path, name, line, asserts, trivial, mocks, empty; the first that applies counts."""
    nothing = F.col("empty") | ((F.col("trivial") > 0) & (F.col("asserts") == F.col("trivial")))
    kind = F.when(nothing, "no_op").when((F.col("mocks") >= f.at.mocks) & (F.col("mocks") > 2 * F.col("asserts")), "over_mocked").when(F.col("asserts") == 0, "assertion_free")
    t = tests.withColumn("k", kind).filter("k is not null").orderBy("path", "line").limit(CAP)
    sure = F.when(F.col("k") == "over_mocked", 0.7).otherwise(0.8 if language == "python" else 0.7)
    out = finding(t, language, "warning", sure, F.concat(F.col("k"), F.lit(" test")), symbol=F.col("name"), line=F.col("line"))
    return out.withColumn("rule_id", F.concat(F.lit(f"{language}."), F.split("message", " ")[0], F.lit("_test")))


@rule
def python_test_quality(f: Facts) -> DataFrame:
    part = F.split("text", ",")
    tests = f.python.filter("fact = 'test'").select("path", "name", "line", F.col("n").alias("asserts"), part[0].cast("long").alias("trivial"), part[1].cast("long").alias("mocks"), (part[3] == "1").alias("empty"))
    return _test_findings(tests, f, "python")


@rule
def python_skipped_test_cluster(f: Facts) -> DataFrame:
    n = f.python.filter("fact = 'test'").groupBy("path").agg(F.sum(F.split("text", ",")[2].cast("long")).alias("n")).filter(F.col("n") >= f.at.skips)
    return finding(n, "python.skipped_test_cluster", "info", 0.7, F.concat(F.col("n"), F.lit(" skipped tests")))


def _ts_tests(f: Facts) -> DataFrame:
    """Blocks of test(...) or it(...) by the running count of such lines; counts by pattern."""
    from pyspark.sql import Window

    lines = f.lines.filter(_ts() & is_test_ts(F.col("path")))
    opened = F.col("text").rlike(r"^\s*(?:it|test)(?:\.\w+)?\(")
    b = lines.withColumn("b", F.sum(opened.cast("int")).over(Window.partitionBy("path").orderBy("line"))).filter("b > 0")
    count = lambda rx: F.sum(F.regexp_count("text", F.lit(rx))).cast("long")
    return b.groupBy("path", "b").agg(F.min("line").alias("line"), F.min_by(F.regexp_extract("text", r"""["'`]([^"'`]*)""", 1), "line").alias("name"), count(r"\bexpect\(|\bassert[.(]").alias("asserts"), count(r"expect\(true\)\.toBe\(true\)").alias("trivial"), count(r"\b(?:jest|vi)\.(?:mock|fn|spyOn)\(").alias("mocks"), count(r"^\s*(?:it|test|describe)\.skip\(|^\s*x(?:it|test|describe)\(").alias("skips"))


@rule
def typescript_test_quality(f: Facts) -> DataFrame:
    return _test_findings(_ts_tests(f).withColumn("empty", F.lit(False)), f, "typescript")


@rule
def typescript_skipped_test_cluster(f: Facts) -> DataFrame:
    n = _ts_tests(f).groupBy("path").agg(F.sum("skips").alias("n")).filter(F.col("n") >= f.at.skips)
    return finding(n, "typescript.skipped_test_cluster", "info", 0.7, F.concat(F.col("n"), F.lit(" skipped tests")))


@rule
def typescript_large_component(f: Facts) -> DataFrame:
    return _span(f.ts, ["component"], f.at.component_lines, "typescript.large_component", 0.8)


def _in_symbols(f: Facts, kinds: list[str], pattern: str, most: int, name: str, word: str) -> DataFrame:
    # Lines that hold any; the join is by path, the span a residual filter.
    lines = f.lines.filter(_ts()).select(F.col("path").alias("_p"), F.col("line").alias("_l"), F.regexp_count("text", F.lit(pattern)).alias("c")).filter("c > 0")
    s = f.ts.filter(F.col("kind").isin(*kinds))
    n = s.join(lines, (F.col("path") == F.col("_p")) & F.col("_l").between(F.col("line"), F.col("end_line"))).groupBy("path", "name", "line").agg(F.sum("c").alias("n")).filter(F.col("n") > most)
    return finding(n, name, "info", 0.7, F.concat(F.col("n"), F.lit(f" {word}")), symbol=F.col("name"), line=F.col("line"))


@rule
def react_too_many_hooks(f: Facts) -> DataFrame:
    return _in_symbols(f, ["component"], r"\buse[A-Z]\w*\(", f.at.hooks, "react.too_many_hooks", "hooks")


@rule
def react_too_many_props(f: Facts) -> DataFrame:
    """readonly members between `type …Props = {` and `};`."""
    from pyspark.sql import Window

    marker = F.when(F.col("text").rlike(r"^\s*(?:export\s+)?type\s+\w*Props\s*=\s*\{"), "open").when(F.col("text").rlike(r"^\s*\};"), "closed")
    state = F.last(marker, ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    n = f.lines.filter(_ts()).withColumn("s", state).filter((F.col("s") == "open") & F.col("text").rlike(r"^\s*readonly\s")).groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > f.at.props)
    return finding(n, "react.too_many_props", "info", 0.65, F.concat(F.col("n"), F.lit(" props")))


@rule
def typescript_too_many_exports(f: Facts) -> DataFrame:
    return finding(f.sums.filter(_ts() & (F.col("exports") > f.at.exports)), "typescript.too_many_exports", "info", 0.65, F.concat(F.col("exports"), F.lit(" exports")))


@rule
def next_route_handler_too_much(f: Facts) -> DataFrame:
    return _span(f.ts, ["route"], f.at.route_lines, "next.route_handler_too_much", 0.75)


@rule
def typescript_todo_cluster(f: Facts) -> DataFrame:
    return _marked(f, _ts(), "markers", f.at.ts_todos, "typescript.todo_cluster", "marker", 0.8)


@rule
def typescript_duplicate_literal(f: Facts) -> DataFrame:
    return _repeated(_text_literals(f, _ts()), 2, F.length("literal") > 4, "typescript.duplicate_literal", 0.7)


@rule
def typescript_missing_nearby_test(f: Facts) -> DataFrame:
    stem = F.regexp_replace("path", r"\.[jt]sx?$", "")
    own = f.ts.filter(~is_test_ts(F.col("path"))).select("path").distinct().withColumn("stem", stem)
    tests = f.files.filter(is_test_ts(F.col("path"))).select(F.regexp_replace("path", r"\.(test|spec)\.[jt]sx?$", "").alias("_s")).distinct()
    return finding(own.join(tests, F.col("stem") == F.col("_s"), "left_anti"), "typescript.missing_nearby_test", "info", 0.65, "no test file beside it")


@rule
def typescript_suspicious_slop_candidate(f: Facts) -> DataFrame:
    return _marked(f, _ts(), "generated", 1, "typescript.suspicious_slop_candidate", "generated", 0.5)


@rule
def go_large_file(f: Facts) -> DataFrame:
    return _sized(f, _is(".go"), "go.large_file")


@rule
def go_large_function(f: Facts) -> DataFrame:
    return _span(f.go, ["function", "method"], f.at.function_lines, "go.large_function", 0.9)


@rule
def go_missing_nearby_test(f: Facts) -> DataFrame:
    """Exported functions in a directory without a test file."""
    directory = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    own = f.go.filter((F.col("kind") == "function") & F.col("name").rlike("^[A-Z]") & ~is_test_go(F.col("path"))).select("path", directory.alias("d")).distinct()
    tests = f.files.filter(is_test_go(F.col("path"))).select(directory.alias("_d")).distinct()
    return finding(own.join(tests, F.col("d") == F.col("_d"), "left_anti"), "go.missing_nearby_test", "warning", 0.6, "no test file in the directory")


@rule
def go_duplicate_literal(f: Facts) -> DataFrame:
    return _repeated(_text_literals(f, _is(".go")), f.at.literal_count, F.length("literal") >= f.at.literal_length, "go.duplicate_literal", 0.8)


def _generic() -> Column:
    return ~(_ts() | _is(".py", ".go"))


@rule
def generic_large_file(f: Facts) -> DataFrame:
    return _sized(f, _generic(), "generic.large_file", 0.8)


@rule
def generic_todo_cluster(f: Facts) -> DataFrame:
    return _marked(f, _generic(), "markers", f.at.todos, "generic.todo_cluster", "marker", 0.8)


@rule
def generic_duplicate_literal(f: Facts) -> DataFrame:
    return _repeated(_text_literals(f, _generic()), f.at.literal_count, F.length("literal") >= f.at.literal_length, "generic.duplicate_literal", 0.7)


def changed_without_test(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """Changed sources no test path shares a term with; both (path); terms of three letters and more of the file name."""
    terms = lambda p: F.filter(F.split(F.lower(F.regexp_extract(p, r"([^/]+?)(?:\.[^.]*)?$", 1)), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin("test", "tests", "spec"))
    t = tests.select(F.explode(terms("path")).alias("_t")).distinct()
    held = changed.select("path", F.explode_outer(terms("path")).alias("t")).join(t, F.col("t") == F.col("_t"), "left").groupBy("path").agg(F.count("_t").alias("n")).filter("n = 0")
    return finding(held, "python.changed_source_without_related_test", "warning", 0.6, "changed, and no related test")
