"""Source text to facts: Python by its syntax tree, TypeScript, JavaScript and Go by line patterns.

Facts are rows of one shape: path, fact, name, kind, line, end_line, n, text,
confidence. What the columns hold depends on the fact:

symbol       name is qualified, kind, span
import       name the module, text the imported name, n the dots of a relative import
reference    name, confidence 1.0 for calls and 0.4 for annotations
literal      text of a string constant
depth        name of the deepest block's file, n the nesting
fingerprint  text of a function's shape, span
test         name, n assertions, text "trivial,mocks,skips"
entry        names that are registered or exported
error        text of a syntax error
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTS = "path string, fact string, name string, kind string, line int, end_line int, n long, text string, confidence double"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in FACTS.split(", ")])
BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)
MIN_STATEMENTS, MIN_NODES = 3, 18
#: Fixed value: attributes whose decorators and calls register what they are given.
REGISTRATION = ("tool", "command", "resource", "prompt")


_AST = ast.AST
#: Nodes that imports, references, entries and literals are made of.
_TOLD = frozenset((ast.Import, ast.ImportFrom, ast.Call, ast.AnnAssign, ast.Constant, ast.Assign))


@cache
def _holding(kind: type) -> tuple[str, ...]:
    """Fields of a kind of node that may hold nodes; names, numbers and constants hold none."""
    told = getattr(kind, "_field_types", {})
    return tuple(f for f in kind._fields if told.get(f) not in (str, int, object, str | None, int | None))


#: Nodes whose own fields, not only the nodes below them, are part of a shape.
_NAMED = (ast.Constant, ast.Name, ast.arg, ast.alias, ast.keyword, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


@cache
def _blocks_of(kind: type) -> tuple[str, ...]:
    return tuple(f for f in ("body", "handlers", "orelse", "finalbody", "cases") if f in kind._fields)


def _children(node: ast.AST) -> list[ast.AST]:
    """As ast.iter_child_nodes gives them."""
    out: list[ast.AST] = []
    for name in _holding(type(node)):
        inner = getattr(node, name, None)
        if type(inner) is list:
            out.extend([y for y in inner if isinstance(y, _AST)])
        elif isinstance(inner, _AST):
            out.append(inner)
    return out


class _Shape:
    """A definition as text, alike for renamed copies: names are numbered as they first appear, docstrings and values left out."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def _name(self, name: str) -> str:
        return f"#{self.numbers.setdefault(name, len(self.numbers))}"

    def of(self, node: ast.AST) -> str:
        own, inner = type(node).__name__, _children(node)
        if not inner and not isinstance(node, _NAMED):
            return f"{own}[]"
        if isinstance(node, (ast.Constant, ast.Name, ast.arg, ast.alias)):
            if isinstance(node, ast.Constant):
                kind = "number" if isinstance(node.value, (int, float, complex)) and not isinstance(node.value, bool) else type(node.value).__name__
                return f"{own}:{kind}"
            return own + self._name(node.id if isinstance(node, ast.Name) else node.arg if isinstance(node, ast.arg) else node.name)
        if isinstance(node, ast.keyword):
            own, inner = own + (self._name(node.arg) if node.arg else "*"), [node.value]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            head = node.bases if isinstance(node, ast.ClassDef) else [node.args]
            inner = [*head, *(node.body[1:] if ast.get_docstring(node) is not None else node.body)]
        return f"{own}[{' '.join(self.of(x) for x in inner)}]"


def _nodes(node: ast.AST) -> list[ast.AST]:
    """The node and all nodes below it, as ast.walk gives them."""
    out = [node]
    for x in out:
        if _holding(type(x)):
            out.extend(_children(x))
    return out


def _inner(node: ast.AST) -> list[ast.AST]:
    """Statements in a statement's blocks, and its handlers and cases; expressions hold none."""
    return [x for name in _blocks_of(type(node)) for x in getattr(node, name, ())]


def fingerprint(node: ast.AST) -> tuple[int, str] | None:
    """Nested statements and the hash of the shape; none for what is too small to tell."""
    inner = _nodes(node)
    statements = sum(isinstance(x, ast.stmt) for x in inner) - 1
    if statements < MIN_STATEMENTS or len(inner) < MIN_NODES:
        return None
    return statements, hashlib.sha256(_Shape().of(node).encode()).hexdigest()[:16]


def _depth(node: ast.AST) -> int:
    deepest, left = 0, [(node, 0)]
    while left:
        x, level = left.pop()
        level += isinstance(x, BLOCKS)
        deepest = max(deepest, level)
        left.extend([(y, level) for y in _inner(x) if _blocks_of(type(y))])
    return deepest


def _called(node: ast.AST) -> str:
    f = node.func if isinstance(node, ast.Call) else node
    return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""


def _signature(args: ast.arguments) -> str:
    """Arguments as text; names alone, the most frequent ones, need no unparsing."""
    if args.posonlyargs or args.vararg or args.kwonlyargs or args.kwarg or args.defaults or any(a.annotation for a in args.args):
        return ast.unparse(args)
    return ", ".join([a.arg for a in args.args])


def python_rows(path: str, text: str, only: tuple[str, ...] | None = None) -> list[tuple]:
    """Facts of one file, all or those of the kinds in `only`; a file that doesn't parse has one error."""
    told = lambda *facts: only is None or not set(facts).isdisjoint(only)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", None, None, getattr(e, "lineno", None), None, None, str(e), None)] if told("error") else []
    shapes, tests, uses_told = told("fingerprint"), told("test"), told("reference")
    out: list[tuple] = []

    def add(fact: str, name=None, kind=None, line=None, end=None, n=None, text=None, confidence=1.0) -> None:
        if only is None or fact in only:
            out.append((path, fact, name, kind, line, end, n, text, confidence))

    def test_counts(f: ast.AST) -> tuple[int, int, int, int]:
        asserts = trivial = mocks = 0
        for x in _nodes(f):
            if isinstance(x, ast.Assert):
                asserts += 1
                trivial += isinstance(x.test, ast.Constant) and bool(x.test.value)
            elif isinstance(x, ast.Call):
                asserts += _called(x).startswith("assert") or _called(x) == "raises"
                mocks += "mock" in _called(x).lower() or _called(x) == "patch"
        mocks += sum("patch" in ast.dump(d) for d in f.decorator_list)
        skips = sum("skip" in ast.dump(d) for d in f.decorator_list)
        return asserts, trivial, mocks, skips

    def uses(annotation: ast.AST | None) -> None:
        """Names in an annotation, also in one that is a string."""
        if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
            try:
                inner = ast.parse(annotation.value, mode="eval")
            except SyntaxError:
                return
            for x in ast.walk(inner):
                if isinstance(x, ast.Name):
                    add("reference", x.id, "annotation", annotation.lineno)
        elif annotation is not None:
            for x in ast.walk(annotation):
                if isinstance(x, (ast.Name, ast.Attribute)):
                    add("reference", _called(x), "annotation", x.lineno)

    def registered(c) -> None:
        for d in c.decorator_list:
            target = d.func if isinstance(d, ast.Call) else d
            if isinstance(target, ast.Attribute) and target.attr in REGISTRATION:
                add("entry", c.name, "decorated", c.lineno)

    def visit(node: ast.AST, owners: tuple[str, ...], inside_class: bool) -> None:
        for c in _inner(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = ("async_" if isinstance(c, ast.AsyncFunctionDef) else "") + ("method" if inside_class else "function")
                name = ".".join((*owners, c.name))
                add("symbol", name, kind, c.lineno, c.end_lineno, len(owners), _signature(c.args))
                if shapes and (shape := fingerprint(c)):
                    add("fingerprint", name, kind, c.lineno, c.end_lineno, *shape)
                if tests and c.name.startswith("test"):
                    a, t, m, s = test_counts(c)
                    body = c.body[1:] if ast.get_docstring(c) is not None else c.body
                    empty = all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) for x in body)
                    add("test", name, kind, c.lineno, c.end_lineno, a, f"{t},{m},{s},{int(empty)}")
                registered(c)
                args = c.args
                for annotated in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg] if uses_told else []:
                    uses(annotated and annotated.annotation)
                if uses_told:
                    uses(c.returns)
                visit(c, (*owners, c.name), False)
            elif isinstance(c, ast.ClassDef):
                add("symbol", ".".join((*owners, c.name)), "class", c.lineno, c.end_lineno, len(owners), ",".join(ast.unparse(b) for b in c.bases))
                if shapes and (shape := fingerprint(c)):
                    add("fingerprint", ".".join((*owners, c.name)), "class", c.lineno, c.end_lineno, *shape)
                registered(c)
                visit(c, (*owners, c.name), True)
            elif _blocks_of(type(c)):
                visit(c, owners, inside_class)

    if told("symbol", "fingerprint", "test", "entry", "reference"):
        visit(tree, (), False)
    # Imports are statements; the others are looked for in expressions, too.
    every = _nodes(tree) if told("reference", "entry", "literal") else []
    if not every and told("import"):
        every = [tree]
        for x in every:
            every.extend(_inner(x))
    for x in every:
        if type(x) not in _TOLD:
            continue
        if isinstance(x, ast.Import):
            for a in x.names:
                add("import", a.name, None, x.lineno, n=0)
        elif isinstance(x, ast.ImportFrom):
            for a in x.names:
                add("import", x.module or "", None, x.lineno, n=x.level, text=a.name)
        elif isinstance(x, ast.Call):
            if _called(x):
                add("reference", _called(x), "call", x.lineno)
            named = x.args[1] if isinstance(x.func, ast.Name) and x.func.id == "getattr" and len(x.args) > 1 else None
            if isinstance(named, ast.Constant) and isinstance(named.value, str):
                add("entry", named.value, "dispatched", x.lineno)
            if isinstance(x.func, ast.Call) and isinstance(x.func.func, ast.Attribute) and x.func.func.attr in REGISTRATION:
                for a in x.args:
                    if isinstance(a, ast.Name):
                        add("entry", a.id, "registered", x.lineno)
        elif isinstance(x, ast.AnnAssign):
            uses(x.annotation)
        elif isinstance(x, ast.Constant) and isinstance(x.value, str):
            add("literal", None, None, x.lineno, text=x.value)
        elif isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple)):
            for e in x.value.elts:
                if isinstance(e, ast.Constant):
                    add("entry", str(e.value), "exported", x.lineno)
    if told("depth"):
        add("depth", None, None, n=_depth(tree))
    return out


def python_facts(files: DataFrame, *only: str) -> DataFrame:
    """Facts of (path, text) rows in Python, all or those of the kinds named. Each file is parsed once, where it lies."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            rows = [r for path, text in zip(*(c.to_pylist() for c in p.columns), strict=True) for r in python_rows(path, text or "", only or None)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return files.select("path", "text").mapInArrow(run, FACTS)


def _lines_of(text: Column) -> Column:
    """A list of lines; a line end at the very end starts no further line."""
    inner = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(inner, "\n", -1))


def source_lines(files: DataFrame, *own: str) -> DataFrame:
    """path, columns of the file, line, text: lines from 1."""
    return files.select("path", *own, F.posexplode(_lines_of(F.col("text"))).alias("p", "text")).select("path", *own, (F.col("p") + 1).cast("int").alias("line"), "text")


#: Comments, strings and templates of the languages with braces, then what is none of them.
_TOKENS = r"""(?s)//[^\n]*+|/\*.*?(?:\*/|\z)|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|`[^`\\]*+(?:\\.[^`\\]*+)*+`?|[^/"'`]++|/"""


def code_only(text: Column) -> Column:
    """text with comments, strings and templates blanked, line by line where it was."""
    blank = lambda t: F.when(t.rlike(r"""^(?://|/\*|["'`])"""), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)
    some = holds(text, "//", "/*", '"', "'", "`")
    return F.when(some, F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), blank), "")).otherwise(text)


def holds(text: Column, *words: str) -> Column:
    """Whether a text holds any of the words: far cheaper than a pattern, so asked first."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _closed(files: DataFrame, name: Callable[[Column], Column], words: tuple[str, ...], kind: Column, braced: bool = False) -> DataFrame:
    """path, line, name, kind, end_line of the lines with a name: end_line is the first line after the start at which the braces opened since are closed again, else the start itself.

    name: of a line, which has one of the words if it has a name; kind: of
    `text` (the line), `path` and `name`. braced: a
    start without a brace is one line long. Braces in strings and comments
    don't count. A line closes each level that it ends below; a start at depth
    d waits for the next line that closes d + 1, so lines and starts of a level
    stand in one order and no start meets all later lines. Lines that start
    nothing and leave the depth as it is don't leave their file's row.
    """
    code = files.select("path", _lines_of(F.col("text")).alias("text"), _lines_of(code_only(F.col("text"))).alias("code"))
    line = lambda text, i: F.struct((i + 1).cast("int").alias("line"), text.alias("text"), F.get("code", i).alias("code"), F.get("code", i + 1).alias("following"))
    seen = F.filter(F.transform("text", line), lambda x: holds(x["code"], "{", "}") | holds(x["text"], *words))
    told = F.transform(seen, lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), x["code"].alias("code"), x["following"].alias("following"), name(x["text"]).alias("name")))
    lines = code.select("path", F.inline(F.filter(told, lambda x: x["name"].isNotNull() | holds(x["code"], "{", "}"))))
    delta = lambda c: F.when(holds(c, "{", "}"), F.regexp_count(c, F.lit(r"\{")) - F.regexp_count(c, F.lit(r"\}"))).when(c.isNotNull(), 0)
    told = lines.withColumn("d", delta(F.col("code"))).filter("name is not null or d <> 0")
    told = told.select("path", "line", "name", F.when(F.col("name").isNotNull(), kind).alias("kind"), "d", F.col("code").contains("{").alias("opens"), delta(F.col("following")).alias("_n"))
    depth = told.withColumn("after", F.sum("d").over(Window.partitionBy("path").orderBy("line"))).withColumn("before", F.col("after") - F.col("d"))
    # Where the start line is itself closed again, the next line ends it, or what that one opens.
    soon = F.when(F.col("_n").isNull() | (~F.col("opens") & F.lit(braced)), F.col("line")).when((F.col("after") <= F.col("before")) & (F.col("after") + F.col("_n") <= F.col("before")), F.col("line") + 1)
    met = lambda level, starts, soon: F.struct(level.alias("level"), starts.alias("starts"), soon.cast("int").alias("soon"))
    closing = F.when(F.col("d") < 0, F.transform(F.sequence(F.col("after") + 1, F.col("before")), lambda level: met(level, F.lit(False), F.lit(None))))
    start = F.when(F.col("name").isNotNull(), F.array(met(F.col("before") + 1, F.lit(True), soon)))
    none = F.array().cast("array<struct<level: bigint, starts: boolean, soon: int>>")
    each = depth.select("path", "line", "name", "kind", F.inline(F.concat(F.coalesce(closing, none), F.coalesce(start, none))))
    order = Window.partitionBy("path", "level").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    end = F.min(F.when(~F.col("starts"), F.col("line"))).over(order)
    return each.withColumn("end_line", F.coalesce("soon", end, "line").cast("int")).filter("starts").select("path", "line", "name", "kind", "end_line")


def ts_symbols(files: DataFrame) -> DataFrame:
    """path, line, name, kind, end_line of TypeScript and JavaScript: routes, hooks, components, classes, functions."""
    patterns = (
        r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)",
        r"^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>",
        r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)",
        r"^\s*export\s+const\s+([A-Za-z_$][\w$]*)",
    )
    name = lambda line: F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])
    is_class = F.col("text").rlike(r"\bclass\s")
    component = F.col("name").rlike("^[A-Z]") & F.col("path").rlike(r"\.[jt]sx$") & F.col("text").rlike("function|const")
    kind = F.when(F.col("path").rlike(r"route\.[jt]s$"), "route").when(F.col("name").startswith("use"), "hook").when(component, "component").when(is_class, "class").otherwise("function")
    return _closed(files, name, ("function", "const", "let", "class"), kind)


def ts_imports(files: DataFrame) -> DataFrame:
    """path, line, module of `import ... from "module"` and `import "module"`."""
    module = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"""^\s*import\s+.+?\s+from\s+["']([^"']+)["']""", r"""^\s*import\s+["']([^"']+)["']""")])
    return source_lines(files).select("path", "line", module.alias("module")).filter("module is not null")


#: What stands before a parenthesis and is no call, and how sure a reference by pattern is.
TS_KEYWORDS = ("function", "if", "for", "return", "switch")
GO_KEYWORDS = ("func", "if", "for", "return", "switch", "go", "defer", "select", "range")
LOW = 0.4


def _calls(files: DataFrame, pattern: str, keywords: tuple[str, ...], *own: str) -> DataFrame:
    """path, columns of the file, line, name, confidence of what stands before a parenthesis in code, not in strings or comments."""
    code = source_lines(files.select("path", *own, code_only(F.col("text")).alias("text")), *own).filter(F.col("text").contains("("))
    calls = code.select("path", *own, "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    return calls.filter(~F.col("name").isin(*keywords)).withColumn("confidence", F.lit(LOW))


def ts_references(files: DataFrame) -> DataFrame:
    """path, line, name, confidence: imported modules, 1.0, and calls, 0.4."""
    modules = ts_imports(files).select("path", "line", F.col("module").alias("name"), F.lit(1.0).alias("confidence"))
    return modules.unionByName(_calls(files, r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(", TS_KEYWORDS))


def go_symbols(files: DataFrame) -> DataFrame:
    """path, line, name, kind, end_line of Go: functions, methods, types."""
    pattern = r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\(\[]"
    name = lambda line: F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (pattern, r"^\s*type\s+([A-Za-z_]\w*)\b")])
    function = F.when(F.col("text").rlike(r"^\s*func\s+\("), "method").otherwise("function")
    kind = F.when(F.col("text").rlike(pattern), function).when(F.col("text").contains("struct"), "struct").when(F.col("text").contains("interface"), "interface").otherwise("type")
    return _closed(files, name, ("func", "type"), kind, braced=True)


def go_imports(files: DataFrame) -> DataFrame:
    """path, line, module: single imports, and the lines between `import (` and one with `)`."""
    marker = F.when(F.col("text").rlike(r"^\s*import\s*\("), "open").when(F.col("text").contains(")"), "closed")
    inside = F.regexp_extract("text", r'^\s*(?:[A-Za-z_.]\w*\s+)?"([^"]+)"', 1)
    single = F.regexp_extract("text", r'^\s*import\s+(?:[A-Za-z_.]\w*\s+)?"([^"]+)"', 1)
    told = source_lines(files).select("path", "line", marker.alias("marker"), single.alias("single"), inside.alias("inside")).filter("marker is not null or single <> '' or inside <> ''")
    # The last line that opens or closes, this one included.
    state = F.last("marker", ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    return told.select("path", "line", F.when(F.col("single") != "", F.col("single")).when(state == "open", F.col("inside")).alias("module")).filter("module <> ''")


def go_package() -> Column:
    """The package of a file's path and text: what the first package line names, else the path with dots."""
    named = F.regexp_extract("text", r"(?m)^\s*package\s+([A-Za-z_]\w*)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.replace(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit("/"), F.lit(".")))


def go_packages(files: DataFrame) -> DataFrame:
    """path, package."""
    return files.select("path", go_package().alias("package"))


def go_references(files: DataFrame, *own: str) -> DataFrame:
    """path, columns of the file, line, name, confidence of calls."""
    return _calls(files, r"\b([A-Za-z_]\w*)\s*\(", GO_KEYWORDS, *own)


def directives(files: DataFrame) -> DataFrame:
    """path, line, rules of inline suppressions: `quern: ignore[rule, ...]`, or all without a list."""
    found = F.regexp_extract("text", r"(?:#|//)\s*quern:\s*ignore(?:\[([^\]]*)\])?", 0)
    inner = F.regexp_extract("text", r"(?:#|//)\s*quern:\s*ignore\[([^\]]*)\]", 1)
    return source_lines(files.filter(F.col("text").contains("quern:"))).filter(found != "").select("path", "line", F.when(inner == "", F.array(F.lit("*"))).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x))).alias("rules"))


def traceback_frames(df: DataFrame, text: str = "text") -> DataFrame:
    """df's key columns with file, line and function of each Python traceback frame."""
    rx = r'File "([^"]+)", line (\d+), in (\S+)'
    parts = [F.regexp_extract_all(text, F.lit(rx), F.lit(i)).alias(n) for i, n in ((1, "file"), (2, "line"), (3, "function"))]
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.inline(F.arrays_zip(*parts))).withColumn("line", F.col("line").cast("int"))


def public_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, name, change of public symbols between two fact tables: removed, added, or another signature."""
    surface = lambda d, p: d.filter("fact = 'symbol' and not name rlike '(^|[.])_'").select(F.col("path").alias(f"{p}path"), F.col("name").alias(f"{p}name"), F.concat_ws("|", "kind", "text").alias(f"{p}sig"))
    a, b = surface(old, "o"), surface(new, "n")
    j = a.join(b, (F.col("opath") == F.col("npath")) & (F.col("oname") == F.col("nname")), "full_outer")
    change = F.when(F.col("nname").isNull(), "removed").when(F.col("oname").isNull(), "added").when(F.col("osig") != F.col("nsig"), "changed")
    return j.select(F.coalesce("opath", "npath").alias("path"), F.coalesce("oname", "nname").alias("name"), change.alias("change")).filter("change is not null")


def call_edges(facts: DataFrame) -> DataFrame:
    """path, caller (the innermost symbol around the line; null at the top level), call_text, line, confidence of each reference."""
    named = facts.filter("fact = 'reference'").groupBy("path", F.col("name").alias("call_text"), "line", "confidence").agg(F.count(F.lit(1)).alias("n"))
    symbols = facts.filter("fact = 'symbol'").select(F.col("path").alias("_p"), F.col("name").alias("_s"), F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    # Either side has rows of every file, so neither is for broadcast.
    around = named.join(symbols.hint("shuffle_merge"), (F.col("path") == F.col("_p")) & F.col("line").between(F.col("_a"), F.col("_b")), "left")
    inner = around.groupBy("path", "call_text", "line", "confidence", "n").agg(F.max_by("_s", F.struct("_a", -F.col("_b"))).alias("caller"))
    each = inner.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("path", "caller", "call_text", "line", "confidence")


def callers_of(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, path, caller, line, confidence: calls of each of names (name), by the last part of a qualified name."""
    wanted = names.select("name", F.element_at(F.split("name", r"\."), -1).alias("_n")).distinct()
    return edges.filter("caller is not null").join(wanted.hint("shuffle_merge"), F.col("call_text") == F.col("_n")).select("name", "path", "caller", "line", "confidence")
