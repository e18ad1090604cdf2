"""The constraint language of searches: words that narrow which files are looked at.

`*.py` globs over the whole path, `src` prefixes, `!tests/` exclusions,
`git:modified`, `git:untracked`, `size:<10kb`, `mtime:<7d`. Kinds are joined by
and; inside globs and prefixes all must hold. A word that can't be read is
dropped with a warning, never an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes in bytes and of ages in seconds.
SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}
TIME_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


@dataclass
class Constraints:
    globs: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    git: list[str] = field(default_factory=list)
    sizes: list[tuple[str, float]] = field(default_factory=list)
    ages: list[tuple[str, float]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def glob_regex(pattern: str) -> str:
    """A shell pattern over the whole string, in which * also crosses slashes, as a regular expression of either engine."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")))) > 0:
            body = pattern[i:j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_/" else c)
    return "^(?s:" + "".join(out) + ")$"


def _ignored(word: str) -> str:
    """What a word that can't be read is told. The messages."""
    if word.startswith("size:"):
        why = "expected e.g. size:<10kb (operators < <= > >=, units b/kb/mb)"
    elif word.startswith("mtime:"):
        why = "expected e.g. mtime:<7d (operators < >, units s/m/h/d/w)"
    elif word.startswith("git:"):
        why = "expected git:modified or git:untracked"
    elif word.startswith("!"):
        why = "exclusion needs a pattern after '!'"
    else:
        why = "unknown constraint scheme"
    return f"ignored {word!r} \u2014 {why}"


def parse(text: str) -> Constraints:
    c = Constraints()
    for word in text.split():
        m = re.fullmatch(r"(size|mtime):(<=|>=|<|>|=)(\d+(?:\.\d+)?)([a-z]*)", word.lower())
        if word.lower() in ("git:modified", "git:untracked"):
            c.git.append(word.lower()[4:])
        elif m and m[1] == "size" and (m[4] or "b") in SIZE_UNITS:
            c.sizes.append((m[2], float(m[3]) * SIZE_UNITS[m[4] or "b"]))
        elif m and m[1] == "mtime" and m[2] in "<>" and m[4] in TIME_UNITS:
            c.ages.append((m[2], float(m[3]) * TIME_UNITS[m[4]]))
        elif word.startswith("!") and len(word) > 1:
            c.excludes.append(word[1:])
        elif word.startswith("!") or re.match(r"(git|size|mtime):", word):
            c.warnings.append(_ignored(word))
        elif any(x in word for x in "*?["):
            c.globs.append(word)
        elif ":" not in word:
            c.prefixes.append(word)
        else:
            c.warnings.append(_ignored(word))
    return c


def _compare(value: Column, op: str, bound: float) -> Column:
    return {"<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound, "=": value == bound}[op]


def predicate(c: Constraints, path: Column, size: Column | None = None, age_seconds: Column | None = None, git_status: Column | None = None) -> Column:
    """One Column; rows without a size or age fail tests of it."""
    tests = [path.rlike(glob_regex(g)) for g in c.globs] + [path.startswith(p) for p in c.prefixes]
    tests += [~(path.rlike(glob_regex(x)) if any(y in x for y in "*?[") else path.startswith(x)) for x in c.excludes]
    if size is not None:
        tests += [_compare(size, op, b) for op, b in c.sizes]
    if age_seconds is not None:
        tests += [_compare(age_seconds, op, b) for op, b in c.ages]
    if git_status is not None:
        tests += [git_status == ("??" if g == "untracked" else "M") for g in c.git]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
