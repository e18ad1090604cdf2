import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.constraints import glob_regex, parse


@settings(max_examples=200, deadline=None)
@given(st.text("ab/.*?", max_size=8), st.text("ab/.", max_size=8))
def test_glob_is_fnmatch(pattern, path):
    assert bool(re.fullmatch(glob_regex(pattern)[1:-1], path)) == fnmatch.fnmatchcase(path, pattern)


@pytest.mark.parametrize(
    ("word", "field", "value"),
    [
        ("*.py", "globs", ["*.py"]),
        ("src/", "prefixes", ["src/"]),
        ("plain", "prefixes", ["plain"]),
        ("!tests/", "excludes", ["tests/"]),
        ("git:modified", "git", ["modified"]),
        ("size:<10kb", "sizes", [("<", 10240.0)]),
        ("mtime:<7d", "ages", [("<", 604800.0)]),
    ],
)
def test_words(word, field, value):
    assert getattr(parse(word), field) == value


@pytest.mark.parametrize(
    ("word", "why"),
    [
        ("size:<10xb", "expected e.g. size:<10kb (operators < <= > >=, units b/kb/mb)"),
        ("size:", "expected e.g. size:<10kb (operators < <= > >=, units b/kb/mb)"),
        ("mtime:<=7d", "expected e.g. mtime:<7d (operators < >, units s/m/h/d/w)"),
        ("git:other", "expected git:modified or git:untracked"),
        ("!", "exclusion needs a pattern after '!'"),
        ("lang:py", "unknown constraint scheme"),
    ],
)
def test_unreadable_words_warn(word, why):
    c = parse(word)
    assert c.warnings == [f"ignored {word!r} \u2014 {why}"]
    assert not (c.globs or c.prefixes or c.excludes or c.sizes or c.ages or c.git)
