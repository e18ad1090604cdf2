"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: runs that the token estimate counts, with Unicode letters and digits in either engine.
TOKEN_RUN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
#: What is scrubbed from evidence, in this order; the first keeps its key. With each, what a text must hold for it.
_START = r"(^|[^0-9A-Za-z_])"
KEYED_SECRET = rf"(?i){_START}(api[_-]?key|secret|token|password|passwd|pwd|authorization|bearer)[ \t\n\x0B\f\r]*[:=][ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+"
SCRUB_PATTERNS = (
    (r"()[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "@"),  # e-mail addresses
    (_START + r"AKIA[0-9A-Z]{16}\b", "AKIA"),  # AWS access keys
    (_START + r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]+", "k_(?:live|test)_"),  # Stripe keys
    (_START + r"gh[posru]_[A-Za-z0-9]{20,}", "gh[posru]_"),  # GitHub tokens
    (_START + r"xox[baprs]-[A-Za-z0-9-]+", "xox[baprs]-"),  # Slack tokens
    (_START + r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "eyJ"),  # JSON web tokens
    (_START + r"[A-Za-z0-9][A-Za-z0-9+/]{39,}={0,2}\b", "[A-Za-z0-9+/]{40}"),  # long base64
    (_START + r"[0-9a-fA-F]{32,}\b", "[0-9a-fA-F]{32}"),  # long hex
)
REDACTED = "[redacted]"


def token_estimate_runs(text: Column) -> Column:
    """One token for every four characters of a run, at least one a run."""
    runs = F.regexp_extract_all(text, F.lit(TOKEN_RUN), F.lit(0))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + F.ceil(F.length(r) / 4).cast("long"))


def token_estimate_bytes(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, and the line ends."""
    return (F.ceil(F.octet_length(text) / 4) + F.regexp_count(text, F.lit("\n"))).cast("long")


def scrubbed(text: Column) -> Column:
    """Keyed secrets first, then the other patterns, each replaced by a mark."""
    keyed = F.when(text.rlike("[:=]"), F.regexp_replace(text, KEYED_SECRET, f"$1$2={REDACTED}")).otherwise(text)
    once = lambda t, p: F.when(text.rlike(p[1]), F.regexp_replace(t, p[0], f"$1{REDACTED}")).otherwise(t)
    return reduce(once, SCRUB_PATTERNS, keyed)


def slug(text: Column) -> Column:
    """Lower case, other characters than a-z 0-9 _ . : - as one underscore, none at the ends, 80 at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_.:-]+", "_"), r"^_+|_+$", ""), 1, 80)


def smart_case(column: Column, needle: str) -> Column:
    """Contains, with regard to case only if the needle has an upper-case letter."""
    return column.contains(needle) if needle != needle.lower() else F.lower(column).contains(needle.lower())


def short_hash(column: Column, n: int) -> Column:
    return F.substring(F.sha2(column, 256), 1, n)


def stable_key(rule: Column, path: Column, symbol: Column, evidence: Column | None = None) -> Column:
    """rule:12 hex of the hash of rule, path, symbol and the evidence that doesn't move."""
    parts = [rule, path, F.coalesce(symbol, F.lit("")), evidence if evidence is not None else F.lit("")]
    return F.concat(rule, F.lit(":"), short_hash(F.concat_ws("|", *parts), 12))


def confidence_tier(rule: Column, symbol: Column) -> Column:
    return F.when((rule.startswith("python.") | rule.startswith("architecture.")) & symbol.isNotNull() & (symbol != ""), "verified").otherwise("heuristic")


def certainty(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.4, "medium").otherwise("low")


def effort(units: Column) -> Column:
    return F.when(units <= 4, "S").when(units <= 12, "M").otherwise("L")


def truncated(text: Column, most: int = 200) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def dirname(path: Column) -> Column:
    """What is before the last slash; '.' at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def annotation_escape(text: Column, value: bool = False) -> Column:
    """Per cent signs first, then line ends; values also colons and commas."""
    t = F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.replace(F.replace(t, F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C")) if value else t


# Test-path predicates differ by where they are used; they are kept apart on purpose.
def is_test_inventory(path: Column) -> Column:
    return path.startswith("tests/") | path.contains("/test_")


def is_test_search(path: Column) -> Column:
    return F.lower(path).contains("test") | F.lower(path).contains("spec")


def is_test_python(path: Column) -> Column:
    return path.startswith("tests/") | path.contains("/tests/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$")


def is_test_ts(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.[jt]sx?$") | path.contains("__tests__/")


def is_test_go(path: Column) -> Column:
    return path.endswith("_test.go")
