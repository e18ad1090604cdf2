"""Fuzzy matching as expressions: no Python on the executors.

The similarity of two strings is that of insertions and deletions, 2 lcs /
(len + len), for their longest common subsequence. A string of up to 62
letters is held as the bits of one long; a letter of the other string then
costs an addition and three logical operations, whatever the length. A
subsequence has no letter more often than either string, so counts of letters
bound the similarity from above and rows out of reach aren't scored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import views
from quern.registry import query

FUZZY_THRESHOLD, SUGGESTIONS = 60.0, 5
_BITS = 62


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _common(letters: Column, places: Column, inside: Column) -> Column:
    """Length of the longest common subsequence of some letters with those places of the needle that are bits of `inside`."""

    def step(row: Column, c: Column) -> Column:
        hit = row.bitwiseAND(F.coalesce(F.element_at(places, c), _long(0)))
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(inside)

    return F.bit_count(inside) - F.bit_count(F.aggregate(letters, inside, step))


def partial_ratio(column: Column, needle: str) -> Column:
    """0-100: the best similarity of the shorter string to a window of the other as long as it is; also to windows cut short at the ends.

    Letters count as they are. Null counts as empty. Needles have 62 letters at most.
    """
    n, text = len(needle), F.coalesce(column, F.lit(""))
    if n > _BITS:
        raise ValueError(f"a needle has at most {_BITS} letters, not {n}")
    if not n:
        return F.when(text == "", 100.0).otherwise(0.0)
    bits: dict[str, int] = {}
    for i, c in enumerate(needle):
        bits[c] = bits.get(c, 0) | 1 << i
    places = F.create_map(*[x for c, b in bits.items() for x in (F.lit(c), _long(b))])
    m = F.length(text)
    best = lambda ratios: F.coalesce(F.array_max(ratios), F.lit(0.0))
    ratio = lambda lcs, a, b: 200.0 * lcs / (a + b)
    # The needle slides over the text: windows of the text.
    letters = _letters(text)
    full = _long((1 << n) - 1)

    def window(i: Column) -> Column:
        first = F.greatest(i, F.lit(0))
        size = F.least(i + n, m) - first
        return ratio(_common(F.slice(letters, first + 1, size), places, full), F.lit(n), size)

    over_text = best(F.transform(F.sequence(F.lit(1 - n), m - 1), window))
    # The text slides over the needle: windows are runs of its bits.
    starts = F.sequence(1 - m, F.lit(n - 1))

    def run(i: Column) -> Column:
        first = F.greatest(i, F.lit(0))
        size = F.least(i + m, F.lit(n)) - first
        inside = F.element_at(_ones(n), size).cast("long") * F.element_at(_powers(n), first + 1)
        return ratio(_common(letters, places, inside), m, size)

    over_needle = best(F.transform(starts, run))
    return F.when(m == 0, 0.0).when(F.contains(text, F.lit(needle)) | F.contains(F.lit(needle), text), 100.0).when(m >= n, over_text).otherwise(over_needle)


def _ones(n: int) -> Column:
    return F.array(*[_long((1 << k) - 1) for k in range(1, n + 1)])


def _powers(n: int) -> Column:
    return F.array(*[_long(1 << k) for k in range(n + 1)])


def within_reach(column: Column, needle: str, threshold: float) -> Column:
    """Whether a text shares enough letters to reach the threshold: false only where it can't.

    Of the shorter string's L letters, a window of w letters needs lcs >=
    threshold / 200 (L + w) and lcs <= w, so lcs >= threshold L / (200 - threshold).
    """
    text = F.coalesce(column, F.lit(""))
    shared = reduce(lambda a, b: a + b, [F.least(F.lit(k), F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) for c, k in Counter(needle).items()], F.lit(0))
    return shared >= F.lit(threshold / (200.0 - threshold)) * F.least(F.length(text), F.lit(len(needle))) - 1e-9


def matches(rows: DataFrame, column: str, needle: str, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """rows with a `score` of at least the threshold. A needle without upper case matches any case."""
    text = F.col(column) if any(c.isupper() for c in needle) else F.lower(column)
    near = rows.filter(within_reach(text, needle, threshold))
    return near.withColumn("score", partial_ratio(text, needle)).filter(F.col("score") >= threshold)


def suggestions(names: DataFrame, column: str, wanted: str) -> DataFrame:
    """The five names nearest to what was asked for, of those near enough; ties by name."""
    return matches(names.select(column).distinct(), column, wanted).orderBy(F.desc("score"), column).limit(SUGGESTIONS)


def _scored(table: str, column: str, needle: str) -> str:
    """SQL: rows (name, score), by the table of longest common subsequences letter by letter; for texts longer than the needle, as others score 0 or 100 here."""
    codes = ", ".join(str(ord(c)) for c in needle)
    n = len(needle)
    lcs = f"""list_reduce(list_transform(range(greatest(i, 0), least(i + {n}, m)), lambda k: [codes[k + 1]]), lambda above, c: list_reduce(list_transform(range(1, {n + 1}), lambda j: [j]),
 lambda now, j: list_append(now, greatest(above[j[1] + 1], now[j[1]], above[j[1]] + CASE WHEN needle[j[1]] = c[1] THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), list_transform(range({n + 1}), lambda z: CAST(0 AS BIGINT)))[{n + 1}]"""
    return f"""WITH texts AS (SELECT DISTINCT {column} AS name, lower({column}) AS t FROM {table}), coded AS (SELECT name, t, length(t) AS m, [{codes}]::BIGINT[] AS needle, list_transform(range(1, length(t) + 1), lambda k: CAST(ascii(substr(t, k, 1)) AS BIGINT)) AS codes FROM texts),
windows AS (SELECT *, unnest(range(1 - {n}, m)) AS i FROM coded WHERE m >= {n}),
scored AS (SELECT name, CASE WHEN contains(any_value(t), '{needle}') THEN 100.0::DOUBLE ELSE max(200.0::DOUBLE * {lcs} / ({n} + least(i + {n}, m) - greatest(i, 0))) END AS score FROM windows GROUP BY name
 UNION ALL SELECT name, short FROM (SELECT name, (SELECT max(200.0::DOUBLE * (list_reduce(list_transform(range(greatest(k, 0), least(k + m, {n})), lambda x: [needle[x + 1]]), lambda above, c: list_reduce(list_transform(range(1, m + 1), lambda j: [j]),
  lambda now, j: list_append(now, greatest(above[j[1] + 1], now[j[1]], above[j[1]] + CASE WHEN codes[j[1]] = c[1] THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), list_transform(range(m + 1), lambda z: CAST(0 AS BIGINT)))[m + 1]) / (m + least(k + m, {n}) - greatest(k, 0))) FROM (SELECT unnest(range(1 - m, {n})) AS k)) AS short FROM coded WHERE m BETWEEN 1 AND {n - 1}))
"""


@query(_scored("(SELECT CASE WHEN doc_id % 10 = 0 THEN 'tests/' ELSE '' END || source || '/' || lang || '/doc_' || doc_id AS path FROM documents)", "path", "src1/dee/doc_11") + "SELECT name AS path, round(score, 6) AS score FROM scored WHERE score >= 60 ORDER BY scored.score DESC, name LIMIT 20")
def path_search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = matches(views.files(spark, sf_dir).select("path"), "path", "src1/dee/doc_11")
    return near.orderBy(F.desc("score"), "path").limit(20).select("path", F.round("score", 6).alias("score"))


@query(_scored("part", "p_name", "blu bolt") + "SELECT name AS p_name, score FROM scored WHERE score >= 60 ORDER BY scored.score DESC, name LIMIT 5")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions(views.table(spark, sf_dir, "part"), "p_name", "blu bolt")
