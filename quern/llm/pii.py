"""Personal data: fixed patterns as seeds, and contextual patterns that they induce, in DataFrame operators.

Bootstrapping works on the graph between patterns and instances. A pattern is a
kind with the word before an entity; an instance is a value that it precedes:
an entity that a fixed pattern found (a seed, score 1) or a candidate, a word
with CANDIDATE_DIGITS digits or more that is none. A pattern's confidence is
the score of its instances over all places where its word occurs in the corpus,
so a word that stands before anything has none. A candidate's score is the
chance that at least one of its patterns is right. After ROUNDS of this,
patterns of at least MIN_CONFIDENCE and MIN_SEEDS distinct seeds stay, and the
candidates behind them are entities of the pattern's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 3, 5, 0.5
CANDIDATE_DIGITS = 5
#: Context words up to which their list is broadcast to count them; more are joined by a shuffle.
BROADCAST_WORDS = 100_000
#: Characters before a value in which its context word is looked for.
CONTEXT = 80

# The contract's patterns with possessive repetition, which finds the same
# longest matches without recursion. A match begins where a run of its first
# characters begins or where the last match ended: inside a run it could only
# begin if it could at the run's start.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match to be possible, found faster.
_HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": lambda t: t.rlike(r"\+[0-9]")}
_BLANK = r"\x20\x09-\x0D"
_AT = r"(?i:@|[(\[]at[)\]])"
CANDIDATE = rf"(?<![^{_BLANK}])(?:[^0-9{_BLANK}]*+(?:[0-9][^0-9{_BLANK}]*+){{{CANDIDATE_DIGITS},}}+|(?=[^{_BLANK}]*?{_AT})[^{_BLANK}]++)"
#: Stands for a character of a span of the fixed patterns.
TAKEN = "\ue000"
#: Elements of an array that are summed up in one go.
BLOCK = 256


def _grown(xs: Column) -> Column:
    """Running sums of an array of ints."""
    step = lambda acc, x: F.concat(acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x).cast("int")))
    return F.aggregate(xs, F.array().cast("array<int>"), step)


def with_pieces(df: DataFrame, name: str, text: str, pattern: str, hint: Column) -> DataFrame:
    """df with `name`, the matches in the column `text` as (start, end, value, gap) in code points, gap being the text since the last match, and `name`_rest.

    `name`_rest is the text after each match up to the next, that before the
    first one included. Time grows with the text, whatever it holds: the places
    are running sums within blocks of BLOCK matches, then of the blocks.
    """
    c = lambda part: F.col(f"{name}_{part}")
    none, t = F.array().cast("array<string>"), F.col(text)
    found, rest = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    df = df.withColumns({f"{name}_v": F.when(hint, found).otherwise(none), f"{name}_rest": F.when(hint, rest).otherwise(F.array(t))})
    df = df.withColumn(f"{name}_g", F.slice(c("rest"), F.lit(1), F.size(c("v"))))
    df = df.withColumn(f"{name}_l", F.zip_with(c("g"), c("v"), lambda b, v: F.length(b) + F.length(v)))
    starts = F.when(F.size(c("l")) > 0, F.sequence(F.lit(1), F.size(c("l")), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(f"{name}_s", F.transform(starts, lambda a: _grown(F.slice(c("l"), a, F.lit(BLOCK)))))
    df = df.withColumn(f"{name}_o", _grown(F.concat(F.array(F.lit(0)), F.transform(c("s"), lambda b: F.get(b, F.size(b) - 1)))))
    moved = F.zip_with(c("s"), F.slice(c("o"), F.lit(1), F.size(c("s"))), lambda b, o: F.transform(b, lambda x: x + o))
    df = df.withColumn(f"{name}_e", F.flatten(moved))

    def placed(x):
        start = x["e"] - F.length(x["v"])
        return F.struct(start.cast("int").alias("start"), x["e"].cast("int").alias("end"), x["v"].alias("value"), x["b"].alias("gap"))

    made = F.transform(F.arrays_zip(c("e").alias("e"), c("v").alias("v"), c("g").alias("b")), placed)
    return df.withColumn(name, made).drop(*[f"{name}_{k}" for k in "vglsoe"])


def in_front(spans: Column, i: Column, characters: int, back: int = 1) -> Column:
    """Up to so many characters before the i-th of spans, from its gap and the `back` matches and gaps before it."""
    own = [F.coalesce(F.get(spans, i)["gap"], F.lit(""))]
    for k in range(1, back + 1):
        earlier = F.get(spans, i - k)
        own = [F.coalesce(earlier["gap"], F.lit("")), F.coalesce(earlier["value"], F.lit("")), *own]
    return F.right(F.concat(*own), F.lit(characters))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = F.regexp_replace(F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1"), r"\.", " ")
        return ~F.exists(F.split(part, " "), lambda p: (F.length(p) > 3) | (F.expr("0") + F.when(F.length(p) <= 3, p.cast("int")).otherwise(F.lit(999)) > 255))
    digits = _digits(value)
    if kind == "card":
        # The sum is only taken of values of the right length.
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _holds(kind: str):
    return lambda s: _valid(kind, s["value"])


def _hidden(kind: str):
    """A match after its gap, with TAKEN for each of its characters if it holds."""
    value = lambda s: F.when(_valid(kind, s["value"]), F.repeat(F.lit(TAKEN), F.length(s["value"]))).otherwise(s["value"])
    return lambda s: F.concat(s["gap"], value(s))


def with_base(df: DataFrame, text: str) -> DataFrame:
    """df with `_<kind>` for each kind: the leftmost matches in the column `text` that hold, as (start, end, value, gap)."""
    for k in KINDS:
        df = with_pieces(df, f"_{k}", text, PATTERNS[k], _HINTS[k](F.col(text))).drop(f"_{k}_rest")
        df = df.withColumn(f"_{k}", F.filter(f"_{k}", _holds(k)))
    return df


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """df with `_other`: (start, end, value, patterns) of words with many digits or an at-sign that touch no span of the fixed patterns.

    patterns tell of the words around it; the candidate is without the
    punctuation around it. The kinds' matches are taken out in their order, a
    character for a character; a word that holds the character TAKEN itself is
    no candidate.
    """
    hint = F.col(text).rlike(rf"(?:[0-9][^0-9{_BLANK}]*+){{{CANDIDATE_DIGITS}}}|{_AT}")
    df = df.withColumn("_hint", hint).withColumn("_free", F.col(text))
    for k in KINDS:
        df = with_pieces(df, "_taken", "_free", PATTERNS[k], F.col("_hint") & _HINTS[k](F.col("_free")))
        parts = F.transform("_taken", _hidden(k))
        tail = F.get("_taken_rest", F.size("_taken"))
        df = df.withColumn("_free", F.when(F.size("_taken") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("_free")))
        df = df.drop("_taken", "_taken_rest")
    df = with_pieces(df, "_words", "_free", CANDIDATE, F.col("_hint"))

    def described(w, i):
        tail = F.length(F.regexp_extract(w["value"], r"""[\p{Punct}]*$""", 0))
        head = F.length(F.regexp_extract(w["value"], r"""^[\p{Punct}]*""", 0))
        near = F.lower(in_front(F.col("_words"), i, CONTEXT))
        nxt = F.lower(F.left(F.coalesce(F.get("_words_rest", i + 1), F.lit("")), F.lit(CONTEXT)))
        return F.struct(
            (w["start"] + head).cast("int").alias("start"),
            (w["end"] - tail).cast("int").alias("end"),
            F.substr(w["value"], head + 1, F.length(w["value"]) - head - tail).alias("value"),
            *_around(near, nxt),
        )

    free = F.filter(F.transform("_words", described), lambda w: ~w["value"].contains(TAKEN) & (w["end"] > w["start"]))
    return df.withColumn("_other", free).drop("_hint", "_free", "_words", "_words_rest")


def _around(near: Column, nxt: Column) -> list[Column]:
    """The patterns of a place with `near` before it and `nxt` after it: the word before, the two before, the word after; empty where there is none."""
    one = F.regexp_extract(near, rf"([^{_BLANK}]++)[{_BLANK}]+$", 1)
    two = F.regexp_extract(near, rf"([^{_BLANK}]++[{_BLANK}]++[^{_BLANK}]++)[{_BLANK}]+$", 1)
    after = F.regexp_extract(nxt, rf"^[{_BLANK}]+([^{_BLANK}]++)", 1)
    mark = lambda c, p: F.when(c != "", F.concat(F.lit(p), F.regexp_replace(c, rf"[{_BLANK}]+", " "))).otherwise(F.lit(""))
    return [F.array(mark(one, "< "), mark(two, "<< "), mark(after, "> ")).alias("patterns")]


def _instances(texts: DataFrame) -> DataFrame:
    """kind (null: candidate), value, word: every entity of the fixed patterns and every candidate with each pattern around it."""
    held = with_candidates(texts, "text")
    for k in KINDS:
        held = with_pieces(held, f"_{k}", "text", PATTERNS[k], _HINTS[k](F.col("text")))

    def named(k: str) -> Column:
        spans, rest = F.col(f"_{k}"), F.col(f"_{k}_rest")
        # Where another match follows at once, its own text is what comes after.
        nxt = lambda i: F.concat(F.coalesce(F.get(rest, i + 1), F.lit("")), F.coalesce(F.get(spans, i + 1)["value"], F.lit("")))
        place = lambda i: _around(F.lower(in_front(spans, i, CONTEXT)), F.lower(F.left(nxt(i), F.lit(CONTEXT))))
        row = lambda s, i: F.struct(F.lit(k).alias("kind"), s["value"].alias("value"), *place(i))
        return F.filter(F.transform(spans, row), lambda s: _valid(k, s["value"]))

    other = F.transform("_other", lambda s: F.struct(F.lit(None).cast("string").alias("kind"), s["value"], s["patterns"].alias("patterns")))
    rows = F.concat(*[named(k) for k in KINDS], other)
    return held.select(F.inline(rows)).select("kind", "value", F.explode("patterns").alias("word")).filter("word <> ''")


def learn(docs: DataFrame, text_col: str = "text") -> list[tuple[str, str, float]]:
    """(kind, word before, confidence) of the patterns that the corpus supports."""
    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    seen = written(_instances(texts).groupBy("kind", "value", "word").agg(F.count(F.lit(1)).alias("n")), "pii-instances")
    seeds = seen.filter("kind is not null")
    enough = seeds.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= MIN_SEEDS)
    others = seen.filter("kind is null").select(F.col("word").alias("_w")).distinct()
    open_patterns = written(enough.join(others, F.col("word") == F.col("_w")).select("kind", "word", "seeds"), "pii-patterns")
    if not open_patterns.count():
        return []
    asked = written(open_patterns.select(F.col("word").alias("_asked")).distinct(), "pii-words")
    held = texts.select(F.filter(F.split(F.lower(F.translate("text", "\t\n\x0b\x0c\r", "     ")), " "), lambda w: w != "").alias("_w"))
    held = held.select(F.inline(F.arrays_zip(F.col("_w").alias("w"), F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("v"))))
    words = held.select(
        F.explode(F.array_compact(F.array(F.concat(F.lit("< "), "w"), F.concat(F.lit("> "), "w"), F.concat(F.lit("<< "), "w", F.lit(" "), "v")))).alias("_word")
    )
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_WORDS else asked
    words = words.join(asked, F.col("_word") == F.col("_asked"), "left_semi").groupBy("_word").agg(F.count(F.lit(1)).alias("places"))
    patterns = written(open_patterns.join(words, F.col("word") == F.col("_word")).select("kind", "word", "seeds", "places"), "pii-places")
    edges = seen.filter("kind is null").join(patterns.select(F.col("kind").alias("pk"), F.col("word").alias("pw")), F.col("word") == F.col("pw")).select(F.col("pk").alias("kind"), "word", "value", "n")
    edges = written(edges, "pii-edges")
    of_seeds = written(seeds.groupBy(F.col("kind").alias("_k"), F.col("word").alias("_w")).agg(F.sum("n").alias("seed_n")), "pii-seeds")
    now = patterns.join(of_seeds, (F.col("kind") == F.col("_k")) & (F.col("word") == F.col("_w"))).select("kind", "word", "seeds", "places", "seed_n", (F.col("seed_n") / F.col("places")).alias("confidence"))
    for _ in range(ROUNDS):
        now = written(now, "pii-round")
        held = edges.join(now.select(F.col("kind").alias("_k"), F.col("word").alias("_w"), "confidence"), (F.col("kind") == F.col("_k")) & (F.col("word") == F.col("_w")))
        scores = held.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        gained = edges.join(scores.select(F.col("kind").alias("_k"), F.col("value").alias("_v"), "score"), (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("_v"))).groupBy(F.col("kind").alias("gk"), F.col("word").alias("gw")).agg(F.sum(F.col("score") * F.col("n")).alias("gain"))
        now = now.join(gained, (F.col("kind") == F.col("gk")) & (F.col("word") == F.col("gw")), "left").select("kind", "word", "seeds", "places", "seed_n", F.least(F.lit(1.0), (F.col("seed_n") + F.coalesce("gain", F.lit(0.0))) / F.col("places")).alias("confidence"))
    best = now.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("seed_n") * 2 >= F.col("places") * MIN_CONFIDENCE)).orderBy("kind", "word")
    return [(r["kind"], r["word"], r["confidence"]) for r in best.collect()]  # the model: no more rows than words that often stand by an entity


def extract(docs: DataFrame, patterns: list[tuple[str, str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans, and `found`: an array of (kind, start, end, base).

    n_* and base_sha256 tell of the fixed patterns alone; spans and found also
    of what the contextual patterns add. A null text is empty; repeated rows
    give repeated rows. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = with_base(rows, "text")
    if patterns:
        rows = with_candidates(rows, "text")
    parts = []
    span = lambda k, base: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"))
    after = lambda words: lambda s: F.exists(s["patterns"], lambda p: p.isin(words))
    for k in KINDS:
        own = F.transform(f"_{k}", span(k, True))
        words = [w for kind, w, _ in patterns if kind == k]
        if words:
            own = F.array_sort(F.concat(own, F.transform(F.filter("_other", after(words)), span(k, False))))
        parts.append(own)
    rows = rows.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*parts).alias("found"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.filter("found", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found")
