"""128-bit SimHash fingerprints in DataFrame operations, and search by permuted block tables.

A text's terms are its words, lower-cased and cut after every PIECE characters;
each votes on 128 bits by its hash, with a weight that grows with the square of
its length, as long words tell more. The votes of two bits share a long, 32
bits each, so that a document is 64 sums beside the total weight. A bit is set
where more than half of the weight votes for it.

Search: the bits are dealt to m blocks. Two fingerprints within `radius` bits
agree in at least m - radius of them, so there is a table for each choice of
m - radius blocks, keyed by their bits, and some table has both in one bucket.
m is the least for which a key has SPARE bits more than it takes to number the
fingerprints, so that unrelated ones seldom meet, at any size. In the buckets
`regions.region_components` finds the classes, exactly.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.order import positions
from quern.llm.regions import region_components
from quern.llm.shared import discard, written

BITS = 128
#: Characters after which a word is cut.
PIECE = 16
#: Bits within which two fingerprints are near. A copy with 2 % of its words replaced differs by 8 on average.
RADIUS = 4
#: Bits from a pivot within which its Voronoi region lies; unrelated texts differ by 40 and more.
BALL = 30
#: Bits of a table's key beyond those that number the fingerprints.
SPARE = 6
_LANES = (1 << 32) | 1


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"([^\\x20\\x09-\\x0D]{{1,{PIECE}}})"), F.lit(1))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, hi, lo: the fingerprint of each row of texts; rows without terms are missing. Rows alike in their keys vote together."""
    terms = texts.select(*keys, F.explode(_terms(F.col(text_col))).alias("_w"))
    # At most 65, so that a lane holds the votes of 66 million words.
    weight = (F.floor(F.pow(F.length("_w"), 2) / 4) + 1).cast("long")
    votes = terms.select(*keys, weight.alias("_m"), F.xxhash64("_w").alias("_h"), F.xxhash64("_w", F.lit(1)).alias("_l"))

    def lane(c: str, k: int) -> Column:
        return F.shiftrightunsigned(c, k).bitwiseAND(F.lit(_LANES)) * F.col("_m")

    sums = [F.sum(lane(c, k)).alias(f"{c}{k}") for c in ("_h", "_l") for k in range(32)]
    total = votes.groupBy(*keys).agg(F.sum("_m").alias("_t"), *sums)

    def half(c: str) -> Column:
        def bit(k: int) -> Column:
            votes = F.shiftrightunsigned(F.col(f"{c}{k % 32}"), 32 if k >= 32 else 0).bitwiseAND(F.lit((1 << 32) - 1))
            return F.shiftleft((votes * 2 > F.col("_t")).cast("long"), k)

        return reduce(lambda x, y: x.bitwiseOR(y), [bit(k) for k in range(64)])

    return total.select(*keys, half("_h").alias("hi"), half("_l").alias("lo"))


def apart(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def _block_count(radius: int, rows: int) -> int:
    m = radius + 1
    while m < BITS and (m - radius) * (BITS // m) < math.log2(max(2, rows)) + SPARE:
        m += 1
    return m


def _keys(radius: int, m: int) -> Column:
    """The table keys of a fingerprint (hi, lo)."""
    ends = [BITS * k // m for k in range(m + 1)]

    def masked(chosen: tuple[int, ...], c: str, base: int) -> Column:
        mask = 0
        for k in chosen:
            low, high = max(0, ends[k] - base), min(64, ends[k + 1] - base)
            mask |= ((1 << high) - (1 << low)) if high > low else 0
        return F.col(c).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    tables = combinations(range(m), m - radius)
    return F.array(*[F.xxhash64(F.lit(t), masked(own, "hi", 0), masked(own, "lo", 64)) for t, own in enumerate(tables)])


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(hi, lo, class): the least id, of prints (id, hi, lo), that steps of at most `radius` bits reach from a fingerprint."""
    points = prints.groupBy("hi", "lo").agg(F.min("id").alias("id"))
    points = written(points.select(F.monotonically_increasing_id().alias("key"), "id", "hi", "lo"), "points")
    m = _block_count(radius, points.count())
    buckets = written(points.select(F.explode(_keys(radius, m)).alias("bucket"), F.col("key").alias("id")), "buckets")
    side = lambda p: points.select(F.col("key").alias(f"_{p}"), F.col("hi").alias(f"{p}hi"), F.col("lo").alias(f"{p}lo"))

    def measure(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
        d = apart(F.col("ahi"), F.col("alo"), F.col("bhi"), F.col("blo")).cast("double")
        return written(both.select("a", "b", d.alias("d"), (d <= radius).alias("link")), "measured")

    def join(rows: DataFrame) -> DataFrame:
        full = rows.join(points.select(F.col("key").alias("_key"), "hi", "lo"), F.col("id") == F.col("_key")).drop("_key", "degree")
        x = full.select(*[F.col(c).alias(f"x_{c}") for c in full.columns])
        y = full.filter(~F.col("main")).select(*[F.col(c).alias(f"y_{c}") for c in full.columns])
        near = apart(F.col("x_hi"), F.col("x_lo"), F.col("y_hi"), F.col("y_lo")) <= radius
        once = F.col("x_main") | (F.col("x_id") < F.col("y_id"))
        on = (F.col("x_region") == F.col("y_region")) & (F.col("x_component") != F.col("y_component")) & once & near
        return x.join(y, on).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))

    labels = region_components(buckets, measure, join, float(radius), float(max(radius, BALL)), in_task=False)
    discard(buckets)
    step = labels.select(F.col("id").alias("_l"), F.col("component").alias("_c"))
    named = points.join(step, F.col("key") == F.col("_l"), "left").select("hi", "lo", "id", F.coalesce("_c", "key").alias("_c"))
    least = named.groupBy("_c").agg(F.min("id").alias("class")).withColumnRenamed("_c", "_k")
    return named.join(least, F.col("_c") == F.col("_k")).select("hi", "lo", "class")


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, class) for each row of prints (id, hi, lo): the least id that steps of at most `radius` bits reach. Null ids are left out."""
    known = prints.filter(F.col("id").isNotNull())
    own = _classes(known, radius).select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "class")
    return known.join(own, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))).select("id", "class")


def with_edits(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document in ascending order of the id;
    the first document follows the last. near_*: the share of equal bits.
    class_id: the least id that steps of at most `radius` bits reach. A null
    text is empty; texts without words have the fingerprint of zeros. Null ids
    come first and name no class. Rows with the same id follow each other by a
    hash of the text; rows alike in id and text are one document, repeated in
    the result. An empty table gives an empty result; other columns of docs
    play no part.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # (k, h) tells documents apart without nulls.
    base = base.select("id", "text", F.coalesce("id", F.lit(0)).alias("k"), F.xxhash64("text", F.col("id").isNull()).alias("h"))
    rows = base.groupBy("id", "k", "h").agg(F.max(F.length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("copies"))
    placed = written(positions(rows, ["id", "h"]), "order")
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).first()
    repeats = size["n"] != (size["copies"] or 0)
    ahead = placed.select(
        F.pmod(F.col("_pos") + 1, F.lit(max(1, size["n"]))).alias("_for"), F.col("k").alias("pk"), F.col("h").alias("ph"), F.col("n").alias("pn")
    )
    links = placed.join(ahead, F.col("_pos") == F.col("_for")).select(F.col("k").alias("_k"), F.col("h").alias("_h"), "n", "pk", "ph", "pn")
    links = written(links, "links")
    texts = base.select("k", "h", "text").join(links, (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")))
    texts = texts.dropDuplicates(["k", "h"]) if repeats else texts
    heads = texts.select("pk", "ph", F.substr("text", F.lit(1), F.floor(F.col("pn") / 4).cast("int")).alias("head"))
    both = texts.join(heads.withColumnsRenamed({"pk": "_pk", "ph": "_ph"}), (F.col("k") == F.col("_pk")) & (F.col("h") == F.col("_ph")))
    cut = F.floor(F.col("n") / 4)
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n") - cut).cast("int")), "head")
    # Dealt by (k, h) from here to the fingerprints: texts cross the shuffle once.
    sides = F.array(F.struct(F.lit(0).alias("edit"), F.col("text")), F.struct(F.lit(1).alias("edit"), edited.alias("text")))
    prints = fingerprints(both.select("k", "h", F.inline(sides)), ["k", "h", "edit"])
    of = lambda c, e: F.max(F.when(F.col("edit") == e, F.col(c)))
    prints = prints.groupBy("k", "h").agg(of("hi", 0).alias("hi"), of("lo", 0).alias("lo"), of("hi", 1).alias("ehi"), of("lo", 1).alias("elo"))
    sha = both.select(F.col("k").alias("_sk"), F.col("h").alias("_sh"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    zero = F.lit(0).cast("long")
    own = sha.join(prints, (F.col("_sk") == F.col("k")) & (F.col("_sh") == F.col("h")), "left")
    bits = [F.coalesce(c, zero).alias(c) for c in ("hi", "lo", "ehi", "elo")]
    own = written(own.select("_sk", "_sh", "edited_sha256", *bits), "fingerprints")
    discard(links)
    own = placed.join(own, (F.col("k") == F.col("_sk")) & (F.col("h") == F.col("_sh"))).drop("k", "h", "_sk", "_sh")
    own = written(own, "documents")
    following = F.pmod(F.col("_pos") - 1, F.lit(max(1, size["n"]))).alias("_np")
    nexts = own.select(following, F.col("hi").alias("nhi"), F.col("lo").alias("nlo"))
    known = own.filter(F.col("id").isNotNull()).select("id", "hi", "lo")
    classes = _classes(known, radius).select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "class")
    out = own.join(nexts, F.col("_pos") == F.col("_np"))
    out = out.join(classes, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left")
    hi, lo, ehi, elo = (F.col(c) for c in ("hi", "lo", "ehi", "elo"))
    out = out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        _fixed(hi, lo).alias("fingerprint"),
        _fixed(ehi, elo).alias("edited_fingerprint"),
        (1 - apart(hi, lo, ehi, elo) / BITS).alias("near_edited"),
        (1 - apart(hi, lo, F.col("nhi"), F.col("nlo")) / BITS).alias("near_next"),
        F.col("class").alias("class_id"),
        "copies",
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")


def _fixed(hi: Column, lo: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in (hi, lo)])
