"""Whitening, exact deduplication and the Merkle manifest, held against plain versions."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, whitening
from quern.llm.exact_dedup import BASES, PRIME, chunk_hashes, combine, exact_duplicates
from quern.llm.merkle import manifest
from quern.llm.order import places_within


# whitening
def plain_whitening(vectors):
    """Of lists of floats or nulls: usable rows as (position, x), n, sums, eigenvalues, vectors, trace."""
    usable = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return usable, n, sums, e[::-1], u[:, ::-1], float((centred**2).sum() / n)


def vectors(seed, count, dim):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim)) / np.sqrt(dim)
    return (rng.standard_normal((count, dim)) @ mix).astype(np.float32).tolist()


def test_whitening_equals_the_plain_version(spark):
    rows = vectors(1, 300, 20)
    rows += [rows[0], rows[0], None, [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [1.0, 2.0], []]
    df = spark.createDataFrame([(None if i == 5 else i, v, "clash", 1.0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, n string, whitened double").repartition(7)
    got = whitening.whiten(df).collect()
    usable, n, sums, e, u, trace = plain_whitening([v if v and len(v) == 20 else None for v in rows])
    assert len(got) == 4 * len(usable) == 4 * 302
    by = {}
    for r in got:
        by.setdefault((-1 if r["vec_id"] is None else r["vec_id"], r["component"]), r)
    sign = {}
    for i, x in usable:
        for k in range(4):
            r = by[(-1 if i == 5 else i, k + 1)]
            want = sum((c - s / n) * w for c, s, w in zip(x, sums, u[:, k], strict=True)) / math.sqrt(e[k])
            sign.setdefault(k, 1 if want * r["whitened"] > 0 else -1)
            assert r["whitened"] == pytest.approx(sign[k] * want, abs=1e-9)
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            assert r["explained"] == pytest.approx(e[k] / trace, rel=1e-10)
            assert r["identity_error"] <= 1e-10


def test_whitening_of_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5])] * 3, schema)).count() == 0
    # Two distinct vectors vary along one direction only.
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])], schema)).collect()
    assert {r["component"] for r in line} == {1} and sorted(round(abs(r["whitened"]), 9) for r in line) == [1.0] * 3


def test_lobpcg_certifies_many_dimensions_with_a_small_block():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    values = np.concatenate([[9.0, 8.9, 5.0, 5.0], np.linspace(4.5, 0.0, 196)])
    matrix = (q * values) @ q.T
    calls = []
    e, u, off, steps = whitening.lobpcg(lambda b: calls.append(b.shape[1]) or matrix @ b, 200, 4, block=8)
    assert e == pytest.approx([9.0, 8.9, 5.0, 5.0], abs=1e-10) and off.max() <= whitening.TOLERANCE
    assert np.abs(u.T @ u - np.eye(4)).max() < 1e-12
    assert abs(abs(u[:, 0] @ q[:, 0]) - 1) < 1e-12 and abs(abs(u[:, 1] @ q[:, 1]) - 1) < 1e-12
    assert max(calls) <= 24 and steps < 100


def test_deviations_beyond_a_double_stay_exact():
    x = np.array([[3_000_000_000, -5], [7, 11]], np.int64)
    sums = np.array([3_000_000_007, 6], object)
    assert whitening._deviations(x, 2, sums) == [sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums.tolist(), strict=True)) for r in x]


# exact duplicates
def plain_hash(data, base):
    return sum(b * pow(base, i, PRIME) for i, b in enumerate(data)) % PRIME


def test_chunk_hashes_compose():
    rng = random.Random(2)
    for n in (0, 1, 7, 100, 1000):
        data = bytes(rng.randrange(256) for _ in range(n))
        cut = rng.randint(0, n)
        got = chunk_hashes(pa.array([data, data[:cut], data[cut:]], pa.binary()), [0, 0, cut])
        for k, base in enumerate(BASES):
            assert got[k][0] == plain_hash(data, base) == (got[k][1] + got[k][2]) % PRIME
            assert combine(plain_hash(data[:cut], base), plain_hash(data[cut:], base), cut, base) == got[k][0]


def plain_duplicates(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max(ids, key=lambda x: -(1 << 62) if x is None else x) for t, ids in groups.items()}
    return sorted(((str(i), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows))


def told(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in df.collect())


def texts(seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, "a", "ab", "é" * 30, "same line\n" * 40, "x" * rng.randint(1, 400)])) for i in range(200)]
    rows += [(1000 + i, "hot text of many copies " * 10) for i in range(300)]
    long = "".join(rng.choice("abc\n") for _ in range(5000))
    rows += [(2000, long), (2001, long), (2002, long[:-1] + "~"), (2003, "~" + long[1:]), (None, long), (None, None), (7, "a"), (7, "a"), (7, "b")]
    return rows


@pytest.mark.parametrize(("chunk", "huge", "bits", "most"), [(1 << 16, 1 << 20, 61, 500_000), (64, 1000, 61, 0), (64, 300, 2, 500_000), (64, 1 << 20, 0, 0)])
def test_exact_duplicates_equal_the_plain_version(spark, chunk, huge, bits, most):
    """Chunks of many sizes, texts dealt out before hashing, joins by shuffle, and hashes of so few bits that different texts collide."""
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, sha string, level int, chunk int").repartition(5)
    got = exact_duplicates(df, chunk=chunk, huge=huge, bits=bits, broadcast_rows=most).cache()
    assert told(got) == plain_duplicates(rows)
    # Of each group one row stays: that of the largest id.
    kept = got.filter("kept").groupBy("text_sha256").count()
    assert kept.count() == got.select("text_sha256").distinct().count() and kept.filter("count > 1").count() == 0
    assert got.filter("kept and not (doc_id <=> keep_id)").count() == 0
    got.unpersist()


def test_exact_duplicates_of_an_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_dedup.CHUNK * 255 * (1 << 32) < 1 << 64  # a chunk's sums fit


# manifest
def plain_manifest(rows, tampered, fanout):
    """rows: tuples of doc_id, source, lang, n_chars, text. Leaf, subroot, root, proof, folded root of each."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*[field(v) for v in r])

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i - i % fanout
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
            i //= fanout
        return out

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for v in langs.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in v]) for k, v in langs.items()}
    top = tree([trees[k][-1][0] for k in order])
    out = []
    for k in order:
        for i, r in enumerate(langs[k]):
            steps = path(trees[k], i) + path(top, order.index(k))
            acc = leaf(tampered(r))
            for before, after in steps:
                acc = h(before, acc, after)
            root = top[-1][0]
            out.append((str(r[0]), leaf(r), trees[k][-1][0], root, h(*[b + a for b, a in steps]), acc, acc == root))
    return sorted(out)


def documents(count, langs, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s1", "", None, "é"]), rng.choices(langs, [50, *[1] * (len(langs) - 1)])[0], rng.choice([None, 0, 5, 10**12]), rng.choice([None, "", "text ü", "x" * 100])) for i in range(count)]
    return [*rows, *rows[:2], (None, None, langs[0], None, None)] if count > 2 else rows


def bumped(r):
    hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    return (*r[:3], r[3] + 1, r[4]) if hit else r


@pytest.mark.parametrize(("count", "langs", "fanout"), [(1, ["en"], 2), (2, ["en"], 2), (700, ["en", None, "", "zz", "ü", "de"], 2), (700, ["en", None, "de"], 5), (300, ["en", "v"], 300), (257, [None], 16)])
def test_manifest_equals_the_plain_version(spark, count, langs, fanout):
    rows = documents(count, langs)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, hash string, idx int").repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fanout=fanout)
    told = sorted((str(r["doc_id"]), *r[1:]) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert told == plain_manifest(rows, bumped, fanout)
    assert count < 100 or {t[-1] for t in told} == {True, False}


def test_manifest_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(df, df.columns, "lang", "doc_id").count() == 0


def test_places_within_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), rng.randint(0, 50)) for _ in range(500)]
    got = places_within(spark.createDataFrame(rows, "g string, k int"), "g", ["k"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["_place"], r["k"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for h, k in rows if h == g)
        assert {r["_size"] for r in got if r["g"] == g} == {len(mine)}
