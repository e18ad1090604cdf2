import random
import re
from collections import defaultdict

import numpy as np
import pytest

import quern.llm.jaccard_join as jaccard
import quern.llm.regions as regions
from quern.llm.components import components
from quern.llm.jaccard_join import similar_components
from quern.llm.simhash import RADIUS, fingerprints, near_classes, with_edits

SCHEMA = "doc_id long, text string, n long, rep string"


def family_corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word()
            rows.append((k, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w), 1, "x"))
            k += 1
    rows += [(k, None, 1, None), (k + 1, "", None, "y"), (k + 2, " \n\t", 0, "z"), (k + 3, "one two", 1, "a"), (k + 4, "ONE  two", 1, "b"), (None, "null id row", 1, "c"), (k + 5, "w " * 3000, 1, "d")]
    return rows + rows[:3]


def brute(rows, n, part):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "part", "shuffled"), [(4, 85, False), (5, 80, False), (3, 60, False), (4, 85, True)])
def test_components_are_exact(spark, monkeypatch, n, part, shuffled):
    if shuffled:  # ids by a shuffle, a pivot's documents in slices
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
        monkeypatch.setattr(jaccard, "SLICE", 3)
        monkeypatch.setattr(regions, "LEAF", 2)
    rows = family_corpus()
    got = similar_components(spark.createDataFrame(rows, SCHEMA), n, part, 100).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(rows, n, part)


def test_documents_that_meet_by_chance_are_parted_by_parities(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(0, 300, 3):  # two of a kind, and two of which three quarters are alike
        common = [word() for _ in range(175)]
        near = [word() for _ in range(200)]
        rows += [(k, " ".join(near)), (k + 1, " ".join([*near[:-1], word()])), (k + 2, " ".join([*common, *[word() for _ in range(25)]]))]
        rows.append((1000 + k, " ".join([*common, *[word() for _ in range(25)]])))
    read, keep = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: (out := keep(df, name), read.append(out.count()) if name == "texts" else None)[0])
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 85)
    assert read == [200]


@pytest.mark.parametrize("size", [5, 30, 150, 700, 40_000])
def test_parities_exclude_no_link(size):
    rng = np.random.default_rng(size)
    every = np.unique(rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64))
    sets = [np.sort(rng.permutation(every[: size + k])[:size]) for k in (0, size // 20, size // 12, size // 8, 2 * size)]
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    parity = jaccard._parities(np.concatenate(sets), bounds).to_pylist()
    sizes = [len(x) for x in sets]
    linked = set()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (sizes[a] + sizes[b] - both):
                linked |= {a, b}
                assert jaccard._possible([sizes[a], sizes[b]], [parity[a], parity[b]], 85, 100) == [0, 1]
    assert linked and linked <= set(jaccard._possible(sizes, parity, 85, 100))


def test_empty_table(spark):
    assert similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 300), (400, 401)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 401: 400}


def test_simhash_contract(spark):
    import hashlib

    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(n))
    rows = [(i * 3, text(rng.randint(1, 80)), 1, "r") for i in range(60)] + [(500, None, 1, None), (501, "", 1, ""), (502, "é", 1, ""), (503, text(400), 1, ""), (504, "x" * 5000, 1, "")]
    rows += [(600, rows[0][1], 1, ""), (600, rows[0][1], 1, "")]
    got = with_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    order = sorted({(i, t or "") for i, t, *_ in rows})
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        assert by[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert by[i]["n_chars"] == len(t)
        assert 0 <= by[i]["near_next"] <= 1
    assert by[600]["fingerprint"] == by[0]["fingerprint"] and by[600]["class_id"] == 0
    assert with_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_block_tables_miss_nothing(spark):
    rng = random.Random(4)
    points = []
    for k in range(40):
        hi, lo = rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)
        for j in range(rng.randint(1, 6)):
            h, low = hi & ((1 << 64) - 1), lo & ((1 << 64) - 1)
            for _ in range(rng.randint(0, 4)):
                b = rng.randrange(128)
                h, low = (h ^ (1 << (b - 64)), low) if b >= 64 else (h, low ^ (1 << b))
            s = lambda v: v - (1 << 64) if v >> 63 else v
            points.append((k * 10 + j, s(h), s(low)))
    points.append((None, 0, 0))
    want = {p[0]: p[0] for p in points if p[0] is not None}
    known = points[:-1]
    near = defaultdict(list)
    for a in known:
        for b in known:
            if bin((a[1] ^ b[1]) & (2**64 - 1)).count("1") + bin((a[2] ^ b[2]) & (2**64 - 1)).count("1") <= 3:
                near[a[0]].append(b[0])
    for _ in range(20):
        want = {i: min(want[j] for j in near[i]) for i in want}
    got = {r["id"]: r["class"] for r in near_classes(spark.createDataFrame(points, "id long, hi long, lo long"), 3).collect()}
    assert got == want


def test_fingerprints_against_plain_votes(spark):
    import xxhash

    texts = ["One word, two words and a third", "a " * 50 + "b", "x" * 40 + " ende Été", ""]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = {}
    for i, t in enumerate(texts):
        votes, total = [0] * 128, 0
        for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", t.lower()):
            hi = xxhash.xxh64(w.encode(), seed=42).intdigest()
            lo = xxhash.xxh64((1).to_bytes(4, "little"), seed=hi).intdigest()
            weight = len(w) ** 2 // 4 + 1
            total += weight
            for k in range(64):
                votes[k] += weight * (hi >> k & 1)
                votes[64 + k] += weight * (lo >> k & 1)
        if total:
            want[i] = tuple(signed(sum((2 * votes[b + k] > total) << k for k in range(64))) for b in (0, 64))
    got = fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()
    assert {r["k"]: (r["hi"], r["lo"]) for r in got} == want


def test_share_of_near_copies_within_the_radius(spark):
    """Copies of 300 words by their similarity in five-word shingles; the README states the shares."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    vocabulary, rows, edits = [word() for _ in range(3000)], [], (1, 3, 6)
    for k in range(300):
        base = [rng.choice(vocabulary) for _ in range(300)]
        copy = list(base)
        for at in rng.sample(range(0, 300, 5), edits[k % 3]):
            copy[at] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {r["k"]: (r["hi"], r["lo"]) for r in fingerprints(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))
    share = [sum(bits(got[2 * k], got[2 * k + 1]) <= RADIUS for k in range(c, 300, 3)) / 100 for c in range(3)]
    print("similarity 0.97, 0.9, 0.82:", share)
    assert share[0] >= 0.7 and share[0] > share[1] > share[2]


def test_large_regions_are_exact(spark):
    """A region of more than a thousand members, of which the most link."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(60)], []
    for k in range(1300):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(60)] = word()
        rows.append((k, " ".join(w), 1, "x"))
    got = similar_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 85)


def test_near_copies_that_do_not_link_are_not_multiplied(spark, monkeypatch):
    """Pivots tell nothing of a large region in which all distances are alike."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(60)], []
    for k in range(0, 300, 2):
        w = list(base)
        w[rng.randrange(5, 30)], w[rng.randrange(35, 55)] = word(), word()
        rows.append((k, " ".join(w)))
        if k % 30 == 0:
            rows.append((k + 1, " ".join([*w[:-1], word()])))
    for module in (jaccard, regions):
        monkeypatch.setattr(module, "LEAF", 20)
    sizes, keep = defaultdict(list), jaccard.written
    for module in (jaccard, regions):
        monkeypatch.setattr(module, "written", lambda df, name: (out := keep(df, name), sizes[name].append(out.count()))[0])
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    want = brute(rows, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and 100 < len({c for _, c in want.values()}) < len(rows)
    assert sizes["level"][0] > 100 and max(sizes["level"]) <= 2 * sizes["level"][0] and len(sizes["level"]) <= 3
    assert sum(sizes["joins"]) <= 20 * sizes["level"][0]


def test_sketch_takes_as_many_jobs_on_any_partitions(spark):
    texts = spark.createDataFrame([(" ".join(f"{k}x{j}" for j in range(20)),) for k in range(300)], "text string").repartition(30)
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("sketch", "")
        assert int(jaccard._sketch(texts, 4).sum()) == 300 * 17
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch")) <= 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("most", [0, 200_000])
def test_components_by_stars_and_in_one_task(spark, monkeypatch, most):
    from quern.llm import components as module

    monkeypatch.setattr(module, "TASK_EDGES", most)
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (7, 1100)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["id"]: r["component"] for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least
    assert module.components(spark.createDataFrame([], "a long, b long")).count() == 0
