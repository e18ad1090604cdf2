"""Fuzzy matches, order statistics, digests and nested payloads, held against plain versions."""

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quern.operators.digests import changed_since, depth_for, digest_tree
from quern.operators.fuzzy import FUZZY_THRESHOLD, matches, partial_ratio, suggestions, within_reach
from quern.operators.payloads import FILE_FIELDS, KIND_FIELDS, SYMBOL_FIELDS, matching, strings
from quern.operators.quantiles import exclusive_quartiles, order_statistics


# fuzzy
def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def plain_ratio(needle, text):
    a, b = (needle, text) if len(needle) <= len(text) else (text, needle)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    windows = [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))]
    return max(200.0 * plain_lcs(a, w) / (len(a) + len(w)) for w in windows)


@pytest.mark.parametrize("needle", ["abcab", "a", "bolt", "ab" * 31, "", "ééb a"])
def test_ratios_equal_the_plain_version(spark, needle):
    rng = random.Random(len(needle))
    texts = ["", "a", "abcab", "xxabcabxx", None] + ["".join(rng.choice("abcé lot") for _ in range(rng.randint(1, 75))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", partial_ratio(F.col("t"), needle).alias("r"), within_reach(F.col("t"), needle, FUZZY_THRESHOLD).alias("near")).collect()
    for r in got:
        want = plain_ratio(needle, r["t"] or "")
        assert r["r"] == pytest.approx(want) and (r["near"] or want < FUZZY_THRESHOLD)


def test_matches_and_suggestions(spark):
    df = spark.createDataFrame([("blue bolt",), ("Blue Bolt",), ("red ring",), ("bolt",), (None,)], "name string")
    assert {r["name"] for r in matches(df, "name", "blu bolt").collect()} == {"blue bolt", "Blue Bolt", "bolt"}
    assert {r["name"] for r in matches(df, "name", "Blue Bolt").collect()} >= {"Blue Bolt"}
    assert [r["name"] for r in suggestions(df, "name", "bolt").collect()][:3] == ["Blue Bolt", "blue bolt", "bolt"]
    with pytest.raises(ValueError):
        partial_ratio(F.col("name"), "x" * 63)


# order statistics
def test_order_statistics_of_odd_values(spark):
    rng = random.Random(3)
    groups = {
        "ties": [5.0] * 40 + [1.0, 9.0],
        "far": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(200)] + [1.7e308, -1.7e308],
        "dense": [rng.random() for _ in range(3000)],
        "one": [2.5],
        "zeros": [0.0, -0.0, 0.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("dense", None)]
    places = [(g, p) for g, vs in groups.items() for p in (1, 2, len(vs) // 3, len(vs), len(vs) + 1) if p]
    got = order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", spark.createDataFrame(places, "g string, place long"), bins=16)
    assert {(r["g"], r["place"]): r["v"] for r in got.collect()} == {(g, p): sorted(groups[g])[p - 1] for g, p in places if p <= len(groups[g])}


def test_quartiles_of_a_group_of_ten_million(spark):
    """One group, in any order; places of 0 ... n - 1 are known."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.pmod(F.col("id") * 7_654_321, F.lit(n)).alias("v"))
    r = exclusive_quartiles(df, ["g"], "v").first()
    m = n + 1
    want = [(i * m // 4 - 1) + (i * m % 4) / 4 for i in (1, 3)]
    assert r["n"] == n and [r["q1"], r["q3"]] == pytest.approx(want)


def test_quartiles_equal_the_library(spark):
    rng = random.Random(9)
    groups = {g: [rng.randint(0, 60) for _ in range(n)] for g, n in (("a", 2), ("b", 3), ("c", 12), ("d", 101))}
    got = exclusive_quartiles(spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("e", 1)], "g string, v int"), ["g"], "v").collect()
    for r in got:
        if r["g"] != "e":
            q = statistics.quantiles(groups[r["g"]], n=4)
            assert (r["q1"], r["q3"]) == pytest.approx((q[0], q[2]))
    assert len(got) == 5 and next(r["q1"] for r in got if r["g"] == "e") is None


# digests
def test_digest_trees_tell_changes(spark):
    rng = random.Random(2)
    old = {f"hot/dir/f{i}": str(rng.randint(0, 9)) for i in range(900)}
    new = dict(old) | {"hot/dir/f3": "x", "new": None, "": "1"}
    del new["hot/dir/f5"]
    df = lambda d: spark.createDataFrame(list(d.items()), "path string, hash string").repartition(3)
    assert depth_for(len(old)) == 1 and depth_for(64) == 0 and depth_for(64 * 16 + 1) == 2
    for depth in (0, 1, 2):
        tree = digest_tree(df(old), depth)
        assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, digest_tree(df(dict(reversed(old.items()))), depth).collect()))
        got, mine = changed_since(df(old), df(new), tree)
        assert {(r["path"], r["change"]) for r in got.collect()} == {("hot/dir/f3", "changed"), ("hot/dir/f5", "deleted"), ("new", "new"), ("", "new")}
        root = {r["digest"] for r in mine.filter("level = 0").collect()}
        assert len(root) == 1 and root != {r["digest"] for r in tree.filter("level = 0").collect()}
    bucket = [f"={p}\n={h}" for p, h in old.items()]
    assert digest_tree(df(old), 0).first()["digest"] == hashlib.sha256("\n".join(sorted(bucket)).encode()).hexdigest()
    assert changed_since(df(old), df(old), files=len(old))[0].count() == 0
    assert digest_tree(df(old).limit(0), 1).count() == 0 and changed_since(df(old).limit(0), df({"a": "1"}))[0].count() == 1


# payloads
def walk(value, path=()):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for x in value:
            yield from walk(x, path)
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from walk(x, (*path, k))


def payload(rng, depth):
    kind = rng.choice(["s", "n", "l", "d", "d"]) if depth else rng.choice(["s", "n"])
    if kind == "s":
        return rng.choice(["src/A.py", "load_Thing", "x", "", "match"])
    if kind == "n":
        return rng.choice([1, 2.5, None, True])
    if kind == "l":
        return [payload(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: payload(rng, depth - 1) for k in rng.sample(["path", "name", "kind", "note", "file", "a b"], rng.randint(0, 4))}


def test_nested_strings_and_record_filters(spark):
    rng = random.Random(7)
    docs = {i: payload(rng, rng.randint(0, 7)) for i in range(150)} | {900: "top", 901: [[[]]], 902: {}}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()] + [(999, None)], "id int, text string").select("id", F.try_parse_json("text").alias("v"))
    got = sorted((r["id"], tuple(r["path"]), r["value"]) for r in strings(df, ["id"], "v").collect())
    assert got == sorted((i, p, s) for i, d in docs.items() for p, s in walk(d))
    under = lambda d, needle, fields: any(needle in s.lower() and (fields is None or set(p) & set(fields)) for p, s in walk(d))
    for ask, fields in (({"file": "a.PY"}, FILE_FIELDS), ({"symbol": "thing"}, SYMBOL_FIELDS), ({"kind": "Match"}, KIND_FIELDS), ({"text": "LOAD"}, None)):
        (needle,) = ask.values()
        want = {i for i, d in docs.items() if under(d, needle.lower(), fields)}
        assert {r["id"] for r in matching(df, ["id"], "v", **ask).collect()} == want and want
    both = {i for i, d in docs.items() if under(d, "x", None) and under(d, "src", FILE_FIELDS)}
    assert {r["id"] for r in matching(df, ["id"], "v", text="x", file="src").collect()} == both
    assert matching(df, ["id"], "v").count() == len(docs) + 1
