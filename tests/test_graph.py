"""Graph algorithms and relatedness, held against plain loops."""

import random
from collections import Counter, deque

import pytest

from quern.operators.graph import label_propagation, shortest_cycles, strong_components
from quern.operators.related import WEIGHTS, co_changed, related, substrings, terms_of
from quern.operators.spread import spread_join


def plain_components(pairs):
    nodes = {x for p in pairs for x in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    reach = {}
    for s in nodes:
        seen, todo = set(), [s]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reach[s] = seen
    groups = {s: {t for t in reach[s] if s in reach[t]} | {s} for s in nodes}
    return {s: (min(g), len(g)) for s, g in groups.items() if len(g) > 1}


def found(df):
    return {r["node"]: (r["component"], r["size"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "nodes", "share"), [(1, 40, 0.9), (2, 150, 1.1), (3, 60, 2.0)])
def test_components_of_random_graphs(spark, seed, nodes, share):
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(int(nodes * share))]
    assert found(strong_components(spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long"))) == plain_components(pairs)


def test_components_of_a_long_ring_with_tails(spark):
    """A ring of 10^5 nodes in random order, a path of as many that leads into it, and a bridge out and back."""
    n, rng = 100_000, random.Random(4)
    place = list(range(n))
    rng.shuffle(place)
    ring = [(place[i], place[(i + 1) % n]) for i in range(n)]
    more = [(n + i, n + i + 1) for i in range(n - 1)] + [(2 * n - 1, 5), (place[7], 3 * n), (3 * n, 3 * n + 1), (3 * n + 1, place[20])]
    got = found(strong_components(spark.createDataFrame(ring + more, "src long, dst long")))
    assert len(got) == n + 2 and set(got.values()) == {(0, n + 2)} and {3 * n, 3 * n + 1} < set(got)


def plain_cycle(out, members):
    start = min(members)
    before, queue = {start: None}, deque([start])
    while queue:
        node = queue.popleft()
        for d in sorted(out.get(node, ())):
            if d not in members or d == node:
                continue
            if d == start:
                path = [start]
                while node is not None:
                    path.append(node)
                    node = before[node]
                return path[::-1]
            if d not in before:
                before[d] = node
                queue.append(d)
    return None


def test_shortest_cycles_equal_a_search_by_queue(spark):
    rng = random.Random(8)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(100, 101), (101, 102), (102, 100), (101, 100), (7, 7)})
    e = spark.createDataFrame(pairs, "src long, dst long")
    groups, out = {}, {}
    for n, (c, _) in plain_components(pairs).items():
        groups.setdefault(c, set()).add(n)
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    got = {r["component"]: r["path"] for r in shortest_cycles(e, strong_components(e)).collect()}
    assert got == {c: plain_cycle(out, g) for c, g in groups.items()} and len(got) >= 2


def plain_labels(edges, label, rounds=10):
    near = {n: set() for n in label}
    for a, b in edges:
        if a in label and b in label and a != b:
            near[a].add(b)
            near[b].add(a)
    label = dict(label)
    for _ in range(rounds):
        moved = False
        for n in sorted(label):
            votes = Counter(label[m] for m in near[n])
            votes[label[n]] += 1
            best = min(x for x, c in votes.items() if c == max(votes.values()))
            moved, label[n] = moved or best != label[n], best
        if not moved:
            break
    return label


@pytest.mark.parametrize(("seed", "nodes", "links", "kinds"), [(1, 60, 120, 3), (2, 80, 100, 30), (3, 40, 39, 40)])
def test_labels_equal_the_sequential_loop(spark, seed, nodes, links, kinds):
    rng = random.Random(seed)
    # The last case is a path in sorted order: every node waits for the one before.
    edges = [(i, i + 1) for i in range(links)] if kinds == 40 else [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]
    label = {n: f"d{rng.randrange(kinds):02d}" for n in range(nodes)}
    got = label_propagation(spark.createDataFrame([*edges, (3, 9999)], "src long, dst long"), spark.createDataFrame(list(label.items()), "node long, label string"))
    assert {r["node"]: r["label"] for r in got.collect()} == plain_labels(edges, label)


def test_spread_join_equals_a_join(spark):
    rows = [("hot", i) for i in range(500)] + [("a", 1), ("a", 1), ("none", 2)]
    left, right = spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame([("hot", "x"), ("a", "y"), ("a", "z")], "k string, w string")
    for how in ("inner", "left"):
        assert sorted(map(str, spread_join(left, right, ["k"], how).select("k", "v", "w").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))


def plain_co_changed(history, top, latest):
    by_path, by_commit = {}, {}
    for c, p, t in history:
        by_path.setdefault(p, []).append((t, c))
        by_commit.setdefault(c, set()).add(p)
    out = []
    for p, cs in by_path.items():
        n = Counter(o for _, c in sorted(cs, reverse=True)[:latest] for o in by_commit[c] if o != p)
        out += [(p, o, k) for o, k in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:top]]
    return sorted(out)


@pytest.mark.parametrize("big", [1000, 12, 0])
def test_co_changes_with_big_commits(spark, big):
    rng = random.Random(5)
    rows = {(c, f"p{p:02d}", c // 3) for c in range(60) for p in rng.sample(range(40), rng.choice([1, 2, 4, 8, 38]))}
    got = co_changed(spark.createDataFrame(sorted(rows), "commit_id int, path string, ts int"), top=5, latest=7, big=big)
    assert sorted((r["path"], r["other"], r["n"]) for r in got.collect()) == plain_co_changed(rows, 5, 7)


def plain_related(links, pairs, traces, top):
    reasons = {}
    for r, (own, cand) in links.items():
        held = {}
        for p, k in cand:
            held.setdefault(k, set()).add(p)
        for p, k in own:
            for o in held.get(k, set()) - {p}:
                reasons.setdefault(p, {}).setdefault(o, set()).add(r)
    for r, rows in pairs.items():
        for p, o in rows:
            reasons.setdefault(p, {}).setdefault(o, set()).add(r)
    out = []
    for p, others in reasons.items():
        for o in others:
            others[o] |= {r for t, r in traces if t == o}
        total = {o: sum(WEIGHTS[r] for r in rs) for o, rs in others.items()}
        out += [(p, o, tuple(sorted(others[o])), min(total[o], 100) / 100) for o in sorted(total, key=lambda o: (-total[o], o))[:top]]
    return sorted(out)


@pytest.mark.parametrize("light", [200, 6, 0])
def test_related_files_equal_all_pairs(spark, light):
    """With every key light, with some heavy, with all heavy: a key of all files among them."""
    rng = random.Random(6)
    paths = [f"f{i:02d}" for i in range(70)]
    some = lambda n, kinds: [(p, f"k{rng.randrange(kinds)}") for p in paths for _ in range(rng.randint(0, n))]
    directory, term = [(p, f"d{rng.randrange(5)}") for p in paths], some(3, 9) + [(p, "all") for p in paths]
    links = {"directory_proximity": (directory, directory), "search_similarity": (term, term), "test_match": (some(2, 30), some(2, 30)), "import_graph": (some(1, 8), some(1, 8))}
    pairs = {"co_change": [(rng.choice(paths), rng.choice(paths)) for _ in range(100)]}
    pairs["co_change"] = [(a, b) for a, b in pairs["co_change"] if a != b]
    traces = [(p, r) for p in paths for r in ("git_modified", "frecency", "recent_query") if rng.random() < 0.2]
    df = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = related({r: tuple(df([*x, (None, "k1"), ("f00", None)], "path string, key string") for x in v) for r, v in links.items()}, {r: df(v, "path string, other string") for r, v in pairs.items()}, df(traces + traces[:3], "path string, reason string"), top=6, light=light)
    assert sorted((r["path"], r["other"], tuple(r["reasons"]), r["confidence"]) for r in got.collect()) == plain_related(links, pairs, traces, 6)


def test_terms_and_substrings(spark):
    from pyspark.sql import functions as F

    assert spark.sql("select 'pkg.Some_x_name.ab' as m").select(terms_of(F.col("m")).alias("t")).first()["t"] == ["pkg", "some", "name"]
    texts, keys = ["tests/test_io.py", "a", ""], ["io", "test_io", "a", "", "zz", "tests/test_io.py"]
    got = substrings(spark.createDataFrame([(t,) for t in texts], "path string"), "path", spark.createDataFrame([(k,) for k in keys], "tail string"), "tail")
    assert {(r["path"], r["tail"]) for r in got.collect()} == {(t, k) for t in texts for k in keys if k and k in t}
