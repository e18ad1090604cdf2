"""Graph algorithms over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import views
from quern.registry import query
from quern.sources.folders import kept


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all nodes that a path of one or more edges joins. Path lengths double each round.

    The closure itself may grow with the square of the nodes: it is for graphs
    of modules, not of documents.
    """
    now = kept(edges.select("src", "dst").distinct(), "closure")
    n = now.count()
    while True:
        b = now.select(F.col("src").alias("_m"), F.col("dst").alias("_d"))
        now = kept(now.unionByName(now.join(b, F.col("dst") == F.col("_m")).select("src", F.col("_d").alias("dst"))).distinct(), "closure")
        m = now.count()
        if m == n:
            return now
        n = m


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of nodes that reach each other, for components of two and more; component: the least node.

    Without the closure: nodes without a way in or out are trimmed, chains
    (nodes with one way out, or one way in) are contracted into their end by
    doubling pointers, in rounds by the logarithm of their length, and what is
    left is coloured: each node by the least node that reaches it, and a
    colour's own node gathers backwards who reaches it. At last the contracted
    chains are told, in reverse, who of them lies on a way back. Rounds of
    colouring grow with the longest of the shortest paths that are left. Null
    nodes and loops count nothing.
    """
    e = kept(_trimmed(edges.select("src", "dst").dropna().filter("src <> dst").distinct()), "edges", n=F.lit(True))
    labels = e.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    undo: list[_Chains] = []
    size, turned = e.counts["n"], False
    # Both ways in turn, until a turn leaves most of the edges.
    while size:
        chains = _Chains(e, turned)
        if chains.steps:
            undo.append(chains)
            labels = kept(labels.unionByName(chains.cycles), "labels") if chains.rings else labels
            e = chains.rest
        now = e.counts["n"]
        if turned and now > 0.75 * size:
            break
        size, turned = now, not turned
    labels = _coloured(e, labels)
    for chains in reversed(undo):
        labels = chains.labelled(labels)
    named = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()
    least = named.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return named.join(least, "label").select("node", "component", "size")


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose start has a way in and whose end has a way out."""
    return e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


class _Chains:
    """Nodes with one way out (turned: one way in) of edges, contracted into the first node ahead that isn't one of them.

    Such a node is in the component of its end exactly if something of that
    component leads to it. Some chains run into a ring of their own kind: the
    ring is a component, what leads into it is in none.
    """

    def __init__(self, edges: DataFrame, turned: bool) -> None:
        self.turned, self.steps = turned, []
        e = self._turn(edges)
        one = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("node", "to")
        ends = one.select(F.col("node").alias("_n"), F.lit(True).alias("open"))
        opened = F.coalesce("open", F.lit(False))
        p = kept(one.join(ends, F.col("to") == F.col("_n"), "left").select("node", "to", opened.alias("open"), F.least("node", "to").alias("low")), "chain", some=F.lit(True), open=F.col("open"))
        if not p.counts["some"]:
            return
        self.steps.append(p)
        # open: the pointer, 2^k steps ahead, is still inside a chain. Once as many are open as before, they lead to
        # rings; once as many nodes are pointed at as before, those are the rings; once no `low` falls, it is the ring's.
        left, before = p.counts["open"], None
        while left:
            q = p.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("open").alias("_open"), F.col("low").alias("_low"))
            far = p.join(q, F.col("open") & (F.col("to") == F.col("_n")), "left")
            less = F.coalesce(F.col("_open") & (F.col("_low") < F.col("low")), F.lit(False))
            p = kept(far.select("node", F.coalesce("_to", "to").alias("to"), F.coalesce("_open", F.lit(False)).alias("open"), F.least("low", "_low").alias("low"), less.alias("less")), "chain", less=F.col("less"))
            self.steps.append(p)
            sizes = tuple(p.filter("open").agg(F.count(F.lit(1)), F.countDistinct("to")).first())
            left = sizes[0]
            if sizes == before and not p.counts["less"]:
                break
            before = sizes
        self.rings = bool(left)
        on_ring = p.filter("open").select(F.col("to").alias("node")).distinct()
        self.cycles = p.join(on_ring, "node", "left_semi").select("node", F.col("low").alias("label"))
        ahead = p.select(F.col("node").alias("_n"), F.col("to").alias("_to"), "open")
        met = e.join(p.select(F.col("node").alias("src")), "src", "left_anti").join(ahead, F.col("dst") == F.col("_n"), "left")
        met = kept(met.filter("open is null or not open").select("src", "dst", F.col("_to").alias("to")), "chain-ends")
        self.entries = met.filter("to is not null")
        self.rest = kept(_trimmed(self._turn(met.select("src", F.coalesce("to", "dst").alias("dst")).filter("src <> dst").distinct())), "edges", n=F.lit(True))

    def _turn(self, e: DataFrame) -> DataFrame:
        return e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if self.turned else e

    def labelled(self, labels: DataFrame) -> DataFrame:
        """labels with those of the chains' nodes; a node without a label is its own."""
        of = lambda c: labels.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"of_{c}"))
        known = self.entries.join(of("src"), F.col("src") == F.col("_src"), "left").join(of("to"), F.col("to") == F.col("_to"), "left")
        label = F.coalesce("of_to", "to")
        marked = kept(known.filter(F.coalesce("of_src", "src") == label).select(F.col("dst").alias("node"), label.alias("label")).distinct(), "marked", some=F.lit(True))
        if not marked.counts["some"]:
            return labels
        for p in self.steps[:-1]:
            ahead = p.filter("open").select(F.col("node").alias("_n"), "to")
            marked = kept(marked.unionByName(marked.join(ahead, F.col("node") == F.col("_n")).select(F.col("to").alias("node"), "label")).distinct(), "marked")
        return kept(labels.unionByName(marked), "labels")


def _coloured(e: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with those of components of the edges, found by colours."""
    while e.counts["n"]:
        nodes = e.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct()
        colour = kept(_less(e, nodes), "colours", less=F.col("less"))
        while colour.counts["less"]:
            colour = kept(_less(e, colour.select("node", "colour")), "colours", less=F.col("less"))
        c = lambda n: colour.select(F.col("node").alias(n), F.col("colour").alias(f"c_{n}"))
        inside = kept(e.join(c("src"), "src").join(c("dst"), "dst").filter("c_src = c_dst").select("src", "dst", F.col("c_src").alias("colour")), "inside")
        found = kept(colour.filter("node = colour").select("node", F.col("colour").alias("label"), F.lit(True).alias("fresh")), "found", fresh=F.lit(True))
        while found.counts["fresh"]:
            back = inside.join(found.filter("fresh").select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.col("colour").alias("label"), F.lit(True).alias("fresh"))
            every = found.withColumn("fresh", F.lit(False)).unionByName(back).groupBy("node", "label").agg(F.bool_and("fresh").alias("fresh"))
            found = kept(every, "found", fresh=F.col("fresh"))
        labels = kept(labels.unionByName(found.filter("node <> label").select("node", "label")), "labels")
        gone = found.select("node")
        left = inside.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        e = kept(_trimmed(left.select("src", "dst")), "edges", n=F.lit(True))
    return labels


def _less(e: DataFrame, colour: DataFrame, steps: int = 3) -> DataFrame:
    """node, colour after that many steps along the edges to lesser colours, and whether the last of them changed it."""
    for _ in range(steps):
        came = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_c")), "src").groupBy(F.col("dst").alias("_n")).agg(F.min("_c").alias("_c"))
        colour = colour.join(came, F.col("node") == F.col("_n"), "left").select("node", F.least("colour", "_c").alias("colour"), (F.col("_c") < F.col("colour")).alias("less"))
    return colour


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, path): the shortest closed walk through each component's least node, smaller successors first.

    All components search at once, a join a step. A node keeps the least of
    the shortest paths to it, which is the order in which a queue would meet
    them; of walks that close at a step the least wins. Steps are as many as
    the longest of the cycles found has nodes.
    """
    c = components.select(F.col("node").alias("src"), "component")
    inside = edges.select("src", "dst").filter("src <> dst").distinct().join(c, "src").join(components.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst").filter("component = _c").select("component", "src", "dst")
    inside = kept(inside, "inside")
    front = seen = kept(components.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("path")), "front", some=F.lit(True))
    done = front.select("component", "path").limit(0)
    while front.counts["some"]:
        ways = kept(front.join(inside.withColumnRenamed("component", "_c"), (F.col("component") == F.col("_c")) & (F.col("node") == F.col("src"))).select("component", "dst", F.concat("path", F.array("dst")).alias("path")), "ways")
        done = kept(done.unionByName(ways.filter("dst = component").groupBy("component").agg(F.min("path").alias("path"))), "cycles")
        ahead = ways.join(done.select("component"), "component", "left_anti").groupBy("component", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        front = kept(ahead.join(seen.select("component", "node"), ["component", "node"], "left_anti"), "front", some=F.lit(True))
        seen = kept(seen.select("component", "node").unionByName(front.select("component", "node")), "seen")
    return done


def label_propagation(edges: DataFrame, seeds: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label) by majority in sorted order, one node after the other, with the own vote, ties to the least label.

    In a round a node sees the new labels of lower neighbours and the old ones
    of higher neighbours. So the new labels are the one solution of equations
    in which each depends on lower nodes alone; sweeps over all nodes at once,
    from the old labels on, reach it: after each sweep at least one more
    length of dependent changes is right, and a sweep without a change proves
    the rest. Sweeps are as many as the longest chain of changes that cause
    each other, not as there are nodes. Neighbours without a seed have no vote.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    known = seeds.select("node")
    both = kept(both.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "neighbours")
    state = kept(seeds.select("node", F.col("label").alias("old"), F.col("label").alias("new")), "labels")
    for _ in range(rounds):
        while True:
            near = both.join(state, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), F.when(F.col("dst") < F.col("src"), F.col("new")).otherwise(F.col("old")).alias("label"))
            votes = near.unionByName(state.select("node", F.col("old").alias("label"))).groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
            best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("less"), "label")).alias("best")).select(F.col("node").alias("_n"), F.col("best.label").alias("_new"))
            # Every node with a seed votes for itself, so each has a row.
            swept = kept(state.join(best, F.col("node") == F.col("_n")).select("node", "old", F.col("_new").alias("new"), (F.col("_new") != F.col("new")).alias("moved")), "labels", moved=F.col("moved"), other=F.col("old") != F.col("new"))
            state = swept.select("node", "old", "new")
            if not swept.counts["moved"]:
                break
        if not swept.counts["other"]:
            break
        state = state.select("node", F.col("new").alias("old"), "new")
    return state.select("node", F.col("new").alias("label"))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): `module.name` where that is a module, else `module`; of equal module keys the first path counts.

    imports: (src, module, name); modules: (module, path, position).
    """
    keys = modules.groupBy("module").agg(F.min_by("path", "position").alias("path"))
    a, b = keys.select(F.col("module").alias("_a"), F.col("path").alias("pa")), keys.select(F.col("module").alias("_b"), F.col("path").alias("pb"))
    full = F.concat_ws(".", "module", "name")
    return imports.join(a, full == F.col("_a"), "left").join(b, F.col("module") == F.col("_b"), "left").select("src", F.coalesce("pa", "pb").alias("dst")).filter("dst is not null").distinct()


def absolute_module(package: str, level: int, tail: str | None) -> str:
    """A relative import with `level` dots from `package`: one dot is the package itself."""
    parts = package.split(".") if package else []
    kept = parts[: max(0, len(parts) - level + 1)]
    return ".".join([*kept, *([tail] if tail else [])])


def _recursive(query_sql: str) -> str:
    from quern.plans.views import SQL

    return "WITH RECURSIVE " + SQL["edges"] + ", reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)\n" + query_sql


@query(_recursive("SELECT src, dst FROM reach"))
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(views.edges(spark, sf_dir))


@query(_recursive("SELECT a.src AS node, CAST(least(min(a.dst), a.src) AS INTEGER) AS component, count(*) + 1 AS size FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst GROUP BY a.src"))
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_components(views.edges(spark, sf_dir))


@query(_recursive(""", members AS (SELECT a.src AS node, least(min(a.dst), a.src) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst GROUP BY a.src),
walk AS (SELECT component, [component] AS path, component AS here FROM (SELECT DISTINCT component FROM members)
 UNION ALL SELECT w.component, list_append(w.path, e.dst), e.dst FROM walk w JOIN edges e ON e.src = w.here JOIN members m ON m.node = e.dst AND m.component = w.component WHERE e.src <> e.dst AND (e.dst = w.component OR NOT list_contains(w.path, e.dst)) AND NOT (len(w.path) > 1 AND w.here = w.component))
SELECT CAST(component AS BIGINT) AS component, CAST(path AS BIGINT[]) AS path FROM walk WHERE len(path) > 1 AND here = component QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), path) = 1"""))
def representative_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kept(views.edges(spark, sf_dir).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "edges")
    return shortest_cycles(e, strong_components(e))


@query(""", both_ways AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
near AS (SELECT n_nationkey AS node, list(dst) FILTER (WHERE dst IS NOT NULL) AS others FROM nation LEFT JOIN both_ways ON src = n_nationkey GROUP BY 1),
told AS (SELECT max(n_nationkey) + 1 AS n, list('r' || n_regionkey ORDER BY n_nationkey) AS start FROM nation),
turn AS (SELECT 0 AS step, start AS labels FROM told
 UNION ALL SELECT step + 1, list_transform(labels, lambda l, i: CASE WHEN i <> step % n + 1 THEN l ELSE list_sort(list_transform(list_distinct(list_append(votes, l)), lambda x: {'less': -len(list_filter(list_append(votes, l), lambda y: y = x)), 'label': x}))[1].label END)
 FROM (SELECT step, labels, n, list_transform(coalesce(others, []), lambda d: labels[d + 1]) AS votes FROM turn JOIN told ON true JOIN near ON node = step % n WHERE step < 10 * n))
SELECT CAST(i AS BIGINT) AS node, labels[i + 1] AS label FROM (SELECT labels, unnest(range(n)) AS i FROM turn JOIN told ON step = 10 * n)""".replace(", both_ways", "WITH RECURSIVE " + views.SQL["edges"] + ", both_ways", 1))
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by who trades with whom, from their regions on."""
    e = views.edges(spark, sf_dir).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("label"))
    return label_propagation(e, n)


@query("SELECT src, dst, 'forbidden ' || dst AS message FROM edges WHERE src < 10 AND dst >= 20 ORDER BY src, dst LIMIT 100", "edges")
def boundary_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a layer into what it must not use; the rules are a handful of literals."""
    return views.edges(spark, sf_dir).filter((F.col("src") < 10) & (F.col("dst") >= 20)).orderBy("src", "dst").limit(100).select("src", "dst", F.concat(F.lit("forbidden "), F.col("dst").cast("string")).alias("message"))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) ORDER BY 1 LIMIT 200")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = views.table(spark, sf_dir, "lineitem").select("l_orderkey")
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(used, F.col("id") == F.col("l_orderkey"), "left_anti").orderBy("id").limit(200)


@query("SELECT dst AS node, count(*) AS callers, list_sort(list(src)) AS impact FROM edges GROUP BY dst", "edges")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real referrers of a node."""
    return views.edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("callers"), F.sort_array(F.collect_list("src")).alias("impact"))


@query("SELECT region, members, CAST(CASE WHEN linked > 0 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence FROM (SELECT n_regionkey AS region, count(DISTINCT n_nationkey) AS members, count(src) AS linked FROM nation LEFT JOIN edges ON src = n_nationkey GROUP BY 1) ORDER BY members DESC, region LIMIT 12", "edges")
def community_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    linked = n.join(views.edges(spark, sf_dir), F.col("n_nationkey") == F.col("src"), "left").groupBy("region").agg(F.countDistinct("n_nationkey").alias("members"), F.count("src").alias("linked"))
    return linked.select("region", "members", F.when(F.col("linked") > 0, 0.6).otherwise(0.3).alias("confidence")).orderBy(F.desc("members"), "region").limit(12)


@query("""SELECT 'language' AS kind, language AS name, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'layer', split_part(path, '/', 1), count(*) FROM files GROUP BY 2 UNION ALL (SELECT 'hotspot', path, line_count FROM files ORDER BY line_count DESC, path LIMIT 10)""", "files")
def architecture_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    a = f.groupBy(F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("language").alias("kind"), "name", "n")
    b = f.groupBy(F.split("path", "/")[0].alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("layer").alias("kind"), "name", "n")
    c = f.orderBy(F.desc("line_count"), "path").limit(10).select(F.lit("hotspot").alias("kind"), F.col("path").alias("name"), F.col("line_count").alias("n"))
    return a.unionByName(b).unionByName(c)
