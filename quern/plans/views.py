"""The code-and-corpus model as views over the driver's parquet tables, in Spark and as SQL for the oracle.

Each view is defined once here in either language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INNER_SPAN = 5
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_count(text: Column) -> Column:
    """Newlines, and one more without a trailing newline; 0 for nothing."""
    n = F.regexp_count(text, F.lit("\n")).cast("long")
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).when(text.endswith("\n"), n).otherwise(n + 1)


def doc_path() -> Column:
    return F.concat(F.when(F.col("doc_id") % 10 == 0, "tests/").otherwise(""), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id"), doc_path().alias("path"), F.col("lang").alias("language"), F.sha2("text", 256).alias("hash"),
        F.octet_length("text").cast("long").alias("size_bytes"), line_count(F.col("text")).alias("line_count"), (F.col("doc_id") % 10 == 0).alias("is_test"), F.col("text"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(doc_path().alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("path", (F.col("p") + 1).cast("int").alias("line_no"), "text")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outer span over each document and inner spans of INNER_SPAN lines."""
    f = files(spark, sf_dir).select("path", "doc_id", "line_count")
    outer = f.select("path", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.lit("module").alias("kind"), F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.col("line_count")).cast("int").alias("end_line"))
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("line_count")), F.lit(INNER_SPAN).cast("long")))
    inner = f.select("path", "line_count", starts.alias("s")).select("path", F.concat(F.lit("block_"), F.col("s").cast("string")).alias("name"), F.lit("function").alias("kind"), F.col("s").cast("int").alias("start_line"), F.least(F.col("s") + INNER_SPAN - 1, F.greatest(F.lit(1).cast("long"), F.col("line_count"))).cast("int").alias("end_line"))
    return outer.unionByName(inner)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))


def commit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path")).distinct()


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and present files: some are new, some have another hash."""
    f = files(spark, sf_dir).select("doc_id", "path", "hash")
    old = f.filter(F.col("doc_id") % 7 != 0).select("path", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.col("hash"), 256)).otherwise(F.col("hash")).alias("hash"))
    gone = f.filter(F.col("doc_id") % 13 == 0).select(F.concat(F.lit("gone/"), F.col("path")).alias("path"), "hash")
    return old.unionByName(gone), f.select("path", "hash")


def edges(spark: SparkSession, sf_dir: str, keep: int = 2) -> DataFrame:
    """Supplier nation to customer nation, the `keep` heaviest of each source, ties by key."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    weighed = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return weighed.withColumn("r", rank).filter(F.col("r") <= keep).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "w")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("call_text"), F.col("p_brand").alias("path"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("caller"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("path", "caller", "call_text", F.col("l_orderkey").alias("site"), F.col("l_linenumber").cast("int").alias("line"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("scope"), F.col("c_name").alias("file_path"))
    priority = F.substring("o_orderpriority", 1, 1)
    severity = F.when(priority == "1", "error").when(priority.isin("2", "3"), "warning").otherwise("info")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("wontfix")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("rule_id"), "scope", "file_path", severity.alias("severity"),
        F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0), 6).alias("confidence"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts"), F.col("user_id").alias("session_id"), "event_type", F.col("value").alias("tokens"), F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as Python files: a package for each brand, a module for each part; the smallest parts are tests."""
    p = table(spark, sf_dir, "part")
    package = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    test = F.col("p_size") <= 5
    name = F.concat(F.when(test, "test_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    rows = p.select("p_partkey", "p_size", test.alias("is_test"), F.concat(F.when(test, "tests/").otherwise("src/"), package, F.lit("/"), name, F.lit(".py")).alias("path"), F.concat(F.when(test, "tests.").otherwise(""), package, F.lit("."), name).alias("module"), F.lower("p_type").alias("symbol"))
    return rows.select("p_partkey", "path", "module", "is_test", "symbol", (F.col("p_size") > 45).alias("modified"))


def source_imports(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    """A file imports the module whose key a returned item of its part names as supplier; the few suppliers are hubs."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    hub = files.select(F.col("p_partkey").alias("_k"), "module")
    return li.join(hub, F.col("l_suppkey") == F.col("_k")).join(files.select("p_partkey", "path"), F.col("l_partkey") == F.col("p_partkey")).select("path", "module")


def source_history(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    # By commit first: rows that are dealt by it are distinct without another shuffle.
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), "l_partkey")
    c = li.join(commits(spark, sf_dir).select("commit_id", "ts"), "commit_id").distinct()
    return c.join(files.select("p_partkey", "path"), F.col("l_partkey") == F.col("p_partkey")).select("commit_id", "path", "ts")


def source_traces(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    """What the user did: changed files, files that queries of the last week showed, files opened at all."""
    e = events(spark, sf_dir).groupBy("k").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("seen"), F.count_if(F.col("event_type") == "click").alias("opened"))
    seen = files.join(e, F.col("p_partkey") == F.col("k"), "left")
    told = {"git_modified": F.col("modified"), "recent_query": F.col("seen") >= F.lit("2024-01-24").cast("timestamp"), "frecency": F.col("opened") > 0}
    return seen.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in told.items()]))).alias("reason"))


SQL = {
    "sources": """sources AS (SELECT p_partkey, p_size, lower(replace(p_brand, '#', '')) AS package, p_size <= 5 AS is_test, CASE WHEN p_size <= 5 THEN 'test_' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_partkey AS name, lower(p_type) AS symbol FROM part),
source_files AS (SELECT p_partkey, CASE WHEN is_test THEN 'tests/' ELSE 'src/' END || package || '/' || name || '.py' AS path, CASE WHEN is_test THEN 'tests.' ELSE '' END || package || '.' || name AS module, name AS tail, is_test, symbol, p_size > 45 AS modified FROM sources),
source_imports AS (SELECT DISTINCT f.path, h.module FROM lineitem JOIN source_files f ON f.p_partkey = l_partkey JOIN source_files h ON h.p_partkey = l_suppkey WHERE l_returnflag = 'R'),
source_history AS (SELECT DISTINCT l_orderkey AS commit_id, path, o_orderdate AS ts FROM lineitem JOIN source_files ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)""",
    "linked_sources": """traces AS (SELECT path, 'git_modified' AS reason FROM source_files WHERE modified UNION SELECT path, 'recent_query' FROM source_files JOIN ev ON k = p_partkey WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-24' UNION SELECT path, 'frecency' FROM source_files JOIN ev ON k = p_partkey WHERE event_type = 'click'),
latest AS (SELECT * FROM source_history QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, commit_id DESC) <= 400),
file_terms AS (SELECT DISTINCT path, unnest(list_filter(string_split_regex(lower(module || '.' || symbol), '[._]'), lambda t: length(t) >= 3)) AS term FROM source_files),
linked AS (SELECT t.path, c.path AS other, 'test_match' AS reason FROM source_files t JOIN source_files c ON c.is_test AND contains(c.path, t.tail) AND c.path <> t.path
 UNION SELECT t.path, c.path, 'test_match' FROM source_files t JOIN source_imports i USING (module) JOIN source_files c ON c.path = i.path AND c.is_test AND c.path <> t.path
 UNION SELECT i.path, c.path, 'import_graph' FROM source_imports i JOIN source_files c USING (module) WHERE i.path <> c.path
 UNION SELECT c.path, i.path, 'import_graph' FROM source_imports i JOIN source_files c USING (module) WHERE i.path <> c.path
 UNION SELECT a.path, b.path, 'git_history' FROM source_history a JOIN source_history b USING (commit_id) WHERE a.path <> b.path
 UNION SELECT path, other, 'co_change' FROM (SELECT a.path, b.path AS other, count(*) AS n FROM latest a JOIN source_history b USING (commit_id) WHERE a.path <> b.path GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, other) <= 10
 UNION SELECT a.path, b.path, 'directory_proximity' FROM source_files a JOIN source_files b ON a.path <> b.path AND regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '')
 UNION SELECT a.path, b.path, 'search_similarity' FROM file_terms a JOIN file_terms b USING (term) WHERE a.path <> b.path)""",
    "files": """files AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'tests/' ELSE '' END || source || '/' || lang || '/doc_' || doc_id AS path, lang AS language, sha256(text) AS hash,
 CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(CASE WHEN text = '' THEN 0 WHEN text LIKE '%' || chr(10) THEN length(text) - length(replace(text, chr(10), '')) ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS BIGINT) AS line_count,
 doc_id % 10 = 0 AS is_test, text FROM documents)""",
    "lines": """split_docs AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'tests/' ELSE '' END || source || '/' || lang || '/doc_' || doc_id AS path, string_split(text, chr(10)) AS s FROM documents),
lines AS (SELECT path, CAST(i AS INTEGER) AS line_no, s[i] AS text FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS i FROM split_docs))""",
    "symbols": f"""symbols AS (SELECT path, 'doc_' || doc_id AS name, 'module' AS kind, 1 AS start_line, CAST(greatest(1, line_count) AS INTEGER) AS end_line FROM files
 UNION ALL SELECT path, 'block_' || s, 'function', CAST(s AS INTEGER), CAST(least(s + {INNER_SPAN - 1}, greatest(1, line_count)) AS INTEGER) FROM (SELECT path, line_count, unnest(range(1, greatest(1, line_count) + 1, {INNER_SPAN})) AS s FROM files))""",
    "found_symbols": """found AS (SELECT CASE WHEN name = 'block_1' THEN 'exact' ELSE 'partial' END AS match_type, CASE WHEN starts_with(path, 'tests/') THEN 'reference' ELSE 'definition' END AS role, path,
 replace(path, '/', '.') AS module, kind, name, start_line AS line, round(7 / length(name), 6) AS score FROM symbols WHERE contains(name, 'block_1'))""",
    "commits": "commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts FROM orders)",
    "commit_paths": "commit_paths AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS path FROM lineitem)",
    "snapshots": """old_files AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256(hash) ELSE hash END AS hash FROM files WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || path, hash FROM files WHERE doc_id % 13 = 0),
new_files AS (SELECT path, hash FROM files)""",
    "edges": """weighed AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
edges AS (SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM weighed) WHERE r <= 2)""",
    "call_edges": "call_edges AS (SELECT p_brand AS path, s_name AS caller, p_name AS call_text, l_orderkey AS site, CAST(l_linenumber AS INTEGER) AS line FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)",
    "findings": """findings AS (SELECT o_orderkey AS id, o_orderpriority AS rule_id, c_mktsegment AS scope, c_name AS file_path,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'error' WHEN '2' THEN 'warning' WHEN '3' THEN 'warning' ELSE 'info' END AS severity, round(least(1.0, o_totalprice / 500000.0), 6) AS confidence,
 CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'wontfix' END AS status, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "events": "ev AS (SELECT event_id, ts, user_id AS session_id, event_type, value AS tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props FROM events)",
}
_NEEDS = {"linked_sources": ["sources", "events"], "symbols": ["files"], "snapshots": ["files"]}


def with_views(names: str, query: str) -> str:
    """query behind the named views and those that they read."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" + query if order else query
