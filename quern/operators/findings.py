"""Findings: keys, life cycle, priorities, plans, calibration, precision, trend and the ratchet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import certainty, confidence_tier, effort, risk_level, stable_key
from quern.operators.quantiles import exclusive_quartiles
from quern.plans import views
from quern.registry import query

#: Ranks, weights and bounds of the analytics.
SEVERITY_RANK = {"error": 2, "warning": 1, "info": 0}
SEVERITY_WEIGHT = {"error": 3.0, "warning": 3.0, "info": 1.0}
SEVERITY_SCORE = {"error": 0.9, "warning": 0.7, "info": 0.3}
STATUS_RANK = {"regressed": 0, "needs_review": 1, "open": 2, "in_progress": 3}
MIN_SAMPLES, MAX_SHIFT, FLOOR = 8, 0.2, 0.3
#: Effort of a cluster's first finding by rule, what each more adds, and the rules that are mended together.
BASE_EFFORT = {
    "python.dead_code_candidate": 1.0,
    "python.duplicate_literal": 1.0,
    "python.todo_cluster": 2.0,
    "python.suspicious_slop_candidate": 2.0,
    "python.missing_nearby_test": 3.0,
    "python.changed_source_without_related_test": 3.0,
    "python.too_many_imports": 3.0,
    "python.deep_nesting": 5.0,
    "python.large_function": 5.0,
    "python.structural_near_duplicate": 5.0,
    "python.relative_large_function": 4.0,
    "python.relative_large_file": 6.0,
    "python.relative_large_class": 6.0,
    "python.large_file": 8.0,
    "python.large_class": 8.0,
    "python.mixed_responsibilities": 8.0,
}
DEFAULT_EFFORT, TOGETHER, APART = 3.0, 0.2, 0.8
CLUSTERABLE = (
    "python.dead_code_candidate",
    "python.duplicate_literal",
    "python.todo_cluster",
    "python.suspicious_slop_candidate",
    "python.missing_nearby_test",
    "python.changed_source_without_related_test",
    "python.too_many_imports",
)
#: Rules that count last among findings, and sizes that tell little of a test.
RULE_RANK = {"python.changed_source_without_related_test": 9, "python.missing_nearby_test": 8}
STRUCTURAL = (
    "large_file large_class large_function relative_large_file relative_large_class relative_large_function "
    "deep_nesting mixed_responsibilities structural_near_duplicate"
).split()
OPEN_LIKE = ("open", "in_progress", "needs_review", "regressed")


def mapped(column: Column, values: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column), F.lit(default))


def reconcile(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """stable_key, before, after, event after a scan.

    stored: (stable_key, status); seen: (stable_key, suppressed). New ones open;
    suppression wins; what was suppressed and no longer is opens; resolved ones
    that are seen regress; open ones that are no longer seen resolve; all else
    stays.
    """
    s = stored.select(F.col("stable_key").alias("_k"), F.col("status").alias("before"))
    j = s.join(seen.select("stable_key", "suppressed"), F.col("_k") == F.col("stable_key"), "full_outer")
    here, known = F.col("stable_key").isNotNull(), F.col("_k").isNotNull()
    after = (
        F.when(here & F.col("suppressed"), "suppressed")
        .when(here & ~known, "open")
        .when(here & (F.col("before") == "suppressed"), "open")
        .when(here & (F.col("before") == "resolved"), "regressed")
        .when(~here & F.col("before").isin(*OPEN_LIKE), "resolved")
        .otherwise(F.col("before"))
    )
    out = j.select(F.coalesce("stable_key", "_k").alias("stable_key"), "before", after.alias("after"))
    return out.withColumn("event", F.when(F.col("before").isNull(), "created").when(F.col("before") != F.col("after"), F.col("after")))


def outliers(values: DataFrame, group: list[str], value: str, absolute: float, least: int = 12) -> DataFrame:
    """Rows with cutoff <= value < absolute, for the cutoff Q3 + 1.5 IQR of groups of `least` rows and a positive IQR."""
    q = exclusive_quartiles(values, group, value).filter((F.col("n") >= least) & (F.col("q3") > F.col("q1")))
    q = q.select(*[F.col(g).alias(f"_{g}") for g in group], (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("cutoff"))
    on = None
    for g in group:
        on = (F.col(g) == F.col(f"_{g}")) if on is None else on & (F.col(g) == F.col(f"_{g}"))
    return values.join(F.broadcast(q), on).filter((F.col(value) >= F.col("cutoff")) & (F.col(value) < absolute)).drop(*[f"_{g}" for g in group])


def calibrated(base: Column, rate: Column, n: Column) -> Column:
    """A confidence moved by how often the rule was right, in bounds, and only with enough samples."""
    return F.when(n >= MIN_SAMPLES, F.least(F.greatest(base + MAX_SHIFT * (2 * rate - 1), F.lit(FLOOR)), F.lit(1.0))).otherwise(base)


def verdict_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "resolved").alias("accepted"), F.count_if(F.col("status").isin("wontfix", "ignored")).alias("dismissed"))


def effort_units(rule: Column, n: Column) -> Column:
    """What mending n findings of a rule in one place costs."""
    return mapped(rule, BASE_EFFORT, DEFAULT_EFFORT) * (1.0 + (n - 1) * F.when(rule.isin(*CLUSTERABLE), TOGETHER).otherwise(APART))


def priority(path: Column, rule: Column, severity: Column, churn: Column, lines: Column) -> list[Column]:
    """Sort keys before the id: sizes of test files last, then severity (errors like warnings), rules that tell of missing tests last, much changed long ones first."""
    in_tests = (path.startswith("tests/") | path.contains("/test_")) & F.element_at(F.split(rule, r"\."), -1).isin(*STRUCTURAL)
    hot = F.when(churn > 0, churn * F.greatest(lines, F.lit(0))).otherwise(0)
    return [in_tests.cast("int"), mapped(severity, {"warning": 0, "error": 0, "info": 1}, 2), mapped(rule, RULE_RANK, 0), -hot]


def running_verdicts(changes: DataFrame, points: int = 90) -> DataFrame:
    """day, accepted, dismissed: standing verdicts at the end of each day with a change, the last `points` such days.

    changes: (finding, at, status). A finding's verdict is its last status, if
    accepting or dismissing; repeats of a verdict are no change.
    """
    verdict = F.when(F.col("status") == "resolved", "accepted").when(F.col("status").isin("wontfix", "false_positive"), "dismissed")
    w = Window.partitionBy("finding").orderBy("at", "status")
    moved = changes.withColumn("verdict", verdict).withColumn("old", F.lag("verdict").over(w)).filter(~F.col("verdict").eqNullSafe(F.col("old")))
    step = lambda v: (F.coalesce((F.col("verdict") == v).cast("int"), F.lit(0)) - F.coalesce((F.col("old") == v).cast("int"), F.lit(0)))
    # Days are few: the running sum is over one row a day.
    daily = moved.groupBy(F.to_date("at").alias("day")).agg(F.sum(step("accepted")).alias("a"), F.sum(step("dismissed")).alias("d"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    trend = daily.select("day", F.sum("a").over(run).alias("accepted"), F.sum("d").over(run).alias("dismissed"))
    return trend.orderBy(F.desc("day")).limit(points)


_KEY = "rule_id || ':' || substr(sha256(concat_ws('|', rule_id, file_path, scope, '')), 1, 12)"


@query(f"SELECT id, {_KEY} AS stable_key FROM findings", "findings")
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.findings(spark, sf_dir).select("id", stable_key(F.col("rule_id"), F.col("file_path"), F.col("scope")).alias("stable_key"))


@query("SELECT rule, symbol, CASE WHEN (starts_with(rule, 'python.') OR starts_with(rule, 'architecture.')) AND symbol <> '' THEN 'verified' ELSE 'heuristic' END AS tier FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'python.' WHEN 'N' THEN 'go.' ELSE 'architecture.' END || l_linestatus AS rule, CASE WHEN l_linenumber > 2 THEN 's' || l_linenumber ELSE '' END AS symbol FROM lineitem)")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem")
    rule = F.concat(F.when(F.col("l_returnflag") == "A", "python.").when(F.col("l_returnflag") == "N", "go.").otherwise("architecture."), F.col("l_linestatus"))
    symbol = F.when(F.col("l_linenumber") > 2, F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))).otherwise("")
    return li.select(rule.alias("rule"), symbol.alias("symbol")).withColumn("tier", confidence_tier(F.col("rule"), F.col("symbol")))


@query("SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 20", "findings")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.findings(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(20)


@query("SELECT severity, status, count(*) AS n FROM findings GROUP BY ALL", "findings")
def smell_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.findings(spark, sf_dir).groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))


_LIFE = """stored AS (SELECT {key} AS stable_key, CASE id % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' WHEN 2 THEN 'wontfix' WHEN 3 THEN 'suppressed' WHEN 4 THEN 'regressed' ELSE 'needs_review' END AS status FROM findings WHERE id % 5 <> 0),
seen AS (SELECT {key} AS stable_key, id % 17 = 0 AS suppressed FROM findings WHERE id % 3 <> 0)"""
_ID_KEY = "rule_id || ':' || substr(sha256(concat_ws('|', rule_id, file_path, CAST(id AS VARCHAR), '')), 1, 12)"


@query(f""", {_LIFE.format(key=_ID_KEY)}, j AS (SELECT coalesce(n.stable_key, s.stable_key) AS stable_key, s.status AS before, n.stable_key IS NOT NULL AS here, s.stable_key IS NOT NULL AS known, n.suppressed FROM stored s FULL JOIN seen n ON s.stable_key = n.stable_key),
a AS (SELECT *, CASE WHEN here AND suppressed THEN 'suppressed' WHEN here AND NOT known THEN 'open' WHEN here AND before = 'suppressed' THEN 'open' WHEN here AND before = 'resolved' THEN 'regressed' WHEN NOT here AND before IN ('open', 'in_progress', 'needs_review', 'regressed') THEN 'resolved' ELSE before END AS after FROM j)
SELECT stable_key, before, after, CASE WHEN before IS NULL THEN 'created' WHEN before <> after THEN after END AS event FROM a""", "findings")
def lifecycle_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir).withColumn("stable_key", stable_key(F.col("rule_id"), F.col("file_path"), F.col("id").cast("string")))
    status = mapped((F.col("id") % 6).cast("string"), {"0": "resolved", "1": "open", "2": "wontfix", "3": "suppressed", "4": "regressed"}, "needs_review")
    return reconcile(f.filter("id % 5 <> 0").select("stable_key", status.alias("status")), f.filter("id % 3 <> 0").select("stable_key", (F.col("id") % 17 == 0).alias("suppressed")))


def suppressed_by(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """findings (id, path, line, rule_id) with a directive (path, line, rules) at their line or the one above; the same line first."""
    d = directives.select(F.col("path").alias("_p"), F.col("line").alias("_l"), "rules")
    at = findings.withColumn("_at", F.explode(F.array(F.col("line"), F.col("line") - 1)))
    j = at.join(d, (F.col("path") == F.col("_p")) & (F.col("_at") == F.col("_l")) & (F.array_contains("rules", "*") | F.array_contains(F.col("rules"), F.col("rule_id"))))
    return j.groupBy("id").agg(F.max("_at").alias("directive_line"))


@query("""SELECT f.id, max(d.line) AS directive_line FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS path, CAST(l_quantity AS BIGINT) AS line, l_returnflag AS rule_id FROM lineitem) f
JOIN (SELECT l_partkey AS path, CAST(l_quantity AS BIGINT) AS line, CASE WHEN l_linenumber = 1 THEN '*' ELSE l_returnflag END AS rule FROM lineitem WHERE l_orderkey % 10 = 0) d ON f.path = d.path AND (d.line = f.line OR d.line = f.line - 1) AND (d.rule = '*' OR d.rule = f.rule_id) GROUP BY f.id""")
def suppression_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem")
    f = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("line"), F.col("l_returnflag").alias("rule_id"))
    d = li.filter("l_orderkey % 10 = 0").select(F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("line"), F.array(F.when(F.col("l_linenumber") == 1, "*").otherwise(F.col("l_returnflag"))).alias("rules"))
    return suppressed_by(f, d)


@query("SELECT id, CASE WHEN status = 'resolved' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R') THEN 'needs_review' ELSE status END AS status FROM findings", "findings")
def gated_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved without a passing run is only to be reviewed."""
    passed = views.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("_r")).distinct()
    j = views.findings(spark, sf_dir).join(passed, F.col("id") == F.col("_r"), "left")
    return j.select("id", F.when((F.col("status") == "resolved") & F.col("_r").isNull(), "needs_review").otherwise(F.col("status")).alias("status"))


def gated(findings: DataFrame, least: str = "warning", tier: Column | None = None) -> DataFrame:
    """findings with `shown`: severe enough or of the verified tier; all of them where none is."""
    headline = mapped(F.col("severity"), SEVERITY_RANK, 0) >= SEVERITY_RANK.get(least, 1)
    headline = headline | (tier == "verified") if tier is not None else headline
    marked = findings.withColumn("_headline", F.coalesce(headline, F.lit(False)))
    some = marked.agg(F.coalesce(F.bool_or("_headline"), F.lit(False)).alias("_some"))
    return marked.crossJoin(F.broadcast(some)).withColumn("shown", F.col("_headline") | ~F.col("_some")).drop("_headline", "_some")  # _some is one row


@query("""SELECT id, severity, headline OR NOT any_headline AS shown FROM (SELECT id, severity, h AS headline, bool_or(h) OVER () AS any_headline FROM (SELECT id, severity, severity IN ('warning', 'error') OR confidence >= 0.9 AS h FROM findings WHERE status = 'open'))""", "findings")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline findings; all that are open if there are none. The tables tell no tier: the surest count as verified."""
    opened = views.findings(spark, sf_dir).filter("status = 'open'")
    return gated(opened, "warning", F.when(F.col("confidence") >= 0.9, "verified").otherwise("heuristic")).select("id", "severity", "shown")


#: Open findings with what the priority reads; rules and test paths, which the tables lack, are dealt by id.
_RANKED = """, ch AS (SELECT l_orderkey, count(*) AS churn, CAST(max(l_quantity) AS BIGINT) AS lines FROM lineitem GROUP BY 1),
f AS (SELECT id, confidence, CASE id % 5 WHEN 0 THEN 'python.missing_nearby_test' WHEN 1 THEN 'python.changed_source_without_related_test' WHEN 2 THEN 'python.large_function' ELSE rule_id END AS rule, CASE WHEN id % 7 = 0 THEN 'tests/' || file_path ELSE file_path END AS path, severity, coalesce(churn * lines, 0) AS hot FROM findings LEFT JOIN ch ON l_orderkey = id WHERE status = 'open'),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(path, 'tests/') AND rule = 'python.large_function' THEN 1 ELSE 0 END, CASE severity WHEN 'warning' THEN 0 WHEN 'error' THEN 0 WHEN 'info' THEN 1 ELSE 2 END, CASE rule WHEN 'python.changed_source_without_related_test' THEN 9 WHEN 'python.missing_nearby_test' THEN 8 ELSE 0 END, hot DESC, id) AS BIGINT) AS place FROM f)
"""


def prioritised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Open findings with the keys of their priority, and the names of the keys in order."""
    li = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_o"))
    churn = li.agg(F.count(F.lit(1)).alias("churn"), F.max("l_quantity").cast("long").alias("lines"))
    rule = mapped((F.col("id") % 5).cast("string"), {"0": "python.missing_nearby_test", "1": "python.changed_source_without_related_test", "2": "python.large_function"}, None)
    path = F.when(F.col("id") % 7 == 0, F.concat(F.lit("tests/"), "file_path")).otherwise(F.col("file_path"))
    f = views.findings(spark, sf_dir).filter("status = 'open'").join(churn, F.col("id") == F.col("_o"), "left")
    f = f.select("id", "confidence", F.coalesce(rule, "rule_id").alias("rule"), path.alias("path"), "severity", F.coalesce("churn", F.lit(0)).alias("churn"), F.coalesce("lines", F.lit(0)).alias("lines"))
    keys = [*priority(*(F.col(c) for c in ("path", "rule", "severity", "churn", "lines"))), F.col("id")]
    order = [f"_k{i}" for i in range(len(keys))]
    return f.select("id", "severity", "confidence", "rule", *[k.alias(n) for k, n in zip(keys, order, strict=True)]), order


@query(f"{_RANKED}SELECT id, severity, confidence, rule FROM ranked WHERE place = 1", "findings")
def next_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first by the five keys of the priority."""
    f, order = prioritised(spark, sf_dir)
    return f.orderBy(*order).limit(1).select("id", "severity", "confidence", "rule")


@query(f"{_RANKED}SELECT id, place FROM ranked ORDER BY place LIMIT 100", "findings")
def finding_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of open findings."""
    f, order = prioritised(spark, sf_dir)
    return f.orderBy(*order).limit(100).select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


_NOISE = "noise AS (SELECT rule_id AS nr, CASE WHEN total >= 8 THEN round(least(greatest(1 - 0.2 * (n / total), 0.3), 1.0), 3) ELSE 1.0 END AS w FROM (SELECT rule_id, count(*) AS n, sum(count(*)) OVER () AS total FROM findings GROUP BY rule_id))"


@query(f", {_NOISE} SELECT id, round(confidence * w, 6) AS weight FROM findings JOIN noise ON rule_id = nr WHERE status <> 'resolved' ORDER BY CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, round(confidence * w, 6) DESC, id LIMIT 100", "findings")
def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir)
    w = noise_weights(f).select(F.col("rule_id").alias("_r"), F.col("weight").alias("_w"))
    j = f.filter("status <> 'resolved'").join(F.broadcast(w), F.col("rule_id") == F.col("_r")).withColumn("weight", F.round(F.col("confidence") * F.col("_w"), 6))
    return j.orderBy(mapped(F.col("severity"), SEVERITY_RANK, 0).desc(), F.desc("weight"), "id").limit(100).select("id", "weight")


def noise_weights(f: DataFrame) -> DataFrame:
    """rule_id, n, weight: rules that make up much of all findings weigh less. One row a rule."""
    n = f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("total")
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("rule_id", "n", F.when(F.col("total") >= MIN_SAMPLES, F.round(F.least(F.greatest(1 - MAX_SHIFT * share, F.lit(FLOOR)), F.lit(1.0)), 3)).otherwise(1.0).alias("weight"))


@query(f", {_NOISE} SELECT nr AS rule_id, w AS weight FROM noise", "findings")
def noise_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_weights(views.findings(spark, sf_dir)).select("rule_id", "weight")


_RULED = "CASE id % 4 WHEN 0 THEN 'python.large_file' WHEN 1 THEN 'python.todo_cluster' WHEN 2 THEN 'python.deep_nesting' ELSE rule_id END"


@query(f"""SELECT rule_id, scope, n, gain, worst, round(u, 6) AS effort_units, round(gain / u, 6) AS roi, CASE WHEN u <= 4 THEN 'S' WHEN u <= 12 THEN 'M' ELSE 'L' END AS effort
FROM (SELECT *, CAST(CASE rule_id WHEN 'python.large_file' THEN 8.0 WHEN 'python.todo_cluster' THEN 2.0 WHEN 'python.deep_nesting' THEN 5.0 ELSE 3.0 END AS DOUBLE) * (1.0 + (n - 1) * CAST(CASE rule_id WHEN 'python.todo_cluster' THEN 0.2 ELSE 0.8 END AS DOUBLE)) AS u
FROM (SELECT {_RULED} AS rule_id, scope, count(*) AS n, round(sum(CASE severity WHEN 'error' THEN 3.0 WHEN 'warning' THEN 3.0 ELSE 1.0 END * confidence), 2) AS gain, arg_max(severity, CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst FROM findings WHERE status = 'open' GROUP BY ALL))""", "findings")
def improvement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of rule and scope by gain for effort; rules, of which the tables have none by name, are dealt by id."""
    rule = mapped((F.col("id") % 4).cast("string"), {"0": "python.large_file", "1": "python.todo_cluster", "2": "python.deep_nesting"}, None)
    f = views.findings(spark, sf_dir).filter("status = 'open'").withColumn("rule_id", F.coalesce(rule, "rule_id"))
    gain = F.round(F.sum(mapped(F.col("severity"), SEVERITY_WEIGHT, 1.0) * F.col("confidence")), 2)
    g = f.groupBy("rule_id", "scope").agg(F.count(F.lit(1)).alias("n"), gain.alias("gain"), F.max_by("severity", mapped(F.col("severity"), SEVERITY_RANK, 0)).alias("worst"))
    units = effort_units(F.col("rule_id"), F.col("n"))
    return g.select("rule_id", "scope", "n", "gain", "worst", F.round(units, 6).alias("effort_units"), F.round(F.col("gain") / units, 6).alias("roi"), effort(units).alias("effort"))


@query("""SELECT rule_id, total, accepted, dismissed, round(accepted / nullif(accepted + dismissed, 0), 6) AS accept_rate, round(CASE WHEN accepted + dismissed >= 8 THEN least(greatest(0.7 + 0.2 * (2 * (accepted / nullif(accepted + dismissed, 0)) - 1), 0.3), 1.0) ELSE 0.7 END, 6) AS confidence
FROM (SELECT rule_id, count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS accepted, count(*) FILTER (WHERE status = 'wontfix') AS dismissed FROM findings GROUP BY rule_id)""", "findings")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdict_counts(views.findings(spark, sf_dir))
    n = F.col("accepted") + F.col("dismissed")
    rate = F.try_divide(F.col("accepted"), n)
    return v.select("rule_id", "total", "accepted", "dismissed", F.round(rate, 6).alias("accept_rate"), F.round(calibrated(F.lit(0.7), rate, n), 6).alias("confidence"))


@query("SELECT rule_id, scope, count(*) AS dismissals FROM findings WHERE status = 'wontfix' GROUP BY ALL HAVING count(*) >= 5", "findings")
def suppression_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.findings(spark, sf_dir).filter("status = 'wontfix'").groupBy("rule_id", "scope").agg(F.count(F.lit(1)).alias("dismissals")).filter("dismissals >= 5")


@query("SELECT coalesce(rule_id, '*') AS rule_id, count(*) FILTER (WHERE status = 'resolved') AS accepted, count(*) FILTER (WHERE status = 'wontfix') AS dismissed, round(count(*) FILTER (WHERE status = 'resolved') / nullif(count(*) FILTER (WHERE status IN ('resolved', 'wontfix')), 0), 6) AS precision FROM findings GROUP BY ROLLUP (rule_id)", "findings")
def precision_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir)
    g = f.rollup("rule_id").agg(F.count_if(F.col("status") == "resolved").alias("accepted"), F.count_if(F.col("status") == "wontfix").alias("dismissed"))
    return g.select(F.coalesce("rule_id", F.lit("*")).alias("rule_id"), "accepted", "dismissed", F.round(F.try_divide(F.col("accepted"), F.col("accepted") + F.col("dismissed")), 6).alias("precision"))


@query(""", changes AS (SELECT session_id AS finding, ts AS at_, CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'wontfix' ELSE 'open' END AS status, event_id FROM ev),
v AS (SELECT *, CASE status WHEN 'resolved' THEN 'accepted' WHEN 'wontfix' THEN 'dismissed' END AS verdict FROM changes), l AS (SELECT *, lag(verdict) OVER (PARTITION BY finding ORDER BY at_, status) AS old FROM v),
d AS (SELECT CAST(at_ AS DATE) AS day, sum(coalesce(CAST(verdict = 'accepted' AS INT), 0) - coalesce(CAST(old = 'accepted' AS INT), 0)) AS a, sum(coalesce(CAST(verdict = 'dismissed' AS INT), 0) - coalesce(CAST(old = 'dismissed' AS INT), 0)) AS d FROM l WHERE verdict IS DISTINCT FROM old GROUP BY 1)
SELECT day, CAST(sum(a) OVER (ORDER BY day) AS BIGINT) AS accepted, CAST(sum(d) OVER (ORDER BY day) AS BIGINT) AS dismissed FROM d ORDER BY day DESC LIMIT 90""", "events")
def health_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type") == "error", "wontfix").otherwise("open")
    return running_verdicts(views.events(spark, sf_dir).select(F.col("session_id").alias("finding"), F.col("ts").alias("at"), status.alias("status")))


@query(""", flags AS (SELECT doc_id, CASE WHEN line_count >= 10 THEN 'long' ELSE 'short' END AS rule FROM files WHERE size_bytes > 500)
SELECT rule, count(*) FILTER (WHERE quality = 0) AS tp, count(*) FILTER (WHERE quality = 1) AS fp, count(*) FILTER (WHERE quality IS NULL) AS unlabeled, round(coalesce(count(*) FILTER (WHERE quality = 0) / nullif(count(*) FILTER (WHERE quality IS NOT NULL), 0), 1.0), 6) AS precision FROM flags LEFT JOIN labels USING (doc_id) GROUP BY rule""", "files")
def label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = views.files(spark, sf_dir).filter("size_bytes > 500").select("doc_id", F.when(F.col("line_count") >= 10, "long").otherwise("short").alias("rule"))
    j = flags.join(views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "quality"), F.col("doc_id") == F.col("_d"), "left")
    tp, fp = F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)
    return j.groupBy("rule").agg(tp.alias("tp"), fp.alias("fp"), F.count_if(F.col("quality").isNull()).alias("unlabeled"), F.round(F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), 6).alias("precision"))


@query("SELECT count(*) AS missed FROM labels l WHERE quality = 0 AND NOT EXISTS (SELECT 1 FROM files f WHERE f.doc_id = l.doc_id AND f.size_bytes > 500)", "files")
def missed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = views.files(spark, sf_dir).filter("size_bytes > 500").select("doc_id")
    return views.table(spark, sf_dir, "labels").filter("quality = 0").join(flagged, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missed"))


@query(f""", cur AS (SELECT {_ID_KEY} AS k, severity FROM findings WHERE id % 4 <> 0), base AS (SELECT {_ID_KEY} AS k, severity FROM findings WHERE id % 6 <> 1)
SELECT n.new, r.resolved, n.new - r.resolved AS net_delta, n.blocking FROM (SELECT count(*) AS new, count(*) FILTER (WHERE severity = 'error') AS blocking FROM cur WHERE k NOT IN (SELECT k FROM base)) n, (SELECT count(*) AS resolved FROM base WHERE k NOT IN (SELECT k FROM cur)) r""", "findings")
def ci_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir).select("id", "severity", stable_key(F.col("rule_id"), F.col("file_path"), F.col("id").cast("string")).alias("k"))
    cur, base = f.filter("id % 4 <> 0"), f.filter("id % 6 <> 1")
    new = cur.join(base, "k", "left_anti").agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("severity") == "error").alias("blocking"))
    gone = base.join(cur, "k", "left_anti").agg(F.count(F.lit(1)).alias("resolved"))
    return new.crossJoin(gone).select("new", "resolved", (F.col("new") - F.col("resolved")).alias("net_delta"), "blocking")  # one row each


@query("""SELECT file_path, list_sort(list(DISTINCT flag)) AS flags, count(*) AS findings FROM (SELECT file_path, CASE WHEN severity = 'error' THEN 'hotspot' WHEN confidence > 0.5 THEN 'complex' ELSE 'minor' END AS flag FROM findings WHERE status = 'open') GROUP BY file_path""", "findings")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("severity") == "error", "hotspot").when(F.col("confidence") > 0.5, "complex").otherwise("minor")
    return views.findings(spark, sf_dir).filter("status = 'open'").groupBy("file_path").agg(F.sort_array(F.collect_set(flag)).alias("flags"), F.count(F.lit(1)).alias("findings"))


@query("""SELECT file_path, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, certainty FROM (SELECT file_path, round(greatest(max(CASE severity WHEN 'error' THEN 0.9 WHEN 'warning' THEN 0.7 WHEN 'info' THEN 0.3 ELSE 0.2 END), max(confidence), least(avg(confidence), 0.95)), 6)::DOUBLE AS score,
CASE WHEN max(confidence) >= 0.85 THEN 'high' WHEN max(confidence) >= 0.6 THEN 'medium' ELSE 'low' END AS certainty FROM findings WHERE status <> 'resolved' GROUP BY file_path)""", "findings")
def diff_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.findings(spark, sf_dir).filter("status <> 'resolved'")
    g = f.groupBy("file_path").agg(F.round(F.greatest(F.max(mapped(F.col("severity"), SEVERITY_SCORE, 0.2)), F.max("confidence"), F.least(F.avg("confidence"), F.lit(0.95))), 6).alias("score"), F.max("confidence").alias("c"))
    return g.select("file_path", "score", risk_level(F.col("score")).alias("level"), certainty(F.col("c")).alias("certainty"))


@query(""", q AS (SELECT language, n, (x[j1] * (4 - d1) + x[j1 + 1] * d1) / 4.0 AS q1, (x[j3] * (4 - d3) + x[j3 + 1] * d3) / 4.0 AS q3 FROM (SELECT *, (n + 1) - 4 * j1 AS d1, 3 * (n + 1) - 4 * j3 AS d3 FROM (SELECT language, list_sort(list(line_count)) AS x, count(*) AS n, CAST(greatest(1, least(count(*) - 1, floor((count(*) + 1) / 4))) AS BIGINT) AS j1, CAST(greatest(1, least(count(*) - 1, floor(3 * (count(*) + 1) / 4))) AS BIGINT) AS j3 FROM files GROUP BY language)))
SELECT path, line_count, CAST(q3 + 1.5 * (q3 - q1) AS DOUBLE) AS cutoff FROM files JOIN q USING (language) WHERE n >= 12 AND q3 > q1 AND line_count >= q3 + 1.5 * (q3 - q1) AND line_count < 300""", "files")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(views.files(spark, sf_dir).select("path", "language", "line_count"), ["language"], "line_count", 300).select("path", "line_count", "cutoff")


_UNC = "unc AS (SELECT path, CAST(unnest(range(1, line_count + 1, 3)) AS INTEGER) AS line FROM files)"


@query(f", {_UNC} SELECT s.path, s.name, s.start_line, count(*) AS uncovered FROM symbols s JOIN unc u ON s.path = u.path AND u.line BETWEEN s.start_line AND s.end_line WHERE s.kind = 'function' GROUP BY ALL ORDER BY uncovered DESC, s.path, s.start_line LIMIT 200", "symbols")
def uncovered_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    unc = views.files(spark, sf_dir).filter("line_count > 0").select(F.col("path").alias("_p"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("line_count"), F.lit(3).cast("long"))).alias("line"))
    s = views.symbols(spark, sf_dir).filter("kind = 'function'")
    j = s.join(unc, (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return j.groupBy("path", "name", "start_line").agg(F.count(F.lit(1)).alias("uncovered")).orderBy(F.desc("uncovered"), "path", "start_line").limit(200)


_DUP = ", dup AS (SELECT path, text AS literal, count(*) AS n FROM lines WHERE length(text) >= 8 GROUP BY ALL HAVING count(*) >= 4)"


@query(f"{_DUP} SELECT path, n, 'python.duplicate_literal:' || substr(sha256(concat_ws('|', 'python.duplicate_literal', path, '', literal)), 1, 12) AS stable_key FROM dup", "lines")
def duplicate_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.lines(spark, sf_dir).filter(F.length("text") >= 8).groupBy("path", F.col("text").alias("literal")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    return d.select("path", "n", stable_key(F.lit("python.duplicate_literal"), F.col("path"), F.lit(""), F.col("literal")).alias("stable_key"))


_FP = "sha256(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '\\s+', ' ', 'g'))"


@query(f", fp AS (SELECT path, substr({_FP}, 1, 16) AS fingerprint FROM files WHERE size_bytes >= 200), c AS (SELECT fingerprint, count(*) AS members FROM fp GROUP BY 1 HAVING count(*) >= 2) SELECT fingerprint, members, list_sort(list(path))[1:8] AS locations FROM fp JOIN c USING (fingerprint) GROUP BY ALL", "files")
def near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal texts but for digits and white space; the first eight places of each."""
    norm = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "0"), r"\s+", " ")
    fp = views.files(spark, sf_dir).filter("size_bytes >= 200").select("path", F.substring(F.sha2(norm, 256), 1, 16).alias("fingerprint"))
    n = fp.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2").withColumnRenamed("fingerprint", "_f")
    first = fp.join(n, F.col("fingerprint") == F.col("_f")).withColumn("r", F.row_number().over(Window.partitionBy("fingerprint").orderBy("path"))).filter("r <= 8")
    return first.groupBy("fingerprint", "members").agg(F.sort_array(F.collect_list("path")).alias("locations"))
