"""Secrets in texts: candidate strings, and a random forest that removes false positives.

Everything that reads documents is DataFrame expressions on one row: candidates
come from a regular expression, features from the candidate, its path and the
words around it, and the fitted trees are CASE expressions. There is no shuffle.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.pii import in_front, with_pieces
from quern.llm.shared import local_rows

#: Runs of key characters, of MIN_LENGTH and more, with a letter and a digit among them, are candidates wherever they stand.
MIN_LENGTH = 12
_KEY = "[A-Za-z0-9+/_-]"
_RUN = rf"(?<!{_KEY})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_KEY}{{{MIN_LENGTH},}}+"
#: What stands where a password, a key or a token is set, of any characters, and the password of an address.
_KEYED = r"""(?<=(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\x20?[=:]\x20?["']?)[^\s"',;]{4,}+"""
_ADDRESS = r"(?<=://[^\s:@/]{1,40}:)[^\s@/]{3,}+(?=@)"
CANDIDATE = rf"{_KEYED}|{_ADDRESS}|{_RUN}"
_HINT = r"(?i)pass(?:w|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|://"
#: Characters before a candidate whose words count as its neighbours.
NEAR = 40
#: Bounds of the fit: labelled findings read, trees and their depth.
MAX_FINDINGS, TREES, DEPTH = 20_000, 15, 6
MARK = "[secret]"

#: Words that placeholders and names of things are made of.
DICTIONARY = (
    "example sample test dummy fake placeholder changeme default your here insert value string secret password passwd token "
    "access key api auth user admin root login client server service name data file path index page image version build release "
    "update config setting module class function method object model view controller handler manager factory table column row "
    "list array number count total date time year month week day hour minute second january february march april may june july "
    "august september october november december http https www com org net html json xml css the and for with from this that"
).split()
SECRET_WORDS = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credential|aws|key"
HASH_WORDS = r"sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|guid|etag|build|version|revision|isbn|serial|order|invoice|id|ref"
_WORDS = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))


def features(value: Column, before: Column, path: Column) -> dict[str, Column]:
    """Numbers that the trees split on. before: up to NEAR characters in front of the candidate."""
    n = F.length(value).cast("double")
    share = lambda rx: F.regexp_count(value, F.lit(rx)).cast("double") / n
    near = F.lower(before)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hex": share("[0-9a-f]"),
        "turns": share(r"(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])"),
        "sounds": share(r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), _WORDS, "")).cast("double") / n,
        "marks": share("[/_-]"),
        "uuid": flag(value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "prefix": flag(value.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk_|pk_|xox[abp]-|AIza|eyJ|glpat-|npm_)")),
        "assigned": flag(before.rlike(r"""[=:]\s*["']?$""")),
        "secret_word": flag(near.rlike(rf"(?<![a-z])(?:{SECRET_WORDS})(?![a-z])")),
        "hash_word": flag(near.rlike(rf"(?<![a-z])(?:{HASH_WORDS})(?![a-z])")),
        "in_path": flag(before.rlike(r"(?:[/.\\]|//)$")),
        "test_path": flag(F.lower(path).rlike("test|example|sample|fixture|mock|doc")),
    }


def labelled_findings(spark: SparkSession, rows: int = 3000, seed: int = 11) -> DataFrame:
    """(value, before, path, label): findings of known truth, made by rule.

    Secrets are keys of usual forms in code, settings or running text; the rest
    are what candidate patterns also catch: checksums, commits, UUIDs,
    placeholders, file paths, identifiers, versions and serial numbers.
    """
    rng = random.Random(seed)
    pick = rng.choice
    of = lambda letters, n: "".join(pick(letters) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: of(low, rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 6)))
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "private_key", "client_secret", "aws_secret_access_key")
    names = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "etag", "build", "revision", "order id", "serial")
    quote = lambda: pick(("", '"', "'"))
    out = []
    for _ in range(rows // 2):
        value = pick((lambda: "AKIA" + of(up + dig, 16), lambda: of("0123456789abcdef", pick((16, 18, 20, 24, 32, 40, 64))), lambda: of(low + up + dig, pick((20, 24, 32, 40))), lambda: "ghp_" + of(low + up + dig, 36), lambda: "sk_live_" + of(low + up + dig, 24), lambda: of(low + up + dig + "+/", 40)))()
        assigned = f"{prose()} {pick(keys)}{pick(('=', ' = ', ': '))}{quote()}"
        out.append((value, assigned if rng.random() < 0.8 or not value.startswith(("AKIA", "ghp_", "sk_")) else prose() + " ", pick(("src", "config", "app", "")), 1.0))
        if rng.random() < 0.2:  # passwords that people make up
            value = pick((lambda: of(low + up + dig + "!&%$#+", rng.randint(6, 16)), lambda: word().capitalize() + of(dig, rng.randint(1, 4)) + pick(("", "!", "#"))))()
            before = pick((f"{prose()} {pick(keys[:3])}{pick(('=', ' = ', ': '))}{quote()}", f"{pick(('postgres', 'mysql', 'ftp', 'https'))}://{word()}:"))
            out.append((value, before, pick(("src", "config", "app", "")), 1.0))
    for _ in range(rows - rows // 2):
        kind = rng.randrange(9)
        if kind == 0:
            value, before = of("0123456789abcdef", pick((32, 40, 64))), f"{prose()} {pick(names)}{pick((' ', ': ', '='))}"
        elif kind == 1:
            value, before = "-".join(of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), f"{prose()} {pick(('id', 'uuid', 'request', 'session'))}{pick((' ', ': ', '='))}"
        elif kind == 2:
            value, before = pick(("your", "example", "test", "dummy", "changeme", "sample", "insert")) + pick(("-", "_", "")) + pick(("api-key", "token", "password", "secret", "access_key")) + pick(("-", "_", "")) + of(dig, rng.randint(1, 4)) + pick(("here", "", "value")), f"{prose()} {pick(keys)}{pick(('=', ': '))}{quote()}"
        elif kind == 3:
            value, before = "/".join(pick(DICTIONARY) for _ in range(rng.randint(2, 5))) + of(dig, 2), f"{prose()} {pick(('/', 'http://', './', 'see '))}"
        elif kind == 4:
            value, before = "".join(pick(DICTIONARY).capitalize() for _ in range(rng.randint(2, 5))) + of(dig, rng.randint(1, 3)), prose() + " "
        elif kind == 5:
            value, before = word() + word() + word() + of(dig, rng.randint(1, 3)), prose() + " "
        elif kind == 6:
            value, before = of("0123456789abcdef", pick((12, 16, 32, 40))), prose() + " "
        elif kind == 7:  # words where a value could be
            value = pick((pick(DICTIONARY), word(), "required", "none", "null", "true", "false", "<hidden>", "****", "${" + word() + "}"))
            out.append((value, f"{prose()} {pick(keys)}{pick(('=', ': '))}{quote()}", pick(("src", "tests", "docs", "")), 0.0))
            continue
        else:
            value, before = pick((of(up, 2) + of(dig, 12), of(up, 3) + "-" + of(dig, 10), "v" + of(dig, 2) + "-" + of(dig, 8) + "-build")), f"{prose()} {pick(names)} "
        if len(value) >= MIN_LENGTH and any(c in dig for c in value) and any(c not in dig for c in value):
            out.append((value, before[-NEAR:], pick(("src", "tests", "docs", "")), 0.0))
    return local_rows(spark, [(v, b[-NEAR:], p, y) for v, b, p, y in out], "value string, before string, path string, label double")


class Forest:
    """The trees of a fitted forest, as an expression."""

    def __init__(self, names: list[str], trees: list):
        self.names, self.trees = names, trees

    def probability(self, of: dict[str, Column]) -> Column:
        def grown(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, threshold, left, right = node
            return F.when(of[name] <= threshold, grown(left)).otherwise(grown(right))

        return reduce(lambda a, b: a + b, [grown(t) for t in self.trees]) / len(self.trees)


def fit(findings: DataFrame, seed: int = 5) -> Forest:
    """A forest from labelled findings (value, before, path, label 0 or 1), of which at most MAX_FINDINGS are read.

    With labels of one class alone, or none, every candidate is a finding.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.filter(F.col("value").isNotNull() & F.col("label").isin(0, 1)).orderBy(F.xxhash64("value", "before"), "value", "before").limit(MAX_FINDINGS)
    made = features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("path", F.lit("")))
    table = rows.select(F.col("label").cast("double").alias("label"), *[v.alias(k) for k, v in made.items()])
    if table.select("label").distinct().count() < 2:
        return Forest(list(made), [1.0])
    table = VectorAssembler(inputCols=list(made), outputCol="features").transform(table).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(table)
    names = list(made)

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return float(stats[1] / max(1e-9, sum(stats)))
        split = node.split()
        return names[split.featureIndex()], float(split.threshold()), read(node.leftChild()), read(node.rightChild())

    return Forest(names, [read(t._java_obj.rootNode()) for t in model.trees])


def _judged(docs: DataFrame, text: Column, path_col: str | None, forest: Forest) -> tuple[DataFrame, str]:
    """docs with two more columns, and the name of the first: the candidates as (start, end, value, gap, score), in code points; the other is that of pieces."""
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col in docs.columns else F.lit("")
    name = "_judged"
    while any(c.startswith(name) for c in docs.columns):
        name = f"_{name}"
    run = F.col(f"{name}_t").rlike(rf"[0-9]{_KEY}{{2}}") & F.col(f"{name}_t").rlike(rf"{_KEY}{{{MIN_LENGTH}}}")
    rows = docs.withColumns({f"{name}_t": F.coalesce(text, F.lit("")), f"{name}_p": path})
    rows = with_pieces(rows, name, f"{name}_t", CANDIDATE, run | F.col(f"{name}_t").rlike(_HINT))
    words = F.col(name)

    def described(s, i):
        made = features(s["value"], in_front(words, i, NEAR, 4), F.col(f"{name}_p"))
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "value", "gap")], *[v.alias(k) for k, v in made.items()])

    def scored(s):
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "value", "gap")], forest.probability({n: s[n] for n in forest.names}).alias("score"))

    return rows.withColumn(name, F.transform(F.transform(words, described), scored)).drop(f"{name}_t", f"{name}_p"), name


def scan(
    docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: float = 0.5
) -> DataFrame:
    """doc_id, start, end, value_sha256, score: one row for each secret, in code points.

    A candidate is what stands where a key word sets a value, the password of an
    address, or a run of MIN_LENGTH key characters with a letter and a digit.
    Texts without secrets, empty and null texts give no rows; repeated rows
    give repeated rows; an empty table gives none. The value itself isn't
    returned. Without the path column every path is empty.
    """
    rows, name = _judged(docs, F.col(text_col), path_col, forest)
    kept = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.filter(name, lambda s: s["score"] >= least)).alias("s"))
    sha = F.sha2(F.col("s.value").cast("binary"), 256).alias("value_sha256")
    return kept.select("doc_id", "s.start", "s.end", sha, F.round("s.score", 9).alias("score"))


def redact(
    docs: DataFrame,
    forest: Forest,
    text_col: str = "text",
    path_col: str | None = "source",
    length_col: str | None = "n_chars",
    least: float = 0.5,
) -> DataFrame:
    """All rows and columns of docs, with MARK for each secret in the text, and the length column counted anew where the text changed.

    Null texts stay null and empty ones empty; repeated rows change alike; an
    empty table stays empty. Columns of any other name are passed on as they are.
    """
    text = F.col(text_col)
    rows, name = _judged(docs, text, path_col, forest)
    spans = F.col(name)
    parts = F.transform(spans, lambda s: F.concat(s["gap"], F.when(s["score"] >= least, F.lit(MARK)).otherwise(s["value"])))
    tail = F.get(f"{name}_rest", F.size(spans))
    changed = F.exists(spans, lambda s: s["score"] >= least)
    clean = F.when(changed, F.concat(F.array_join(parts, ""), tail)).otherwise(text)
    made = {text_col: clean}
    if length_col in docs.columns:
        length = F.length(clean).cast(docs.schema[length_col].dataType)
        made[length_col] = F.when(changed, length).otherwise(F.col(length_col))
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])
