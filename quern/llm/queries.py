"""One query for each operator, over the whole of its table, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe_stream import encode_decode
from quern.llm.decontam import search
from quern.llm.exact_dedup import exact_duplicates
from quern.llm.jaccard_join import similar_components
from quern.llm.kd_shards import kd_shards
from quern.llm.merkle import manifest
from quern.llm import pii, secrets
from quern.llm.shared import documents
from quern.llm.simhash import with_edits
from quern.llm.token_counts import section_tokens
from quern.llm.token_files import round_trip
from quern.llm.toxicity import score, train
from quern.llm.whitening import whiten


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), rule="start")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir), n=4, part=85, whole=100)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.extract(docs, pii.learn(docs)).drop("found")


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op8_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), secrets.fit(secrets.labelled_findings(spark)))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir), shards=24)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered: one more in n_chars, in about every seventh row."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], group="lang", order="doc_id", tampered={"n_chars": more})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_section_tokens": op1_section_tokens,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_simhash": op3_simhash,
    "op4_toxic_segments": op4_toxic_segments,
    "op5_pii_bootstrap": op5_pii_bootstrap,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_token_files": op7_token_files,
    "op8_bpe_stream": op8_bpe_stream,
    "op9_secret_forest": op9_secret_forest,
    "op10_kd_shards": op10_kd_shards,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(g)) END AS class_id FROM s), x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.class_id FROM n JOIN r ON r.id = n.doc_id GROUP BY ALL""",
    "op12_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op13_merkle_manifest": """WITH RECURSIVE crc AS (SELECT doc_id, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
 lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295) AS c FROM documents),
d AS (SELECT doc_id, coalesce('v' || lang, 'n') AS tree, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS i, coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS sl, coalesce(strlen(text) || ':' || text, '-') AS t,
 n_chars AS n0, n_chars + CASE WHEN xor(crc.c, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS n1 FROM documents JOIN crc USING (doc_id)),
leaf AS (SELECT doc_id, tree, sha256(i || sl || coalesce(length(CAST(n0 AS VARCHAR)) || ':' || n0, '-') || t) AS h, sha256(i || sl || coalesce(length(CAST(n1 AS VARCHAR)) || ':' || n1, '-') || t) AS changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx FROM d),
up AS (SELECT 0 AS level, tree, idx, h, count(*) OVER (PARTITION BY tree) AS n FROM leaf
 UNION ALL SELECT DISTINCT level + 1, tree, idx // 2, sha256(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY tree, idx // 2 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 1) // 2 FROM up WHERE n > 1),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx FROM up WHERE n = 1),
over AS (SELECT 0 AS level, idx, h, count(*) OVER () AS n FROM sub
 UNION ALL SELECT DISTINCT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY idx // 2 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 1) // 2 FROM over WHERE n > 1),
both_trees AS (SELECT level, tree, idx, h, n FROM up UNION ALL SELECT 1000 + level, '', idx, h, n FROM over),
walk AS (SELECT doc_id, tree, 0 AS level, idx, '' AS proof, changed AS folded FROM leaf
 UNION ALL SELECT w.doc_id, CASE WHEN b.n = 1 THEN '' ELSE w.tree END, CASE WHEN b.n = 1 THEN 1000 ELSE w.level + 1 END, CASE WHEN b.n = 1 THEN s.idx ELSE w.idx // 2 END,
  w.proof || CASE WHEN b.n = 1 THEN '' ELSE coalesce(o.h, '') END, CASE WHEN b.n = 1 THEN w.folded WHEN w.idx % 2 = 0 THEN sha256(w.folded || coalesce(o.h, '')) ELSE sha256(o.h || w.folded) END
 FROM walk w JOIN both_trees b ON b.tree = w.tree AND b.level = w.level AND b.idx = w.idx LEFT JOIN both_trees o ON o.tree = w.tree AND o.level = w.level AND o.idx = xor(w.idx, 1) LEFT JOIN sub s ON s.tree = w.tree
 WHERE NOT (w.tree = '' AND b.n = 1))
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.h AS verified
FROM leaf l JOIN sub s USING (tree) CROSS JOIN (SELECT h FROM over WHERE n = 1) r JOIN (SELECT doc_id, proof, folded FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1) w ON w.doc_id = l.doc_id""",
}
