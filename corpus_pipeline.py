"""A training-data pipeline over documents: five stages, each one operator of quern.llm.

Each stage takes (spark, docs, sf_dir) and returns documents; the last returns
the encoding. run() writes each stage's rows and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, secrets, toxicity
from quern.llm.bpe_stream import encode_decode
from quern.llm.jaccard_join import similar_components
from quern.llm.queries import _tokenizer
from quern.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; null and empty texts stay, as do repeated rows of a clean document."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8) the document with the least id; rows without an id stay.

    Rows that repeat an id that stays are copies of it: one of them stays.
    """
    classes = similar_components(docs, n=5, part=80, whole=100)
    kept = classes.filter("doc_id = component_id").select("doc_id").distinct()
    # A join by name adds no column, whatever the others are called.
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, as do repeated rows of a clean document."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; null and empty texts stay as they are."""
    return secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    return encode_decode(docs, _tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No stage but the last could be told in SQL without its fitted model; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
