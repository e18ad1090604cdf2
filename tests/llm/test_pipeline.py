"""The stages of the pipeline against plain versions, and the tables they must bear."""

import random
import re

import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from quern.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _keep string, _clean string"


def row(i, text, keep="k"):
    return (i, text, "en", "src0", None if text is None else len(text), keep, "c")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_leave_one_of_each_group(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    rows = []
    for g in range(8):
        base = [word() for _ in range(60)]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            if rng.random() < 0.6:
                w[rng.randrange(60)] = word()
            rows.append(row(len(rows), " ".join(w), f"k{g}"))
    rows += [row(900, None), row(901, ""), row(902, ""), row(None, "no id here"), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if near(sets[i], sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(i for i in sets if label[i] == i) and kept.count(None) == 1
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r[0] for r in toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 1").select("doc_id").collect()}
    got = pipeline.drop_toxic(spark, docs, SF)
    assert got.columns == docs.columns
    assert {r[0] for r in got.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - bad


def test_leaks_go_and_secrets_are_marked(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "these are other words that no question holds at all, I am sure of it"
    rows = [row(1, f"before {item} after"), row(2, clean), row(3, None), row(4, ""), row(2, clean), row(5, f"{clean} password=b7db7aa4a5fcc783")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = pipeline.drop_benchmark_leaks(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 2, 3, 4, 5]
    marked = pipeline.redact_secrets(spark, left, SF)
    assert marked.columns == docs.columns
    got = {r["doc_id"]: r for r in marked.collect()}
    assert got[5]["text"] == f"{clean} password=[secret]" and got[5]["n_chars"] == len(got[5]["text"])
    assert got[2]["text"] == clean and got[3]["text"] is None and got[4]["text"] == "" and got[5]["_clean"] == "c"
    for stage in (pipeline.drop_benchmark_leaks, pipeline.redact_secrets, pipeline.encode):
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_encodes_what_is_left(spark):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    got = pipeline.run(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len(got) < len(docs) and len({r["doc_id"] for r in got}) == len(got)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    same = 0
    for r in got:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        same += hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() == r["ids_sha256"]
    assert same >= 0.9 * len(got)  # but for those in which secrets were marked
