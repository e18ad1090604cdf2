"""Toxic passages as maximum-scoring segments over token log-odds.

Training: of the labelled rows a bounded sample (`max_labelled`, by a hash of
the id); near copies among them count as one (their smallest word-shingle hash
is the same). Features of a word are the word and its proper beginnings of
STEMS bytes, so inflected and compound forms share evidence. A feature's
log-odds between toxic and clean documents has an informative Dirichlet prior,
its frequency in the whole corpus. Words score the highest log-odds of their
features that stand out from the standard error; other words score a small
loss. A linear scan finds every maximal scoring segment of a document.
Scores become extreme-value statistics: with the background's lambda and K, a
segment of score S among n words has the expectation E = K n exp(-lambda S).
The document's statistic is the sum of -ln E over segments with E < 1, and a
logistic curve fitted on the training rows turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import bounded_batches, written
from quern.llm.words import chunks, mix, words_of

#: Bounds of what is fitted: labelled rows read, and words the model may hold.
MAX_LABELLED, MAX_TERMS = 30_000, 1 << 18
MIN_DOCS, MIN_Z, MIN_ODDS = 3, 2.6, 0.7
#: Lengths in bytes of the word beginnings that count as features.
STEMS = range(3, 13)
#: What a word without a score of its own loses.
DRIFT = 0.1
BINS, STEP = 400, 0.25
#: Bytes of text that are worked on at once.
RUN = 1 << 19
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: float = 1.0
    k: float = 1.0
    a: float = 0.0
    b: float = 0.0

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a + self.b * np.minimum(statistic, BINS * STEP))))


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words lose `drift` but for those at `at`.

    Linear in the number of scoring words: the words between two of them are one
    loss, and a segment knows the last one before it with a lower sum before it,
    so the search skips those between.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum at its end, the one to go on with
    total, last = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (p - last - 1)
        gain = s - drift
        last = p
        if gain <= 0:
            total += gain
            continue
        first, before = p, total
        total += gain
        j = len(found) - 1
        while j >= 0 and found[j][2] >= before:
            j = found[j][4]
        while j >= 0 and found[j][3] < total:
            first, _, before, _, lower = found[j]
            del found[j:]
            j = lower
        found.append((first, p, before, total, j))
    return [(a, b, r - l) for a, b, l, r, _ in found]


def features(w, member=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes of one feature of theirs), for each kind of feature; only those that member() lets through."""
    size = w.end - w.start
    for n in (0, *STEMS):
        if n:
            words = np.flatnonzero(size > n)
            h = type(w)(w.data, w.start[words], w.start[words] + n, w.doc, w.first, w.text_start).hashes() ^ np.uint64(0x5DEECE66D)
        else:
            words, h = np.arange(len(w.start)), w.hashes()
        if member is not None:
            k = np.flatnonzero(member(h))
            h, words = h[k], words[k]
        yield words, h


def _members(terms: np.ndarray):
    """Whether hashes are among the sorted terms: a bitmap first, then the list."""
    bitmap = np.zeros(1 << 20, bool)
    bitmap[terms & np.uint64((1 << 20) - 1)] = True

    def member(h: np.ndarray) -> np.ndarray:
        out = bitmap[h & np.uint64((1 << 20) - 1)]
        k = np.flatnonzero(out)
        if len(k):
            out[k] = terms[np.minimum(np.searchsorted(terms, h[k]), len(terms) - 1)] == h[k]
        return out

    return member


def _scored(w, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words that have a score, ascending, and the score: the highest of their features."""
    words, scores = [], []
    for k, h in features(w, _members(model.terms)):
        words.append(k)
        scores.append(model.scores[np.searchsorted(model.terms, h)])
    words, scores = np.concatenate(words), np.concatenate(scores)
    order = np.lexsort((-scores, words))
    words, scores = words[order], scores[order]
    new = np.ones(len(words), bool)
    new[1:] = words[1:] != words[:-1]
    return words[new], scores[new]


def _scan(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
    """The statistic of each text, and its segments with E < 1 as (start, end, score, E), in bytes."""
    stats, found = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for i, _, data, bounds in chunks(texts, "unicode", RUN):
        w = words_of(data, bounds, _BREAK)
        if not len(w.start) or not len(model.terms):
            continue
        hits, score = _scored(w, model)
        doc = w.doc[hits]
        cuts = np.searchsorted(doc, np.arange(len(bounds)))
        for d in np.unique(doc).tolist():
            own = slice(cuts[d], cuts[d + 1])
            mine = hits[own]
            base, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
            for a, b, s in segments(mine - base, score[own]):
                logged = model.lam * s - math.log(model.k * n)
                if logged > 0:
                    stats[i + d] += logged
                    found[i + d].append((int(w.start[base + a] - bounds[d]), int(w.end[base + b] - bounds[d]), s, math.exp(-logged)))
    return stats, found


def held_out(doc_id) -> F.Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(df: DataFrame, per_doc, schema: str) -> DataFrame:
    """Rows that per_doc makes of each run of texts of a task; df: text first, then what per_doc wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in chunks(batch.column(0), "unicode", RUN):
                yield from per_doc(words_of(data, bounds, _BREAK), batch.slice(i, j - i))

    return df.mapInArrow(run, schema)


def _family(w, batch) -> Iterator[pa.RecordBatch]:
    h, n = w.hashes(), batch.num_rows
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    two = h.copy()
    two[:-1] ^= mix(h[1:] + np.uint64(1))
    np.minimum.at(low, w.doc, mix(two))
    yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(low.view(np.int64))], names=["doc_id", "toxic", "family"])


def _presence(w, member=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, as the features' hashes and the documents."""
    parts = list(features(w, member))
    h, d = np.concatenate([x for _, x in parts]), np.concatenate([w.doc[k] for k, _ in parts])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from rows of labels (doc_id, toxic) that aren't held out. Without rows of both classes every text gets the same score."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sample = written(marks.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled), "tox-labels")
    table = bounded_batches(docs).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    # At most max_labelled rows of two numbers.
    labelled = table.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_text", "_id", "toxic")
    families = _counts(labelled, _family, "doc_id long, toxic int, family long")
    kept = written(families.groupBy("family").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("_id")).select("_id", "toxic"), "tox-families")
    single = table.join(F.broadcast(kept), F.col("_doc") == F.col("_id")).select("_text", "toxic")

    def by_class(w, batch):
        """Documents that hold a feature, by class; feature 0 counts the documents."""
        h, d = _presence(w)
        mark = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        u, k = np.unique(h, return_inverse=True)
        n = np.bincount(k, minlength=len(u))
        n1 = np.bincount(k, mark[d], len(u)).astype(np.int64)
        u, n, n1 = np.append(u, np.uint64(0)), np.append(n, len(mark)), np.append(n1, mark.sum())
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array((n - n1).astype(np.int64)), pa.array(n1)], names=["h", "n0", "n1"])

    seen = written(_counts(single, by_class, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "tox-features")
    docs_of = seen.filter("h = 0").first()
    total = np.array([docs_of["n0"], docs_of["n1"], 0] if docs_of else [0, 0, 0], float)
    if not total[0] or not total[1]:
        return Model()
    # Features that lean to the toxic side, those in most toxic documents first; never more than MAX_TERMS.
    lean = (F.col("n1") + 0.5) / float(total[1]) > math.exp(MIN_ODDS) * (F.col("n0") + 0.5) / float(total[0])
    rows = seen.filter((F.col("h") != 0) & (F.col("n1") >= MIN_DOCS) & lean).orderBy(F.desc("n1"), "n0", "h").limit(MAX_TERMS).toPandas()
    if not len(rows):
        return Model()
    rows["u"] = rows["h"].to_numpy(np.int64).view(np.uint64)
    rows = rows.sort_values("u")
    terms, y = rows["u"].to_numpy(), [rows["n0"].to_numpy(float), rows["n1"].to_numpy(float), np.zeros(len(rows))]
    member = _members(terms)

    def tally(w, batch):
        """Documents of the corpus that hold a term; -1 counts the documents."""
        h, _ = _presence(w, member)
        k, n = np.unique(np.searchsorted(terms, h), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int64)), pa.array(np.append(n, batch.num_rows).astype(np.int64))], names=["k", "n"])

    for k, n in _counts(table.select("_text"), tally, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):  # a row a term
        if k < 0:
            total[2] = n
        else:
            y[2][k] = n
    # The prior weighs as much as what the training rows hold.
    strength = total[0] + total[1]
    alpha = np.maximum(y[2], 1) / max(total[2], 1) * strength
    odds = [np.log((y[c] + alpha) / (total[c] + strength - y[c] - alpha + 0.5)) for c in (0, 1)]
    delta = odds[1] - odds[0]
    z = delta / np.sqrt(1 / (y[0] + alpha) + 1 / (y[1] + alpha))
    keep = (z >= MIN_Z) & (delta > MIN_ODDS)
    model = Model(terms[keep], delta[keep])
    per_doc = max(1.0, _labelled_words(single) / total[0])  # words of a clean document
    background = (y[0][keep] + alpha[keep] / 100) / (total[0] * 1.01) / per_doc
    model.lam = _lambda(background, model.scores)
    stats = _labelled_stats(single, model)
    model.k = _scale(stats, model)
    model.a, model.b = _curve(_labelled_bins(single, model))
    return model


def _labelled_words(single: DataFrame) -> float:
    """Words of the clean training rows."""
    count = lambda w, batch: iter([pa.RecordBatch.from_arrays([pa.array([len(w.start)])], names=["n"])])
    return float(_counts(single.filter("toxic = 0"), count, "n long").agg(F.sum("n")).first()[0] or 0)


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda x) = 1 over the background's words."""
    if not len(s):
        return 1.0
    rest = max(0.0, 1 - p.sum())
    f = lambda x: float((p * np.exp(x * (s - DRIFT))).sum() + rest * math.exp(-x * DRIFT) - 1)
    low, high = 1e-9, 1e-3
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _labelled_stats(single: DataFrame, model: Model):
    """Of the clean training rows: words, and rows that hold a segment of the least score any word has."""

    def clean(w, batch):
        hit = len(np.unique(w.doc[_scored(w, model)[0]])) if len(model.terms) else 0
        yield pa.RecordBatch.from_arrays([pa.array([len(w.start)]), pa.array([hit])], names=["words", "hits"])

    return _counts(single.filter("toxic = 0"), clean, "words long, hits long").agg(F.sum("words").alias("words"), F.sum("hits").alias("hits")).first()


def _scale(stats, model: Model) -> float:
    """K such that the clean rows' segments are as many as E expects."""
    if not len(model.scores) or not stats["words"]:
        return 1.0
    least = float(model.scores.min() - DRIFT)
    return max(stats["hits"], 0.5) / (stats["words"] * math.exp(-model.lam * least))


def _labelled_bins(single: DataFrame, model: Model) -> np.ndarray:
    """Training rows by class and bin of their statistic: a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stat, _ = _scan(batch.column(0), model)
            bins = np.minimum((stat / STEP).astype(np.int64), BINS)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(bins)], names=["toxic", "bin"])

    out = np.zeros((2, BINS + 1))
    for c, k, n in single.mapInArrow(run, "toxic long, bin long").groupBy("toxic", "bin").count().toPandas().itertuples(index=False):
        out[c, k] = n
    return out


def _curve(bins: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the class on the statistic, by Newton's steps with a light ridge."""
    x, n, y = np.arange(BINS + 1) * STEP, bins.sum(0), bins[1]
    a, b = math.log((y.sum() + 1) / (n.sum() - y.sum() + 1)), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(y - n * p).sum(), ((y - n * p) * x).sum() - 1e-3 * b])
        v = n * p * (1 - p)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2 / max(1e-9, abs(step[0])), 2 / max(1e-9, abs(step[1])))
        a, b = a + scale * step[0], b + scale * step[1]
    return float(a), float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; passages adds an array of (start, end, score, evalue) in code points.

    Null and empty texts have no segments and get the score of that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stat, found = _scan(batch.column(1), model)
            p = model.probability(stat)
            cols = [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            if passages:
                spans = []
                for t, own in zip(batch.column(1), found, strict=True):
                    raw = pc.utf8_lower(t).as_py().encode() if own else b""
                    spans.append([{"start": len(raw[:a].decode()), "end": len(raw[:b].decode()), "score": s, "evalue": e} for a, b, s, e in own])
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", *["passages"] * passages])

    kind = "doc_id long, score double, predicted int" + ", passages array<struct<start: long, end: long, score: double, evalue: double>>" * passages
    out = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *["passages"] * passages)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic. No shuffle.

    Null and empty texts have no segments and stay; repeated rows stay or go
    together; an empty table stays empty. Other columns are passed on as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stat, _ = _scan(batch.column(batch.schema.get_field_index(text_col)), model)
            yield batch.filter(pa.array(model.probability(stat) < 0.5))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
