import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quern.llm.bpe_stream import Merges, PieceEncoder, TextDecoder, bpe, byte_alphabet, encode_decode  # noqa: E402
from quern.llm.pretokens import KNOWN, cached  # noqa: E402
from quern.llm.token_counts import section_tokens, token_bytes  # noqa: E402
from quern.llm.token_files import round_trip  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["abcdefgh the", "ÀÉñçß", "Σσς ΑΣ", "0123456789", ".,!?'s't're", "\n\t   ", "<|endoftext|>", "日本語", "é", "😀", "İŸﬁ", "x" * 40, "\x1c\x85\xa0", "a\n b"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(PARTS)) if rng.random() < 0.9 else rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", " ", "\n", "a "]


def ids_of(coder, rows):
    out = []
    for _, _, ids, counts in coder.encode(pa.array(rows, pa.string())):
        ends = np.cumsum(counts)
        out += [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
    return out


def test_pieces_encode_as_the_library():
    coder, rows = cached(BYTE), texts(1500)
    assert ids_of(coder, rows) == [e.ids for e in coder.library.encode_batch(rows, add_special_tokens=False)]
    known = [chr(c) for c in range(0x800) if KNOWN.fullmatch(chr(c))]
    rows = [f"a{c}1{c} {c}b {c}.{c}" for c in known]
    assert ids_of(coder, rows) == [e.ids for e in coder.library.encode_batch(rows, add_special_tokens=False)]


def test_transducer_encodes_as_the_library():
    coder = bpe(WORD)
    rng = random.Random(1)
    rows = texts(800) + ["".join(rng.choice(k) for _ in range(9000)) for k in ("ab", "nonono", "!?.", "é")] + [k * m for k in "ae*=" for m in (4095, 4096, 12001)]
    for t in rows:
        e = coder.library.encode(t, add_special_tokens=False)
        a, b = coder.encode_decode(t)
        assert np.frombuffer(a, "<u4").tolist() == e.ids
        assert b.decode() == coder.library.decode(e.ids, skip_special_tokens=False)


def test_memory_of_the_transducer_is_bounded():
    coder = bpe(WORD)
    machine = PieceEncoder(coder.merges, coder.names, coder.length)
    for _ in range(50):
        machine.feed("ab" * 2048)
        assert len(machine.held) < coder.merges.lookahead + 4096


def test_improper_merges_have_no_lookahead():
    vocab = {"a": 0, "b": 1, "ab": 2, "aba": 3}
    assert Merges(vocab, [("ab", "a"), ("a", "b")], None).lookahead is None
    assert Merges(vocab, [("a", "b"), ("ab", "a")], None).lookahead >= 2


def test_byte_state_machine():
    t = Tokenizer.from_file(BYTE)
    names = {i: s for s, i in t.get_vocab().items()}
    d = TextDecoder({c: b for b, c in byte_alphabet().items()}, names)
    text = "naïve 😀 日本 end"
    assert "".join(d.feed([i]) for i in t.encode(text).ids) + d.close() == text
    half = t.encode("😀").ids[:1]
    d = TextDecoder({c: b for b, c in byte_alphabet().items()}, names)
    assert d.feed(half) + d.close() == "�"


ROWS = [(3, "The idiot\nran 😀 home.\n", "x"), (1, None, None), (2, "", "y"), (None, "no id", "z"), (3, "The idiot\nran 😀 home.\n", "x"), (9, "long " * 30000, None)]
SCHEMA = "doc_id long, text string, ids string"


def test_files_round_trip(spark):
    got = sorted((tuple(r) for r in round_trip(spark.createDataFrame(ROWS, SCHEMA), BYTE).collect()), key=lambda r: r[1])
    t, start, want = Tokenizer.from_file(BYTE), 0, []
    for i, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "").ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert round_trip(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_encode_decode_rows(spark):
    got = sorted((tuple(r) for r in encode_decode(spark.createDataFrame(ROWS, SCHEMA), WORD).collect()), key=str)
    t, want = Tokenizer.from_file(WORD), []
    for i, text, _ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_decode(spark.createDataFrame([], SCHEMA), WORD).count() == 0


@pytest.mark.parametrize("rule", ["start", "end", "split"])
def test_sections_against_a_plain_loop(spark, rule):
    size, t = token_bytes(BYTE), Tokenizer.from_file(BYTE)
    docs = [(i, x) for i, x in enumerate(texts(60, 8) + [None, "a\n\nb\n"])]
    got = {}
    for r in section_tokens(spark.createDataFrame(docs, "doc_id long, text string"), BYTE, rule).collect():
        got[r["doc_id"], r["section"]] = (r["start"], r["end"], pytest.approx(r["n_tokens"]))
    want = {}
    for i, x in docs:
        x, spans, at = x or "", [], 0
        for k in t.encode(x, add_special_tokens=False).ids:
            spans.append((at, at + int(size[k])))
            at += int(size[k])
        cuts = [0, *[k + 1 for k, c in enumerate(x) if c == "\n" and k + 1 < len(x)], len(x)]
        for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            p, q = len(x[:a].encode()), len(x[:b].encode())
            n = {"start": sum(p <= u < q for u, _ in spans), "end": sum(p < v <= q for _, v in spans), "split": sum(max(0, min(q, v) - max(p, u)) / (v - u) for u, v in spans)}[rule]
            want[i, s] = (a, b, n)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k]


def test_given_sections_may_overlap(spark):
    docs = spark.createDataFrame([(1, "hello world again"), (2, None)], "doc_id long, text string")
    s = spark.createDataFrame([(1, 0, 0, 17), (1, 1, 6, 11), (2, 0, 0, 5), (7, 0, 0, 1)], "doc_id long, section long, start long, end long")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in section_tokens(docs, BYTE, "end", s).collect()}
    assert got == {(1, 0): 3.0, (1, 1): 1.0, (2, 0): 0.0}


def test_bpe_of_long_texts_holds_little():
    """Stretches and long pieces give what the library gives; what is held doesn't follow the text."""
    import tracemalloc

    import public_tokenizers

    from quern.llm.bpe_stream import Bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Bpe(path)
    rng = random.Random(3)
    words = ["ab", "Été", "naïve", "x1y22", "don't", "…", "Σας", "é ́x", "\t", "<|endoftext|>", "日本語", "q" * 9000]
    text = " ".join(rng.choice(words[:-1]) for _ in range(30_000)) + " " + words[-1] * 3
    want = coder.library.encode(text, add_special_tokens=False).ids
    got, spelled = coder.encode_decode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert spelled.decode() == coder.library.decode(want, skip_special_tokens=False)
    n, ids, decoded = coder.digests(text)
    assert (n, ids, decoded) == (len(want), hashlib.sha256(got).hexdigest(), hashlib.sha256(spelled).hexdigest())

    def peak(times):
        long = "some words of it " * times
        tracemalloc.start()
        coder.digests(long)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(100)
    assert peak(200_000) < 2 * peak(20_000)


def test_section_tokens_of_odd_tables(spark):
    """Null ids and texts, repeated rows, a very long text, columns of clashing names, an empty table."""
    long = "word and more\n" * 30_000
    rows = [(1, "a b\nc", 5, "x"), (1, "a b\nc", 5, "x"), (None, "no id\n", 0, None), (2, None, 1, "y"), (3, "", 1, "y"), (4, long, 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, section int, n_tokens string")
    got = section_tokens(df, BYTE, "start").collect()
    lines = lambda t: max(1, (t or "").count("\n") + (not (t or "").endswith("\n"))) if t else 1
    assert len(got) == sum(lines(t) for _, t, _, _ in rows)
    library = Tokenizer.from_file(BYTE)
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for i, t, _, _ in rows:
        want[i] = want.get(i, 0) + len(library.encode(t or "", add_special_tokens=False).ids)
    assert total == want
    assert section_tokens(df.limit(0), BYTE).count() == 0
