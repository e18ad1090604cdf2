import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.shingles import shingle_sets
from quern.llm.token_files import COUNT, from_file, pack, to_file, unpack

SPACE = r"[^\x20\x09-\x0D]+"
TEXTS = st.lists(st.one_of(st.none(), st.text("aAbB é\n\t\x0b ßZ", max_size=30)), max_size=8)


def plain_set(text, n):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(SPACE, t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingle_sets_are_those_of_a_plain_loop(texts, n):
    sets = []
    for i, j, h, b in shingle_sets(pa.array(texts, pa.string()), n):
        sets += [frozenset(h[b[k] : b[k + 1]].tolist()) for k in range(j - i)]
    want = [plain_set(t, n) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(sets[a] & sets[b]) == len(want[a] & want[b])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    words, offsets = pack(x)
    assert (unpack(words, offsets, len(x)) == x).all()


def test_simple8b_edges():
    for x in ([], [0] * 5000, [2**60 - 1, 2**60, 2**64 - 1], [1] * int(COUNT.max()) * 9, list(range(513))):
        v = np.array(x, np.uint64)
        w, o = pack(v)
        assert (unpack(w, o, len(v)) == v).all()
    assert len(pack(np.zeros(512, np.uint64))[0]) < 10


def test_file_holds_null_ids():
    data = to_file([None, 5], [1, 2], np.array([0, 7, 0]))
    ids, lengths, values = from_file(data)
    assert ids == [None, 5] and lengths.tolist() == [1, 2] and values.tolist() == [0, 7, 0]
