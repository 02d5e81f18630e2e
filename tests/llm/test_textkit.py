import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelake.llm.textkit import code_points, pieces, shingle_sets, utf8, word_counts, words

TEXT = st.text(alphabet="aAbé \t\n\x0b\x1f ", max_size=30)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_equal_the_pattern(texts):
    raw, offsets = utf8(pa.array(texts, pa.string()))
    starts, ends, first = words(raw, offsets)
    found = [[raw[starts[k]: ends[k]].tobytes().decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert found == [WORD.findall(t or "") for t in texts]
    assert word_counts(pa.array(texts, pa.string())).tolist() == [len(f) for f in found]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=2, max_size=2), st.integers(1, 4))
def test_shingle_sets_are_equal_exactly_where_the_shingles_are(texts, size):
    def plain(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[k: k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    got, want = [set(s.tolist()) for s in shingle_sets(pa.array(texts), size)], [plain(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert len(got[0] & got[1]) == len(want[0] & want[1])


def test_pieces_cover_all_rows_and_keep_long_ones_whole():
    offsets = np.cumsum([0, 5, 0, 100, 3, 3, 3])
    assert [list(range(a, b)) for a, b in pieces(offsets, 10)] == [[0, 1], [2], [3, 4, 5]]


def test_code_points_of_malformed_bytes():
    raw = np.frombuffer(b"a\xffb\xc3\xa9", np.uint8)
    cp, at = code_points(raw, np.array([0, 3, 5]))
    assert cp.tolist() == [97, 0xFFFD, 98, 233] and at.tolist() == [0, 3, 4]
