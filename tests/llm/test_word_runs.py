import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from estatelake.llm import word_runs as W
from estatelake.llm.queries import QUERIES


def plain_lyndon(s):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    return [max(j - i for j in range(i + 1, len(s) + 1) if is_lyndon(s[i:j])) for i in range(len(s))]


def plain_runs(x, least=6, times=4):
    """All maximal stretches of each period, then those that no smaller period explains."""
    n, stretches = len(x), set()
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j > i:
                stretches.add((i, j - i + p, p))
            i = max(j, i + 1)
    inside = lambda r, o: o[2] < r[2] and o[0] <= r[0] and r[0] + r[1] <= o[0] + o[1]
    good = [r for r in stretches if r[1] >= max(least, times * r[2]) and not any(inside(r, o) for o in stretches)]
    return sorted(good, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept)))


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def repetitive(draw, letters, most):
    x = []
    while len(x) < draw.randint(1, most):
        x += [draw.randint(0, letters) for _ in range(draw.randint(1, 6))] * draw.randint(1, 6)
        x += [draw.randint(0, letters)] * (draw.random() < 0.3)
    return x


def test_lyndon_arrays_equal_the_definition():
    draw = random.Random(5)
    for _ in range(300):
        s = [draw.randint(0, draw.choice([0, 1, 2, 3])) for _ in range(draw.randint(0, 24))]
        assert W.lyndon_array(s) == plain_lyndon(s)


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (3, 3), (1, 5)])
def test_runs_equal_all_stretches(least, times):
    draw = random.Random(9)
    for _ in range(400):
        x = repetitive(draw, draw.choice([1, 2, 3]), 60)
        assert W.runs_of(np.array(x), least, times) == plain_runs(x, least, times)


def test_long_runs_take_no_quadratic_time():
    assert W.runs_of(np.array([0] * 100_000 + [1] + [2, 3] * 50_000)) == [(0, 100_000, 1), (100_001, 100_000, 2)]


ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b c " * 9), (7, "x " + "one two three " * 4 + "y"),
        (8, "x  y\x0bz w v é é é é é é é"), (9, "1 2 1 2 1 2 1 2 3 1 2 1 2 1 2 1 2 3 " * 5), (10, "aa a aa a aa a aa a " * 3), (11, "w" * 50_000 + " end end end end end end")]


def test_rows_of_odd_tables(documents):
    docs = documents(ROWS)
    assert order(W.describe(docs, rewrite=None).collect()) == order(plain_row(i, t, rewrite=False) for i, t in ROWS)
    assert order(W.describe(docs).collect()) == order(plain_row(i, t) for i, t in ROWS)
    listed = [(i, s, n, p) for i, t in ROWS for s, n, p in plain_runs(re.findall(r"[^\x20\x09-\x0D]+", t or ""))]
    got = W.runs(docs).collect()
    assert order((r.doc_id, r.start, r.length, r.period) for r in got) == order(listed)
    assert {r.phrase for r in got if r.doc_id == 7} == {"one two three"}
    assert {r.text for r in W.collapse(docs).where("doc_id in (5, 7)").collect()} == {"a", "x one two three y"}
    for fn in (W.describe, W.runs, W.collapse):
        assert fn(documents([])).collect() == []


def test_random_documents_equal_brute_force(documents):
    draw = random.Random(11)
    rows = [(i, " ".join(f"w{k}" for k in repetitive(draw, draw.choice([2, 5, 40]), 90))) for i in range(300)]
    assert order(W.describe(documents(rows)).collect()) == order(plain_row(i, t) for i, t in rows)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 8000]
    want = {i: plain_row(i, t) for i, t in docs}
    got = [tuple(r) for r in QUERIES["op13_word_runs"](spark, sf_dir).collect()]
    assert [r for r in got if r[0] in want and r != want[r[0]]] == [] and sum(r[1] > 0 for r in got) > 5
