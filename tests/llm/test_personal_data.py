import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelake.llm import personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return personal_data.fit()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+0123 ()é%", max_size=40))
def test_base_equals_the_patterns(text):
    assert personal_data.base_spans(text) == plain(text)


def test_base_on_long_runs():
    text = "a" * 200_000 + " " + "1" * 200_000 + " " + "1." * 50_000 + "+1" * 50_000 + "@" * 50_000
    assert personal_data.base_spans(text)[:1] == [(400_002, 1, 400_009)]


def test_many_spans_in_one_text(field):
    """Added spans clash with none, offsets count code points, and a text of 10^5 numbers takes seconds."""
    import time

    one = "é call +1 (265) 555-5428 or write jane (at) host (dot) com today x.1@mail.example.com 29.112.136.108 "
    (base, every), = personal_data._spans(field, pa.array([one]))
    assert len(every) > len(base)
    (bases, all_spans), = personal_data._spans(field, pa.array([one * 200]))
    move = lambda spans: [(a + i * len(one), k, b + i * len(one)) for i in range(200) for a, k, b in spans]
    assert bases == move(base)
    for a, k, b in set(all_spans) - set(bases):
        assert all(b <= x or y <= a for x, _, y in all_spans if (x, y) != (a, b))
    added = {(one * 200)[a:b] for a, _, b in set(all_spans) - set(bases)}
    assert added == {one[a:b] for a, _, b in set(every) - set(base)} == {"jane (at) host (dot) com"}
    started = time.time()
    (bases, _), = personal_data._spans(field, pa.array(["é +1 (265) 555-5428 " * 100_000]))
    assert len(bases) == 100_000 and time.time() - started < 60


def test_held_out_spans(field):
    rows = personal_data.made_rows(300, seed=99)
    good = found = wanted = 0
    for (text, spans), (_, every) in zip(rows, personal_data._spans(field, pa.array([t for t, _ in rows]))):
        want = {(a, personal_data.KINDS.index(k), b) for k, a, b in spans}
        good, found, wanted = good + len(want & set(every)), found + len(every), wanted + len(want)
    assert good / found > 0.95 and good / wanted > 0.9


def test_decoding_equals_the_best_of_all_paths(field):
    import itertools

    import numpy as np

    text = ["call (020) 555 01 at host2 dot net +1", "7 8"]
    w = personal_data._Words(*personal_data.utf8(pa.array(text)))
    e, move, states = field.scores(w.codes), field.move + personal_data._RULED, field.decode(w)
    for s, n in zip(w.run, w.length):
        n = min(int(n), 5) if n <= 5 else 0
        if n:
            score = lambda p: move[0, p[0]] + sum(move[a, b] for a, b in zip(p, p[1:])) + move[p[-1], 0] + sum(e[s + t, x] for t, x in enumerate(p))
            best = max(itertools.product(range(len(personal_data.STATES)), repeat=n), key=score)
            assert np.isclose(score(best), score(tuple(states[s: s + n])))


def test_edge_rows(spark, documents, field):
    long = "plain words " * 50_000 + "x.1@mail.example.com"
    rows = [(1, None), (2, ""), (3, "é mail x.1@mail.example.com and 29.112.136.108"), (3, "same id"), (None, "+1 (265) 555-5428."), (5, long), (6, "write jane (at) host (dot) com today")]
    got = personal_data.find(documents(rows), field).collect()
    by = {r["doc_id"]: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 7 and by[1]["base_sha256"] == by[2]["base_sha256"] == empty and by[1]["spans"] == ""
    three = next(r for r in got if r["doc_id"] == 3 and r["spans"])
    assert three["spans"] == "email:7:27,ip:32:46" and three["base_sha256"] == hashlib.sha256(three["spans"].encode()).hexdigest()
    assert by[None]["spans"] == "phone:0:17" and by[5]["n_email"] == 1
    assert by[6]["n_added"] == 1 and by[6]["base_sha256"] == empty and by[6]["spans"] == "email:6:30"
    assert personal_data.find(documents([]), field).count() == 0
