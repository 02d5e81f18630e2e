import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelake.llm import fingerprints as fp


def sketch(*texts):
    return list(fp._sketches([t.encode() for t in texts]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", max_size=60), min_size=1, max_size=6))
def test_a_text_alone_and_in_company(texts):
    for text, s in zip(texts, sketch(*texts)):
        alone = sketch(text)[0]
        assert fp.as_text(s) == fp.as_text(alone)
        assert all(np.array_equal(a, b) for a, b in zip(fp.from_text(fp.as_text(s)), s))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_phrases_do_not_depend_on_the_offset():
    rng = random.Random(2)
    shared = words(rng, 400)
    texts = [words(rng, k) + " " + shared + " " + words(rng, 7) for k in (1, 2, 3, 5, 8)]
    names = []
    for t in texts:
        b, at = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])
        for _ in range(3):
            b, at = fp._phrases(b, at)
        names.append(set(b.tolist()))
    common = set.intersection(*names)
    assert len(common) > 0.85 * min(map(len, names))


def test_phrases_are_short_and_cover_the_text():
    rng = random.Random(5)
    b = np.frombuffer(words(rng, 500).encode(), np.uint8)
    at = np.array([0, len(b)])
    sizes = [len(b)]
    for _ in range(4):
        b, at = fp._phrases(b, at)
        sizes.append(len(b))
    assert all(2 <= a / c <= 4 for a, c in zip(sizes, sizes[1:]))


def test_likeness_follows_the_shared_part():
    rng = random.Random(9)
    a, b = words(rng, 800), words(rng, 800)
    near = [fp.likeness(*sketch(a, a[: int(len(a) * part)] + b[int(len(b) * part):])) for part in (1, 0.9, 2 / 3, 0.3, 0)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and 0.3 < near[2] < 0.7 and near[4] < 0.05


def expected(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(sketch(t)[0]), fp.as_text(sketch(e)[0]), fp.likeness(*sketch(t, e)), fp.likeness(*sketch(t, n))))
    return sorted(out, key=str)


def test_equals_a_plain_loop(spark, documents, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rng = random.Random(1)
    rows = [(rng.randrange(10_000), words(rng, rng.choice([0, 1, 3, 40, 300]))) for _ in range(90)]
    rows += [(77, "same id"), (77, None), (None, "no id"), (20_000, "é" * 50), (20_001, ""), (-5, "ab" * 40_000), (rows[0][0], rows[0][1])]
    got = sorted((tuple(r) for r in fp.compare_with_next(documents(rows)).collect()), key=str)
    assert got == expected(rows)


def test_edge_tables(spark, documents):
    assert fp.compare_with_next(documents([])).count() == 0
    one = fp.compare_with_next(documents([(1, "abc def")])).first()
    assert (one["near_next"], one["n_chars"]) == (1.0, 7)
    nothing = fp.compare_with_next(documents([(1, None)])).first()
    assert (nothing["near_edited"], nothing["edited_sha256"]) == (1.0, hashlib.sha256(b"").hexdigest())
    texts = documents([(1, None), (2, "a")]).select(fp.fingerprint_column()("text").alias("f")).collect()
    assert texts[0]["f"] == "."
