import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from estatelake.llm import bpe_automaton as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "Hello world, it's 12 o'clock"), (2, ""), (3, None), (None, "no id"), (4, "same"), (4, "same"), (5, " \n\n x  "),
        (6, "a<|endoftext|> b<|endoftext|"), (7, "naïve 中文 \U0001f600 ՘ \U00016fff"), (8, "ab" * 3000 + " " * 300 + "=" * 500), (9, "word " * 60_000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return B.Coder(B.Tables(PATH))


def ids_of(coder, texts):
    out = [b"" for _ in texts]
    for row, part in coder.encode(texts):
        out[row] += part
    return [np.frombuffer(x, "<u4").tolist() for x in out]


def merged(symbols, merges):
    """Plain merging: one merge after the other, from left to right."""
    row = list(symbols)
    for a, b in merges:
        out, i = [], 0
        while i < len(row):
            if row[i: i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(row[i])
                i += 1
        row = out
    return row


@pytest.mark.parametrize("seed", range(30))
def test_paths_are_the_correct_token_sequences(seed):
    """Every text over two symbols is spelt by exactly one path of the automaton: its merged form."""
    draw, letters, merges = random.Random(seed), ["x", "y"], []
    tokens = list(letters)
    while len(merges) < 6:
        pair = (draw.choice(tokens), draw.choice(tokens))
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    automaton, label = B.Automaton(2), {"x": 0, "y": 1}
    for a, b in merges:
        label[a + b] = B.NONE if B.NONE in (label[a], label[b]) else automaton.merge(label[a], label[b])
    live = [t for t in tokens if label[t] != B.NONE]

    def paths(text, last=None):
        if not text:
            yield []
        for t in live:
            if text.startswith(t) and (last is None or automaton.follows(label[last], label[t])):
                yield from ([t, *rest] for rest in paths(text[len(t):], t))

    for text in map("".join, itertools.chain.from_iterable(itertools.product("xy", repeat=n) for n in range(1, 9))):
        assert list(paths(text)) == [merged(text, merges)]


def test_equals_the_library(coder, library):
    draw, texts = random.Random(7), [t for _, t in ROWS if t]
    for _ in range(400):
        texts.append("".join(draw.choice("aehtinos rld'st\n\t 19.=<|") for _ in range(draw.randint(0, 150))))
        texts.append("".join(chr(draw.choice([draw.randint(0, 0x2FF), draw.randint(0x300, 0xD7FF), draw.randint(0xE000, 0x10FFFF)])) for _ in range(40)))
    got = ids_of(coder, texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [coder.decode(np.array(i, "<u4").tobytes()).decode() for i in got] == [library.decode(i, skip_special_tokens=False) for i in got] == texts


def test_every_code_point_is_split_like_the_library(coder, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = ["".join(f"a{c}{c}1 {c}  {c}" for c in chars[k: k + 500]) for k in range(0, len(chars), 500)]
    assert ids_of(coder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_pieces_and_steps_do_not_change_results(coder, library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 20)
    monkeypatch.setattr(B, "STEP", 7)
    fresh, texts = B.Coder(coder.t), [t for _, t in ROWS[:9] if t]
    assert ids_of(fresh, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_decode_and_digests(spark, documents, library):
    docs = documents(ROWS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    coded = B.encode(docs, PATH)
    assert sorted([(r.doc_id, r.ids) for r in coded.collect()], key=key) == sorted([(i, w) for (i, _), w in zip(ROWS, want)], key=key)
    assert sorted([tuple(r) for r in B.decode(coded, PATH).collect()], key=key) == sorted([(i, t or "") for i, t in ROWS], key=key)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted([tuple(r) for r in B.digests(docs, PATH).collect()], key=key) == sorted(
        [(i, len(w), sha(np.array(w, "<u4").tobytes()), sha((t or "").encode())) for (i, t), w in zip(ROWS, want)], key=key)
    assert B.digests(documents([]), PATH).collect() == B.encode(documents([]), PATH).collect() == []
    odd = spark.createDataFrame([(1, [72, 999_999, None]), (2, None), (3, [172])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, B.decode(odd, PATH).collect())) == [(1, library.decode([72])), (2, ""), (3, "�")]


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "dropout": 0.1}},
                   {"model": {**spec["model"], "merges": [["zz", "zz"]]}}):
        (tmp_path / "t.json").write_text(json.dumps({**spec, **change}), encoding="utf-8")
        with pytest.raises(ValueError):
            B.Tables(str(tmp_path / "t.json"))
