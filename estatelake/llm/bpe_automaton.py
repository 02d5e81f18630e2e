"""Byte-level BPE as a deterministic automaton over tokens.

*Construction.* The automaton starts as one state in which every byte symbol is an arc back to it: all sequences of bytes.
Merges are built in one after the other, in their order. The gadget of a merge ``a b -> c`` changes exactly the places where
``a`` may be followed by ``b``: the state behind ``a`` is copied for its arcs labelled ``a`` and loses its arc ``b``, and
wherever an arc ``a`` begins, a new arc ``c`` leads to where ``a b`` led. For ``a a -> c`` the copy also has no arc ``c``, as
merging goes from left to right (``a a a`` becomes ``c a``). In the end the paths are the correct token sequences and no
others, and every text of bytes is spelt by one path.

*Tables.* The state reached depends on the last arc's label only. States with equal arcs stay one state, and labels that have
stood at the same states all along stay one class; a gadget copies one state and one class at most. The transition
table is therefore one bit for each (state, class), some ten megabytes for 50,000 merges, built in one pass over the merges. A second
table is the trie of the labels' bytes.

*Encoding.* Texts are split by the pattern first. Of a piece, every prefix is spelt by one path, so each position is reached in
one state: from position to position, the labels that match the bytes there are tried against the state's row; a
trace back from the end gives the labels. A task's distinct pieces of a batch go through the tables together and are kept for later batches.
*Decoding* emits the bytes of the arcs' labels.

The vocabulary's size bounds the tables, which are built once on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

# fixed value: the pattern that splits texts before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pieces up to this many bytes go through the tables together, longer ones alone
SHORT = 48
#: distinct pieces that a task remembers; beyond, it starts anew (results do not depend on it)
REMEMBERED = 400_000
#: pieces of a text that are taken in one step, so that a very long text needs no list of all its pieces
STEP = 200_000
NONE = -1


def byte_symbols() -> dict[str, int]:
    """Character that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def later_characters() -> list[tuple[int, int]]:
    """Ranges of the letters and numbers of the regex module's Unicode version that the tokenizers library does not split as such."""
    seen = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    known, ranges = {kind: regex.compile(rf"\p{{{kind}}}") for kind in "LN"}, []
    for c in range(0x110000):
        # only characters that are new in some version can differ
        if unicodedata.category(chr(c)) != "Cn":
            continue
        joins = next((before for kind, before in (("L", "a"), ("N", "1")) if known[kind].match(chr(c))), None)
        if joins and len(seen.pre_tokenize_str(joins + chr(c))) > 1:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return [tuple(r) for r in ranges]


def pattern_without(ranges: list[tuple[int, int]]) -> str:
    """``PATTERN`` where the characters of ``ranges`` are neither letters nor numbers."""
    later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    kinds = {r"[\p{L}]": rf"[\p{{L}}--[{later}]]", r"[\p{N}]": rf"[\p{{N}}--[{later}]]", r"[^\s\p{L}\p{N}]": rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])"}
    return "(?V1)" + regex.sub("|".join(map(regex.escape, kinds)), lambda m: kinds[m.group()], PATTERN)


class Automaton:
    """States, label classes and their table (a bit for each), built by one merge gadget after another."""

    def __init__(self, symbols: int):
        self.state = [0] * symbols  # state behind each label
        self.group = [0] * symbols  # class of each label
        self.in_state, self.in_group = [symbols], [symbols]
        self.table = np.ones((1, 1), np.uint8)

    def _room(self, rows: int, columns: int) -> None:
        have, columns = self.table.shape, -(-columns // 8)
        if rows > have[0] or columns > have[1]:
            grown = [h if n <= h else n + n // 4 for n, h in zip((rows, columns), have)]
            bigger = np.zeros(grown, np.uint8)
            bigger[: have[0], : have[1]] = self.table
            self.table = bigger

    def _clear(self, state: int, group: int) -> None:
        self.table[state, group >> 3] &= ~np.uint8(1 << (group & 7))

    def _own_state(self, label: int) -> int:
        """The state behind ``label``, copied if other labels lead to it."""
        s = self.state[label]
        if self.in_state[s] > 1:
            self.in_state[s] -= 1
            new = len(self.in_state)
            self._room(new + 1, len(self.in_group))
            self.table[new] = self.table[s]
            self.in_state.append(1)
            self.state[label] = s = new
        return s

    def _own_group(self, label: int) -> int:
        """The class of ``label``, copied if it has other labels."""
        g = self.group[label]
        if self.in_group[g] > 1:
            self.in_group[g] -= 1
            new = len(self.in_group)
            self._room(len(self.in_state), new + 1)
            self.table[:, new >> 3] |= (self.table[:, g >> 3] >> np.uint8(g & 7) & np.uint8(1)) << np.uint8(new & 7)
            self.in_group.append(1)
            self.group[label] = g = new
        return g

    def follows(self, a: int, b: int) -> bool:
        s, g = self.state[a], self.group[b]
        return bool(self.table[s, g >> 3] >> (g & 7) & 1)

    def merge(self, a: int, b: int) -> int:
        """The gadget of ``a b``; returns the new label, or NONE if ``b`` never follows ``a`` (then nothing changes)."""
        if not self.follows(a, b):
            return NONE
        c = len(self.state)
        self.state.append(self.state[b])
        self.in_state[self.state[b]] += 1
        self.group.append(self.group[a])
        self.in_group[self.group[a]] += 1
        s = self._own_state(a)
        if a == b:
            # c stands where a stood, but not behind a
            self._clear(s, self._own_group(c))
        self._clear(s, self._own_group(b))
        return c


class Tables:
    """What encoding and decoding need, as flat arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level BPE model")
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: texts are split in another way")
        symbols, vocab = byte_symbols(), model["vocab"]
        order = sorted(symbols, key=symbols.get)
        if missing := [c for c in order if c not in vocab]:
            raise ValueError(f"{path}: no token for the byte {symbols[missing[0]]}")
        automaton = Automaton(256)
        label = {c: i for i, c in enumerate(order)}
        ids = [vocab[c] for c in order]
        texts = [bytes([i]) for i in range(256)]
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a not in label or b not in label:
                raise ValueError(f"{path}: a merge of {a} and {b} before both exist")
            c = NONE if NONE in (label[a], label[b]) else automaton.merge(label[a], label[b])
            if c == NONE:  # no path has this pair
                label.setdefault(a + b, NONE)
                continue
            if label.get(a + b, NONE) != NONE:
                raise ValueError(f"{path}: two merges make {a + b}")
            label[a + b] = c
            ids.append(vocab[a + b])
            texts.append(texts[label[a]] + texts[label[b]])
        self.ids = np.array(ids, np.uint32)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.state = np.append(np.array(automaton.state, np.int32), 0)  # the last entry: before the first arc
        self.group = np.array(automaton.group, np.int32)
        rows, columns = len(automaton.in_state), len(automaton.in_group)
        # at the start all labels that exist are allowed: a row of its own
        self.table = np.full((rows + 1, -(-columns // 8)), 255, np.uint8)
        self.table[:rows] = automaton.table[:rows, : self.table.shape[1]]
        self.state[-1] = rows
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or []):
            raise ValueError(f"{path}: added tokens that strip or stand alone are not supported")
        self.by_id = {int(i): t for i, t in zip(self.ids, texts)} | {i: t.encode() for t, i in self.added.items()}
        # tokens that no path has still decode
        self.by_id |= {i: bytes(symbols[c] for c in t) for t, i in vocab.items() if i not in self.by_id and all(c in symbols for c in t)}
        self._trie(texts)
        self.later = later_characters()

    def _trie(self, texts: list[bytes]) -> None:
        """Edges as sorted keys ``node * 256 + byte``; ``target`` the node behind each, ``label_at`` the label that ends there."""
        nodes, edges, ends = {b"": 0}, [], {}
        for i, t in enumerate(texts):
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(nodes)
                    edges.append((nodes[t[: k - 1]] * 256 + t[k - 1], nodes[t[:k]]))
            ends[nodes[t]] = i
        edges.sort()
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.target = np.array([n for _, n in edges], np.int32)
        self.label_at = np.full(len(nodes), NONE, np.int32)
        self.label_at[list(ends)] = list(ends.values())


class Coder:
    """Encodes and decodes with the tables; one for each task."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.plain = regex.compile(PATTERN)
        if tables.later:
            self.careful = regex.compile(pattern_without(tables.later))
            self.high = re.compile(f"[{chr(tables.later[0][0])}-\U0010ffff]")
        added = sorted(tables.added, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.added = {t: int(i).to_bytes(4, "little") for t, i in tables.added.items()}
        self.known: dict[str, bytes] = dict(self.added)

    def _allowed(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        group = self.t.group[label]
        return (self.t.table[state, group >> 3] >> (group & 7).astype(np.uint8)) & 1 != 0

    def _matches(self, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, label) of every label that matches at a position and ends by the position's ``end``."""
        at = np.arange(len(raw))
        node = np.zeros(len(raw), np.int64)
        out, depth = [], 0
        while len(at):
            key = node * 256 + raw[at + depth]
            k = np.minimum(np.searchsorted(self.t.keys, key), len(self.t.keys) - 1)
            hit = self.t.keys[k] == key
            at, node = at[hit], self.t.target[k[hit]].astype(np.int64)
            depth += 1
            label = self.t.label_at[node]
            full = label != NONE
            out.append((at[full], np.full(int(full.sum()), depth), label[full]))
            more = at + depth < end[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out))

    def _walk(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece (none is empty)."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        where = np.arange(len(raw)) - np.repeat(first, size)  # place within the piece
        at, length, label = self._matches(raw, np.repeat(first + size, size))
        order = np.argsort(where[at], kind="stable")
        at, length, label = at[order], length[order], label[order]
        cut = np.searchsorted(where[at], np.arange(int(size.max()) + 1))
        # position p + 1 + its piece's number: each piece has one position more than bytes
        slot = at + np.repeat(np.arange(len(words)), size)[at]
        last = np.full(len(raw) + len(words), len(self.t.group), np.int64)  # label of the arc that reaches a position
        for a, b in zip(cut[:-1], cut[1:]):
            here, to = slot[a:b], label[a:b]
            good = self._allowed(self.t.state[last[here]], to)
            last[here[good] + length[a:b][good]] = to[good]
        # back from the ends, all pieces in step
        begin = first + np.arange(len(words))
        place, rows, steps = begin + size, np.arange(len(words)), []
        while len(rows):
            step = last[place]
            steps.append((rows, step))
            place = place - self.t.length[step]
            more = place > begin[rows]
            place, rows = place[more], rows[more]
        who, what = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((-np.arange(len(who)), who))
        ids = self.t.ids[what[order]]
        return np.split(ids, np.cumsum(np.bincount(who, minlength=len(words)))[:-1])

    def _learn(self, words: list[str]) -> None:
        """Encode pieces and remember them."""
        coded = {w: w.encode() for w in words}
        short = [w for w in words if len(coded[w]) <= SHORT]
        # pieces of like length go together, as a step takes one byte of each
        short.sort(key=lambda w: len(coded[w]))
        for k in range(0, len(short), 20_000):
            some = short[k: k + 20_000]
            self.known.update((w, i.tobytes()) for w, i in zip(some, self._walk([coded[w] for w in some])))
        for w in words:
            if len(coded[w]) > SHORT:
                self.known[w] = self._walk([coded[w]])[0].tobytes()

    def _split(self, text: str) -> regex.Pattern:
        return self.careful if self.t.later and self.high.search(text) else self.plain

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text in lists of at most ``STEP``; an added token is a piece."""
        if self.apart and self.apart.search(text):
            parts = (p for k, part in enumerate(self.apart.splititer(text)) for p in ([part] if k % 2 else (m.group() for m in self._split(text).finditer(part))))
        elif len(text) <= STEP:
            yield self._split(text).findall(text)
            return
        else:
            parts = (m.group() for m in self._split(text).finditer(text))
        while some := list(islice(parts, STEP)):
            yield some

    def _coded(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
        needed = set().union(*(some for _, some in held))
        unknown = needed.difference(self.known)
        if len(self.known) + len(unknown) > REMEMBERED:
            self.known = dict(self.added)
            unknown = needed.difference(self.known)
        self._learn(list(unknown))
        for row, some in held:
            yield row, b"".join(map(self.known.__getitem__, some))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
        """(row, ids as little-endian 32-bit numbers), in order and in bounded parts: a long text has several."""
        held, n = [], 0
        for row, text in enumerate(texts):
            for some in self._pieces(text or ""):
                held.append((row, some))
                n += len(some)
                if n >= STEP:
                    yield from self._coded(held)
                    held, n = [], 0
        yield from self._coded(held)

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the labels of the ids spell."""
        emit = self.t.by_id
        return b"".join([emit[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _batches(tables, make):
    """mapInArrow with one coder a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tables.value)
        for batch in batches:
            yield make(coder, batch)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as the tokenizer file at ``path`` defines them.

    A null text has no ids, like an empty one. Special tokens' strings in a text are those tokens. Repeated rows stay, an
    empty table gives none, and other columns are not read. ``path`` is read on the driver only.
    """
    tables = docs.sparkSession.sparkContext.broadcast(Tables(path))

    def make(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [[] for _ in range(batch.num_rows)]
        for row, part in coder.encode(batch.column(1).to_pylist()):
            parts[row].append(part)
        offsets = np.cumsum([0, *(sum(map(len, p)) // 4 for p in parts)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(b"".join(p) for p in parts), "<u4").astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_batches(tables, make), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from token ids; null ids give an empty text, bytes that are no UTF-8 become U+FFFD.

    Ids that the vocabulary lacks are left out, as are nulls within ``ids``.
    """
    tables = coded.sparkSession.sparkContext.broadcast(Tables(path))

    def make(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[i for i in r or [] if i in coder.t.by_id] for r in batch.column(1).to_pylist()]
        texts = [coder.decode(np.array(r, "<u4").tobytes()).decode("utf-8", "replace") for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_batches(tables, make), "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again, in one pass.

    As ``encode`` followed by ``decode``, with the digests of both results; ids never leave the task.
    """
    tables = docs.sparkSession.sparkContext.broadcast(Tables(path))

    def make(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [0] * batch.num_rows
        ids, texts = ([hashlib.sha256() for _ in counts] for _ in range(2))
        for row, part in coder.encode(batch.column(1).to_pylist()):
            counts[row] += len(part) // 4
            ids[row].update(part)
            texts[row].update(coder.decode(part))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), *(pa.array([h.hexdigest() for h in x], pa.string()) for x in (ids, texts))], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_batches(tables, make), DIGESTS)
