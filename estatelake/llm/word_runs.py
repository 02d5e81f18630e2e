"""Periodic runs of words: stretches in which a phrase repeats several times on end.

*Lyndon arrays by grouping.* Phase one of a suffix sorter that works by grouping gathers suffixes by their longest Lyndon
prefix, and the length of a group's common prefix is the Lyndon array; no suffix array is needed. Groups start as
the suffixes of equal first word and are taken from the highest down. Every member of the group points to the nearest position
before it whose group is lower; such a position's prefix grows by the group's, as often as members point to it, and positions
of one old group and one number of pointers become a group of their own, right above the old one. All is linear but for path
halving.

*Runs.* In one of the two orders of the alphabet (a given one and its reverse), every run has a root that is the longest Lyndon
word at its place. So the Lyndon arrays under both orders name one candidate for each place; where the root is followed by
itself as often as a wanted run needs (compared by prefix hashes, which never miss an equality), it is extended to both sides by longest common
extensions, word by word and exactly. Places inside a run of the same period are skipped, so a run is extended once.

*What a place needs.* A word of a run with the period q has an equal word at most q away, and q is at most a quarter of the run. Words whose nearest
equal word is further away than a quarter of the stretch they stand in are in no run; they cut the stretch, again and again until
nothing changes. This is exact, done for all documents of a chunk at once, and leaves little of ordinary prose.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.llm.textkit import U, mix, pieces, span_hashes, utf8, words

#: a run has at least so many words, and its period at least so many times
LEAST, TIMES = 6, 4
#: cutting may stop early, at the cost of more work only
CUTS = 64

Runs = list[tuple[int, int, int]]  # (start, length, period), sorted by start and period


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place; symbols are numbers from 0."""
    n = len(symbols)
    group, length = list(symbols), [1] * n
    kinds = max(symbols, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    lower, higher = [g - 1 for g in range(kinds)], [g + 1 for g in range(kinds)]
    left = list(range(n + 1))  # place i is entry i + 1; an entry that is not done points to itself
    g = kinds - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in mine:
            left[i + 1] = i
        pointed: dict[int, int] = {}
        for i in mine:
            j = i
            while left[j] != j:
                left[j] = j = left[left[j]]
            left[i + 1] = j
            if j:
                pointed[j - 1] = pointed.get(j - 1, 0) + 1
        if pointed:
            grown = length[mine[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                moved.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new = len(members)
                members.append(moved[times, old])
                above = higher[old]
                lower.append(old)
                higher.append(above)
                higher[old] = new
                lower[above] = new
                for j in members[new]:
                    group[j] = new
                    length[j] += times * grown
        g = lower[g]
    return length


def _same(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How far the words from ``a`` and from ``b`` on (``step`` 1) or back (-1) are equal, both within ``x``."""
    n, done, width = (len(x) - b if step > 0 else a + 1), 0, 64
    while done < n:
        take = min(width, n - done)
        if step > 0:
            differ = x[a + done: a + done + take] != x[b + done: b + done + take]
        else:
            differ = (x[a - done - take + 1: a - done + 1] != x[b - done - take + 1: b - done + 1])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += take
        width *= 2
    return n


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> Runs:
    """All runs of the numbers ``x`` (from 0) with a length of at least ``max(least, times * period)``; ``times`` is 2 or more."""
    n, found = len(x), set()
    if n < max(least, times):
        return []
    top = int(x.max())
    # the numbers as bytes: spans of equal numbers have equal hashes
    raw = np.ascontiguousarray(x, dtype=">u4").view(np.uint8)
    for order in (x, top - x):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        at = np.flatnonzero(np.arange(n) + (times - 1) * period <= n)
        for k in range(1, times - 1):
            p = period[at]
            spans = [span_hashes(raw, 4 * (at + c * p), 4 * (at + (c + 1) * p)) for c in (0, k)]
            at = at[spans[0] == spans[1]]
        last: dict[int, int] = {}  # period -> end of its last run
        for i, p in zip(at.tolist(), period[at].tolist()):
            if i + p <= last.get(p, 0):
                continue
            start, end = i - _same(x, i - 1, i + p - 1, -1), i + p + _same(x, i, i + p, 1)
            if end - start >= 2 * p:
                last[p] = end
                if end - start >= max(least, times * p):
                    found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(names: np.ndarray, first: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that may hold a run; ``first``: offsets of the documents, n + 1."""
    n = len(names)
    if not n:
        return
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = mix(names + row.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    gap = np.where(key[order[1:]] == key[order[:-1]], np.diff(order), n)
    near = np.full(n, n, np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    at = np.arange(n)  # places left
    for _ in range(CUTS):
        if not len(at):
            return
        begin = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])))
        size = np.diff(np.append(begin, len(at)))
        size = np.repeat(np.where(size < max(least, times), 0, size), size)
        good = near[at] * times <= size
        if good.all():
            break
        at = at[good]
    if len(at):
        begin = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])))
        yield from zip(at[begin].tolist(), (at[np.append(begin[1:], len(at)) - 1] + 1).tolist())


Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def _documents(ids: list[int | None], column: pa.Array, least: int, times: int, rewrite: Rewrite | None) -> Iterator[tuple[list[bytes], Runs]]:
    """For each row its words and its runs. ``rewrite(id, n)`` may name (a, p): word i >= a becomes word a + (i - a) % p."""
    raw_all, offsets_all = utf8(column)
    for a, b in pieces(offsets_all):
        raw, offsets = raw_all[offsets_all[a]: offsets_all[b]], offsets_all[a: b + 1] - offsets_all[a]
        starts, ends, first = words(raw, offsets)
        changed = {}
        for i in range(b - a) if rewrite else ():
            n = int(first[i + 1] - first[i])
            if n and (change := rewrite(ids[a + i], n)):
                changed[i] = change
                at = int(first[i]) + change[0]
                take = at + np.arange(int(first[i + 1]) - at) % change[1]
                starts[at: first[i + 1]], ends[at: first[i + 1]] = starts[take], ends[take]
        data, found = raw.tobytes(), {}
        for s, e in _stretches(span_hashes(raw, starts, ends), first, least, times):
            row = int(np.searchsorted(first, s, side="right")) - 1
            seen: dict[bytes, int] = {}
            x = np.array([seen.setdefault(data[p:q], len(seen)) for p, q in zip(starts[s:e].tolist(), ends[s:e].tolist())], np.int64)
            found.setdefault(row, []).extend((r + s - int(first[row]), length, p) for r, length, p in runs_of(x, least, times))
        for i in range(b - a):
            text = data[offsets[i]: offsets[i + 1]].split()  # splits at the same six characters
            if i in changed:
                at, p = changed[i]
                text[at:] = (text[at: at + p] * (-(-(len(text) - at) // p)))[: len(text) - at]
            yield text, found.get(i, [])


def _kept(text: list[bytes], found: Runs) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not found:
        return text
    gone = np.zeros(len(text) + 1, np.int64)
    for start, length, p in found:
        gone[start + p] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(text, np.cumsum(gone)[:-1].tolist()) if not g]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The registered query's own repetitions: of every tenth document (by crc32 of its id), words from some place on repeat.

    A document without an id has none.
    """
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _over(docs: DataFrame, make, schema: str, id_col: str, text_col: str, least: int, times: int, rewrite: Rewrite | None) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, (text, found) in zip(ids, _documents(ids, batch.column(1), least, times, rewrite)):
                rows.extend(make(i, text, found))
            columns = zip(*rows) if rows else [[] for _ in names]
            types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period, phrase): one row for each run of each whole text; start is a word's number.

    Words are runs of characters other than space and U+0009 to U+000D. A run has the smallest period q, at least ``max(least,
    times * q)`` words, and neither neighbouring word continues it. Null, empty and wordless texts have none, an empty table gives
    none, repeated rows have their runs each, other columns are not read.
    """
    def make(i, text, found):
        return [(i, s, n, p, b" ".join(text[s: s + p]).decode("utf-8", "replace")) for s, n, p in found]

    return _over(docs, make, "doc_id long, start long, length long, period long, phrase string", id_col, text_col, least, times, None)


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every text with each run cut to its first period, words joined by one space; a null text is empty."""
    def make(i, text, found):
        return [(i, b" ".join(_kept(text, found)).decode("utf-8", "replace"))]

    return _over(docs, make, "doc_id long, text string", id_col, text_col, least, times, None)


DESCRIBED = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def describe(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = planted) -> DataFrame:
    """One row per document: its number of runs, the longest one, and digests of all runs and of the collapsed text.

    Of runs of equal length the first counts, then that of the smaller period; without any, four columns are null. ``rewrite`` changes words first
    (see ``planted``); None takes texts as they are. Null, empty and wordless texts have no runs and an empty collapsed text. Repeated
    rows stay, an empty table gives none.
    """
    def make(i, text, found):
        s, n, p = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        return [(i, len(found), s, n, p, None if p is None else 1000 * n // p, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(_kept(text, found))).hexdigest())]

    return _over(docs, make, DESCRIBED, id_col, text_col, least, times, rewrite)
