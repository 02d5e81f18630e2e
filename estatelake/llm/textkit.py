"""Helpers shared by the text operators: UTF-8 columns of Arrow batches as numpy arrays, words, hashes.

Everything here works on one Arrow batch inside a task; Spark deals out the batches. Texts are taken as
bytes, so that a batch of documents is a single array and no Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: space and U+0009 to U+000D
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: bytes of text that one step takes; its arrays of 64-bit numbers are many times as large
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone and is whole."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n, start + rows)
        yield start, end
        start = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the index of its first word (n + 1)."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(SEPARATOR[raw], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] |= inside[1:-1][edges]
    last[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    raw, offsets = utf8(column)
    return np.concatenate([np.zeros(0, np.int64), *(np.diff(words(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])[2]) for a, b in pieces(offsets))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, U)
        full[0] = 1
        have = np.cumprod(full)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from prefix sums of a polynomial: equal bytes, equal hash, wherever they stand."""
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * _power(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(U) * U(0xD1B54A32D192ED03))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``size``-word shingles, A-Z lower-cased.

    A text with fewer words is one shingle of all its words; without words the set is empty.
    """
    raw_all, offsets_all = utf8(column)
    for a, b in pieces(offsets_all):
        raw, offsets = LOWER[raw_all[offsets_all[a]: offsets_all[b]]], offsets_all[a: b + 1] - offsets_all[a]
        starts, ends, first = words(raw, offsets)
        h = span_hashes(raw, starts, ends)
        n = len(h) - size + 1
        full = np.zeros(0, U)
        if n > 0:
            full = h[:n] + U(size)
            for k in range(1, size):
                full = mix(full) + h[k: n + k]
            full = mix(full)
        for i in range(b - a):
            s, e = int(first[i]), int(first[i + 1])
            if e - s >= size:
                row = np.sort(full[s: e - size + 1])
                yield row if len(row) < 2 else row[np.concatenate(([True], row[1:] != row[:-1]))]
            elif e > s:
                x = h[s: s + 1] + U(e - s)
                for k in range(s + 1, e):
                    x = mix(x) + h[k: k + 1]
                yield mix(x)
            else:
                yield np.zeros(0, U)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the rows and the n + 1 offsets of the rows in them; malformed bytes become U+FFFD."""
    data = raw.tobytes()
    try:
        return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:
        rows = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
