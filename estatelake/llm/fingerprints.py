"""Document fingerprints by locally consistent parsing.

A text is cut into phrases of a few symbols, each phrase gets a name from its content, and the names are cut again, level by
level. Where a phrase begins follows from deterministic coin tossing: neighbours that differ are labelled by the lowest
bit in which they differ, again and again, until six labels are left, then three; local maxima (and minima between
them) of the labels begin phrases. A label depends on a few neighbours only, so that equal substrings get equal phrases
away from their ends, at whatever offset they stand. The fingerprint keeps the smallest names of a fine and of a
coarse level; the likeness of two texts is estimated from them as the Jaccard measure
of their phrases, repeated ones counting as often as they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.llm.textkit import U, _power, _BASE, _INVERSE, mix
from estatelake.session import stored

#: levels whose names are kept, and how many: (level, names)
FINE, COARSE = (1, 16), (3, 48)
#: with fewer coarse names than this in either text, the fine ones are compared
ENOUGH = 8
#: rows in a range of ids, up to MOST_RANGES ranges; beyond, ranges grow and are sorted with spilling
RANGE_ROWS, MOST_RANGES = 4096, 20_000
_BYTES = 1 << 20
_CTZ = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _lowest(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit; 0 for 0."""
    if x.dtype == np.uint8:
        return _CTZ[x]
    return np.where(x == 0, 0, np.bitwise_count((x & (~x + U(1))) - U(1))).astype(np.uint8)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each symbol; neighbours within a text differ but for the ends. ``first``: where texts begin."""
    label = symbols
    for _ in range(4):
        x = np.empty_like(label)
        x[1:] = label[1:] ^ label[:-1]
        x[first] = 1
        low = _lowest(x)
        bit = (label >> low.astype(label.dtype)).astype(np.uint8) & np.uint8(1)
        label = (low << np.uint8(1)) | bit
    begins, ends = _marks(len(label), first), _marks(len(label), np.append(first[1:], len(symbols)) - 1)
    for v in (5, 4, 3):
        at = np.flatnonzero(label == v)
        left, right = label[at - 1], label[(at + 1) % len(label)]
        left, right = np.where(begins[at], 9, left), np.where(ends[at], 9, right)
        label[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    return label


def _marks(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _phrases(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text and the offsets of the texts in them; ``at``: offsets of the texts."""
    first = at[:-1][np.diff(at) > 0]
    # a run of one symbol is a single symbol that knows its length
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first] = True
    runs = np.flatnonzero(new)
    where = np.searchsorted(runs, at)
    first = where[:-1][np.diff(where) > 0]
    plain = symbols[runs]
    size = np.diff(np.append(runs, len(symbols)))
    name = plain.astype(U)
    long = size > 1
    name[long] = mix(name[long] + size[long].astype(U) * U(0x9E3779B97F4A7C15))
    symbols = name if long.any() or plain.dtype != np.uint8 else plain
    label = _labels(symbols, first).astype(np.int8)
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    last = np.append(first[1:], len(label)) - 1
    left[first] = right[last] = -1
    top = (label > left) & (label > right)
    low = (label < left) & (label < right)
    beside = np.zeros(len(top), bool)
    beside[1:] = top[:-1]
    beside[:-1] |= top[1:]
    begin = top | low & ~beside
    # a phrase has two symbols at least: a beginning right after a text's first symbol is none
    after = first + 1
    begin[after[after < len(begin)]] = False
    begin[first] = True
    starts = np.flatnonzero(begin)
    sums = np.zeros(len(name) + 1, U)
    np.cumsum((name + U(1)) * _power(_BASE, len(name)), out=sums[1:])
    ends = np.append(starts[1:], len(name))
    names = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(name) + 1)[starts] + (ends - starts).astype(U) * U(0xD1B54A32D192ED03))
    return names, np.searchsorted(starts, where)


def _smallest(names: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest hashes of the names as a multiset: the n-th occurrence of a name is another member."""
    if not len(names):
        return np.zeros(0, np.uint32)
    names = np.sort(names)
    new = np.append(True, names[1:] != names[:-1])
    nth = np.arange(len(names)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    h = (mix(names + nth.astype(U) * U(0x9FB21C651E98DF25) + U(77)) >> U(32)).astype(np.uint32)
    return np.unique(np.partition(h, k - 1)[:k] if len(h) > k else h)


def _sketches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fine, coarse) smallest names of each text."""
    start, total = 0, 0
    for end in range(1, len(texts) + 1):
        total += len(texts[end - 1])
        if total < _BYTES and end < len(texts):
            continue
        some = texts[start:end]
        at = np.concatenate(([0], np.cumsum([len(t) for t in some]))).astype(np.int64)
        names, kept = np.frombuffer(b"".join(some), np.uint8), {}
        for level in range(1, COARSE[0] + 1):
            if len(names):
                names, at = _phrases(names, at)
            kept[level] = (names, at)
        (fine, fine_at), (coarse, coarse_at) = kept[FINE[0]], kept[COARSE[0]]
        for i in range(len(some)):
            yield _smallest(fine[fine_at[i]: fine_at[i + 1]], FINE[1]), _smallest(coarse[coarse_at[i]: coarse_at[i + 1]], COARSE[1])
        start, total = end, 0


def _jaccard(a: np.ndarray, b: np.ndarray, k: int) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:k]
    return sum(h in x and h in y for h in least) / len(least) if least else 1.0


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; 1 for equal fingerprints. A text with a phrase and one without any have 0."""
    if min(len(a[1]), len(b[1])) >= ENOUGH:
        return _jaccard(a[1], b[1], COARSE[1])
    return _jaccard(a[0], b[0], FINE[1])


def as_text(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    return f"{sketch[0].astype('>u4').tobytes().hex()}.{sketch[1].astype('>u4').tobytes().hex()}"


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    fine, coarse = (np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in text.split("."))
    return fine, coarse


def fingerprint_column():
    """A column function from text to its fingerprint; null is fingerprinted as the empty text."""
    def named(text: pa.Array) -> pa.Array:
        return pa.array([as_text(s) for s in _sketches([(t or "").encode() for t in text.to_pylist()])], pa.string())

    return F.arrow_udf(named, "string")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, tail), each followed by the next document's row; a tail row is only followed."""
    held = None
    for batch in batches:
        ids, texts, tails = (batch.column(k).to_pylist() for k in range(3))
        texts = [t or "" for t in texts]
        sketches = list(_sketches([t.encode() for t in texts]))
        rows = list(zip(ids, texts, tails, sketches))
        if held:
            rows.insert(0, held)
        held = rows[-1]
        pairs = [(r, n) for r, n in zip(rows, rows[1:]) if not r[2]]
        edited = [(r[1][: len(r[1]) - (k := len(r[1]) // 3)] + n[1][:k]).encode() for r, n in pairs]
        marks = list(_sketches(edited))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r, _ in pairs], pa.int64()), pa.array([len(r[1]) for r, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([as_text(r[3]) for r, _ in pairs], pa.string()), pa.array([as_text(m) for m in marks], pa.string()),
            pa.array([likeness(r[3], m) for (r, _), m in zip(pairs, marks)], pa.float64()), pa.array([likeness(r[3], n[3]) for r, n in pairs], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document (descending id, then the first).

    The edited text has its last third (rounded down) replaced by as many first code points of the next document, or all of
    them. A null text is empty; a null id comes last; rows that share an id are ordered by text. A single row is its own
    next. An empty table gives none. Texts are shuffled once, into ranges of ids; the row that follows
    a range's last one (one for each range) is sent along with it.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = stored(docs.select(key.alias("key")), "ids")
    ranges = min(max(-(-ids.count() // RANGE_ROWS), 1), MOST_RANGES)
    cuts = ids.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def found(column: pa.Array) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, column.to_numpy(zero_copy_only=False))  # falling ids, rising ranges

    bucket = F.arrow_udf(lambda column: pa.array(found(column), pa.int32()), "int")
    heads = {r["b"]: r["head"] for r in ids.groupBy(bucket("key").alias("b")).agg(F.max("key").alias("head")).collect()}  # one row for each range
    used = sorted(heads)
    before = {heads[b]: used[i - 1] for i, b in enumerate(used)}  # the first range follows the last

    def places(column: pa.Array) -> pa.Array:
        own = found(column)
        rows = [[(int(b), 0)] if k not in before else [(int(b), 0), (before[k], 1)] for b, k in zip(own, column.to_pylist())]
        return pa.array([[{"bucket": b, "tail": t} for b, t in row] for row in rows], pa.list_(pa.struct([("bucket", pa.int32()), ("tail", pa.int32())])))

    place = F.arrow_udf(places, "array<struct<bucket: int, tail: int>>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key")).withColumn("p", F.explode(place("key")))
    return rows.select("doc_id", "text", "p.bucket", "p.tail", "key").repartition(max(len(used), 1), "bucket")\
        .sortWithinPartitions("bucket", "tail", F.desc("key"), "text").select("doc_id", "text", "tail").mapInArrow(_compared, COMPARED)
