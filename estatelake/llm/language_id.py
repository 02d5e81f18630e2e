"""Language identification by rank-order profiles of n-grams.

A profile is a language's ``TOP`` most frequent letter n-grams (one to three letters, word edges counting as a
letter) in order of frequency. A document's own most frequent n-grams are compared with each profile: an n-gram
costs the distance between its two ranks ("out of place"), at most ``TOP`` where the profile lacks it. The least
sum wins. Sorting and ranking run on whole Arrow batches in numpy; only profiles reach the driver, ``TOP`` rows
for each language of the closed label set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.textkit import code_points, pieces, utf8

#: n-grams in a profile
TOP = 400
#: bound of the labelled sample that profiles are fitted on, in expectation, for each language
ROWS_PER_LANGUAGE = 5_000
UNDETERMINED = "und"
NONE = 0x1FFFFF  # stands for "no further letter"; above every code point
_BYTES, _ROWS = 1 << 20, 512


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 for all that are no letters."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _counted(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count), by group and n-gram; ``group``: small numbers, one for each row."""
    cp, at = code_points(raw, offsets)
    rows = len(at) - 1
    letter = np.insert(_letters()[cp], at[:-1], 0)  # a word edge before each row
    row = np.repeat(np.arange(rows), np.diff(at) + 1)
    keep = letter != 0
    keep[1:] |= letter[:-1] != 0
    keep[at[:-1] + np.arange(rows)] = True
    letter, row = letter[keep], row[keep]
    seen = np.zeros(0x110000, bool)
    seen[letter] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    ids = np.zeros(0x110000, np.uint64)
    ids[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    bits = np.uint64(len(alphabet).bit_length())
    z = np.concatenate((ids[letter], np.zeros(2, np.uint64)))
    owner = group.astype(np.uint64)[row] << (np.uint64(3) * bits + np.uint64(2))
    i0, i1, i2 = z[:-2], z[1:-1], z[2:]
    edge0, edge1 = i0 == 0, i1 == 0
    keys = [
        (owner | i0)[~edge0],
        (owner | np.uint64(1) << (np.uint64(3) * bits) | i0 << bits | i1)[~(edge0 & edge1)],
        (owner | np.uint64(2) << (np.uint64(3) * bits) | i0 << (bits + bits) | i1 << bits | i2)[~edge1],
    ]
    # the pair "letter, edge" and the like stay; a single letter between edges is both a pair and a triple
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    part = lambda k: alphabet[((key >> (bits * np.uint64(k))) & mask).astype(np.int64)]
    order = (key >> (np.uint64(3) * bits)) & np.uint64(3)
    gram = np.where(order == 0, part(0) << 42 | NONE << 21 | NONE, np.where(order == 1, part(1) << 42 | part(0) << 21 | NONE, part(2) << 42 | part(1) << 21 | part(0)))
    return (key >> (np.uint64(3) * bits + np.uint64(2))).astype(np.int64), gram, count


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, group = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        raw, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets, _BYTES, _ROWS):
            lang, gram, count = _counted(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], group[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(names[lang], pa.string()), pa.array(gram, pa.int64()), pa.array(count, pa.int64())], names=["lang", "gram", "n"])


def fit_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, top: int = TOP) -> pd.DataFrame:
    """(lang, gram, rank) learned from rows with a language and an id.

    A language with more than ``rows_per_language`` rows is fitted on a sample of about that many, chosen by a
    hash of the id; smaller ones on all their rows. Whole texts are counted. Ties in frequency go by the letters.
    Null texts and texts without letters add nothing; a language without any letter is not learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null")
    share = rows.groupBy("lang").count().select("lang", (F.lit(float(rows_per_language)) / F.col("count")).alias("share"))
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counts = sample.select("lang", "text").mapInArrow(_count_languages, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).where(F.col("rank") < top).select("lang", "gram", "rank").toPandas()


def language_column(profiles: pd.DataFrame, top: int = TOP):
    """A column function from text to struct(lang_pred, score).

    ``score`` is 1 less the mean out-of-place distance as a part of ``top``. A null text, one without letters, and any
    text when no language was learned get ``und`` and 0. Equal distances go to the first language by code point.
    """
    names = sorted(profiles["lang"].unique())
    vocabulary, where = np.unique(profiles["gram"].to_numpy(np.int64), return_inverse=True)
    ranks = np.full((len(vocabulary) + 1, len(names)), top, np.int32)  # the last row: n-grams of no profile
    if len(names):
        ranks[where, np.searchsorted(np.array(names, object), profiles["lang"].to_numpy(object))] = profiles["rank"]

    def predicted(text: pa.Array) -> pa.Array:
        raw, offsets = utf8(text)
        best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in pieces(offsets, _BYTES, _ROWS):
            doc, gram, count = _counted(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], np.arange(b - a))
            some = np.bincount(doc, minlength=b - a) > 0
            # by row, falling count and n-gram, as one integer
            wide = np.uint64(len(doc).bit_length())
            tall = np.uint64(int(count.max()).bit_length()) if len(count) else np.uint64(0)
            order = np.sort((doc.astype(np.uint64) << tall | (np.uint64(1) << tall) - np.uint64(1) - count.astype(np.uint64)) << wide | np.arange(len(doc), dtype=np.uint64))
            order = (order & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64)
            start = np.searchsorted(doc, np.arange(b - a))
            rank = np.arange(len(doc)) - start[doc]
            order, rank = order[rank < top], rank[rank < top]
            d, g = doc[order], gram[order]
            at = np.searchsorted(vocabulary, g)
            at[at == len(vocabulary)] = len(vocabulary) - 1
            at[vocabulary[at] != g] = len(vocabulary)
            mine = ranks[at]
            cost = np.where(mine == top, top, np.abs(mine - rank[:, None]))
            total = np.stack([np.bincount(d, cost[:, k], b - a) for k in range(len(names))], 1)
            size = np.bincount(d, minlength=b - a)
            pick = total.argmin(1)
            best.append(np.where(some, pick, -1))
            score.append(np.where(some, 1 - total[np.arange(b - a), pick] / np.maximum(size, 1) / top, 0.0))
        labels = np.array([*names, UNDETERMINED], object)
        return pa.StructArray.from_arrays([pa.array(labels[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score), pa.float64())], names=["lang_pred", "score"])

    def undetermined(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([UNDETERMINED] * len(text), pa.string()), pa.array([0.0] * len(text), pa.float64())], names=["lang_pred", "score"])

    fn = predicted if len(names) else undetermined
    # marked so that a filter on the result does not make the planner run it twice, with two Python workers a task
    return F.arrow_udf(fn, "lang_pred string, score double").asNondeterministic()


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Profiles are learned from the rows that are not held out; a prediction sees the text alone. Rows of an empty
    table give none; repeated rows give repeated results; other columns are not read.
    """
    fold = held_out(id_col)
    profiles = fit_profiles(docs.where(~fold), lang_col, text_col, id_col)
    found = language_column(profiles)(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")
