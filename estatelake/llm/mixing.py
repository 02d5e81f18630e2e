"""Mixing sources to target weights by fitting each source's budget exactly to documents.

Documents are counted by (source, size in words): that histogram, not the documents, is what a source's plan is
made from. Whole repetitions of the source come first. For the rest of the budget every length gives its share,
the longest lengths then close the gap down to a fixed window, and a bounded-knapsack dynamic programme over
lengths and their remaining counts hits what is left. Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from estatelake.llm.textkit import word_counts
from estatelake.session import stored

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
#: words that the dynamic programme fits at most
WINDOW = 1 << 16
#: documents of one source and length that are ranked in one task
BUCKET = 10_000
BROADCAST_IDS = 1_000_000


@F.arrow_udf(LongType())
def words_in(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    for column in text:
        yield pa.array(word_counts(column), pa.int64())


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size to take, so that their words come to ``budget`` or as close below as possible.

    ``sizes`` are positive and differ. Sums above the window are fixed first; within it the fit is the best there is.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(n) * budget // total for n in counts], np.int64)
    rest = budget - int((take * sizes).sum())
    left = counts - take
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= window:
            break
        n = min(int(left[i]), -(-(rest - window) // int(sizes[i])), rest // int(sizes[i]))
        take[i] += n
        left[i] -= n
        rest -= n * int(sizes[i])
    # subset sums as bits of one integer; counts are split into powers of two
    mask, reach, steps = (1 << rest + 1) - 1, 1, []
    for i in np.argsort(sizes, kind="stable"):
        free, part = min(int(left[i]), rest // int(sizes[i])), 1
        while free > 0 and not reach >> rest & 1:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= reach << part * int(sizes[i]) & mask
            free -= part
            part *= 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= part * int(sizes[i])
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """Histogram of one source to its plan."""
    rows = rows.sort_values("size", ignore_index=True)
    whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    times = min(int(target // whole), CAP) if whole else 0
    budget = round(target - times * whole) if whole and times < CAP else 0
    some = (rows["size"] > 0).to_numpy()
    extra = np.zeros(len(rows), np.int64)
    extra[some] = fit_counts(rows["size"].to_numpy(np.int64)[some], rows["n"].to_numpy(np.int64)[some], budget)
    return pd.DataFrame({"nameless": rows["nameless"], "name": rows["name"], "size": rows["size"], "n": rows["n"], "source_size": whole, "target": target, "times": times, "extra": extra})


def _taken(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, nameless, name, content (hash of the text), size, source_size, target, times."""
    if cap != CAP:
        raise ValueError(f"the plan is made for a cap of {CAP}")
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("nameless"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), F.xxhash64(F.col(text_col)).alias("content"), words_in(F.col(text_col)).alias("size")), "sizes")
    key = ["nameless", "name", "size"]
    counts = stored(sized.groupBy(*key).agg(F.count("*").alias("n")), "sizes-counted")
    # one row per source from here: a closed set of labels
    order = Window.orderBy("nameless", "name")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    sources = counts.groupBy("nameless", "name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("w", weight.cast("double")).withColumn("cap", cap * F.col("source_size").cast("double"))
    everything = Window.orderBy(F.col("cap") / F.col("w"), "nameless", "name")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    open_level = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"]
    targets = sources.withColumn("water", open_level).withColumn("target", F.least("cap", F.coalesce(F.col("water") * F.col("w"), "cap"))).select("nameless", "name", "source_size", "target")
    plan = counts.join(targets, ["nameless", "name"]).groupBy("nameless", "name").applyInPandas(_plan, "nameless boolean, name string, size long, n long, source_size long, target double, times long, extra long")
    plan = stored(plan, "mixing-plan")
    # a length with many documents is ranked in buckets of its hash, with the counts of the buckets before
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), "content"), F.lit(seed))
    dealt = sized.join(plan, key).withColumn("row", row).withColumn("bucket", F.pmod("row", F.ceil(F.col("n") / BUCKET)))
    part = [*key, "bucket"]
    ahead = dealt.where(F.col("n") > BUCKET).groupBy(*part).agg(F.count("*").alias("here"))
    ahead = ahead.withColumn("ahead", F.sum("here").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("here")
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("row", "doc_id", "content")) + F.coalesce("ahead", F.lit(0))
    ranked = dealt.join(ahead, part, "left").withColumn("times", F.col("times") + (rank <= F.col("extra")).cast("long"))
    return ranked.select("doc_id", "nameless", "name", "content", "size", "source_size", "target", "times")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, times, taken (= times * size).

    Sources in code-point order, null last, get the weights in turn and share the words of all documents by
    weight; a target stops at ``cap`` times its source's words and the excess is shared out again. A document without
    words is taken as often as its whole source is. A source without words has the target 0. An empty table
    gives no rows. Reruns agree; of equal rows it does not matter which is taken.
    """
    taken = _taken(docs, weights, cap, seed, id_col, text_col, source_col)
    return taken.select("doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, rows without an id too.

    Rows are found again by id, source and a hash of the text; of rows that agree in these it does not matter which is taken once more.
    """
    key = ["_id", "_nameless", "_name", "_content"]
    times = _taken(docs, weights, cap, seed, id_col, text_col, source_col).groupBy(*(F.col(c[1:] if c != "_id" else "doc_id").alias(c) for c in key))\
        .agg(F.min("times").alias("_times"), (F.sum("times") - F.count("*") * F.min("times")).alias("_more"), F.count("*").alias("_rows"))
    # rows of one source and length differ by one repetition at most
    times = stored(times.where("_times > 0 or _more > 0"), "mixed-rows")
    if times.count() <= BROADCAST_IDS:
        times = F.broadcast(times)
    marked = docs.withColumns({"_i": F.col(id_col), "_n": F.col(source_col).isNull(), "_s": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_c": F.xxhash64(F.col(text_col))})
    found = marked.join(times, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_nameless")) & (F.col("_s") == F.col("_name")) & (F.col("_c") == F.col("_content")))
    some = (F.col("_more") > 0) & (F.col("_more") < F.col("_rows"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    even = found.where(~some).withColumn("_times", F.col("_times") + (F.col("_more") > 0).cast("long"))
    uneven = found.where(some).withColumn("_times", F.col("_times") + (number <= F.col("_more")).cast("long")).where("_times > 0")
    return even.unionByName(uneven).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)
