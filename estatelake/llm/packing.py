"""Best-fit packing of documents into training sequences under conflicts.

Documents are dealt into shards of bounded size by a hash. In a shard, pieces go in order of falling size into the
bin with the least residual that still holds them (best fit), provided that the bin has no document of the same
duplicate cluster and not yet too many of the same source. Bins stand in lists by residual; each carries a bitmap
of the sources that are full in it and one of the clusters in it. The search goes from the piece's size to
the next larger residual until it meets the tightest compatible bin. A document longer than a bin fills bins of its own and only its
end is packed: nothing is cut away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.llm.mixing import words_in
from estatelake.llm.ngram_join import row_components, row_key
from estatelake.session import stored

CAPACITY = 2048
SHARD = 20_000
PER_SOURCE = 8
OUT = "doc_id long, source string, copy int, piece int, bin string, bin_start int, first_word long, n_words long"


class Bins:
    """Bins by residual, each with a bitmap of full sources and one of clusters."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # bit r: there is a bin with the residual r
        self.residual: list[int] = []
        self.full: list[int] = []
        self.clusters: list[int] = []
        self.held: list[dict[int, int]] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) of a piece; ``cluster`` below 0 conflicts with nothing."""
        r = size
        ahead = self.filled >> r
        bit_s, bit_c = 1 << source, 1 << cluster if cluster >= 0 else 0
        while ahead:
            r += (ahead & -ahead).bit_length() - 1  # the successor among the residuals
            row = self.by_residual[r]
            for k in range(len(row) - 1, -1, -1):
                b = row[k]
                if not self.full[b] & bit_s and not self.clusters[b] & bit_c:
                    row[k] = row[-1]
                    row.pop()
                    if not row:
                        self.filled &= ~(1 << r)
                    return b, self._add(b, size, source, bit_s, bit_c)
            r += 1
            ahead = self.filled >> r
        b = len(self.residual)
        self.residual.append(self.capacity)
        self.full.append(0)
        self.clusters.append(0)
        self.held.append({})
        return b, self._add(b, size, source, bit_s, bit_c)

    def _add(self, b: int, size: int, source: int, bit_s: int, bit_c: int) -> int:
        start = self.capacity - self.residual[b]
        self.residual[b] -= size
        self.clusters[b] |= bit_c
        n = self.held[b][source] = self.held[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full[b] |= bit_s
        if r := self.residual[b]:
            self.by_residual[r].append(b)
            self.filled |= 1 << r
        return start


def _pack(capacity: int, per_source: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(rest=rows["size"] % capacity).sort_values(["rest", "size", "doc_id", "cluster"], ascending=[False, False, True, True], ignore_index=True, na_position="last")
        shard = int(rows["shard"].iloc[0])
        sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        many = rows["cluster"].map(rows["cluster"].value_counts()).to_numpy() > 1  # a cluster of one needs no bit
        clusters = np.full(len(rows), -1)
        clusters[many] = pd.factorize(rows["cluster"][many])[0]
        copies = rows.groupby("doc_id", dropna=False).cumcount()
        bins, whole, out = Bins(capacity, per_source), 0, []
        for doc, source, size, rest, copy, s, c in zip(rows["doc_id"], rows["source"], rows["size"], rows["rest"], copies, sources.tolist(), clusters.tolist()):
            doc = None if pd.isna(doc) else int(doc)
            for piece in range(size // capacity):
                out.append((doc, source, copy, piece, f"{shard}-w{whole}", 0, piece * capacity, capacity))
                whole += 1
            if rest:
                b, start = bins.place(int(rest), s, c)
                out.append((doc, source, copy, size // capacity, f"{shard}-{b}", start, size - rest, rest))
            elif not size:
                out.append((doc, source, copy, 0, None, None, 0, 0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64", "bin_start": "Int32"})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """Where each document goes: doc_id, source, copy, piece, bin, bin_start, first_word, n_words.

    Pieces of a document, in order, make up all its words. ``cluster_col`` names its duplicate cluster; without
    one, equal texts are a cluster. Rows that share an id and text (``copy`` numbers them) never share a bin. A null cluster conflicts
    with nothing, a null source counts as a source. A document without words has one row with a null bin. An
    empty table gives none. Shards hold about ``shard_rows`` rows; a hot source or cluster is spread over all of them.
    """
    cluster = F.xxhash64(F.col(text_col)) if cluster_col is None else F.col(cluster_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).alias("content"), words_in(F.col(text_col)).alias("size"))
    rows = stored(rows, "packing-sizes")
    shards = max(1, -(-rows.count() // shard_rows))
    # without repeated copies of one row in mind, an id alone would do; a null id is dealt by its content
    shard = F.pmod(F.xxhash64("doc_id", "content"), F.lit(shards))
    return rows.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack(capacity, per_source), OUT)


def pack_apart(docs: DataFrame, **options) -> DataFrame:
    """``pack`` with near copies (five-word shingles, similarity of 0.8) as clusters; columns doc_id, text and source."""
    clusters = row_components(docs).select(F.col("row").alias("_row"), F.col("component").alias("_component"))
    marked = docs.select("doc_id", "text", "source").withColumn("_row", row_key()).join(clusters, "_row", "left")
    return pack(marked, cluster_col="_component", **options)
