"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors are dealt into shards by a hash of their id; each shard's task builds one tree. For inner products the vectors get one
more component that makes all of a shard equally long (queries get 0 there and that length), which turns the largest
product into the least Euclidean distance. A tree node knows a vantage point and the range of distances to it on
either side. By the triangle inequality no point of a side is nearer to a query than the gap between the query's distance and that
range; a side is skipped when the gap exceeds ``factor`` times the distance of the worst neighbour kept so far. With
factor 1 the search is exact; less skips more. Queries visit trees in blocks: every block meets every shard once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelake.session import stored

SHARD = 8_192
LEAF = 512
K = 20
FACTOR = 0.9
EVERY = 20
SEED = 5


class Tree:
    """Points in leaf order and nodes (vantage point, ranges, children or leaf bounds) as arrays."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        norms = (points * points).sum(1)
        self.length = float(np.sqrt(norms.max())) if len(points) else 0.0
        self.lift = np.sqrt(np.maximum(self.length**2 - norms, 0))
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []

        def build(start: int, end: int) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            own = order[start:end].copy()
            if end - start <= leaf:
                self.nodes[at] = (start, end)
                return at
            # of a few points the one from which distances vary most
            tried = [(v, self._distances(points, self.lift, own, v)) for v in rng.choice(own, min(4, len(own)), replace=False)]
            vantage, d = max(tried, key=lambda t: t[1].var())
            by = np.lexsort((ids[own], d))
            order[start:end], d = own[by], d[by]
            mid = (end - start) // 2
            ranges = (d[0], d[mid - 1], d[mid], d[-1])
            self.nodes[at] = (int(vantage), ranges, build(start, start + mid), build(start + mid, end))
            return at

        if len(ids):
            build(0, len(ids))
        self.vantage_points = {n[0]: (points[n[0]], self.lift[n[0]]) for n in self.nodes if len(n) == 4}
        self.ids, self.points = ids[order], points[order]

    def _distances(self, points, lift, own, v) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.length**2 - 2 * (points[own] @ points[v] + lift[own] * lift[v]), 0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, product) of up to ``k`` points for each query, without the points that share its id."""
        n = len(queries)
        best = np.full((n, k), -np.inf)
        found = np.full((n, k), np.iinfo(np.int64).max)
        scale = self.length / np.maximum(np.sqrt((queries * queries).sum(1)), 1e-300)

        def distance(product, q):
            return np.sqrt(np.maximum(2 * self.length**2 - 2 * scale[q] * product, 0))

        def leaf(start, end, q):
            x, ids = self.points[start:end], self.ids[start:end]
            rough = queries[q] @ x.T
            rough[ids[None, :] == query_ids[q][:, None]] = -np.inf
            worst = best[q, -1]
            r, c = np.nonzero(rough >= np.where(np.isfinite(worst), worst - 1e-9 * np.abs(worst) - 1e-300, -1e300)[:, None])
            if not len(r):
                return
            exact = (queries[q[r]] * x[c]).sum(1)
            rows = np.unique(r)
            row = np.concatenate((r, np.repeat(rows, k)))
            score = np.concatenate((exact, best[q[rows]].ravel()))
            ident = np.concatenate((ids[c], found[q[rows]].ravel()))
            by = np.lexsort((ident, -score, row))
            row, score, ident = row[by], score[by], ident[by]
            first = np.searchsorted(row, rows)
            pick = first[:, None] + np.arange(k)
            best[q[rows]], found[q[rows]] = score[pick], ident[pick]

        def visit(at, q):
            if not len(q):
                return
            node = self.nodes[at]
            if len(node) == 2:
                leaf(*node, q)
                return
            vantage, (low0, high0, low1, high1), inner, outer = node
            point, _ = self.vantage_points[vantage]
            d = distance(queries[q] @ point, q)
            first = d <= (high0 + low1) / 2
            gap0 = np.maximum(np.maximum(d - high0, low0 - d), 0)
            gap1 = np.maximum(np.maximum(d - high1, low1 - d), 0)
            for child, gap, mine in ((inner, gap0, first), (outer, gap1, ~first), (outer, gap1, first), (inner, gap0, ~first)):
                if mine.any():
                    s = q[mine]
                    full = np.isfinite(best[s, -1])
                    reach = np.full(len(s), np.inf)
                    reach[full] = distance(best[s[full], -1], s[full])
                    visit(child, s[gap[mine] <= factor * reach + 1e-9 * self.length])

        if len(self.ids) and n:
            visit(0, np.arange(n))
        r, c = np.nonzero(found != np.iinfo(np.int64).max)
        return r, found[r, c], best[r, c]


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _shard(every: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        ids, x = rows.column("vec_id").to_numpy(), _vectors(rows.column("embedding"))
        by = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[by], x[by]
        once = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
        ids, x = ids[once], x[once]
        asked = ids % every == 0
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "points": pa.array([x.tobytes()], pa.binary()),
            "query_ids": pa.array([ids[asked].tobytes()], pa.binary()), "queries": pa.array([x[asked].tobytes()], pa.binary()),
        })

    return run


def _searched(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != (row["dim"], row["shard"]):
                    held = row["dim"], row["shard"]
                    ids = np.frombuffer(row["ids"], np.int64)
                    tree = Tree(ids, np.frombuffer(row["points"]).reshape(len(ids), -1))
                asked = np.frombuffer(row["query_ids"], np.int64)
                q, ids, score = tree.search(asked, np.frombuffer(row["queries"]).reshape(len(asked), -1), k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = K, factor: float = FACTOR, every: int = EVERY, shard_rows: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors of each vector whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller id. Candidates are all vectors of the same length
    but those that share the query's id. Vectors that are null, empty or zero or hold null or non-finite
    components take no part, nor do null ids. Of rows that share an id the first (by components) counts. With fewer candidates
    than ``k`` all are returned; an empty table gives no rows; other columns are not read.
    """
    x = F.col("embedding")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0))
    shards = max(1, -(-good.count() // shard_rows))
    dealt = good.withColumn("dim", F.size(x)).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    parts = stored(dealt.groupBy("dim", "shard").applyInArrow(_shard(every), "dim int, shard int, ids binary, points binary, query_ids binary, queries binary"), "vector-shards")
    blocks = parts.where("length(query_ids) > 0").select("dim", "query_ids", "queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    met = parts.select("dim", "shard", "ids", "points").join(blocks, ["dim", "shard"]).select("dim", "shard", "ids", "points", "query_ids", "queries")
    found = met.mapInArrow(_searched(k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
