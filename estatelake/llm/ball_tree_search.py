"""Ranked lexical search as exact inner-product search in sparse ball trees.

A document is a sparse vector with an entry for each of its terms, the term's saturated frequency times its weight; an item asks for
the sum of the entries of its own terms, an inner product with a vector of ones. Entries and sums are whole numbers.

*Trees.* Documents are taken as they lie, in shards of bounded rows and entries, without a shuffle. A shard is halved again and again: the
document furthest from the centroid and the one furthest from that one are the two poles, and a half goes to each. A node
knows its centroid, its radius (the largest distance of a document to the centroid) and its radius by term: by how much
any document's entry exceeds the centroid's.

*Bounds.* No document of a node has more than ``sum of the centroid's entries + sqrt(number of terms) * radius``, nor more than
``sum over terms of (centroid + radius of the term)``. The first is in doubles and rounded up by more than its error; the second is, per term,
the largest entry in the node, so it is kept as a whole number and exact. The smaller one counts.

*Search.* First every shard scores a few documents of its most promising leaves; the k-th best of all of these is a bound from below for
each item. Then shards are searched best first: the node with the highest bound is opened next, and subtrees that cannot reach the
k-th best, by score or, at an equal score, by id, are never opened. Leaves are scored exactly in whole numbers.

Only terms of items matter to inner products, so vectors keep no others. Items are taken in blocks of bounded text; a block's terms, weights
and bounds are what the driver holds and broadcasts. Document frequencies, lengths and all candidates stay distributed.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.textkit import utf8
from estatelake.session import remove_folder, work_dir

K = 10
#: documents and entries of a shard, documents of a leaf
SHARD_ROWS, SHARD_ENTRIES, LEAF = 4096, 1_000_000, 4
#: documents that each shard scores for the first bound of an item
TRIED = 24
#: characters of items that are searched together; a longer item stands alone
BLOCK_CHARS = 4_000_000
#: shards in an Arrow batch: a row of the tree table has many megabytes
SHARDS_A_BATCH = 4
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_NO_ID = np.iinfo(np.int64).max
_SPLIT = bytes(c + 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_SPLIT).split()


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = end - start
    return np.repeat(end - np.cumsum(size), size) + np.arange(int(size.sum()))


class Shard:
    """Documents of a shard (ids, offsets, terms and whole-number entries) in the order of their tree.

    Nodes are numbered like a heap: 2i + 1 and 2i + 2 below i; a node at some depth holds an equal share of the rows.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, term: np.ndarray, value: np.ndarray, radius: np.ndarray | None = None):
        self.ids, self.at, self.term, self.value, self.radius = ids, at, term, value, radius
        self.depth = 0
        while (len(ids) >> self.depth) > LEAF:
            self.depth += 1
        self.nodes = (2 << self.depth) - 1
        cuts = [np.array([len(ids) * i >> d for i in range((1 << d) + 1)]) for d in range(self.depth + 1)]
        self.low, self.high = (np.concatenate([c[side: len(c) - 1 + side] for c in cuts]) for side in (0, 1))

    @classmethod
    def built(cls, ids: np.ndarray, at: np.ndarray, term: np.ndarray, value: np.ndarray) -> Shard:
        plan = cls(ids, at, term, value)
        width = int(term.max()) + 1 if len(term) else 1
        v = value.astype(float)
        norm = np.bincount(np.repeat(np.arange(len(ids)), np.diff(at)), v * v, len(ids))
        order, radius = np.arange(len(ids)), np.zeros(plan.nodes)
        for node in range(plan.nodes):
            lo, hi = plan.low[node], plan.high[node]
            rows = order[lo:hi]
            take = _spread(at[rows], at[rows + 1])
            t, x, who = term[take], v[take], np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows])

            def along(direction: np.ndarray) -> np.ndarray:
                return np.bincount(who, x * direction[t], len(rows))

            centre = np.bincount(t, x, width) / max(len(rows), 1)
            square = float(centre @ centre)
            far = norm[rows] - 2 * along(centre) + square
            if len(rows):
                # the slack is far above the rounding error of the three sums
                radius[node] = np.sqrt(max(float(far.max()), 0.0) + 1e-9 * (float(norm[rows].max()) + square)) * (1 + 1e-12)
            if 2 * node + 1 < plan.nodes:
                def pole(i: int) -> np.ndarray:
                    out = np.zeros(width)
                    out[t[who == i]] = x[who == i]
                    return out

                first = pole(int(far.argmax()))
                second = pole(int((norm[rows] - 2 * along(first)).argmax()))
                middle = plan.high[2 * node + 1] - lo
                by = np.argsort(-along(first - second), kind="stable")
                order[lo:hi] = rows[np.concatenate((np.sort(by[:middle]), np.sort(by[middle:])))]
        take = _spread(at[order], at[order + 1])
        return cls(ids[order], np.append(0, np.cumsum(np.diff(at)[order])), term[take], value[take], radius)

    def summarise(self) -> None:
        """For each (term, node): the largest entry and the centroid's; for each node its smallest id."""
        leaves = 1 << self.depth
        leaf = np.repeat(np.arange(leaves), np.diff(self.at[np.append(self.low[-leaves:], len(self.ids))])) + leaves - 1
        key, top, total = self.term.astype(np.int64) * self.nodes + leaf, self.value, self.value.astype(float)
        levels = []
        for depth in range(self.depth, -1, -1):
            order = np.argsort(key, kind="stable")
            key, top, total = key[order], top[order], total[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            key, top, total = (key[begin], np.maximum.reduceat(top, begin), np.add.reduceat(total, begin)) if len(begin) else (key, top, total)
            levels.append((key, top, total))
            term, node = np.divmod(key, self.nodes)
            key = term * self.nodes + (node - 1) // 2
        key, top, total = (np.concatenate(x) for x in zip(*levels))
        order = np.argsort(key, kind="stable")
        self.key, self.top = key[order], top[order].astype(float)
        size = np.maximum(self.high - self.low, 1)
        self.centre = total[order] / size[self.key % self.nodes]
        self.least = np.array([self.ids[a:b].min() if b > a else _NO_ID for a, b in zip(self.low, self.high)])

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each node what no document in it exceeds."""
        take = _spread(np.searchsorted(self.key, terms * self.nodes), np.searchsorted(self.key, (terms + 1) * self.nodes))
        node = self.key[take] % self.nodes
        by_term = np.bincount(node, self.top[take], self.nodes)
        if by_term.max(initial=0) >= 2.0 ** 53:  # beyond whole numbers of doubles
            by_term *= 1 + 1e-9
        ball = np.bincount(node, self.centre[take], self.nodes) + np.sqrt(len(terms)) * self.radius
        return np.minimum(by_term, np.floor(ball * (1 + 1e-9) + 1))

    def scores(self, leaf: int, wanted: np.ndarray) -> list[tuple[int, int]]:
        """(-score, id) of a leaf's documents, exact; ``wanted`` marks the item's terms."""
        lo, hi = int(self.low[leaf]), int(self.high[leaf])
        a, b = int(self.at[lo]), int(self.at[hi])
        sums = np.append(0, np.cumsum(np.where(wanted[self.term[a:b]], self.value[a:b], 0)))
        cut = self.at[lo: hi + 1] - a
        return [(-s, i) for s, i in zip((sums[cut[1:]] - sums[cut[:-1]]).tolist(), self.ids[lo:hi].tolist()) if s > 0]

    def search(self, terms: np.ndarray, wanted: np.ndarray, k: int, floor: tuple[int, int] = (-1, _NO_ID), tried: int | None = None, seen: list | None = None) -> list[tuple[int, int]]:
        """The ``k`` best (-score, id), best first, that are not worse than ``floor``.

        With ``tried``, stops after so many documents. ``seen`` receives the number of nodes opened.
        """
        bound = self.bounds(terms)
        heap, best, left, opened = [(-bound[0], 0)], [], tried, 0
        wanted[terms] = True
        while heap:
            negative, node = heapq.heappop(heap)
            # the worst that still counts: the floor, or the k-th best so far
            last = min(floor, best[k - 1]) if len(best) >= k else floor
            if negative > last[0]:
                break
            if negative == 0 or negative == last[0] and self.least[node] > last[1]:
                continue
            opened += 1
            if 2 * node + 1 < self.nodes:
                for child in (2 * node + 1, 2 * node + 2):
                    # a child's bound is never above its parent's
                    heapq.heappush(heap, (max(-bound[child], negative), child))
            else:
                best = sorted(best + self.scores(node, wanted))[:k]
                if left is not None and (left := left - int(self.high[node] - self.low[node])) <= 0:
                    break
        wanted[terms] = False
        if seen is not None:
            seen.append(opened)
        return [b for b in best if b <= floor]


VECTORS = "doc_id long, n long, term array<int>, tf array<int>"
TREES = "rows long, ids binary, at binary, term binary, value binary, radius binary, item array<int>, score array<long>, id array<long>"
RESULT = "item_id long, rank int, doc_id long, score long"
FOUND = "item int, doc_id long, score long"


def _vectors(vocabulary):
    """Rows (doc_id, text) to lengths and frequencies of the terms that items have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            data, lengths, at, term, tf = raw.tobytes(), [], [0], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found = terms_of(data[a:b])
                counted = Counter(map(number, found))
                counted.pop(None, None)
                lengths.append(len(found))
                term.extend(counted)
                tf.extend(counted.values())
                at.append(len(term))
            offset = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offset, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offset, pa.array(tf, pa.int32()))], names=["doc_id", "n", "term", "tf"])

    return run


def _entries(n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Whole-number entries: term weight times saturated frequency."""
    # whole numbers of Python: 90 * n * N may pass 64 bits in a large corpus
    m = np.array([10 + 90 * x * documents // words for x in n.tolist()], np.int64) if words else np.zeros(len(n), np.int64)
    tf = tf.astype(np.int64)
    return weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at))))


def _trees(state, documents: int, words: int, k: int):
    """Vectors to shards with their trees, and for each item the best of a few documents."""
    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = rows.column("doc_id").fill_null(_NO_ID).to_numpy()
        lists = [rows.column(c).combine_chunks() for c in ("term", "tf")]
        lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
        at = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        term, tf = (c.flatten().to_numpy().astype(np.int32) for c in lists)
        weight, items = state.value
        tree = Shard.built(ids, at, term, _entries(rows.column("n").to_numpy(), at, term, tf, weight, documents, words))
        tree.summarise()
        wanted, found = np.zeros(len(weight), bool), []
        for i, terms in enumerate(items):
            found.extend((i, -s, d) for s, d in tree.search(terms, wanted, k, tried=TRIED))
        columns = [[c] for c in ([x for x, _, _ in found], [x for _, x, _ in found], [x for _, _, x in found])]
        return pa.RecordBatch.from_arrays([
            pa.array([len(ids)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (tree.ids, tree.at, tree.term, tree.value, tree.radius)),
            pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.int64()))], names=[c.split()[0] for c in TREES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, entries = [], 0, 0
        for batch in batches:
            start = 0
            sizes = np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            while start < batch.num_rows:
                before = int(sizes[start - 1]) if start else 0
                fit = int(np.searchsorted(sizes, before + SHARD_ENTRIES - entries, side="right")) - start
                take = min(max(fit, 0 if held else 1), SHARD_ROWS - rows, batch.num_rows - start)
                if take > 0:
                    held.append(batch.slice(start, take))
                    start, rows, entries = start + take, rows + take, entries + int(sizes[start + take - 1]) - before
                if take <= 0 or rows >= SHARD_ROWS or entries >= SHARD_ENTRIES:
                    yield shard(held)
                    held, rows, entries = [], 0, 0
        if held:
            yield shard(held)

    return run


def _searched(state, floors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items = state.value
        wanted = np.zeros(len(weight), bool)
        for batch in batches:
            for row in batch.to_pylist():
                tree = Shard(*(np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("at", np.int64), ("term", np.int32), ("value", np.int64), ("radius", float))))
                tree.summarise()
                found = [(i, d, -s) for i, terms in enumerate(items) for s, d in tree.search(terms, wanted, k, floors.value[i])]
                item, doc, score = zip(*found) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([None if d == _NO_ID else d for d in doc], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _block(texts: DataFrame, block: list[tuple[int | None, str]], k: int, folder: str) -> str:
    """Searches a block of items (id, text) and names the folder of its results."""
    spark = texts.sparkSession
    context = spark.sparkContext
    of_items = [sorted(set(terms_of(text.encode()))) for _, text in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*of_items)))}
    items = [np.array([vocabulary[t] for t in terms], np.int64) for terms in of_items]

    def kept(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        before = spark.conf.get(_ARROW_ROWS)
        try:
            spark.conf.set(_ARROW_ROWS, rows or before)
            df.write.parquet(f"{folder}/{name}")
        finally:
            spark.conf.set(_ARROW_ROWS, before)
        return spark.read.parquet(f"{folder}/{name}")

    vectors = kept(texts.mapInArrow(_vectors(context.broadcast(vocabulary)), VECTORS), "vectors")
    documents, words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in vectors.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():  # the block's terms at most
        df[term] = n
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    state = context.broadcast((weight, items))
    has_terms = vectors.where("size(term) > 0")
    trees = kept(has_terms.mapInArrow(_trees(state, documents, words, k), TREES), "trees")
    remove_folder(spark, f"{folder}/vectors")
    first = trees.select(F.explode(F.arrays_zip("item", "score", "id")).alias("x")).select("x.*")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    floors = [(-1, _NO_ID)] * len(items)
    for r in first.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").where(f"rank = {k}").collect():  # a row for each item
        floors[r["item"]] = (-r["score"], r["id"])
    found = trees.select("ids", "at", "term", "value", "radius").mapInArrow(_searched(state, context.broadcast(floors), k), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    kept(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "found", SHARDS_A_BATCH)  # a block's items at most
    remove_folder(spark, f"{folder}/trees")
    return f"{folder}/found"


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each row of ``items``: item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id, documents without an id last. Every row of ``docs`` is a document and every row of ``items`` an item,
    also where ids repeat. An item or a document that is null, empty or without a term finds nothing and is not found. With fewer
    documents than ``k`` all with a score are returned; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    root = work_dir(spark, "ball-trees")
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, -(-chars // BLOCK_CHARS))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    done = []
    for b in range(blocks if n else 0):
        # a block of bounded text; its items are what every shard is asked
        rows = sorted(((r["item_id"], r["text"]) for r in dealt.where(F.col("block") == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            done.append(_block(texts, rows, k, f"{root}/{b}"))
    return spark.read.parquet(*done) if done else spark.createDataFrame([], RESULT)
