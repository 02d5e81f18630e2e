"""N-gram Jaccard self-join by a token-group matrix.

Documents are sets of word shingles; two documents link when ``intersection / union`` reaches the threshold.

1. Equal sets are one class; only one document of each class goes on (copies cost nothing later).
2. Each class gets *set tokens*: the sorted shingle hashes are cut into m hash ranges, and a token names one
   range together with all shingles in it. Sets that reach the threshold differ in at most k shingles, so at
   least m - k of their tokens are equal. Single shingles would be tokens too, but one frequent passage would
   then make a matrix row as long as the corpus; a token of a range is shared by near copies only. m and k
   follow from a size class, and a set also takes the tokens of the next class if a partner may lie there.
   Of the at least m - k tokens that partners share, each may leave out its m - k - 1 most widely held ones
   (empty ranges, ranges with one frequent shingle) and still shares another one: those go, by their real counts.
3. Classes whose most widely shared token is the same form a group; one of more than ``GROUP`` classes or
   ``GROUP_SHINGLES`` shingles is dealt into parts by a hash. Every group is opened: in it, sets are compared exactly. The matrix has a
   row (token, group) for the union of each group's tokens.
4. Only components are asked for, and two sets of one component need no comparison. So a token all of whose holders are in one
   component is done. For the others, *star rounds* come first: one group of each component is opened against one group
   of the token's pivot component. A hot cluster, dealt into many groups, becomes one component in this way, with as many opened pairs as
   groups. What then remains is compared in full: sets of small components are grouped again, and a pair of groups whose token unions
   overlap is opened unless all their sets are in one component. In an opened pair the same bound on shingles (overlap of a set with the union of the other group)
   thins the sets out before sets are compared exactly.

No link between components is lost: the bounds are upper bounds, nothing is capped. The output of an opened pair is a spanning
forest of the links between its components, never the list of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.components import components
from estatelake.llm.textkit import U, mix, shingle_sets
from estatelake.session import remove_folder, stored, work_dir

GROUP = 256
GROUP_SHINGLES = 200_000
#: rounds that join one group of each component to a pivot before the rest is compared in full
STARS = 2
#: by how many shared tokens in turn a set may be away from a large component to be compared beside it
HOPS = 2
#: ids up to this many are broadcast (8 bytes each); beyond, both sides are shuffled
BROADCAST_IDS = 1_000_000


class _Plan:
    """Size classes and numbers of ranges for the threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def classes(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(class, m, k) of the class of size ``n`` and of those where a larger partner may lie."""
        while self.low[-1] <= n * self.den // self.num:
            self.low.append(max(self.low[-1] + 1, -(-3 * self.low[-1] // 2)))
        c = int(np.searchsorted(self.low, n, side="right")) - 1
        while self.low[c] <= n * self.den // self.num:
            top = self.low[c + 1] - 1 if c + 1 < len(self.low) else -(-3 * self.low[c] // 2) - 1
            k = 2 * max(top, self.low[c]) * (self.den - self.num) // (self.den + self.num)
            if k:
                yield c, k + 2 + -(-k // 5), k
            c += 1
            if c == len(self.low):
                break


@lru_cache(maxsize=512)
def _edges(m: int) -> np.ndarray:
    return np.array([(i << 64) // m for i in range(1, m)], U)


def _tokens(s: np.ndarray, plan: _Plan) -> Iterator[tuple[int, np.ndarray, int]]:
    """(class, set tokens, how many of them a partner shares at least) of a sorted set, own size class first.

    Tokens of empty ranges count as the most widely held ones: as many as may be left out are.
    """
    sums = np.zeros(len(s) + 1, U)
    np.cumsum(mix(s + U(11)), out=sums[1:])
    for c, m, k in plan.classes(len(s)):
        cut = np.concatenate(([0], np.searchsorted(s, _edges(m)), [len(s)]))
        out = mix(sums[cut[1:]] - sums[cut[:-1]] + np.arange(m, dtype=U) * U(0xA24BAED4963EE407) + np.full(1, c, U) * U(0x9FB21C651E98DF25))
        empty = np.flatnonzero(cut[1:] == cut[:-1])[: m - k - 1]  # in the order of ranges, which is the same for all sets
        yield c, np.delete(out, empty), m - k - len(empty)


SIGNED = "doc_id long, n long, h1 long, h2 long"
TOKENS = "token long, doc_id long, class int, need int"


def _signed(size: int):
    """Rows (doc_id, text) to the size of the set and 128 bits that stand for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2 = [], [], []
            for s in shingle_sets(batch.column(1), size):
                g = mix(s + U(23))
                n.append(len(s))
                h1.append(int(g.sum()) if len(s) else 0)
                h2.append(int(mix(g + U(5)).sum()) if len(s) else 0)
            signed = lambda x: pa.array(np.array(x, U).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), signed(h1), signed(h2)], names=["doc_id", "n", "h1", "h2"])

    return run


def _token_rows(size: int, num: int, den: int):
    """Rows (doc_id, text) to a row for each set token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _Plan(num, den)
        for batch in batches:
            tokens, ids, classes, needs = [np.zeros(0, U)], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size)):
                for c, found, need in _tokens(s, plan) if len(s) else ():
                    tokens.append(found)
                    ids.append(i), classes.append(c), needs.append(need)
            counts = [len(t) for t in tokens[1:]]
            spread = lambda x, kind: pa.array(np.repeat(np.array(x, np.int64), counts), kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), spread(ids, pa.int64()), spread(classes, pa.int32()), spread(needs, pa.int32())], names=["token", "doc_id", "class", "need"])

    return run


def _opened(size: int, num: int, den: int):
    """Rows (a, b, side, comp, seen, text), sorted by (a, b), to links between components.

    Sets of one component and those that were in one group (``seen``) before are not compared.
    """
    def links(comps, seen, sets, sides) -> list[tuple[int, int]]:
        left = np.flatnonzero(sides == 0)
        right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
        same = right is left
        lengths = np.array([len(s) for s in sets])
        names = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.concatenate(([0], np.cumsum(lengths)))

        def reach(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
            """Rows whose overlap with the union of ``others`` lets them reach the threshold."""
            union = np.zeros(int(names.max()) + 1, bool)
            for r in others:
                union[names[at[r]: at[r + 1]]] = True
            return np.array([r for r in rows if den * int(union[names[at[r]: at[r + 1]]].sum()) >= num * lengths[r]], np.int64)

        if not same:
            left = reach(left, right)
            right = reach(right, left)
        if not len(left) or not len(right):
            return []
        label = np.unique(comps, return_inverse=True)[1]
        forest = []
        mask = np.zeros(int(names.max()) + 1, bool)
        for i in left:
            others = right[right > i] if same else right
            # components, earlier comparisons and sizes rule out pairs first
            others = others[(label[others] != label[i]) & (seen[others] != seen[i])]
            a, b = lengths[i], lengths[others]
            others = others[den * np.minimum(a, b) >= num * np.maximum(a, b)]
            if not len(others):
                continue
            mine = names[at[i]: at[i + 1]]
            mask[mine] = True
            inter = np.add.reduceat(mask[names], at[:-1], dtype=np.int64)[others] if len(others) > 8 else np.array([np.count_nonzero(mask[names[at[j]: at[j + 1]]]) for j in others])
            mask[mine] = False
            for j in others[den * inter >= num * (a + lengths[others] - inter)]:
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    forest.append((int(comps[i]), int(comps[j])))
        return forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        group: dict = {}

        def closed():
            sides, comps, seen, sets = zip(*group.values())
            forest = links(np.array(comps), np.array(seen), list(sets), np.array(sides))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in forest], pa.int64()), pa.array([y for _, y in forest], pa.int64())], names=["u", "v"])

        for batch in batches:
            a, b, side, comps, seen = (batch.column(k).to_numpy() for k in range(5))
            for i, s in enumerate(shingle_sets(batch.column(5), size)):
                if held != (a[i], b[i]):
                    if group:
                        yield closed()
                    held, group = (a[i], b[i]), {}
                # a row that occurs twice is one node
                group.setdefault((comps[i], side[i], s.tobytes()), (side[i], comps[i], seen[i], s))
        if group:
            yield closed()

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with an id in ``ids`` (doc_id, ...), with its columns."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc_id, n, ...) with ``grp``: rows of one key together, dealt by a hash where there are too many."""
    large = rows.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("parts")).where("parts > 1")
    grp = F.xxhash64(key, F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(0))
    return rows.join(large, key, "left").withColumn("grp", grp).drop("parts")


class _Join:
    """The steps of one join, with their tables; all are removed by ``close``."""

    def __init__(self, texts: DataFrame, size: int, num: int, den: int):
        self.spark, self.texts, self.how = texts.sparkSession, texts, (size, num, den)
        self.root, self.count = work_dir(self.spark, "ngram-join"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(f"{self.root}/{self.count}")
        return self.spark.read.parquet(f"{self.root}/{self.count}")

    def drop(self, df: DataFrame) -> None:
        """A table goes after its last reader."""
        for number in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
            remove_folder(self.spark, f"{self.root}/{number}")

    def close(self) -> None:
        remove_folder(self.spark, self.root)

    def tokens(self, classes: DataFrame) -> DataFrame:
        """(token, doc_id, held): the set tokens by which partners can be found, and how many hold each."""
        # texts are read again rather than tokens kept: these are several times as large as what is shared in the end
        by_token = _only(self.texts, classes.select("doc_id")).select("doc_id", "text").mapInArrow(_token_rows(*self.how), TOKENS).repartition("token")
        held = self.keep(by_token.withColumn("held", F.count("*").over(Window.partitionBy("token"))).where("held > 1"))
        # partners share m - k tokens of a class, so each may leave out its m - k - 1 most widely held ones and still shares one
        rank = F.row_number().over(Window.partitionBy("doc_id", "class").orderBy(F.desc("held"), "token"))
        shared = self.keep(held.withColumn("rank", rank).where("rank >= need").select("token", "doc_id", "held"))
        self.drop(held)
        return shared

    def links(self, pairs: DataFrame, cells: DataFrame) -> DataFrame:
        """Links (u, v) between components, of the opened ``pairs`` (a, b) of ``cells`` (cell, doc_id, comp, seen)."""
        sides = pairs.select("a", "b", F.col("a").alias("cell"), F.lit(0).alias("side")).union(pairs.where("a != b").select("a", "b", F.col("b").alias("cell"), F.lit(1).alias("side")))
        wanted = self.keep(cells.join(sides.select("cell").distinct(), "cell"))
        # an id that occurs with several texts would bring in texts of other classes: they are one node anyway
        fetched = self.keep(_only(self.texts, wanted))
        found = self.keep(sides.join(fetched, "cell").select("a", "b", "side", "comp", "seen", "text")
                          .repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_opened(*self.how), "u long, v long"))
        self.drop(fetched)
        self.drop(wanted)
        return found

    def merged(self, state: DataFrame, links: DataFrame) -> DataFrame:
        """``state`` with the components that the links between components make."""
        tree = components(links).select(F.col("node").alias("comp"), "component")
        return self.keep(state.join(tree, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).select(*state.columns))

    def undone(self, shared: DataFrame, state: DataFrame) -> DataFrame:
        """(token, doc_id, n, part, grp, comp) of the tokens whose holders are in several components."""
        held = self.keep(shared.select("token", "doc_id").join(state, "doc_id"))
        several = held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
        out = self.keep(held.join(several, "token"))
        self.drop(held)
        return out

    def star_pairs(self, undone: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs of cells, cells): of each component its sets in one group, against the largest cell that shares a token with them.

        A cell has the sets of a component in a group. What is sent to one pivot is dealt into cells again.
        """
        cell = F.xxhash64("grp", "comp")
        cells = undone.groupBy("token", "comp", cell.alias("cell")).agg(F.count("*").alias("sets"))
        pivot = cells.groupBy("token").agg(F.max(F.struct("sets", "cell", "comp")).alias("pivot"))
        beside = cells.join(pivot, "token").where("comp != pivot.comp")
        best = beside.groupBy("comp").agg(F.max(F.struct("pivot.sets", F.col("sets").alias("mine"), "pivot.cell", F.col("cell").alias("own"))).alias("x"))
        sent = self.keep(best.select(F.col("x.cell").alias("a"), F.col("x.own").alias("cell")))
        rows = state.select("doc_id", "n", "comp", cell.alias("cell"), F.col("grp").alias("seen"))
        pivots = rows.join(sent.select(F.col("a").alias("cell")).distinct(), "cell")
        bundles = self.keep(_dealt(rows.join(sent, "cell"), "a"))
        columns = ["doc_id", "comp", "cell", "seen"]
        return bundles.select("a", F.col("grp").alias("b")).distinct(), self.keep(pivots.select(*columns).union(bundles.drop("cell").withColumnRenamed("grp", "cell").select(*columns)))

    def full_pairs(self, undone: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs of cells, cells) of all comparisons that are left.

        Sets of components of more than ``GROUP`` sets stand in cells of one component each; the others are dealt again, those
        near a large component by that one, so that few cells meet its cells.
        """
        rows = self.keep(undone.select("doc_id", "n", "part", "grp", "comp").distinct())
        big = self.keep(rows.groupBy("comp").count().where(F.col("count") > GROUP).select("comp"))
        apart = _dealt(self.keep(rows.join(big, "comp").withColumnRenamed("grp", "seen")), "comp").withColumn("large", F.lit(True))
        # first those that share a token with a large component, then those that share one with them
        near, known = None, undone.join(big, "comp").select("token", F.col("comp").alias("near"))
        for _ in range(HOPS):
            by_token = known.groupBy("token").agg(F.max("near").alias("near"))
            near = self.keep(undone.join(by_token, "token").groupBy("doc_id").agg(F.max("near").alias("near")))
            known = undone.join(near, "doc_id").select("token", "near")
        others = rows.join(big, "comp", "left_anti").join(near, "doc_id", "left").withColumn("key", F.coalesce("near", "part")).withColumnRenamed("grp", "seen")
        rest = _dealt(self.keep(others), "key").withColumn("large", F.lit(False))
        columns = ["doc_id", "comp", "cell", "seen", "large"]
        cells = self.keep(apart.unionByName(rest, allowMissingColumns=True).withColumnRenamed("grp", "cell").select(*columns))
        matrix = self.keep(undone.select("token", "doc_id").join(cells, "doc_id").select("token", "cell", F.when(F.col("large"), F.col("comp")).alias("comp")).distinct())
        small, large = matrix.where("comp is null").select("token", F.col("cell").alias("a")), matrix.where("comp is not null").select("token", F.col("cell").alias("b"), "comp")
        among = small.join(small.withColumnRenamed("a", "b"), "token").where("a < b").select("a", "b")
        against = small.join(large, "token").select("a", "b")
        # cells of one large component never meet: components are paired first, then their cells
        whole = large.select("token", "comp").distinct()
        met = whole.withColumnRenamed("comp", "x").join(whole.withColumnRenamed("comp", "y"), "token").where("x < y")
        between = met.join(large.select("token", F.col("comp").alias("x"), F.col("b").alias("a")), ["token", "x"]).join(large.withColumnRenamed("comp", "y"), ["token", "y"]).select("a", "b")
        alone = cells.where("not large").groupBy("cell").count().where("count > 1").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
        return among.union(against).union(between).union(alone).distinct(), cells.select("cell", "doc_id", "comp", "seen")

    def run(self, classes: DataFrame) -> DataFrame:
        """(doc_id, comp) of the classes that share a token."""
        shared = self.tokens(classes)
        part = shared.groupBy("doc_id").agg(F.max(F.struct("held", "token"))["token"].alias("part"))
        state = self.keep(_dealt(part.join(classes.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"), "part").withColumn("comp", F.col("doc_id")))
        alone = state.groupBy("grp").count().where("count > 1").select(F.col("grp").alias("a"), F.col("grp").alias("b"))
        first = self.links(alone, state.select(F.col("grp").alias("cell"), "doc_id", "comp", F.col("doc_id").alias("seen")))
        state = self.merged(state, first)
        for _ in range(STARS):
            undone = self.undone(shared, state)
            if undone.isEmpty():
                return state.select("doc_id", "comp")
            found = self.links(*self.star_pairs(undone, state))
            if found.isEmpty():
                break
            state = self.merged(state, found)
            # a token whose holders are one component is done for good
            self.drop(shared)
            shared = self.keep(undone.select("token", "doc_id"))
            self.drop(undone)
        pairs, cells = self.full_pairs(self.undone(shared, state))
        return self.merged(state, self.links(self.keep(pairs), cells)).select("doc_id", "comp")


def jaccard_classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id, class_size.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. ``component_id`` is the
    smallest id reachable by links, ``class_id`` the smallest id with an equal set and ``class_size`` the rows with an id and an equal
    set. A null or wordless text has an empty set: no links, its own component. Fewer words than
    ``size`` make one shingle. Rows that share an id are one node. A null id takes no part: null component.
    Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signed(size), SIGNED), "shingle-sets")
    key = ["n", "h1", "h2"]
    classes = stored(signed.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
    join = _Join(texts, size, num, den)
    try:
        found = join.run(classes)
        labelled = stored(classes.join(found, "doc_id", "left").select(*key, F.coalesce("comp", "doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.col("copies").alias("class_size")), "classes-labelled")
    finally:
        join.close()
    return signed.select("doc_id", *key).join(labelled, key, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"))


def row_key() -> Column:
    """64 bits for a row's id and text: rows that share an id but not their text are nodes of their own."""
    return F.xxhash64("doc_id", "text")


def row_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(row, component): one row per distinct id and text of ``docs``; ``row`` is ``row_key``. Null ids take part."""
    marked = jaccard_classes(docs.select(row_key().alias("_row"), "text"), size, num, den, id_col="_row")
    return marked.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the smallest-id row of each component, with all its columns.

    Rows without an id or without words stay. Rows that share an id go together only if their texts link. Of rows that share
    id and text, and of the least id's texts in a component, one stays.
    """
    named = docs.where("doc_id is not null")
    component = row_components(named, size, num, den)
    ids = named.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("id")).groupBy("row").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    kept = ids.join(component, "row").groupBy("component").agg(F.min(F.struct("id", "row", "rows")).alias("r")).select("r.row", "r.rows")
    kept = stored(kept, "kept-rows")
    rest = docs.where("doc_id is null")
    marked = named.withColumn("_row", row_key())
    once = marked.join(kept.where("rows = 1").select(F.col("row").alias("_row")), "_row", "left_semi").select(*docs.columns)
    out = once.unionByName(rest)
    again = kept.where("rows > 1").select(F.col("row").alias("_row"))
    if again.head(1):
        row = F.struct(*docs.columns)
        out = out.unionByName(marked.join(again, "_row", "left_semi").groupBy("_row").agg(F.min(row).alias("r")).select("r.*"))
    return out
