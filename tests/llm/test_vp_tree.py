import numpy as np
import pytest

from estatelake.llm.vp_tree import Tree, nearest


def brute(ids, x, q, k):
    s = (x * x[q]).sum(1)
    s[ids == ids[q]] = -np.inf
    return ids[np.lexsort((ids, -s))][: min(k, len(ids) - 1)].tolist()


@pytest.mark.parametrize("kind", ["gauss", "clusters", "copies", "lengths"])
def test_factor_one_is_exact(kind):
    rng = np.random.default_rng(1)
    n = 700
    x = rng.normal(size=(n, 6))
    if kind == "clusters":
        x = rng.normal(size=(10, 6))[rng.integers(10, size=n)] + 0.05 * x
    if kind == "copies":
        x[: n // 3] = x[0]
    if kind == "lengths":
        x *= rng.uniform(0.1, 30, size=(n, 1))
    ids = rng.permutation(n)
    tree = Tree(ids, x, leaf=16)
    asked = np.arange(0, n, 9)
    q, found, score = tree.search(ids[asked], x[asked], 5, 1.0)
    for j, i in enumerate(asked):
        mine = sorted(zip(-score[q == j], found[q == j]))
        assert [v for _, v in mine] == brute(ids, x, i, 5)


def test_recall_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = docs.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got: dict = {}
    for r in nearest(docs, shard_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {i: brute(ids, x, np.flatnonzero(ids == i)[0], 20) for i in ids[ids % 20 == 0].tolist()}
    assert set(got) == set(want) and np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (20, [0.0, 2.0]), (21, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, shard int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert nearest(df.limit(0)).count() == 0
