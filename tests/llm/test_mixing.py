import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelake.llm.mixing import fit_counts, mix, mixed


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 40))
def test_budget_is_met_as_well_as_can_be(lengths, budget):
    sizes, counts = (np.array(v, np.int64) for v in zip(*sorted(lengths.items())))
    take = fit_counts(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {sum(a * s for a, s in zip(c, sizes)) for c in itertools.product(*(range(n + 1) for n in counts))}
    full = int((sizes * counts).sum())
    # the shares of all lengths are fixed first, so a sum within one document of the best
    best = max(s for s in sums if s <= budget) if budget < full else full
    assert best - int((take * sizes).sum()) < max(sizes)


def test_large_budgets_are_met_exactly():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 20_000, 2_000))
    counts = rng.integers(1, 500, len(sizes))
    for part in (0.1, 0.5, 0.93):
        budget = int((sizes * counts).sum() * part)
        assert int((fit_counts(sizes, counts, budget) * sizes).sum()) == budget


def water(sizes, weights):
    """targets by sharing out the excess again and again"""
    total, target, done = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in done)
        open_weights = sum(weights[i] for i in range(len(sizes)) if i not in done)
        over = set()
        for i in range(len(sizes)):
            target[i] = 3.0 * sizes[i] if i in done else left * weights[i] / open_weights
            if i not in done and target[i] > 3 * sizes[i]:
                over.add(i)
        if not over:
            return target
        done |= over


def test_targets_and_taken_words(spark, documents):
    rng = np.random.default_rng(5)
    docs, wanted = documents([], source="a"), {}
    for k, (name, n) in enumerate([("b", 3), ("a", 200), ("é", 40), (None, 30), ("Z", 5), ("c", 60)]):
        docs = docs.union(documents([(1000 * k + j, "w " * int(rng.integers(0, 40))) for j in range(n)], source=name))
    rows = mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(source[r["doc_id"]], []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, size, target in zip(names, sizes, water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
        wanted[s] = target
        assert {r["source_size"] for r in by[s]} == {size}
        assert all(abs(r["target"] - target) < 1e-6 * max(target, 1) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 1
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    again = {r["doc_id"]: r["taken"] for r in mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in rows)


def test_buckets_of_one_length(spark, documents, monkeypatch):
    monkeypatch.setattr("estatelake.llm.mixing.BUCKET", 10)
    docs = documents([(i, "a b c") for i in range(200)], source="a").union(documents([(1000 + i, "a b") for i in range(80)], source="b"))
    rows = mix(docs).collect()
    for low, high in ((0, 1000), (1000, 2000)):
        own = [r for r in rows if low <= r["doc_id"] < high]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2


def test_edge_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (5, "w " * 50_000)])
    rows = mix(docs).collect()
    assert len(rows) == 6 and sum(r["taken"] for r in rows) == sum(r["size"] for r in rows) == 50_004
    assert {r["target"] for r in rows} == {50_004.0}
    silent = mix(documents([(1, None), (2, "  ")])).collect()
    assert [(r["target"], r["taken"]) for r in silent] == [(0.0, 0)] * 2
    assert mix(documents([])).count() == 0


def test_rows_without_an_id_and_with_a_repeated_one_are_mixed(spark, documents):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{rng.integers(99)}" for _ in range(int(rng.integers(1, 30)))) for _ in range(60)]
    a = documents([(None, t) for t in texts] + [(7, t) for t in texts[:20]] + [(None, "same text")] * 9, source="a")
    docs = a.union(documents([(100 + i, t) for i, t in enumerate(texts)], source="b")).union(documents([(None, t) for t in texts[:5]], source=None))
    want, got = {}, {}
    for r in mix(docs).collect():
        want[r["doc_id"], r["size"], r["target"]] = want.get((r["doc_id"], r["size"], r["target"]), 0) + r["taken"]
    target = {s: t for s, t in zip(("a", "b", None), sorted({r[2] for r in want}, reverse=True))}
    for r in mixed(docs).collect():
        k = (r["doc_id"], len(r["text"].split()), target[r["source"]])
        got[k] = got.get(k, 0) + k[1]
    assert got == {k: v for k, v in want.items() if v}
    assert any(k[0] is None for k in got)
