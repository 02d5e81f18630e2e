import random
from collections import Counter

from estatelake.llm.packing import Bins, pack, pack_apart


def test_best_fit_equals_a_plain_search():
    rng = random.Random(3)
    bins, plain = Bins(50, 2), []
    for _ in range(600):
        size, source, cluster = rng.randint(1, 50), rng.randrange(4), rng.choice([-1, -1, 0, 1, 2])
        b, start = bins.place(size, source, cluster)
        fits = [x for x in plain if x["rest"] >= size and x["sources"][source] < 2 and cluster not in x["clusters"]]
        if fits:
            assert bins.residual[b] + size == min(x["rest"] for x in fits)
        else:
            assert b == len(plain)
            plain.append({"rest": 50, "sources": Counter(), "clusters": set()})
        assert start == 50 - plain[b]["rest"]
        plain[b]["rest"] -= size
        plain[b]["sources"][source] += 1
        if cluster >= 0:
            plain[b]["clusters"].add(cluster)


def test_all_words_are_packed_without_conflicts(spark, documents):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 5, 30, 90, 250]))) for _ in range(150)]
    rows = [(i, texts[i % 110]) for i in range(300)]
    docs = documents(rows[:200], source="hot").union(documents(rows[200:], source=None))
    out = pack(docs, capacity=100, per_source=3, shard_rows=60).collect()
    size = {i: len(t.split()) for i, t in rows}
    got, held, source, cluster = Counter(), Counter(), Counter(), Counter()
    for r in out:
        assert r["first_word"] == r["piece"] * 100
        got[r["doc_id"]] += r["n_words"]
        held[r["bin"]] += r["n_words"]
        source[r["bin"], r["source"]] += 1
        cluster[r["bin"], dict(rows)[r["doc_id"]]] += 1
    assert got == size and max(held.values()) <= 100
    assert max(source.values()) <= 3 and max(cluster.values()) == 1
    by_bin: dict = {}
    for r in out:
        by_bin.setdefault(r["bin"], []).append((r["bin_start"], r["n_words"]))
    assert all(sum(n for _, n in sorted(v)[:k]) == s for v in by_bin.values() for k, (s, _) in enumerate(sorted(v)))


def test_edge_rows(spark, documents):
    out = pack(documents([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (None, None), (4, "w " * 9000)])).collect()
    by = {(r["doc_id"], r["copy"], r["piece"]): r for r in out}
    assert by[1, 0, 0]["bin"] is None and by[1, 0, 0]["n_words"] == 0
    assert by[3, 0, 0]["bin"] != by[3, 1, 0]["bin"]
    assert [by[4, 0, k]["n_words"] for k in range(5)] == [2048] * 4 + [808]
    assert len(out) == 11 and pack(documents([])).count() == 0


def test_near_copies_never_share_a_bin(spark, documents):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(12)] + [(50, " ".join([*base, "other"])), (50, "short text"), (None, " ".join([*base, "last"]))]
    rows += [(100 + i, f"x{i} y{i} z{i}") for i in range(30)]
    out = pack_apart(documents(rows, source=None), capacity=400, per_source=99).collect()
    bins = [r["bin"] for r in out if r["n_words"] == 61]
    assert len(bins) == 14 and len(set(bins)) == 14
    assert sum(r["n_words"] for r in out) == 14 * 61 + 2 + 90
