import random
import re

import pytest

from estatelake.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, num, den):
    """doc_id -> (size of set, component)"""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k: k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(df, **options).collect()}


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_equals_all_pairs(spark, documents, size, num):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(25):  # clusters of near copies, with sizes around the limits of the size classes
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8, 11, 12, 20, 40, 75, 76, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at: at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
                w = w or base
            rows.append((i, " ".join(w)))
            i += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(i + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 200])))) for k in range(40)]
    assert got(documents(rows), size=size, num=num) == brute(rows, size, num, 100)


def near_copies(n, seed=4, edits=(1, 2, 3)):
    rng = random.Random(seed)
    base, rows = [f"v{k}" for k in range(120)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture()
def opened(monkeypatch):
    """How many texts the opened pairs of groups held."""
    monkeypatch.setattr(ngram_join, "GROUP", 8)
    rows, links = [], ngram_join._Join.links

    def counted(self, pairs, cells):
        sides = pairs.selectExpr("a as cell").union(pairs.where("a != b").selectExpr("b as cell"))
        rows.append(sides.join(cells, "cell").count())
        return links(self, pairs, cells)

    monkeypatch.setattr(ngram_join._Join, "links", counted)
    return rows


def test_opened_pairs_grow_with_a_cluster_not_with_its_square(spark, documents, opened):
    taken = {}
    for n in (60, 240):
        opened.clear()
        rows = near_copies(n, edits=(1,))
        assert got(documents(rows), size=3, num=90) == brute(rows, 3, 90, 100)
        taken[n] = sum(opened)
    assert taken[240] < 6 * taken[60] and taken[240] < 6 * 240, taken


def test_cluster_that_hardly_links_is_compared_in_full(spark, documents, opened):
    rows = near_copies(120)
    assert got(documents(rows), size=3, num=90) == brute(rows, 3, 90, 100)


def test_two_hot_clusters_and_what_lies_between(spark, documents, opened):
    """A cluster whose ends are unlike, another one, and texts that are nearly but not near copies."""
    rng = random.Random(8)
    rows = near_copies(50)
    other = [f"u{k}" for k in range(120)]
    for i in range(50, 90):
        w = list(other)
        w[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(w)))
    for i in range(90, 130):  # a chain: each differs from the one before in one word
        other = list(other)
        other[(i * 7) % 120] = f"z{i}"
        rows.append((i, " ".join(other)))
    for i in range(130, 170):  # share a third with the first cluster
        rows.append((i, " ".join([f"v{k}" for k in range(40)] + [f"q{i}.{k}" for k in range(80)])))
    rng.shuffle(rows)
    assert got(documents(rows), size=3, num=90) == brute(rows, 3, 90, 100)
    assert got(documents(rows), size=5, num=80) == brute(rows, 5, 80, 100)


def test_tables_of_the_join_are_removed(spark, documents):
    import os
    ngram_join.jaccard_classes(documents(near_copies(30)), size=3, num=90).collect()
    root = os.path.dirname(ngram_join.work_dir(spark, "x"))
    assert not [f for f in os.listdir(root) if f.startswith("ngram-join-")]


def test_edge_rows(spark, documents):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "one two"), (7, long), (8, long + " end"), (9, "a b c d e f"), (9, "a b c d e f")]
    marked = ngram_join.jaccard_classes(documents([*rows, (None, "one"), (None, None)])).collect()
    assert len(marked) == 12
    by = {r["doc_id"]: r for r in marked if r["doc_id"] is not None}
    assert {i: by[i]["component_id"] for i in by} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}
    assert by[1]["n_shingles"] == 0 and (by[5]["class_id"], by[5]["class_size"]) == (4, 2) and (by[8]["class_id"], by[8]["class_size"]) == (8, 1)
    assert [(r["component_id"], r["class_id"]) for r in marked if r["doc_id"] is None] == [(None, None)] * 2
    kept = ngram_join.keep_one(documents([*rows, (None, "one")]))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9]
    assert kept.columns == documents([]).columns
    assert ngram_join.jaccard_classes(documents([])).count() == 0


def test_rows_that_share_an_id_but_not_their_text_stay(spark, documents):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (1, "quite another text of the very same id"), (2, long), (2, "a third text that nobody else has"), (3, "quite another text of the very same id"), (None, long), (4, long), (4, long)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.keep_one(documents(rows)).collect())
    assert got == sorted([(1, long), (1, rows[1][1]), (2, rows[3][1]), (0, long)])
