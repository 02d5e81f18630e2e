import math
import random
import re

import numpy as np
import pytest
from oracle import connect, differences

from estatelake.llm import ball_tree_search as B
from estatelake.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=10):
    split = [(i, terms(t)) for i, t in docs]
    n_docs, words = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    out = []
    for item_id, text in items:
        ranked = []
        for doc_id, t in split:
            score = 0
            for term in set(terms(text)) & set(t):
                df, tf = sum(term in other for _, other in split), t.count(term)
                m = 100 - 90 + (90 * len(t) * n_docs) // words
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(ranked, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


DOCS = [(1, "alpha beta gamma"), (2, "Alpha ALPHA beta-x"), (3, None), (4, ""), (5, "... --"), (6, "éclair Éclair zeta"), (6, "alpha delta"), (None, "alpha beta"), (None, "beta beta"),
        (7, "alpha beta gamma"), (8, "alpha beta gamma"), (9, "word " * 30_000 + "rare"), (10, "x1 x2 \x00 x1")]
ITEMS = [(1, "alpha beta"), (2, None), (3, ""), (4, "unknown terms only"), (5, "ÉCLAIR rare word"), (5, "alpha beta"), (None, "gamma x1"), (6, "!?")]


def test_odd_tables(spark, documents):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, score int, term int")
    assert rows(B.search(documents(DOCS), items)) == plain(DOCS, ITEMS)
    assert rows(B.search(documents(DOCS), items, k=2)) == plain(DOCS, ITEMS, 2)
    empty = items.where("false")
    for got in (B.search(documents([]), items), B.search(documents(DOCS), empty), B.search(documents([(1, None)]), items)):
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def _corpus(seed, n):
    draw = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(5)]
    docs = []
    for i in range(n):
        words = draw.choice(topics)
        docs.append((i, " ".join(words[min(int(draw.expovariate(0.08)), 59)] for _ in range(draw.choice([5, 30, 80])))))
    docs += [(n + i, docs[3][1]) for i in range(n // 3)]  # a hot group of copies
    return docs, [(i, " ".join(docs[draw.randrange(n)][1].split()[:12])) for i in range(12)]


@pytest.mark.parametrize("shard,leaf,block", [(4096, 4, 4_000_000), (37, 1, 100), (64, 16, 700)])
def test_many_shards_and_blocks_equal_brute_force(spark, documents, monkeypatch, shard, leaf, block):
    monkeypatch.setattr(B, "SHARD_ROWS", shard)
    monkeypatch.setattr(B, "SHARD_ENTRIES", shard * 20)
    monkeypatch.setattr(B, "LEAF", leaf)
    monkeypatch.setattr(B, "BLOCK_CHARS", block)
    docs, items = _corpus(1, 240)
    got = B.search(documents(docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == plain(docs, items)


def _shard(docs, items):
    split = [terms(t) for _, t in docs]
    number = {t: i for i, t in enumerate(sorted({t for s in split for t in s}))}
    vectors = [sorted({number[t] for t in s}) for s in split]
    at = np.append(0, np.cumsum([len(v) for v in vectors]))
    term = np.array([t for v in vectors for t in v], np.int32)
    value = np.random.default_rng(2).integers(1, 1_000_000_000, len(term))
    tree = B.Shard.built(np.array([i for i, _ in docs]), at, term, value)
    tree.summarise()
    return tree, [np.array(sorted({number[t] for t in terms(x) if t in number})) for _, x in items], len(number)


def test_no_bound_is_below_a_score_and_subtrees_are_pruned():
    docs, items = _corpus(4, 1500)
    tree, asked, width = _shard(docs, items)
    opened = []
    for q in asked:
        wanted = np.zeros(width, bool)
        wanted[q] = True
        sums = np.append(0, np.cumsum(np.where(wanted[tree.term], tree.value, 0)))
        scores = sums[tree.at[1:]] - sums[tree.at[:-1]]
        bound = tree.bounds(q)
        for node in range(tree.nodes):
            assert scores[tree.low[node]: tree.high[node]].max(initial=0) <= bound[node]
        best = tree.search(q, np.zeros(width, bool), 10, seen=opened)
        assert best == sorted((-int(s), int(i)) for s, i in zip(scores, tree.ids) if s)[:10]
    assert sum(opened) < 0.4 * tree.nodes * len(asked)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(spark, connect(sf_dir), QUERIES["op12_ball_tree_search"], ORACLES["op12_ball_tree_search"], sf_dir) == []
