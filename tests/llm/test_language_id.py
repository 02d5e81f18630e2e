from collections import Counter

import numpy as np

from estatelake.llm import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if got[r["doc_id"]]["held_out"]]
    assert len(got) == docs.count() and 100 < len(held) < 300
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def grams(text):
    out, word = Counter(), "".join(c.lower() if c.isalpha() else " " for c in text).split()
    for w in word:
        p = f"_{w}_"
        out.update(w)
        out.update(p[k: k + 2] for k in range(len(p) - 1))
        out.update(p[k: k + 3] for k in range(len(p) - 2))
    return out


def test_profiles_equal_plain_counting(spark, documents):
    text = "Une été, l'été! une   autre " * 3
    got = language_id.fit_profiles(documents([(1, text), (2, "x1y")], lang="fr"))
    counts = grams(text + " x y")
    name = lambda g: "".join("" if c == language_id.NONE else "_" if c == 0 else chr(c) for c in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))
    rows = {name(g): r for g, r in zip(got["gram"], got["rank"])}
    assert set(rows) == set(counts)
    order = sorted(rows, key=rows.get)
    assert [counts[g] for g in order] == sorted(counts.values(), reverse=True)


def test_edge_rows(spark, documents):
    english, french = "the house and the garden of them " * 5, "une maison et le jardin de la ville " * 5
    docs = documents([(i, english) for i in range(10)]).union(documents([(20 + i, french) for i in range(10)], lang="fr"))
    docs = docs.union(documents([(None, "the house"), (40, None), (41, ""), (42, "12 !!"), (43, english * 3000), (44, "the house"), (44, "the house"), (45, "日本語")], lang=None))
    rows = language_id.identify(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 28
    assert [got[i]["lang_pred"] for i in (40, 41, 42)] == ["und"] * 3 and got[40]["score"] == 0
    assert got[43]["lang_pred"] == "en" and got[44]["lang_pred"] == "en" and got[25]["lang_pred"] == "fr"
    assert got[None]["held_out"] and got[45]["score"] == 0
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(documents([(1, "some text")], lang=None)).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
