import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from estatelake.llm.mixing import mix
from oracle import connect, differences
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = dict(corpus_pipeline.STAGES)
    assert list(found) == ["language ID", "near duplicates", "secret scan", "source mixing", "packing"]
    columns = docs.columns
    docs = docs.union(spark.createDataFrame([(900_001, "12 34 !!", "en", "src0", 8), (900_002, None, None, None, None)], docs.schema))
    kept = found["language ID"](spark, docs, SF)
    assert kept.columns == columns and docs.count() - kept.count() == 2
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = found["near duplicates"](spark, kept, SF)
    want = {c for _, c, _ in brute(rows, 5, 80, 100).values()}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == want
    clean = found["secret scan"](spark, single, SF)
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and set(texts) == want and all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert not any(re.search(r"AKIA[A-Z2-7]{16}|password=[0-9a-f]{18}", r["text"]) for r in texts.values())
    mixture = found["source mixing"](spark, clean, SF)
    times = {r["doc_id"]: r["times"] for r in mix(clean).collect()}
    assert mixture.columns == columns and Counter(r["doc_id"] for r in mixture.collect()) == Counter({i: t for i, t in times.items() if t})
    packed = Counter()
    for r in found["packing"](spark, mixture, SF).collect():
        packed[r["doc_id"]] += r["n_words"]
    assert packed == Counter({i: t * len(re.findall(r"[^\x20\x09-\x0D]+", texts[i]["text"])) for i, t in times.items() if t})


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_registration():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if re.match(r"op\d+_", n)))
def test_queries_with_sql(spark, name):
    assert differences(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == []
