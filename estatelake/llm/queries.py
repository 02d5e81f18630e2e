"""Registered queries of the numbered operators and the pipeline, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: rows of an Arrow batch; documents may be long, and a batch stands in a worker's memory
ARROW_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.ngram_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.secret_scan import scan

    found = scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"), F.coalesce(F.round(F.array_max(F.transform("secrets", lambda s: s["score"])), 6), F.lit(0.0)).alias("top_score"))


@query("op3_source_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.packing import pack_apart

    return pack_apart(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    from estatelake.llm.url_rules import RULES

    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
    with rules(rhost, rpath, verdict) as (values {values}),
    urls as (
        select page_id,
            translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path,
            row_number() over () as row
        from pages),
    fitting as (
        select row, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
        from urls join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
        group by row)
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from urls left join fitting using (row)"""


@query("op5_url_rules", _url_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.url_rules import judge, rule_table

    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.fingerprints import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


@query("op2_vp_tree_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.vp_tree import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.personal_data import find

    return find(table(spark, sf_dir, "documents"))


@query("op11_bpe_automaton")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from estatelake.llm.bpe_automaton import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_word_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.word_runs import describe

    return describe(table(spark, sf_dir, "documents"))


_LEXICAL_SQL = r"""
    with texts as (
        select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms, row_number() over () as row
        from documents where text is not null),
    total as (select count_if(len(terms) > 0) as docs, sum(len(terms))::bigint as words from texts),
    tf as (select row, doc_id, len(terms) as n, term, count(*) as tf from (select row, doc_id, terms, unnest(terms) as term from texts) group by all),
    weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by term, docs),
    items as (
        select item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
        from (select *, row_number() over () as item from benchmark)),
    scored as (
        select item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::bigint as score
        from items join tf using (term) join weights using (term), total group by item, item_id, row, doc_id),
    ranked as (select item_id, row_number() over (partition by item order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
    select * from ranked where rank <= 10"""


@query("op12_ball_tree_search", _LEXICAL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelake.llm.ball_tree_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
