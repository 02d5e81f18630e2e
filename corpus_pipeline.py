"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet below the
shared working folder and reads them again as the next stage's documents, so that a lost executor costs part of one stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.llm import language_id, mixing, ngram_join, packing, secret_scan
from estatelake.llm.queries import ARROW_ROWS, table
from estatelake.session import stored

#: a text further than this from every profile is in none of the languages
LEAST_SCORE = 0.3


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those unlike every profile, go; ``lang`` becomes the language found."""
    _ready(spark)
    profiles = language_id.fit_profiles(docs)
    found = docs.withColumn("_found", language_id.language_column(profiles)(F.col("text")))
    kept = found.where((F.col("_found.lang_pred") != language_id.UNDETERMINED) & (F.col("_found.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("_found.lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity of 0.8)."""
    _ready(spark)
    return ngram_join.keep_one(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays."""
    _ready(spark)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    _ready(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training sequences."""
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: profiles, forests and packing are beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
