"""Listings in compressed files, and intermediate tables."""

import gzip

from pyspark.sql import functions as F

from estatelake.session import stored
from estatelake.sources import files
from estatelake.streaming.incremental import stream_incremental_load


def packed(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", newline="") as f:
        f.write(text)


def test_compressed_files_are_scanned(spark, tmp_path):
    packed(tmp_path / "in.csv" / "a.csv.gz", 'listing_id,title\n"1","two\nlines"\n"2","None"\n')
    packed(tmp_path / "in.csv" / "b.csv.gz", 'TITLE,Listing ID\n"plain","3"\n')
    got = {r["listing_id"]: r["title"] for r in files.scan_listings(spark, str(tmp_path / "in.csv")).collect()}
    assert got == {"1": "two\nlines", "2": None, "3": "plain"}
    assert files.scan_listings(spark, str(tmp_path / "in.csv" / "b.csv.gz")).count() == 1


def test_compressed_files_are_streamed(spark, tmp_path):
    packed(tmp_path / "drop" / "a.csv.gz", 'listing_id,title,price_egp\n"1","x","10"\n"1","y","10"\n')
    with open(tmp_path / "drop" / "b.csv", "w") as f:
        f.write("listing_id,title\n2,plain\n")
    now = F.lit("2006-01-01 00:00:00").cast("timestamp")
    stream_incremental_load(spark, str(tmp_path / "drop"), str(tmp_path / "target"), str(tmp_path / "state"), now, now).awaitTermination()
    assert sorted(r["listing_id"] for r in spark.read.parquet(str(tmp_path / "target")).collect()) == [1, 2]


def test_intermediate_tables_take_little_disk(spark):
    text = F.concat(F.lit("a text of many words, as in the row before, number "), F.col("id"))
    paths = stored(spark.range(10).withColumn("text", text), "small").inputFiles()
    assert paths and all(p.endswith(".zstd.parquet") for p in paths)
