"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.session import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long), the component being its smallest node.

    Each round is written to the shared folder, so that a lost executor repeats one round only. The minimum
    of a node's neighbours is combined on the map side; the joins are between two shuffled sides, of which
    Spark splits the hot ones. Links of a node with itself and nulls are ignored; an empty table gives none.
    """
    edges = stored(edges.where("u != v").select("u", "v").distinct(), "links")
    digest = None
    while True:
        edges = stored(_small(_large(edges)), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == digest:
            break
        digest = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))\
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
