"""Registration of queries and shared helpers of the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.sources.sample import LISTING, RAW, listings_sql, raw_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF_TEXT = "2006-01-01 12:00:00"


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


def query(name: str, sql: str | None = None, over: str | None = "listings"):
    """Register a query. ``over`` names the mapped table the SQL reads, None for plain tables."""
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # the JVM interprets methods of more byte code, for every row; Spark's other form of the plan is compiled in parts
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            wrap = {"listings": listings_sql, "raw": raw_sql, None: lambda q: q}[over]
            ORACLES[name] = wrap(sql)
        return fn

    return keep


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Means and other order-dependent sums are compared after rounding."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


__all__ = ["AS_OF_TEXT", "LISTING", "ORACLES", "QUERIES", "RAW", "as_of", "query", "rounded", "texts"]
