"""De-duplication by business key.

"Last" needs an order: Spark has no file order. ``row_number() = 1`` is planned with a group
limit before the shuffle, so a key that holds a large share of all rows sends one row per map
task, not all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.functions import sqltext as X


def _last_first(df: DataFrame, order_by: list[str] | None) -> list[Column]:
    names = order_by if order_by else [c for c in ("scraped_at", "listed_date") if c in df.columns]
    ordered = [F.col(c).desc_nulls_last() for c in names]
    if order_by:
        return ordered
    # rows that tie in time are told apart by content; equal rows are interchangeable
    return [*ordered, F.xxhash64(*df.columns).desc(), F.hash(*df.columns).desc()]


def keep_last_by_key(
    df: DataFrame, key: str, order_by: list[str] | None = None, keep_null_ids: bool = True
) -> DataFrame:
    """The last row per key; without the key column, distinct rows.

    With ``keep_null_ids`` all rows without a key count as one key, else they all stay out.
    """
    if key not in df.columns:
        return df.dropDuplicates()
    if not keep_null_ids:
        df = df.where(F.col(key).isNotNull())
    same = F.col(key)
    if df.schema[key].dataType.simpleString() == "string":
        # texts of the same whole number are the same key
        same = F.coalesce(same.try_cast("bigint").cast("string"), same)
    per_key = Window.partitionBy(same).orderBy(*_last_first(df, order_by))
    return df.withColumn("_place", F.row_number().over(per_key)).where(F.col("_place") == 1).drop("_place")


def dedup_listings(
    df: DataFrame, key: str = "listing_id", order_by: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(last row per key, rows rejected for lack of a key)."""
    if key not in df.columns:
        raise ValueError(f"{key} column is required")
    return keep_last_by_key(df, key, order_by, keep_null_ids=False), df.where(F.col(key).isNull())


def key_sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, counted on the map side first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))


def rows_in_duplicate_groups(df: DataFrame, key: str = "listing_id") -> DataFrame:
    """One row: how many rows share their (present) key with another row."""
    sizes = key_sizes(df.where(F.col(key).isNotNull()), key)
    return sizes.agg(
        F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias("rows_in_duplicate_groups")
    )


def duplicate_row_count(df: DataFrame, name: str = "duplicate_rows", rows: str | None = None) -> DataFrame:
    """One row: rows that equal an earlier row in every column (NULL equals NULL), and all rows in a column ``rows`` if that is named.

    Rows are compared by a 160-bit digest of all values and of which ones are NULL (hash
    functions skip NULLs). Only digests are shuffled, copies are combined on the map side
    first; unequal rows with one digest are not to be expected at any table size.
    """
    nulls = F.expr("concat(" + ", ".join(f"int({X.name(c)} IS NULL)" for c in df.columns) + ")")
    digest = [
        F.xxhash64(nulls, *df.columns).alias("_h1"), F.xxhash64(F.lit("second"), nulls, *df.columns).alias("_h2"),
        F.hash(nulls, *df.columns).alias("_h3"),
    ]
    copies = df.select(*digest).groupBy("_h1", "_h2", "_h3").agg(F.count(F.lit(1)).alias("_rows"))
    totals = {name: F.sum(F.col("_rows") - 1), **({rows: F.sum("_rows")} if rows else {})}
    return copies.agg(*[F.coalesce(n, F.lit(0)).alias(c) for c, n in totals.items()])


def key_statistics(df: DataFrame, key: str = "listing_id") -> DataFrame:
    """One row: total rows, rows without key, rows in duplicate groups, distinct keys."""
    sizes = key_sizes(df, key)
    has_key, rows = F.col(key).isNotNull(), F.col("_rows")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    return sizes.agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("total_rows"),
        total(~has_key).alias("null_listing_ids"),
        total(has_key & (rows > 1)).alias("duplicate_listing_ids"),
        F.count_if(has_key).alias("unique_listing_ids"),
    )


def duplicate_statistics(df: DataFrame, key: str = "listing_id") -> DataFrame:
    """One row with all counts about keys and equal rows."""
    if key in df.columns:
        keys = key_statistics(df, key)
    else:
        zero = [F.lit(0).cast("bigint").alias(c)
                for c in ("null_listing_ids", "duplicate_listing_ids", "unique_listing_ids")]
        keys = df.agg(F.count(F.lit(1)).alias("total_rows")).select("total_rows", *zero)
    both = keys.unionByName(duplicate_row_count(df), allowMissingColumns=True)
    order = ["total_rows", "null_listing_ids", "duplicate_rows", "duplicate_listing_ids", "unique_listing_ids"]
    return both.agg(*[F.max(c).alias(c) for c in order])
