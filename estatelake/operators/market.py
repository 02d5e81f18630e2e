"""Descriptive market statistics, distributions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.functions.stats import correlations, group_stats, stacked
from estatelake.operators.clean import columns_of_type, price_prepare
from estatelake.operators.filters import market_filter
from estatelake.schema import CATEGORY_BY_MARKET

MISSING_TEXT = "nan"


def _market(category: Column) -> Column:
    """``sale``/``rent`` from the category, NULL for anything else."""
    text = F.lower(category)
    picked = F.when(text == CATEGORY_BY_MARKET["sale"], F.lit("sale"))
    return picked.when(text == CATEGORY_BY_MARKET["rent"], F.lit("rent"))


def with_market(df: DataFrame) -> DataFrame:
    return df.withColumn("market", _market(F.col("category")))


# --- overview -----------------------------------------------------------------------------

def market_overview(df: DataFrame) -> DataFrame:
    """One row: counts, shares in percent (two decimals) and the median price per market."""
    by_market = group_rows(with_market(df), "market", "price_egp")

    def of(market: str, column: str) -> Column:
        return F.max(F.when(F.col("market") == market, F.col(column)))

    def share(part: Column) -> Column:
        return F.coalesce(F.bround(F.try_divide(part * 100.0, F.col("total_listings")), 2), F.lit(0.0))

    counts = by_market.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_listings"),
        F.coalesce(of("sale", "rows"), F.lit(0)).alias("sale_listings"),
        F.coalesce(of("rent", "rows"), F.lit(0)).alias("rent_listings"),
        of("sale", "median_price").alias("median_sale_price"),
        of("rent", "median_price").alias("median_rent_price"),
    )
    return counts.select(
        "total_listings", "sale_listings", "rent_listings",
        share(F.col("sale_listings")).alias("sale_percentage"),
        share(F.col("rent_listings")).alias("rent_percentage"),
        "median_sale_price", "median_rent_price",
    )


def group_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows and median value per key, with the rows of a missing key in one more group."""
    other = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    rows = df.select(other.alias(key), value)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    medians = group_stats(rows, [key], value, {"median_price": 0.5})
    return sizes.join(medians, key, "left")


def price_summary(df: DataFrame) -> DataFrame:
    """min, max, mean, median and sample deviation of the price per market."""
    return group_stats(
        with_market(df).where(F.col("price_egp").isNotNull()), ["market"], "price_egp", {"median_price": 0.5},
        mean="mean_price", low="min_price", high="max_price", std="std_price",
    )


# --- counts -------------------------------------------------------------------------------

def value_counts(df: DataFrame, key: str, nulls: str = "as_text") -> DataFrame:
    """Listings per value; missing values count as the text ``nan`` or are left out (``drop``)."""
    if nulls == "as_text":
        df = df.select(F.coalesce(F.col(key).cast("string"), F.lit(MISSING_TEXT)).alias(key))
    else:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("listings"))


def top_values(df: DataFrame, key: str, n: int = 10, nulls: str = "as_text") -> DataFrame:
    return value_counts(df, key, nulls).orderBy(F.col("listings").desc(), key).limit(n)


def status_distribution(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column, nulls="drop")


def listing_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def latest_loaded_at(df: DataFrame) -> DataFrame:
    return df.agg(F.max("loaded_at").alias("latest_loaded_at"))


def segment_sizes(df: DataFrame, min_rows: int = 500) -> DataFrame:
    """Listings per market and property type, large segments only."""
    kind = F.coalesce(F.col("property_type"), F.lit("__MISSING__"))
    sizes = df.groupBy("offering_type", kind.alias("property_type")).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.where(F.col("offering_type").isNotNull() & (F.col("rows") >= min_rows))


def market_distribution(df: DataFrame) -> DataFrame:
    return value_counts(df, "offering_type", nulls="drop")


def market_share(df: DataFrame) -> DataFrame:
    """Listings of both markets in a fixed order, and their share of the two together."""
    names = list(CATEGORY_BY_MARKET.values())
    counts = df.agg(*[F.count_if(F.col("category") == c).alias(c) for c in names])
    together = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("category"), F.col(c).alias("listings"),
            F.try_divide(F.col(c) * 100.0, together).alias("percentage"),
        )
        for i, c in enumerate(names, start=1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _of_markets(df: DataFrame, category: str | None, normalize: str = "lower") -> DataFrame:
    if category:
        return market_filter(df, "category", category, normalize)
    names = F.lower("category") if normalize == "lower" else F.col("category")
    return df.withColumn("category", names).where(F.col("category").isin(list(CATEGORY_BY_MARKET.values())))


# --- prices by group ------------------------------------------------------------------------

def category_prices(df: DataFrame, category: str | None, key: str, extremes: bool = False,
                    present_only: bool = False) -> DataFrame:
    """Price statistics per ``key`` in one market, or per category and key in one pass over both for None.

    Rows without the key are left out. ``listings`` counts present prices; ``present_only`` leaves out groups without any price.
    """
    rows, keys = _of_markets(df, category), [key] if category else ["category", key]
    if present_only:
        rows = rows.where(F.col("price_egp").isNotNull())
    return group_stats(
        rows, keys, "price_egp", {"median_price": 0.5}, count="listings", mean="mean_price",
        low="min_price" if extremes else None, high="max_price" if extremes else None,
    )


def property_type_prices(df: DataFrame, category: str | None) -> DataFrame:
    return category_prices(df, category, "property_type", extremes=True)


def city_prices(df: DataFrame, category: str | None) -> DataFrame:
    return category_prices(df, category, "city")


def bedroom_prices(df: DataFrame, category: str | None) -> DataFrame:
    return category_prices(df, category, "bedrooms", present_only=True)


def furnished_prices(df: DataFrame, category: str | None) -> DataFrame:
    return category_prices(df, category, "furnished")


def median_price_by(df: DataFrame, category: str | None, key: str) -> DataFrame:
    """Median of positive prices per ``key`` in one market (chart data), or per category and key for None."""
    rows = _of_markets(price_prepare(df), category, normalize="exact")
    return group_stats(rows, [key] if category else ["category", key], "price_egp", {"median_price": 0.5})


def median_price_by_market(df: DataFrame) -> DataFrame:
    rows = price_prepare(df).where(F.col("category").isin(list(CATEGORY_BY_MARKET.values())))
    return group_stats(rows, ["category"], "price_egp", {"median_price": 0.5})


def median_price_by_bedrooms(df: DataFrame, category: str | None, most: int = 8) -> DataFrame:
    return median_price_by(df.where(F.col("bedrooms") <= most), category, "bedrooms")


def top_by_median(df: DataFrame, category: str | None, key: str, n: int = 10) -> DataFrame:
    if category is None:
        rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("median_price"), key))
        ranked = median_price_by(df, None, key).dropna().withColumn("_rank", rank)
        return ranked.where(F.col("_rank") <= n).drop("_rank")
    return top_by_metric(median_price_by(df, category, key), key, "median_price", n)


def top_by_metric(df: DataFrame, dimension: str, metric: str, n: int = 15) -> DataFrame:
    """The n rows with the largest metric; ties in the order of the dimension."""
    return df.select(dimension, metric).dropna().orderBy(F.col(metric).desc(), dimension).limit(n)


# --- distributions ---------------------------------------------------------------------------

def property_characteristics(df: DataFrame, columns: tuple[str, ...] = ("area_value", "bedrooms", "bathrooms")) -> DataFrame:
    """count, mean, deviation, extremes and quartiles, one row per column."""
    present = [c for c in columns if c in df.columns]
    long = stacked(df, present, "feature", "value", "double")
    return group_stats(
        long, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75},
        count="count", mean="mean", std="std", low="min", high="max",
    )


def numeric_correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return correlations(df, columns or columns_of_type(df, "numeric"))


def log_price_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins of log1p(price) per market: bin number, lower edge, listings.

    The range is one row per market, so joining it back costs no shuffle of the listings.
    """
    priced = price_prepare(df).where(F.col("category").isin(list(CATEGORY_BY_MARKET.values())))
    logs = priced.select("category", F.log1p("price_egp").alias("x"))
    span = logs.groupBy("category").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(0))
    binned = logs.join(F.broadcast(span), "category").select(  # two rows: the categories above
        "category", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "lo", "hi"
    )
    return (
        binned.groupBy("category", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("listings"))
        .select("category", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "listings")
    )
