"""The seven reporting views.

Only the names of these views are given; their bodies here are our own definitions, chosen to
fit the names. Each function takes processed listings and returns a lazy frame; ``register``
makes them temporary views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.functions.stats import group_stats
from estatelake.operators.dedup import key_statistics
from estatelake.operators.quality import missing_counts, range_counts
from estatelake.schema import CATEGORY_BY_MARKET, REQUIRED_COLUMNS

LOCATION = ["city", "town", "district"]


def _one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def _count_of(category: str) -> Column:
    return F.count_if(F.col("category") == category)


def vw_market_overview(df: DataFrame) -> DataFrame:
    plain = df.agg(
        F.count(F.lit(1)).alias("total_listings"), F.avg("price_egp").alias("avg_price_egp"),
        F.avg("price_per_sqm").alias("avg_price_per_sqm"), _count_of("buy").alias("sale_listings"),
        _count_of("rent").alias("rent_listings"),
    )
    median = group_stats(df, [], "price_egp", {"median_price_egp": 0.5})
    return _one_row(plain, median).select(
        "total_listings", "avg_price_egp", "median_price_egp", "avg_price_per_sqm", "sale_listings", "rent_listings"
    )


def vw_market_summary(df: DataFrame) -> DataFrame:
    keys = ["category", "property_type"]
    known = df.where(F.col("category").isNotNull() & F.col("property_type").isNotNull())
    plain = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("listings"), F.avg("price_egp").alias("avg_price"), F.min("price_egp").alias("min_price"),
        F.max("price_egp").alias("max_price"), F.avg("price_per_sqm").alias("avg_price_per_sqm"),
    )
    return plain.join(group_stats(known, keys, "price_egp", {"median_price": 0.5}), keys)


def vw_market_robust_metrics(df: DataFrame) -> DataFrame:
    """Percentiles per category and the mean of prices between the 1st and the 99th percentile.

    There are two categories, so the bounds are broadcast and no listing is moved.
    """
    df = df.where(F.col("category").isin(list(CATEGORY_BY_MARKET.values())))
    marks = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "median_price": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}
    stats = group_stats(df, ["category"], "price_egp", marks, count="listings")
    inside = F.col("price_egp").between(F.col("p01"), F.col("p99"))
    trimmed = (
        df.select("category", "price_egp").join(F.broadcast(stats.select("category", "p01", "p99")), "category").where(inside)
        .groupBy("category").agg(F.avg("price_egp").alias("trimmed_mean"))
    )
    return stats.join(trimmed, "category", "left").select(
        "category", "listings", "p10", "p25", "median_price", "p75", "p90",
        (F.col("p75") - F.col("p25")).alias("iqr"), "trimmed_mean",
    )


def medians_of(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Medians of several columns per key from one pass: columns are folded into rows first."""
    cells = [F.struct(F.lit(out).alias("_metric"), F.col(c).cast("double").alias("_value")) for out, c in columns.items()]
    long = df.select(*keys, F.inline(F.array(*cells)))
    stats = group_stats(long, [*keys, "_metric"], "_value", {"_median": 0.5})
    picks = [F.max(F.when(F.col("_metric") == out, F.col("_median"))).alias(out) for out in columns]
    return stats.groupBy(*keys).agg(*picks)


def vw_location_intelligence(df: DataFrame) -> DataFrame:
    """Per district: listings, medians, share and rank within the city.

    The window runs over one row per district, not over listings.
    """
    known = df
    for c in LOCATION:
        known = known.where(F.col(c).isNotNull())
    counts = known.groupBy(*LOCATION).agg(F.count(F.lit(1)).alias("listings"))
    medians = medians_of(known, LOCATION, {"median_price": "price_egp", "median_price_per_sqm": "price_per_sqm"})
    city = Window.partitionBy("city")
    ranked = city.orderBy(F.col("listings").desc(), "town", "district")
    return counts.join(medians, LOCATION).select(
        *LOCATION, "listings", "median_price", "median_price_per_sqm",
        F.try_divide(F.col("listings") * 100.0, F.sum("listings").over(city)).alias("share_of_city"),
        F.row_number().over(ranked).alias("rank_in_city"),
    )


def vw_city_market_profile(df: DataFrame) -> DataFrame:
    known = df.where(F.col("city").isNotNull())
    plain = known.groupBy("city").agg(
        _count_of("buy").alias("sale_listings"), _count_of("rent").alias("rent_listings"),
        F.avg("area_value").alias("avg_area"),
    )
    # towns are counted from distinct pairs, so a large city is spread over its towns
    towns = (
        known.where(F.col("town").isNotNull()).select("city", "town").distinct()
        .groupBy("city").agg(F.count(F.lit(1)).alias("towns"))
    )
    medians = group_stats(known, ["city", "category"], "price_egp", {"_median": 0.5})
    picks = [
        F.max(F.when(F.col("category") == c, F.col("_median"))).alias(out)
        for c, out in (("buy", "median_sale_price"), ("rent", "median_rent_price"))
    ]
    return (
        plain.join(medians.groupBy("city").agg(*picks), "city", "left").join(towns, "city", "left")
        .select("city", "sale_listings", "rent_listings", "median_sale_price", "median_rent_price",
                F.coalesce("towns", F.lit(0)).cast("bigint").alias("towns"), "avg_area")
    )


def vw_market_opportunity_signals(df: DataFrame, min_group: int = 10) -> DataFrame:
    """Each listing against the median price per square metre of its category, city and type.

    Listings of groups below ``min_group``, or without a positive median, stay with the signal ``insufficient_data``. The
    view is lazy: medians follow the listings, and the planner picks the join when it runs, from the real
    size of the medians (adaptive execution), splitting large groups.
    """
    keys = ["category", "city", "property_type"]
    usable = df.where(F.col("price_per_sqm").isNotNull())
    medians = group_stats(usable, keys, "price_per_sqm", {"group_median": 0.5}, count="group_listings")
    enough = (F.col("group_listings") >= min_group) & (F.col("group_median") > 0)
    discount = F.when(enough, (F.col("group_median") - F.col("price_per_sqm")) * 100.0 / F.col("group_median"))
    label = (
        F.when(F.col("discount_pct").isNull(), "insufficient_data").when(F.col("discount_pct") >= 25, "strong_opportunity")
        .when(F.col("discount_pct") >= 10, "opportunity").when(F.col("discount_pct") > -10, "fair").otherwise("premium")
    )
    return (
        usable.select("listing_id", *keys, "price_egp", "price_per_sqm").join(medians, keys)
        .select("listing_id", *keys, "price_egp", "price_per_sqm", "group_median", discount.alias("discount_pct"))
        .withColumn("signal", label)
    )


def vw_data_quality_monitor(df: DataFrame) -> DataFrame:
    """One row per check with failing rows, their share and a status (FAIL from 5 percent)."""
    required = [c for c in REQUIRED_COLUMNS if c in df.columns and c != "listing_id"]
    missing = missing_counts(df.select(*required))
    checks = range_counts(df) | {f"missing_{c}": missing[c] for c in required}
    wide = df.agg(F.count(F.lit(1)).alias("total_rows"), *[c.alias(n) for n, c in checks.items()])
    names = list(checks)
    if "listing_id" in df.columns:
        ids = key_statistics(df).select("null_listing_ids", "duplicate_listing_ids")
        wide = _one_row(wide, ids)
        names += ["null_listing_ids", "duplicate_listing_ids"]
    cells = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("failing_rows"), F.col("total_rows")) for n in names]
    share = F.coalesce(F.try_divide(F.col("failing_rows") * 100.0, F.col("total_rows")), F.lit(0.0))
    return wide.select(F.inline(F.array(*cells))).withColumn("pct", share).withColumn(
        "status", F.when(F.col("failing_rows") == 0, "PASS").when(F.col("pct") < 5, "WARN").otherwise("FAIL")
    )


VIEWS = {
    "vw_market_overview": vw_market_overview,
    "vw_market_summary": vw_market_summary,
    "vw_market_robust_metrics": vw_market_robust_metrics,
    "vw_location_intelligence": vw_location_intelligence,
    "vw_city_market_profile": vw_city_market_profile,
    "vw_market_opportunity_signals": vw_market_opportunity_signals,
    "vw_data_quality_monitor": vw_data_quality_monitor,
}


def register(df: DataFrame) -> None:
    for name, build in VIEWS.items():
        build(df).createOrReplaceTempView(name)
