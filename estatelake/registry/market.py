"""Market statistics, counts, distributions and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.operators import market as M
from estatelake.plans import bundles
from estatelake.registry.base import query, rounded
from estatelake.session import stored
from estatelake.sources.sample import listings, table

MARKETS = ("buy", "rent")


@query("market_overview", """
SELECT count(*) AS total_listings,
  count(*) FILTER (category = 'buy') AS sale_listings, count(*) FILTER (category = 'rent') AS rent_listings,
  round(count(*) FILTER (category = 'buy') * 100.0::DOUBLE / count(*), 2) AS sale_percentage,
  round(count(*) FILTER (category = 'rent') * 100.0::DOUBLE / count(*), 2) AS rent_percentage,
  median(price_egp) FILTER (category = 'buy') AS median_sale_price,
  median(price_egp) FILTER (category = 'rent') AS median_rent_price
FROM listings""")
def _overview(spark, d):
    return M.market_overview(listings(spark, d, "category", "price_egp"))


@query("price_summary", """
SELECT CASE category WHEN 'buy' THEN 'sale' ELSE 'rent' END AS market, round(avg(price_egp), 4) AS mean_price,
  min(price_egp) AS min_price, max(price_egp) AS max_price, round(stddev_samp(price_egp), 4) AS std_price,
  median(price_egp) AS median_price
FROM listings WHERE price_egp IS NOT NULL GROUP BY category""")
def _price_summary(spark, d):
    return rounded(M.price_summary(listings(spark, d, "category", "price_egp")), 4, "mean_price", "std_price")


for _key, _name in (("property_type", "property_type_counts"), ("city", "city_counts"), ("town", "town_counts"),
                    ("district", "district_counts")):
    query(_name, f"SELECT coalesce({_key}, 'nan') AS {_key}, count(*) AS listings FROM listings GROUP BY 1")(
        lambda spark, d, key=_key: M.value_counts(listings(spark, d, key), key)
    )

_PRICES = "count(price_egp) AS listings, round(avg(price_egp), 4) AS mean_price, median(price_egp) AS median_price"


@query("property_type_prices", f"""
SELECT category, property_type, {_PRICES}, min(price_egp) AS min_price, max(price_egp) AS max_price
FROM listings WHERE property_type IS NOT NULL GROUP BY category, property_type""")
def _type_prices(spark, d):
    df = listings(spark, d, "category", "property_type", "price_egp")
    return rounded(M.property_type_prices(df, None), 4, "mean_price")


@query("city_prices", f"SELECT city, {_PRICES} FROM listings WHERE category = 'buy' AND city IS NOT NULL GROUP BY city")
def city_prices(spark, d):
    return rounded(M.city_prices(listings(spark, d, "category", "city", "price_egp"), "buy"), 4, "mean_price")


@query("city_prices_rent",
       f"SELECT city, {_PRICES} FROM listings WHERE category = 'rent' AND city IS NOT NULL GROUP BY city")
def _city_prices_rent(spark, d):
    return rounded(M.city_prices(listings(spark, d, "category", "city", "price_egp"), "rent"), 4, "mean_price")


@query("bedroom_prices", f"""
SELECT category, bedrooms, {_PRICES} FROM listings
WHERE bedrooms IS NOT NULL AND price_egp IS NOT NULL GROUP BY category, bedrooms""")
def _bedroom_prices(spark, d):
    df = listings(spark, d, "category", "bedrooms", "price_egp")
    return rounded(M.bedroom_prices(df, None), 4, "mean_price")


@query("furnished_prices", f"""
SELECT category, furnished, {_PRICES} FROM listings WHERE furnished IS NOT NULL GROUP BY category, furnished""")
def _furnished_prices(spark, d):
    df = listings(spark, d, "category", "furnished", "price_egp")
    return rounded(M.furnished_prices(df, None), 4, "mean_price")


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max,
    round(stddev_samp({c}), 4) AS std, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
    quantile_cont({c}, 0.75) AS p75 FROM listings""" for c in ("area_value", "bedrooms", "bathrooms"))


@query("property_characteristics", _DESCRIBE)
def _characteristics(spark, d):
    df = listings(spark, d, "area_value", "bedrooms", "bathrooms")
    return rounded(M.property_characteristics(df), 4, "mean", "std")


_NUMBERS = ["price_egp", "area_value", "bedrooms", "bathrooms", "lat", "lon", "images_count"]
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS corr FROM listings"
    for a in _NUMBERS for b in _NUMBERS)


@query("numeric_correlation", _CORR)
def _correlation(spark, d):
    return rounded(M.numeric_correlation(listings(spark, d, *_NUMBERS)), 8, "corr")


@query("market_share", """
WITH c AS (SELECT CASE category WHEN 'buy' THEN 1 ELSE 2 END AS position, category, count(*) AS listings
  FROM listings GROUP BY category)
SELECT position, category, listings, round(listings * 100.0::DOUBLE / (SELECT sum(listings) FROM c), 8) AS percentage
FROM c""".replace("WITH c AS", ", c AS"))
def _share(spark, d):
    return rounded(M.market_share(listings(spark, d, "category")), 8, "percentage")


@query("median_price_by_market", """
SELECT category, median(price_egp) AS median_price FROM listings WHERE price_egp > 0 GROUP BY category""")
def _median_market(spark, d):
    return M.median_price_by_market(listings(spark, d, "category", "price_egp"))


@query("median_price_by_bedrooms", """
SELECT category, bedrooms, median(price_egp) AS median_price FROM listings
WHERE price_egp > 0 AND bedrooms <= 8 GROUP BY category, bedrooms""")
def _median_bedrooms(spark, d):
    df = listings(spark, d, "category", "bedrooms", "price_egp")
    return M.median_price_by_bedrooms(df, None)


@query("log_price_histogram", """, x AS (SELECT category, ln(1 + price_egp) AS x FROM listings WHERE price_egp > 0),
r AS (SELECT category, min(x) AS lo, max(x) AS hi FROM x GROUP BY category)
SELECT category, least(floor((x - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin,
  round(lo + least(floor((x - lo) / ((hi - lo) / 50)), 49) * ((hi - lo) / 50), 8) AS bin_start, count(*) AS listings
FROM x JOIN r USING (category) GROUP BY ALL""")
def _histogram(spark, d):
    return rounded(M.log_price_histogram(listings(spark, d, "category", "price_egp")), 8, "bin_start")


@query("status_distribution",
       "SELECT completion_status, count(*) AS listings FROM listings WHERE completion_status IS NOT NULL GROUP BY 1")
def _status(spark, d):
    return M.status_distribution(listings(spark, d, "completion_status"), "completion_status")


@query("listing_count", "SELECT count(*) AS total_rows FROM listings")
def _count(spark, d):
    return M.listing_count(listings(spark, d, "listing_id"))


@query("latest_loaded_at", "SELECT CAST(max(listed_date) AS VARCHAR) AS latest_loaded_at FROM listings")
def _latest_loaded(spark, d):
    df = listings(spark, d, "listed_date").withColumnRenamed("listed_date", "loaded_at")
    return M.latest_loaded_at(df).select(F.col("latest_loaded_at").cast("string").alias("latest_loaded_at"))


@query("segment_sizes", """
SELECT offering_type, coalesce(property_type, '__MISSING__') AS property_type, count(*) AS rows
FROM listings GROUP BY ALL HAVING count(*) >= 500""")
def _segments(spark, d):
    return M.segment_sizes(listings(spark, d, "offering_type", "property_type"))


@query("market_distribution", "SELECT offering_type, count(*) AS listings FROM listings GROUP BY 1")
def _distribution(spark, d):
    return M.market_distribution(listings(spark, d, "offering_type"))


@query("top_locations", """
SELECT coalesce(city, 'nan') AS city, count(*) AS listings FROM listings GROUP BY 1
ORDER BY listings DESC, city LIMIT 10""")
def _top_locations(spark, d):
    return M.top_values(listings(spark, d, "city"), "city")


@query("top_property_types", """
SELECT coalesce(property_type, 'nan') AS property_type, count(*) AS listings FROM listings GROUP BY 1
ORDER BY listings DESC, property_type LIMIT 10""")
def _top_types(spark, d):
    return M.top_values(listings(spark, d, "property_type"), "property_type")


def _top_median_sql(key: str) -> str:
    per = [
        f"(SELECT '{c}' AS category, {key}, median(price_egp) AS median_price FROM listings WHERE category = '{c}' "
        f"AND price_egp > 0 AND {key} IS NOT NULL GROUP BY {key} ORDER BY median_price DESC, {key} LIMIT 10)"
        for c in MARKETS
    ]
    return " UNION ALL ".join(per)


@query("top_cities_by_median", _top_median_sql("city"))
def _top_cities_median(spark, d):
    df = listings(spark, d, "category", "city", "price_egp")
    return M.top_by_median(df, None, "city")


@query("top_types_by_median", _top_median_sql("property_type"))
def _top_types_median(spark, d):
    df = listings(spark, d, "category", "property_type", "price_egp")
    return M.top_by_median(df, None, "property_type")


@query("top_by_metric", """
SELECT town, metric FROM (SELECT town, round(avg(area_value), 6) AS metric FROM listings GROUP BY town)
WHERE town IS NOT NULL AND metric IS NOT NULL ORDER BY metric DESC, town LIMIT 15""")
def _top_metric(spark, d):
    means = listings(spark, d, "town", "area_value").groupBy("town").agg(F.round(F.avg("area_value"), 6).alias("metric"))
    return M.top_by_metric(means, "town", "metric")


def _study_sql() -> str:
    """Every result as (section, item, measure, value)."""
    def part(section: str, key: str, columns: str, rest: str) -> str:
        rows = f"SELECT {key} AS item, {columns} FROM listings {rest}"
        return (f"SELECT '{section}' AS section, item, measure, value FROM (UNPIVOT (SELECT item, COLUMNS(* EXCLUDE (item))::DOUBLE FROM ({rows})) "
                "ON COLUMNS(* EXCLUDE (item)) INTO NAME measure VALUE value)")

    of = lambda c, what: f"{what} FILTER (category = '{c}')"
    overview = ", ".join([
        "count(*) AS total_listings", f"{of('buy', 'count(*)')} AS sale_listings", f"{of('rent', 'count(*)')} AS rent_listings",
        f"round({of('buy', 'count(*)')} * 100.0::DOUBLE / count(*), 2) AS sale_percentage", f"round({of('rent', 'count(*)')} * 100.0::DOUBLE / count(*), 2) AS rent_percentage",
        f"{of('buy', 'median(price_egp)')} AS median_sale_price", f"{of('rent', 'median(price_egp)')} AS median_rent_price"])
    extremes = "min(price_egp) AS min_price, max(price_egp) AS max_price"
    parts = [part("market_overview", "''", overview, ""),
             part("price_summary", "CASE category WHEN 'buy' THEN 'sale' ELSE 'rent' END", f"round(avg(price_egp), 4) AS mean_price, {extremes}, round(stddev_samp(price_egp), 4) AS std_price, median(price_egp) AS median_price",
                  "WHERE price_egp IS NOT NULL GROUP BY 1")]
    parts += [part(s, f"coalesce({k}, 'nan')", "count(*) AS listings", "GROUP BY 1") for s, k in (("property_types", "property_type"), ("locations", "city"), ("towns", "town"), ("districts", "district"))]
    parts += [part("property_characteristics", f"'{c}'", f"count({c}) AS count, round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max, round(stddev_samp({c}), 4) AS std, "
                   f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75", "") for c in ("area_value", "bedrooms", "bathrooms")]
    for market, c in (("sale", "buy"), ("rent", "rent")):
        for name, key, more, only in (("property_type_prices", "property_type", f", {extremes}", ""), ("city_prices", "city", "", ""),
                                      ("bedroom_prices", "bedrooms", "", " AND price_egp IS NOT NULL"), ("furnished", "furnished", "", "")):
            parts.append(part(f"{market}_{name}", f"CAST({key} AS VARCHAR)", _PRICES + more, f"WHERE category = '{c}' AND {key} IS NOT NULL{only} GROUP BY 1"))
    return " UNION ALL ".join(parts)


@query("market_analysis", _study_sql())
def _analysis(spark, d):
    # stored once: each of the fifteen results reads this narrow table
    df = stored(listings(spark, d, "category", "price_egp", "property_type", "city", "town", "district", "area_value",
                         "bedrooms", "bathrooms", "furnished"), "study")
    rows = bundles.analysis_rows(bundles.market_analysis(df))
    return rows.withColumn("value", F.expr("CASE WHEN measure IN ('mean_price', 'std_price', 'mean', 'std') THEN round(value, 4) ELSE value END"))


@query("best_model", """
SELECT user_id AS model_id, round(value / 1000, 6) AS r2, mae FROM (
  SELECT user_id, value, CAST(event_id AS DOUBLE) AS mae FROM events) ORDER BY value DESC, mae LIMIT 1""", over=None)
def _best_model(spark, d):
    from estatelake.plans.training import best_model

    scores = table(spark, d, "events").select(
        F.col("user_id").alias("model_id"), (F.col("value") / 1000).alias("r2"), F.col("event_id").cast("double").alias("mae_egp")
    )
    return best_model(scores).select("model_id", F.round("r2", 6).alias("r2"), F.col("mae_egp").alias("mae"))
