"""Reporting views."""

from __future__ import annotations

from estatelake.plans import views as V
from estatelake.registry.base import query, rounded
from estatelake.sources.sample import listings

_ALL = ["listing_id", "category", "property_type", "city", "town", "district", "price_egp", "price_per_sqm",
        "area_value", "listing_type", "listed_date", "lat", "lon", "images_count"]


@query("vw_market_overview", """
SELECT count(*) AS total_listings, round(avg(price_egp), 4) AS avg_price_egp, median(price_egp) AS median_price_egp,
  round(avg(price_per_sqm), 4) AS avg_price_per_sqm, count(*) FILTER (category = 'buy') AS sale_listings,
  count(*) FILTER (category = 'rent') AS rent_listings FROM listings""")
def _overview(spark, d):
    df = V.vw_market_overview(listings(spark, d, "category", "price_egp", "price_per_sqm"))
    return rounded(df, 4, "avg_price_egp", "avg_price_per_sqm")


@query("vw_market_summary", """
SELECT category, property_type, count(*) AS listings, round(avg(price_egp), 4) AS avg_price, min(price_egp) AS min_price,
  max(price_egp) AS max_price, round(avg(price_per_sqm), 4) AS avg_price_per_sqm, median(price_egp) AS median_price
FROM listings WHERE category IS NOT NULL AND property_type IS NOT NULL GROUP BY ALL""")
def _summary(spark, d):
    df = V.vw_market_summary(listings(spark, d, "category", "property_type", "price_egp", "price_per_sqm"))
    return rounded(df, 4, "avg_price", "avg_price_per_sqm")


_Q = {"p10": 0.1, "p25": 0.25, "median_price": 0.5, "p75": 0.75, "p90": 0.9}


@query("vw_market_robust_metrics", f""", b AS (SELECT category, quantile_cont(price_egp, 0.01) AS lo,
  quantile_cont(price_egp, 0.99) AS hi FROM listings GROUP BY category),
t AS (SELECT category, avg(price_egp) AS trimmed_mean FROM listings JOIN b USING (category)
  WHERE price_egp BETWEEN lo AND hi GROUP BY category)
SELECT category, count(price_egp) AS listings, {', '.join(f'round(quantile_cont(price_egp, {p}), 6) AS {n}' for n, p in _Q.items())},
  round(quantile_cont(price_egp, 0.75) - quantile_cont(price_egp, 0.25), 6) AS iqr,
  round(any_value(trimmed_mean), 4) AS trimmed_mean FROM listings JOIN t USING (category) GROUP BY category""")
def _robust(spark, d):
    df = V.vw_market_robust_metrics(listings(spark, d, "category", "price_egp"))
    return rounded(rounded(df, 6, *_Q, "iqr"), 4, "trimmed_mean")


@query("vw_location_intelligence", """, g AS (SELECT city, town, district, count(*) AS listings,
  median(price_egp) AS median_price, median(price_per_sqm) AS median_price_per_sqm
  FROM listings WHERE city IS NOT NULL AND town IS NOT NULL AND district IS NOT NULL GROUP BY ALL)
SELECT *, round(listings * 100.0::DOUBLE / sum(listings) OVER (PARTITION BY city), 8) AS share_of_city,
  CAST(row_number() OVER (PARTITION BY city ORDER BY listings DESC, town, district) AS INTEGER) AS rank_in_city FROM g""")
def _locations(spark, d):
    df = listings(spark, d, "city", "town", "district", "price_egp", "price_per_sqm")
    return rounded(V.vw_location_intelligence(df), 8, "share_of_city")


@query("vw_city_market_profile", """
SELECT city, count(*) FILTER (category = 'buy') AS sale_listings, count(*) FILTER (category = 'rent') AS rent_listings,
  median(price_egp) FILTER (category = 'buy') AS median_sale_price, median(price_egp) FILTER (category = 'rent') AS median_rent_price,
  count(DISTINCT town) AS towns, round(avg(area_value), 4) AS avg_area FROM listings WHERE city IS NOT NULL GROUP BY city""")
def _cities(spark, d):
    df = listings(spark, d, "city", "category", "town", "price_egp", "area_value")
    return rounded(V.vw_city_market_profile(df), 4, "avg_area")


@query("vw_market_opportunity_signals", """, m AS (SELECT category, city, property_type, median(price_per_sqm) AS group_median
  FROM listings WHERE price_per_sqm IS NOT NULL AND city IS NOT NULL AND property_type IS NOT NULL
  GROUP BY ALL),
e AS (SELECT category, city, property_type FROM listings WHERE price_per_sqm IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT listing_id, category, city, property_type, price_egp, price_per_sqm, group_median,
  CASE WHEN group_median > 0 AND (category, city, property_type) IN (SELECT (category, city, property_type) FROM e) THEN (group_median - price_per_sqm) * 100.0::DOUBLE / group_median END AS discount_pct
  FROM listings JOIN m USING (category, city, property_type) WHERE price_per_sqm IS NOT NULL)
SELECT * REPLACE (round(discount_pct, 6) AS discount_pct), CASE WHEN discount_pct IS NULL THEN 'insufficient_data' WHEN discount_pct >= 25 THEN 'strong_opportunity'
  WHEN discount_pct >= 10 THEN 'opportunity' WHEN discount_pct > -10 THEN 'fair' ELSE 'premium' END AS signal FROM s""")
def _signals(spark, d):
    df = listings(spark, d, "listing_id", "category", "city", "property_type", "price_egp", "price_per_sqm")
    return rounded(V.vw_market_opportunity_signals(df), 6, "discount_pct")


_CHECKS = {
    "invalid_price": "price_egp <= 0", "invalid_area": "area_value <= 0", "invalid_latitude": "lat NOT BETWEEN -90 AND 90",
    "invalid_longitude": "lon NOT BETWEEN -180 AND 180", "invalid_images_count": "images_count < 0",
    "null_listing_ids": "listing_id IS NULL",
    **{f"missing_{c}": f"{c} IS NULL" for c in
       ("area_value", "category", "city", "listed_date", "listing_type", "price_egp", "property_type")},
}


@query("vw_data_quality_monitor", ", c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, count(*) FILTER ({t}) AS failing_rows, count(*) AS total_rows FROM listings"
    for n, t in _CHECKS.items()) + """ UNION ALL SELECT 'duplicate_listing_ids', (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (
  SELECT count(*) AS n FROM listings GROUP BY listing_id HAVING count(*) > 1)), count(*) FROM listings)
SELECT check_name, failing_rows, total_rows, round(failing_rows * 100.0::DOUBLE / total_rows, 8) AS pct,
  CASE WHEN failing_rows = 0 THEN 'PASS' WHEN failing_rows * 100.0 / total_rows < 5 THEN 'WARN' ELSE 'FAIL' END AS status FROM c""")
def _monitor(spark, d):
    return rounded(V.vw_data_quality_monitor(listings(spark, d, *_ALL)), 8, "pct")
