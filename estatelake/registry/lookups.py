"""Scans, filters, searches and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelake.operators import filters as FI
from estatelake.operators import load as L
from estatelake.operators.dedup import rows_in_duplicate_groups
from estatelake.operators.features import category_vocabulary
from estatelake.operators.quality import missing_required_columns, names_frame
from estatelake.functions.scalars import hash_bucket
from estatelake.plans import bundles, valuation
from estatelake.plans.views import vw_market_overview
from estatelake.registry import views as _views  # noqa: F401  (their checks are part of the bundle's)
from estatelake.registry.base import ORACLES, query, texts
from estatelake.schema import RAW_COLUMNS, SEARCH_COLUMNS
from estatelake.session import stored, work_dir
from estatelake.sources import files
from estatelake.sources.sample import csv_files, listings, raw_listings

_SCAN = ["listing_id", "category", "city", "title", "price_egp", "furnished", "rera", "description"]
_NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"


_BREAKS = """CASE WHEN k_l_suppkey % 3 = 0 THEN concat(title, chr(10), 'a "second" line, and', chr(13), chr(10), chr(10), 'more') ELSE title END"""


@query("scan_listings", "SELECT " + ", ".join(
    f"CASE WHEN {c} NOT IN {_NA}{' AND k_l_suppkey % 2 = 0' if c == 'description' else ''} THEN {c} END AS {c}" for c in _SCAN)
       + f" FROM (SELECT * REPLACE ({_BREAKS} AS title) FROM raw)", over="raw")
def _scan(spark, d):
    """The sample written as CSV, with line breaks in quoted titles, half of it in another column order, without the description and with
    untidy names, and read back through the listing scan."""
    root = work_dir(spark, "scan")
    raw = raw_listings(spark, d, *RAW_COLUMNS, "k_l_suppkey").withColumn("title", F.expr(_BREAKS))
    other = [c for c in reversed(RAW_COLUMNS) if c != "description"]
    halves = {
        f"{root}/a.csv": raw.where("k_l_suppkey % 2 = 0").select(*RAW_COLUMNS),
        f"{root}/b.csv": raw.where("k_l_suppkey % 2 = 1").select(*[F.col(c).alias(f" {c.upper().replace('_', ' ')}") for c in other]),
    }
    for path, part in halves.items():
        part.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                           ignoreTrailingWhiteSpace=False, emptyValue="", **csv_files(spark, d)).csv(path)
    return files.scan_listings(spark, list(halves)).select(*_SCAN)


_SUMMARY_COLUMNS = ["category", "city", "town", "district", "subdistrict", "property_type", "bedrooms", "furnished"]


@query("dataset_summary", f"""
SELECT count(*) AS rows, {len(_SUMMARY_COLUMNS)} AS columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_SUMMARY_COLUMNS)} FROM listings)) AS duplicate_rows,
  CAST({' + '.join(f'sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in _SUMMARY_COLUMNS)} AS BIGINT) AS missing_cells
FROM listings""")
def _summary(spark, d):
    return files.dataset_summary(listings(spark, d, *_SUMMARY_COLUMNS)).drop("column_names")


@query("scan_training_rows", """
SELECT listing_id, offering_type, price_egp FROM listings
WHERE price_egp IS NOT NULL AND price_egp > 0 AND offering_type IS NOT NULL""")
def _training_rows(spark, d):
    return files.scan_training_rows(listings(spark, d, "listing_id", "offering_type", "price_egp"))


@query("scan_view", """
SELECT count(*) AS total_listings, count(*) FILTER (category = 'buy') AS sale_listings,
  count(*) FILTER (category = 'rent') AS rent_listings FROM listings""")
def _view(spark, d):
    vw_market_overview(listings(spark, d, "category", "price_egp", "price_per_sqm")).createOrReplaceTempView("vw_market_overview")
    return files.scan_view(spark, "vw_market_overview").select("total_listings", "sale_listings", "rent_listings")


@query("records_json", """
SELECT listing_id, '{"listing_id":' || listing_id || ',"city":' || coalesce('"' || city || '"', 'null') || '}' AS record_json
FROM listings""")
def _records(spark, d):
    df = listings(spark, d, "listing_id", "city")
    packed = files.records_json(df)
    return packed.select(F.get_json_object("record_json", "$.listing_id").cast("bigint").alias("listing_id"), "record_json")


def _bundle_sql() -> str:
    """The contents of the six views, which have checks of their own, as (section, item, measure, value, label)."""
    keys = {"overview": [], "summary": ["category", "property_type"], "robust_metrics": ["category"], "location_intelligence": ["city", "town", "district"],
            "city_profiles": ["city"], "opportunity_signals": ["listing_id", "category", "city", "property_type"]}
    parts = []
    for section, names in keys.items():
        sql = ORACLES[bundles.OVERVIEW_SECTIONS[section]]
        item = f"concat_ws('|', {', '.join(names)})" if names else "''"
        labels = ["signal"] if section == "opportunity_signals" else []
        left_out = f" EXCLUDE ({', '.join([*names, *labels])})" if names else ""
        parts.append(f"SELECT '{section}' AS section, item, measure, value, NULL::VARCHAR AS label FROM (UNPIVOT (SELECT {item} AS item, COLUMNS(*{left_out})::DOUBLE FROM ({sql})) "
                     "ON COLUMNS(* EXCLUDE (item)) INTO NAME measure VALUE value)")
        parts += [f"SELECT '{section}', {item}, '{c}', NULL::DOUBLE, {c} FROM ({sql})" for c in labels]
    return " UNION ALL ".join(parts)


@query("market_overview_bundle", _bundle_sql(), over=None)
def _bundle(spark, d):
    # stored once: the six views read this narrow table
    df = stored(listings(spark, d, "listing_id", "category", "city", "town", "district", "property_type", "price_egp",
                         "area_value", "price_per_sqm"), "overview")
    rows = bundles.bundle_rows(bundles.market_overview_bundle(df))
    return rows.withColumn("value", F.expr("""CASE WHEN measure = 'share_of_city' THEN round(value, 8)
        WHEN measure IN ('discount_pct', 'iqr') OR section = 'robust_metrics' AND measure IN ('p10', 'p25', 'median_price', 'p75', 'p90') THEN round(value, 6)
        WHEN measure LIKE 'avg_%' OR measure = 'trimmed_mean' THEN round(value, 4) ELSE value END"""))


# --- filters and lookups --------------------------------------------------------------------

_SEARCHED = SEARCH_COLUMNS


@query("search_listings", f"""
SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' if c in ('is_verified', 'listed_date') else c for c in _SEARCHED)}
FROM (SELECT {', '.join(_SEARCHED)} FROM listings WHERE city = 'ASIA' AND listing_type = 'sale'
ORDER BY listed_date DESC NULLS LAST, {', '.join(c + ' NULLS FIRST' for c in _SEARCHED if c != 'listed_date')} LIMIT 100)""")
def _search(spark, d):
    found = FI.search_listings(listings(spark, d, *_SEARCHED), city="ASIA", listing_type="sale", property_type=" ", limit=100)
    return texts(found, "is_verified", "listed_date")


@query("area_price_pairs", """
SELECT category, area_value, price_egp FROM listings WHERE category IN ('buy', 'rent') AND area_value IS NOT NULL AND price_egp IS NOT NULL""")
def _pairs(spark, d):
    df = listings(spark, d, "category", "area_value", "price_egp")
    return _both_markets(lambda c: FI.area_price_pairs(df, c))


@query("price_per_sqm_listings", """
SELECT category, property_type, city, area_value, price_egp, price_egp / area_value AS price_per_sqm
FROM listings WHERE category IN ('buy', 'rent') AND area_value > 0 AND price_egp > 0""")
def _per_sqm(spark, d):
    df = listings(spark, d, "category", "property_type", "city", "area_value", "price_egp")
    return _both_markets(lambda c: FI.price_per_sqm_listings(df, c))


def _both_markets(of):
    sale, rent = (of(c).withColumn("category", F.lit(c)) for c in ("buy", "rent"))
    return sale.unionByName(rent)


@query("p99_trim", """, v AS (SELECT category, area_value, price_egp FROM listings WHERE area_value > 0 AND price_egp > 0),
a AS (SELECT category, quantile_cont(area_value, 0.99) AS bound FROM v GROUP BY category),
w AS (SELECT v.* FROM v JOIN a USING (category) WHERE area_value <= bound),
p AS (SELECT category, quantile_cont(price_egp, 0.99) AS bound FROM w GROUP BY category)
SELECT category, area_value, price_egp FROM w JOIN p USING (category) WHERE price_egp <= bound""")
def _trim(spark, d):
    return FI.p99_trim(listings(spark, d, "category", "area_value", "price_egp"))


@query("city_locations", """
SELECT city, town, district, count(*) AS listings FROM listings WHERE lower(city) = 'europe' GROUP BY ALL""")
def _city_locations(spark, d):
    return FI.city_locations(listings(spark, d, "city", "town", "district"), "Europe")


@query("page_listings", """
SELECT listing_id, category, price_egp, area_value, (SELECT count(*) FROM listings) AS total FROM listings
ORDER BY listing_id, category, price_egp NULLS FIRST, area_value LIMIT 50 OFFSET 200""")
def _page(spark, d):
    df = listings(spark, d, "listing_id", "category", "price_egp", "area_value")
    return FI.page_listings(df, 200, 50, ["listing_id", "category", "price_egp", "area_value"])


@query("page_after", """
, p AS (SELECT DISTINCT listing_id, category, price_egp, area_value FROM listings),
n AS (SELECT *, row_number() OVER (ORDER BY listing_id, category, price_egp NULLS FIRST, area_value) AS place FROM p)
SELECT listing_id, category, price_egp, area_value FROM n WHERE place BETWEEN 101 AND 150""")
def _page_after(spark, d):
    """The page after the last row of another page."""
    columns = ["listing_id", "category", "price_egp", "area_value"]
    df = listings(spark, d, *columns).distinct()
    order = [F.col(c).asc_nulls_first() for c in columns]
    last = df.orderBy(*order).limit(100).orderBy(*[F.col(c).desc_nulls_last() for c in columns]).first().asDict()
    return FI.page_after(df, last, 50)


@query("first_numeric_value", """
SELECT price_egp AS value FROM listings WHERE price_egp IS NOT NULL ORDER BY listing_id, price_egp LIMIT 1""")
def _first_value(spark, d):
    return FI.first_numeric_value(listings(spark, d, "listing_id", "price_egp"), ["amount", "PRICE_EGP"], ["listing_id"])


_RULE_ROWS = """SELECT listing_id, listing_type AS market_type, offering_type,
  CASE WHEN listing_id % 17 = 0 THEN ' ' ELSE property_type END AS property_type, area_value, bedrooms, bathrooms,
  images_count, lat, lon, CASE WHEN listing_id % 19 = 0 THEN price_egp END AS price_egp,
  CASE WHEN listing_id % 23 = 0 THEN 'elsewhere' ELSE listing_type END AS m FROM listings"""


@query("request_rules", f"""
SELECT listing_id, CASE
  WHEN m NOT IN ('sale', 'rent') THEN 'market_type must be sale or rent'
  WHEN price_egp IS NOT NULL THEN 'forbidden field price_egp'
  WHEN property_type IS NULL THEN 'property_type is required'
  WHEN trim(property_type) = '' THEN 'property_type cannot be empty'
  WHEN area_value < 0 THEN 'area_value cannot be negative'
  WHEN bedrooms < 0 THEN 'bedrooms cannot be negative'
  WHEN bathrooms < 0 THEN 'bathrooms cannot be negative'
  WHEN images_count < 0 THEN 'images_count cannot be negative'
  WHEN area_value <= 0 THEN 'area_value must be greater than zero'
  WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat must be between -90 and 90'
  WHEN lon NOT BETWEEN -180 AND 180 THEN 'lon must be between -180 and 180'
  WHEN lower(offering_type) <> CASE m WHEN 'sale' THEN 'residential for sale' ELSE 'residential for rent' END
    THEN 'offering_type does not match market_type' END AS rejection_reason FROM ({_RULE_ROWS})""")
def _rules(spark, d):
    id17 = F.col("listing_id")
    requests = listings(spark, d, "listing_id", "listing_type", "offering_type", "property_type", "area_value",
                        "bedrooms", "bathrooms", "images_count", "lat", "lon", "price_egp").withColumns({
        "property_type": F.when(id17 % 17 == 0, " ").otherwise(F.col("property_type")),
        "price_egp": F.when(id17 % 19 == 0, F.col("price_egp")),
        "market_type": F.when(id17 % 23 == 0, "elsewhere").otherwise(F.col("listing_type")),
    })
    return FI.request_rules(requests).select("listing_id", "rejection_reason")


# --- joins and sets ---------------------------------------------------------------------------

@query("new_listings", """, held AS (SELECT DISTINCT listing_id FROM listings WHERE k_l_suppkey % 3 = 0)
SELECT listing_id, price_egp FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM held)""")
def _new(spark, d):
    df = listings(spark, d, "listing_id", "price_egp", "k_l_suppkey")
    held = df.where(F.col("k_l_suppkey") % 3 == 0)
    return L.new_listings(df, held).select("listing_id", "price_egp")


@query("existing_listings", """
SELECT count(DISTINCT listing_id) AS existing_rows FROM listings WHERE k_l_suppkey % 3 = 0 AND listing_id IN (
  SELECT listing_id FROM listings WHERE k_l_suppkey % 3 = 1)""")
def _existing(spark, d):
    df = listings(spark, d, "listing_id", "k_l_suppkey")
    return L.existing_listings(df.where(F.col("k_l_suppkey") % 3 == 0), df.where(F.col("k_l_suppkey") % 3 == 1))


@query("route_model_group", """
SELECT listing_type AS market_type, property_type, CASE
  WHEN (listing_type = 'sale' AND lower(property_type) IN ('economy', 'promo'))
    OR (listing_type = 'rent' AND lower(property_type) = 'large') THEN 'specialized' ELSE 'market' END AS model_resolution,
  count(*) AS n FROM listings GROUP BY ALL""")
def _route(spark, d):
    requests = listings(spark, d, "listing_type", "property_type").withColumnRenamed("listing_type", "market_type")
    qualified = [("sale", "Economy"), ("sale", "promo"), ("rent", "large"), ("rent", "medium")]
    trained = [("sale", "ECONOMY"), ("sale", "PROMO"), ("rent", "LARGE"), ("rent", "SMALL")]
    routed = valuation.route_model_group(requests, qualified, trained)
    return routed.groupBy("market_type", "property_type", "model_resolution").agg(F.count(F.lit(1)).alias("n"))


@query("missing_required_columns", """
SELECT 'area_value' AS column_name, count(*) AS checked_rows FROM listings
UNION ALL SELECT 'listed_date', count(*) FROM listings""")
def _required(spark, d):
    df = listings(spark, d, "listing_id", "category", "listing_type", "property_type", "price_egp", "city")
    return names_frame(df, missing_required_columns(df), "column_name")


@query("category_vocabulary", """
, t AS (SELECT * FROM listings WHERE CAST('0x' || substr(md5(CAST(listing_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80)
SELECT DISTINCT 'city' AS column_name, city AS value FROM t WHERE city IS NOT NULL
UNION SELECT DISTINCT 'town', town FROM t UNION SELECT DISTINCT 'furnished', furnished FROM t WHERE furnished IS NOT NULL""")
def _vocabulary(spark, d):
    train = listings(spark, d, "listing_id", "city", "town", "furnished").where(hash_bucket(F.col("listing_id")) < 80)
    return category_vocabulary(train, ["city", "town", "furnished"])


@query("rows_in_duplicate_groups", """
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_duplicate_groups FROM (
  SELECT count(*) AS n FROM listings GROUP BY listing_id HAVING count(*) > 1)""")
def _dup_groups(spark, d):
    return rows_in_duplicate_groups(listings(spark, d, "listing_id"))


