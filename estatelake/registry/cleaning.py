"""Cleaning steps over the raw text listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelake.operators import clean as C
from estatelake.operators.filters import market_filter
from estatelake.registry.base import AS_OF_TEXT, as_of, query, rounded, texts
from estatelake.schema import FLAG_COLUMNS, RAW_COLUMNS, SENSITIVE_COLUMNS
from estatelake.sources.sample import KEEP_ORDER, listings, raw_listings

BLANKS = "('', 'nan', 'None', 'null', 'NULL')"


def text_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN {BLANKS} THEN trim({c}) END"


def label_sql(c: str) -> str:
    return f"regexp_replace({text_sql(c)}, '\\s+', ' ', 'g')"


def number_sql(c: str) -> str:
    return (f"CASE WHEN regexp_full_match({text_sql(c)}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN try_cast({text_sql(c)} AS DOUBLE) END")


def flag_sql(c: str) -> str:
    low = f"lower(trim({c}))"
    return (f"CASE WHEN {low} IN ('true','1','yes','y','t') THEN true "
            f"WHEN {low} IN ('false','0','no','n','f') THEN false END")


def date_sql(c: str) -> str:
    return f"try_cast({text_sql(c)} AS TIMESTAMP)"


def rooms_sql(c: str) -> str:
    return f"CAST(nullif(regexp_extract({text_sql(c)}, '([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE)"


AREA_UNIT_SQL = ("CASE WHEN lower(u) IN ('sqm','m2','m²','square meter','square meters') THEN 'sqm' ELSE lower(u) END")
FURNISHED_SQL = ("CASE WHEN lower(u) IN ('yes','true','1') THEN 'furnished' "
                 "WHEN lower(u) IN ('no','false','0') THEN 'not_furnished' "
                 "WHEN lower(u) IN ('partly','partial') THEN 'partly_furnished' ELSE lower(u) END")


def _as(c: str, e: str) -> str:
    return f"{e} AS {c}"


@query("standardize_column_names", """
SELECT CAST(l_orderkey AS VARCHAR) AS listing_id, l_returnflag AS market_flag, l_linenumber AS nr_2 FROM lineitem""",
       over=None)
def _names(spark, d):
    from estatelake.sources.sample import table

    odd = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias(" Listing-ID "), F.col("l_returnflag").alias("Market (Flag)"),
        F.col("l_linenumber").alias("__Nr. 2"),
    )
    return C.standardize_column_names(odd)


_TEXTS = ["title", "district", "completion_status", "furnished", "video_url", "amenities", "town"]


@query("clean_text_columns", "SELECT " + ", ".join(_as(c, text_sql(c)) for c in _TEXTS) + " FROM raw", over="raw")
def _text(spark, d):
    return C.clean_text_columns(raw_listings(spark, d, *_TEXTS))


_LABELS = ["listing_type", "offering_type", "town", "district"]


@query("normalize_categories",
       "SELECT " + ", ".join(_as(c, f"regexp_replace(trim({c}), '\\s+', ' ', 'g')") for c in _LABELS) + " FROM raw",
       over="raw")
def _labels(spark, d):
    return C.normalize_categories(raw_listings(spark, d, *_LABELS))


_NUMBERS = ["price_egp", "area_value", "lat", "lon", "images_count", "broker_id", "agent_id"]


def _valid(c: str) -> str:
    test = {"price_egp": "> 0", "area_value": "> 0", "lat": "BETWEEN -90 AND 90", "lon": "BETWEEN -180 AND 180",
            "images_count": ">= 0"}.get(c)
    n = number_sql(c)
    return n if test is None else f"CASE WHEN ({n}) {test} THEN {n} END"


@query("clean_numeric_columns", "SELECT " + ", ".join(_as(c, _valid(c)) for c in _NUMBERS) + " FROM raw", over="raw")
def _numeric(spark, d):
    return C.clean_numeric_columns(raw_listings(spark, d, *_NUMBERS))


@query("normalize_boolean_columns",
       "SELECT " + ", ".join(_as(c, f"CAST({flag_sql(c)} AS VARCHAR)") for c in FLAG_COLUMNS) + " FROM raw", over="raw")
def _flags(spark, d):
    return texts(C.normalize_boolean_columns(raw_listings(spark, d, *FLAG_COLUMNS)), *FLAG_COLUMNS)


@query("parse_dates", "SELECT " + ", ".join(
    _as(c, f"CAST({date_sql(c)} AS VARCHAR)") for c in ("listed_date", "scraped_at")) + " FROM raw", over="raw")
def _dates(spark, d):
    return texts(C.parse_dates(raw_listings(spark, d, "listed_date", "scraped_at")), "listed_date", "scraped_at")


@query("extract_room_counts",
       "SELECT " + ", ".join(_as(c, rooms_sql(c)) for c in ("bedrooms", "bathrooms")) + " FROM raw", over="raw")
def _rooms(spark, d):
    return C.extract_room_counts(raw_listings(spark, d, "bedrooms", "bathrooms"))


@query("normalize_area_unit",
       f"SELECT {AREA_UNIT_SQL} AS area_unit, count(*) AS n FROM (SELECT trim(area_unit) AS u FROM raw) GROUP BY 1", over="raw")
def _unit(spark, d):
    return C.normalize_area_unit(raw_listings(spark, d, "area_unit")).groupBy("area_unit").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_furnished",
       f"SELECT {FURNISHED_SQL} AS furnished, count(*) AS n FROM (SELECT trim(furnished) AS u FROM raw) GROUP BY 1", over="raw")
def _furnished(spark, d):
    return C.normalize_furnished(raw_listings(spark, d, "furnished")).groupBy("furnished").agg(F.count(F.lit(1)).alias("n"))


@query("price_per_sqm", """
SELECT listing_id, CASE WHEN area_value > 0 THEN price_egp / area_value END AS price_per_sqm FROM listings""")
def _ppsqm(spark, d):
    return C.price_per_sqm(listings(spark, d, "listing_id", "price_egp", "area_value")).select("listing_id", "price_per_sqm")


def age_sql(date: str) -> str:
    return f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF_TEXT}') - epoch_us({date})) / 86400000000.0) AS BIGINT)"


@query("listing_age_days", f"SELECT listing_id, {age_sql('listed_date')} AS listing_age_days FROM listings")
def _age(spark, d):
    return C.listing_age_days(listings(spark, d, "listing_id", "listed_date"), as_of()).drop("listed_date")


def path_sql(parts: list[str]) -> str:
    return "nullif(trim(" + " || ' | ' || ".join(f"coalesce({p}, '')" for p in parts) + ", ' |'), '')"


_PLACES = ["city", "town", "district", "subdistrict"]


@query("location_key", f"SELECT {path_sql(_PLACES)} AS location_key, count(*) AS n FROM listings GROUP BY 1")
def _location(spark, d):
    keyed = C.location_key(listings(spark, d, *_PLACES))
    return keyed.groupBy("location_key").agg(F.count(F.lit(1)).alias("n"))


@query("media_flags", """
SELECT listing_id, coalesce(images_count > 0, false) AS has_images,
  coalesce(trim(video_url) <> '', false) AS has_video FROM listings""")
def _media(spark, d):
    return C.media_flags(listings(spark, d, "listing_id", "images_count", "video_url")).drop("images_count", "video_url")


@query("final_quality_rules", f"""
SELECT listing_id, CASE WHEN price_per_sqm > 0 THEN price_per_sqm END AS price_per_sqm,
  CASE WHEN {age_sql('listed_date')} <= 3650 THEN {age_sql('listed_date')} END AS listing_age_days FROM listings""")
def _rules(spark, d):
    aged = C.listing_age_days(listings(spark, d, "listing_id", "price_per_sqm", "listed_date"), as_of())
    return C.final_quality_rules(aged).drop("listed_date")


@query("drop_sensitive_columns", "SELECT " + ", ".join(c for c in RAW_COLUMNS if c not in SENSITIVE_COLUMNS) + " FROM raw",
       over="raw")
def _private(spark, d):
    return C.drop_sensitive_columns(raw_listings(spark, d))


def _transform_sql() -> str:
    out = {}
    for c in RAW_COLUMNS:
        if c in SENSITIVE_COLUMNS:
            continue
        if c in FLAG_COLUMNS:
            out[c] = flag_sql(c)
        elif c in ("price_egp", "area_value", "lat", "lon", "images_count", "internal_id", "rera", "agent_id", "broker_id"):
            out[c] = _valid(c)
        elif c in ("listed_date", "scraped_at"):
            out[c] = date_sql(c)
        elif c in ("bedrooms", "bathrooms"):
            out[c] = rooms_sql(c)
        elif c == "area_unit":
            out[c] = AREA_UNIT_SQL.replace("(u)", f"({label_sql(c)})")
        elif c == "furnished":
            out[c] = FURNISHED_SQL.replace("(u)", f"({label_sql(c)})")
        elif c in C.LABEL_COLUMNS:
            out[c] = label_sql(c)
        else:
            out[c] = text_sql(c)
    cols = ", ".join(_as(c, e) for c, e in out.items())
    order = ", ".join(f"{c} DESC" for c in KEEP_ORDER)
    shown = [f"CAST({c} AS VARCHAR) AS {c}" if c in FLAG_COLUMNS + ["listed_date", "scraped_at"] else c for c in out]
    return f""", cleaned AS (SELECT {cols}, row_number() OVER (
      PARTITION BY {text_sql('listing_id')} ORDER BY {order}) AS place FROM raw),
    kept AS (SELECT *, CASE WHEN area_value > 0 THEN price_egp / area_value END AS p, {age_sql('listed_date')} AS age
      FROM cleaned WHERE place = 1)
    SELECT {', '.join(shown)}, CASE WHEN p > 0 THEN p END AS price_per_sqm,
      CASE WHEN age BETWEEN 0 AND 3650 THEN age END AS listing_age_days, {path_sql(_PLACES)} AS location_key,
      CAST(coalesce(images_count > 0, false) AS VARCHAR) AS has_images,
      CAST(video_url IS NOT NULL AS VARCHAR) AS has_video FROM kept"""


def processed_listings(spark, d, keep_null_ids: bool = True):
    """The raw sample after the whole cleaning chain."""
    raw = raw_listings(spark, d, *RAW_COLUMNS, *KEEP_ORDER)
    return C.transform_listings(raw, as_of(), order_by=KEEP_ORDER, keep_null_ids=keep_null_ids).drop(*KEEP_ORDER)


@query("transform_listings", _transform_sql(), over="raw")
def _transform(spark, d):
    flags = FLAG_COLUMNS + ["has_images", "has_video", "listed_date", "scraped_at"]
    return texts(processed_listings(spark, d), *flags)


@query("select_by_dtype", "SELECT price_egp, area_value, lat FROM listings")
def _by_type(spark, d):
    return C.select_by_dtype(listings(spark, d, "city", "price_egp", "area_value", "is_premium", "lat"), "numeric")


@query("price_prepare", """
SELECT category, count(*) AS listings, round(avg(p), 4) AS mean_price FROM (
  SELECT category, try_cast(price_egp AS DOUBLE) AS p FROM raw) WHERE p > 0 GROUP BY category""", over="raw")
def _price(spark, d):
    priced = C.price_prepare(raw_listings(spark, d, "category", "price_egp"))
    out = priced.groupBy("category").agg(F.count(F.lit(1)).alias("listings"), F.avg("price_egp").alias("mean_price"))
    return rounded(out, 4, "mean_price")


@query("market_filter", """
SELECT 'lower' AS mode, count(*) AS n FROM raw WHERE lower(category) = 'rent'
UNION ALL SELECT 'strip_lower', count(*) FROM raw WHERE lower(trim(listing_type)) = 'rent'
UNION ALL SELECT 'exact', count(*) FROM raw WHERE listing_type = ' rent '""", over="raw")
def _market_filter(spark, d):
    df = raw_listings(spark, d, "category", "listing_type")
    cases = [("lower", "category", "RENT"), ("strip_lower", "listing_type", "Rent"), ("exact", "listing_type", " rent ")]
    parts = [
        market_filter(df, c, v, normalize=m).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n")
        for m, c, v in cases
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
