"""Column names and groups of the listing table.

Every list below is a set of fixed values: the names of the listing data model.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the 53 raw columns ------------------------------------------------
RAW_COLUMNS = [
    "listing_id", "internal_id", "reference", "agent_id", "broker_id",
    "category", "listing_type", "property_type", "offering_type", "completion_status",
    "listing_level", "furnished", "payment_method",
    "price_egp", "price_period", "price_currency",
    "location_full", "city", "town", "district", "subdistrict", "lat", "lon",
    "bedrooms", "bathrooms", "area_value", "area_unit",
    "is_premium", "is_verified", "is_featured", "is_new_construction",
    "is_direct_from_dev", "is_exclusive", "has_view_360", "agent_is_super",
    "title", "description", "amenities", "detail_url", "video_url", "images_count",
    "rera", "agent_languages",
    "listed_date", "scraped_at",
    "agent_name", "agent_email", "broker_name", "broker_email", "broker_phone",
    "contact_phone", "contact_whatsapp", "contact_email",
]

# --- fixed values: column groups used by cleaning and validation ----------------------
REQUIRED_COLUMNS = [
    "area_value", "category", "city", "listed_date", "listing_id", "listing_type",
    "price_egp", "property_type",
]
SENSITIVE_COLUMNS = [
    "agent_name", "agent_email", "broker_name", "broker_email", "broker_phone",
    "contact_phone", "contact_whatsapp", "contact_email",
]
FLAG_COLUMNS = [
    "is_premium", "is_verified", "is_featured", "is_new_construction",
    "is_direct_from_dev", "is_exclusive", "has_view_360", "agent_is_super",
]
LABEL_COLUMNS = [
    "category", "listing_type", "property_type", "offering_type", "completion_status",
    "price_period", "price_currency", "city", "town", "district", "subdistrict",
    "area_unit", "furnished", "listing_level", "payment_method",
]
NUMBER_COLUMNS = [
    "internal_id", "price_egp", "lat", "lon", "area_value", "images_count", "rera",
    "agent_id", "broker_id",
]
DATE_COLUMNS = ["listed_date", "scraped_at"]
LOCATION_COLUMNS = ["city", "town", "district", "subdistrict"]

# --- fixed values: types of the load target -------------------------------------------
TARGET_INTEGERS = [
    "listing_id", "bedrooms", "bathrooms", "images_count", "rera", "agent_id",
    "broker_id", "listing_age_days",
]
TARGET_DOUBLES = ["price_egp", "lat", "lon", "area_value", "price_per_sqm"]
TARGET_FLAGS = FLAG_COLUMNS + ["has_images", "has_video"]

# --- fixed values: columns of a search result ------------------------------------------
SEARCH_COLUMNS = [
    "listing_id", "category", "listing_type", "property_type", "offering_type",
    "price_egp", "price_period", "city", "town", "district", "bedrooms", "bathrooms",
    "area_value", "area_unit", "furnished", "listing_level", "is_premium",
    "is_verified", "listed_date", "price_per_sqm",
]

# --- fixed values: model columns ---------------------------------------------------------
LEAKAGE_COLUMNS = ["price_egp", "price_per_sqm", "target", "log_price", "log_target"]
NUMERIC_FEATURES = [
    "lat", "lon", "bedrooms", "bathrooms", "area_value", "is_premium", "is_featured",
    "images_count", "has_view_360", "listing_year", "listing_month", "listing_day",
    "listing_dayofweek", "log_area", "total_rooms", "bed_bath_ratio",
    "area_per_bedroom", "area_per_bathroom", "bathrooms_per_bedroom", "has_video",
    "has_360_view", "has_amenities", "has_district", "has_subdistrict",
    "location_completeness", "listing_quality_score", "agent_language_count",
    "bedrooms_per_100sqm", "is_large_property", "is_high_bedroom",
    "is_new_construction", "is_direct_from_dev", "is_exclusive", "direct_developer",
    "super_agent",
]
CATEGORICAL_FEATURES = [
    "property_type", "city", "town", "district", "subdistrict", "furnished",
    "listing_level", "payment_method", "area_size_category", "bedroom_category",
    "bathroom_category", "city_town", "town_district", "district_subdistrict",
    "property_location", "area_category", "city_property_type",
    "district_property_type", "furnished_property_type",
]

# --- how model categories are encoded, whatever values a table holds: few values by nature, one-hot; the others by their target mean
ONE_HOT_FEATURES = [
    "property_type", "furnished", "listing_level", "payment_method", "area_size_category",
    "bedroom_category", "bathroom_category",
]
TARGET_MEAN_FEATURES = [c for c in CATEGORICAL_FEATURES if c not in ONE_HOT_FEATURES]

# --- fixed values: the two older model input layouts --------------------------------------
LEGACY_SALE_INPUT = [
    "lat", "lon", "bedrooms", "bathrooms", "area_value", "is_premium", "is_featured",
    "images_count", "has_view_360", "listing_year", "listing_month", "listing_day",
    "listing_dayofweek", "log_area", "total_rooms", "bed_bath_ratio",
    "area_per_bedroom", "area_per_bathroom", "bathrooms_per_bedroom", "has_video",
    "has_360_view", "has_amenities", "has_district", "has_subdistrict",
    "location_completeness", "listing_quality_score", "agent_language_count",
    "bedrooms_per_100sqm", "is_luxury_property", "is_large_property",
    "is_high_bedroom", "is_new_construction", "is_direct_from_dev", "is_exclusive",
    "direct_developer", "super_agent", "property_type", "completion_status", "city",
    "town", "district", "subdistrict", "furnished", "listing_level",
    "payment_method", "area_size_category", "bedroom_category", "bathroom_category",
    "city_town", "town_district", "district_subdistrict", "property_location",
    "area_category", "city_property_type", "district_property_type",
    "furnished_property_type",
]
LEGACY_RENT_INPUT = [
    "area_value", "bedrooms", "bathrooms", "log_area", "bedrooms_per_100sqm",
    "bathrooms_per_bedroom", "is_luxury_property", "is_large_property",
    "is_high_bedroom", "is_new_construction", "is_direct_from_dev", "property_type",
    "city", "town", "district", "subdistrict", "furnished", "listing_level",
    "city_town", "town_district", "district_subdistrict", "area_category",
    "bedroom_category", "city_property_type", "district_property_type",
    "furnished_property_type",
]

# --- fixed values: markets and qualified model segments -------------------------------------
OFFERING_BY_MARKET = {"sale": "Residential for Sale", "rent": "Residential for Rent"}
CATEGORY_BY_MARKET = {"sale": "buy", "rent": "rent"}
QUALIFIED_SEGMENTS = [
    ("sale", "chalet"), ("sale", "townhouse"), ("sale", "twin house"),
    ("rent", "duplex"), ("rent", "penthouse"),
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("pipeline_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("source_rows", T.LongType()),
    T.StructField("processed_rows", T.LongType()),
    T.StructField("inserted_rows", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("event_ts", T.TimestampType()),
    # beyond the fixed ones: source rows that were not loaded, for want of an id or for a fraction in an integer
    T.StructField("null_id_rows", T.LongType()),
    T.StructField("unfit_rows", T.LongType()),
])
