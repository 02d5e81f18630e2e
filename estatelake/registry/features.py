"""Feature steps over typed listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelake.operators import features as E
from estatelake.registry.base import as_of, query, rounded
from estatelake.schema import CATEGORICAL_FEATURES, LEGACY_RENT_INPUT, LEGACY_SALE_INPUT, NUMERIC_FEATURES
from estatelake.sources.sample import listings

MODEL_SOURCE = [
    "listing_id", "category", "offering_type", "property_type", "city", "town", "district", "subdistrict", "furnished",
    "listing_level", "payment_method", "price_egp", "lat", "lon", "bedrooms", "bathrooms", "area_value", "is_premium",
    "is_featured", "is_verified", "is_new_construction", "is_direct_from_dev", "is_exclusive", "has_view_360",
    "agent_is_super", "amenities", "video_url", "images_count", "agent_languages", "listed_date", "has_images",
]


def _b(c: str) -> str:
    return f"coalesce(CAST({c} AS INTEGER), 0)"


DATE_PARTS = {
    "listing_year": "CAST(year(listed_date) AS INTEGER)", "listing_month": "CAST(month(listed_date) AS INTEGER)",
    "listing_day": "CAST(day(listed_date) AS INTEGER)", "listing_dayofweek": "CAST(isodow(listed_date) - 1 AS INTEGER)",
}
ROOMS = {
    "total_rooms": "coalesce(bedrooms, 0) + coalesce(bathrooms, 0)",
    "bed_bath_ratio": "bedrooms / nullif(bathrooms, 0)", "area_per_bedroom": "area_value / nullif(bedrooms, 0)",
    "area_per_bathroom": "area_value / nullif(bathrooms, 0)", "bathrooms_per_bedroom": "bathrooms / nullif(bedrooms, 0)",
    "bedrooms_per_100sqm": "bedrooms * 100 / nullif(area_value, 0)",
}
BINARY = {
    "has_video": "CAST(video_url IS NOT NULL AS INTEGER)", "has_360_view": _b("has_view_360"),
    "has_amenities": "CAST(trim(coalesce(amenities, '')) <> '' AS INTEGER)",
    "has_district": "CAST(district IS NOT NULL AS INTEGER)", "has_subdistrict": "CAST(subdistrict IS NOT NULL AS INTEGER)",
}
COMPLETE = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ("city", "town", "district", "subdistrict"))
SCORE = " + ".join([_b("has_images"), *[f"({e})" for e in BINARY.values()], _b("is_verified"), _b("is_featured")])
LANGUAGES = "CAST(len(list_filter(string_split(coalesce(agent_languages, ''), ','), lambda x: trim(x) <> '')) AS INTEGER)"
AGENT = {"agent_language_count": LANGUAGES, "super_agent": _b("agent_is_super"), "direct_developer": _b("is_direct_from_dev")}
SIZE = {"is_large_property": "CAST(coalesce(area_value >= 200, false) AS INTEGER)",
        "is_high_bedroom": "CAST(coalesce(bedrooms >= 4, false) AS INTEGER)"}


def _bin(c: str, edges: list, labels: list[str]) -> str:
    tests = " ".join(f"WHEN {c} <= {e} THEN '{n}'" for e, n in zip(edges, labels))
    return f"CASE {tests} WHEN {c} IS NOT NULL THEN '{labels[-1]}' END"


BINS = {
    "area_size_category": _bin("area_value", [60, 100, 150, 250], ["small", "medium", "large", "very_large", "luxury_size"]),
    "area_category": _bin("area_value", [80, 120, 180], ["compact", "standard", "spacious", "very_spacious"]),
    "bedroom_category": _bin("bedrooms", [0, 1, 2, 3],
                             ["studio", "one_bedroom", "two_bedrooms", "three_bedrooms", "four_plus_bedrooms"]),
    "bathroom_category": _bin("bathrooms", [1, 2, 3], ["one_or_less", "two", "three", "four_plus"]),
}


def _pair(*parts: str) -> str:
    return " || ' | ' || ".join(f"coalesce({p}, 'Unknown')" for p in parts)


INTERACTIONS = {
    "city_town": _pair("city", "town"), "town_district": _pair("town", "district"),
    "district_subdistrict": _pair("district", "subdistrict"), "city_property_type": _pair("city", "property_type"),
    "district_property_type": _pair("district", "property_type"),
    "furnished_property_type": _pair("furnished", "property_type"),
    "property_location": _pair("city", "town", "district", "subdistrict"),
}
LOG_AREA = {"log_area": "round(ln(1 + greatest(area_value, 0)), 10)"}


def _select(columns: dict[str, str]) -> str:
    return "SELECT listing_id, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM listings"


def _feature(name: str, columns: dict[str, str], step, *sources: str):
    def run(spark, d):
        out = step(listings(spark, d, "listing_id", *sources)).select("listing_id", *columns)
        return rounded(out, 10, "log_area") if "log_area" in columns else out

    query(name, _select(columns))(run)


_feature("feat_dates", DATE_PARTS, lambda df: E.feat_dates(df, as_of()), "listed_date")
_feature("feat_area", LOG_AREA, E.feat_area, "area_value")
_feature("feat_rooms", ROOMS, E.feat_rooms, "bedrooms", "bathrooms", "area_value")
_feature("feat_binary", BINARY, E.feat_binary, "video_url", "has_view_360", "amenities", "district", "subdistrict")
_feature("feat_location_completeness", {"location_completeness": COMPLETE}, E.feat_location_completeness,
         "city", "town", "district", "subdistrict")
_feature("feat_listing_quality_score", {"listing_quality_score": SCORE},
         lambda df: E.feat_listing_quality_score(E.feat_binary(df)), "has_images", "video_url", "has_view_360",
         "amenities", "district", "subdistrict", "is_verified", "is_featured")
_feature("feat_agent", AGENT, E.feat_agent, "agent_languages", "agent_is_super", "is_direct_from_dev")
_feature("feat_size_flags", SIZE, E.feat_size_flags, "area_value", "bedrooms")
_feature("feat_bins", BINS, E.feat_bins, "area_value", "bedrooms", "bathrooms")
_feature("feat_interactions", INTERACTIONS, E.feat_interactions, "city", "town", "district", "subdistrict",
         "property_type", "furnished")


@query("drop_leakage", "SELECT listing_id, city FROM listings")
def _leak(spark, d):
    return E.drop_leakage(listings(spark, d, "listing_id", "price_egp", "price_per_sqm", "city"))


_ALL = DATE_PARTS | LOG_AREA | ROOMS | BINARY | {"location_completeness": COMPLETE, "listing_quality_score": SCORE} | AGENT | SIZE
_NUMERIC = {c: _ALL.get(c, f"CAST({c} AS INTEGER)" if c.startswith(("is_", "has_")) else c) for c in NUMERIC_FEATURES}
_CATEGORICAL = {c: (BINS | INTERACTIONS).get(c, c) for c in CATEGORICAL_FEATURES}


@query("build_features", _select(
    {c: e for c, e in (_ALL | BINS | INTERACTIONS).items()}))
def _features(spark, d):
    out = E.build_features(listings(spark, d, *MODEL_SOURCE), as_of())
    return rounded(out.select("listing_id", *_ALL, *BINS, *INTERACTIONS), 10, "log_area")


@query("ml_dataset", "SELECT listing_id, " + ", ".join(
    [f"CAST({e} AS DOUBLE) AS {c}" for c, e in _NUMERIC.items()] + [f"{e} AS {c}" for c, e in _CATEGORICAL.items()])
    + ", round(ln(1 + price_egp), 10) AS label FROM listings WHERE price_egp > 0")
def _dataset(spark, d):
    out = E.ml_dataset(listings(spark, d, *MODEL_SOURCE), as_of(), keep=("listing_id",))
    return rounded(out, 10, "log_area", "label")


_LEGACY_KNOWN = ["area_value", "bedrooms", "bathrooms", "property_type", "city", "town", "district", "subdistrict",
                 "furnished", "listing_level"]


def _layout_sql(layout: list[str]) -> str:
    return "SELECT " + ", ".join(c if c in _LEGACY_KNOWN else f"CAST(NULL AS VARCHAR) AS {c}" for c in layout) + " FROM listings"


@query("conform_model_input", _layout_sql(LEGACY_RENT_INPUT))
def _conform(spark, d):
    return E.conform_model_input(listings(spark, d, *_LEGACY_KNOWN), "rent")


@query("conform_model_input_sale", _layout_sql(LEGACY_SALE_INPUT))
def _conform_sale(spark, d):
    """The older layout of the other market; another query, as its columns differ."""
    return E.conform_model_input(listings(spark, d, *_LEGACY_KNOWN), "sale")


@query("missing_category_token", """
SELECT coalesce(city, '__MISSING__') AS city, coalesce(property_type, '__MISSING__') AS property_type,
  coalesce(furnished, '__MISSING__') AS furnished, count(*) AS n FROM listings GROUP BY ALL""")
def _token(spark, d):
    keys = ["city", "property_type", "furnished"]
    filled = E.missing_category_token(listings(spark, d, *keys))
    return filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
