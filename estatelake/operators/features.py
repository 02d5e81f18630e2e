"""Model features without target leakage. Every step is a projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.functions import scalars as S
from estatelake.functions import sqltext as X
from estatelake.functions.stats import stacked
from estatelake.schema import (
    CATEGORICAL_FEATURES,
    LEAKAGE_COLUMNS,
    LEGACY_RENT_INPUT,
    LEGACY_SALE_INPUT,
    LOCATION_COLUMNS,
    NUMERIC_FEATURES,
)

# Upper edges and labels of the size classes.
AREA_SIZE = ([60, 100, 150, 250], ["small", "medium", "large", "very_large", "luxury_size"])
AREA = ([80, 120, 180], ["compact", "standard", "spacious", "very_spacious"])
BEDROOMS = ([0, 1, 2, 3], ["studio", "one_bedroom", "two_bedrooms", "three_bedrooms", "four_plus_bedrooms"])
BATHROOMS = ([1, 2, 3], ["one_or_less", "two", "three", "four_plus"])
LARGE_AREA = 200
MANY_BEDROOMS = 4
PAIRS = {
    "city_town": ["city", "town"],
    "town_district": ["town", "district"],
    "district_subdistrict": ["district", "subdistrict"],
    "city_property_type": ["city", "property_type"],
    "district_property_type": ["district", "property_type"],
    "furnished_property_type": ["furnished", "property_type"],
}


def _number(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        return "CAST(NULL AS double)"
    return X.number(X.name(name), S.dtype_of(df, name))


def _indicator(df: DataFrame, name: str) -> str:
    return X.indicator(X.name(name), S.dtype_of(df, name)) if name in df.columns else "0"


def _add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.expr(e) for c, e in columns.items()})


def feat_dates(df: DataFrame, as_of: Column) -> DataFrame:
    """Calendar parts of the listing day; without one, of today less the age, else of today."""
    df = df.withColumn("_today", F.date_trunc("day", as_of.cast("timestamp")))
    tries = []
    if "listed_date" in df.columns:
        tries.append(X.utc_timestamp("listed_date", S.dtype_of(df, "listed_date")))
    if "listing_age_days" in df.columns:
        age = _number(df, "listing_age_days")
        tries.append(f"timestamp_micros(bigint(unix_micros(_today) - ({age}) * 86400e6D))")
    df = df.withColumn("_day", F.expr(f"coalesce({', '.join([*tries, '_today'])})"))
    return _add(df, {
        "listing_year": "year(_day)", "listing_month": "month(_day)", "listing_day": "dayofmonth(_day)",
        "listing_dayofweek": "weekday(_day)",
    }).drop("_today", "_day")


def feat_area(df: DataFrame) -> DataFrame:
    area = _number(df, "area_value")
    return _add(df, {"log_area": f"CASE WHEN ({area}) IS NOT NULL THEN log1p(greatest({area}, 0D)) END"})


def feat_rooms(df: DataFrame) -> DataFrame:
    beds, baths, area = (_number(df, c) for c in ("bedrooms", "bathrooms", "area_value"))
    return _add(df, {
        "total_rooms": f"coalesce({beds}, 0D) + coalesce({baths}, 0D)",
        "bed_bath_ratio": X.ratio(beds, baths),
        "area_per_bedroom": X.ratio(area, beds),
        "area_per_bathroom": X.ratio(area, baths),
        "bathrooms_per_bedroom": X.ratio(baths, beds),
        "bedrooms_per_100sqm": X.ratio(f"({beds}) * 100", area),
    })


def feat_binary(df: DataFrame) -> DataFrame:
    """0/1 columns from their source columns; a supplied value is replaced, no source gives 0."""
    def present(name: str) -> str:
        return f"int({X.name(name)} IS NOT NULL)" if name in df.columns else "0"

    return _add(df, {
        "has_video": present("video_url"), "has_360_view": _indicator(df, "has_view_360"),
        "has_amenities": f"int({X.has_text('amenities')})" if "amenities" in df.columns else "0",
        "has_district": present("district"), "has_subdistrict": present("subdistrict"),
    })


def feat_location_completeness(df: DataFrame) -> DataFrame:
    levels = [f"int({c} IS NOT NULL)" for c in LOCATION_COLUMNS if c in df.columns]
    return _add(df, {"location_completeness": " + ".join(levels or ["0"])})


def feat_listing_quality_score(df: DataFrame) -> DataFrame:
    """Sum of eight flags; needs the columns of ``feat_binary``."""
    parts = ["has_images", "has_video", "has_360_view", "has_amenities", "has_district", "has_subdistrict",
             "is_verified", "is_featured"]
    return _add(df, {"listing_quality_score": " + ".join(_indicator(df, c) for c in parts)})


def feat_agent(df: DataFrame) -> DataFrame:
    languages = "0"
    if "agent_languages" in df.columns:
        languages = f"size(filter(split(coalesce(agent_languages, ''), ','), x -> {X.strip('x')} <> ''))"
    return _add(df, {
        "agent_language_count": languages, "super_agent": _indicator(df, "agent_is_super"),
        "direct_developer": _indicator(df, "is_direct_from_dev"),
    })


def feat_size_flags(df: DataFrame) -> DataFrame:
    return _add(df, {
        "is_large_property": f"int(coalesce(({_number(df, 'area_value')}) >= {LARGE_AREA}, false))",
        "is_high_bedroom": f"int(coalesce(({_number(df, 'bedrooms')}) >= {MANY_BEDROOMS}, false))",
    })


def feat_bins(df: DataFrame) -> DataFrame:
    """Size classes closed on the right; ``unknown`` only where the source column is absent."""
    def binned(name: str, classes: tuple[list, list]) -> str:
        return X.label_up_to(f"({_number(df, name)})", *classes) if name in df.columns else "'unknown'"

    return _add(df, {
        "area_size_category": binned("area_value", AREA_SIZE), "area_category": binned("area_value", AREA),
        "bedroom_category": binned("bedrooms", BEDROOMS), "bathroom_category": binned("bathrooms", BATHROOMS),
    })


def feat_interactions(df: DataFrame) -> DataFrame:
    present = set(df.columns)
    out = {n: X.joined_labels(pair) if set(pair) <= present else "'Unknown'" for n, pair in PAIRS.items()}
    out["property_location"] = X.joined_labels([c if c in present else "'Unknown'" for c in LOCATION_COLUMNS])
    return _add(df, out)


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*LEAKAGE_COLUMNS)


def build_features(df: DataFrame, as_of: Column) -> DataFrame:
    """All features of a listing or request frame; columns that reveal the price are dropped."""
    df = feat_dates(df, as_of)
    for step in (feat_area, feat_rooms, feat_binary, feat_location_completeness, feat_listing_quality_score,
                 feat_agent, feat_size_flags, feat_bins, feat_interactions, drop_leakage):
        df = df.transform(step)
    return df


def ml_dataset(df: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns in their fixed order and ``label`` = log1p(price), rows with a price only.

    ``keep`` names source columns to carry along, such as the key. Numeric features are double.
    """
    if "price_egp" not in df.columns:
        raise ValueError("price_egp is required")
    price = S.number_of(df, "price_egp")
    priced = df.withColumns({"_price": price, **{f"_keep_{c}": F.col(c) for c in keep}}).where(F.col("_price") > 0)
    features = build_features(priced, as_of)
    missing = [c for c in NUMERIC_FEATURES + CATEGORICAL_FEATURES if c not in features.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    features = numeric_features_as_double(features)
    kept = [F.col(f"_keep_{c}").alias(c if c not in NUMERIC_FEATURES + CATEGORICAL_FEATURES else f"{c}_source")
            for c in keep]
    return features.select(*kept, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, F.log1p("_price").alias("label"))


def _as_double(df: DataFrame, c: str) -> str:
    x, dtype = X.name(c), S.dtype_of(df, c)
    if dtype == "boolean":
        return f"double(int({x}))"
    if dtype == "string":
        return f"coalesce({X.number(x, dtype)}, double(int({X.flag(x, dtype)})))"
    return X.finite(x)


def numeric_features_as_double(df: DataFrame) -> DataFrame:
    """All numeric features as finite doubles or NULL; one the frame lacks becomes NULL."""
    return _add(df, {c: _as_double(df, c) if c in df.columns else "CAST(NULL AS double)" for c in NUMERIC_FEATURES})


def conform_model_input(df: DataFrame, market: str) -> DataFrame:
    """The columns of an older model layout in order, NULL where the frame lacks one."""
    layout = {"sale": LEGACY_SALE_INPUT, "rent": LEGACY_RENT_INPUT}[market]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in layout])


def missing_category_token(df: DataFrame, columns: list[str] | None = None, token: str = "__MISSING__") -> DataFrame:
    names = [c for c in (columns or CATEGORICAL_FEATURES) if c in df.columns]
    return df.fillna({c: token for c in names}) if names else df


def category_vocabulary(train: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (column, value) pairs of the training rows."""
    long = stacked(train, columns, "column_name", "value", "string")
    return long.where(F.col("value").isNotNull()).distinct()
