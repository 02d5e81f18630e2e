"""Several results together, as lazy frames or as one frame of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.functions.stats import stacked
from estatelake.operators import market as M
from estatelake.plans.views import VIEWS
from estatelake.sources.files import records_json

# Result names of the overview, each with its view.
OVERVIEW_SECTIONS = {
    "overview": "vw_market_overview",
    "summary": "vw_market_summary",
    "robust_metrics": "vw_market_robust_metrics",
    "location_intelligence": "vw_location_intelligence",
    "city_profiles": "vw_city_market_profile",
    "opportunity_signals": "vw_market_opportunity_signals",
}

#: fields that name a record
OVERVIEW_KEYS = ["listing_id", "category", "city", "town", "district", "property_type"]


def market_overview_bundle(df: DataFrame) -> DataFrame:
    """All records of the six market views as (section, record_json), one row per record."""
    parts = [
        records_json(VIEWS[view](df)).select(F.lit(section).alias("section"), "record_json")
        for section, view in OVERVIEW_SECTIONS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def market_analysis(df: DataFrame) -> dict[str, DataFrame]:
    """The fifteen results of a market study by name; nothing runs until one is used."""
    by_market = {"sale": "buy", "rent": "rent"}
    out = {
        "market_overview": M.market_overview(df),
        "price_summary": M.price_summary(df),
        "property_types": M.value_counts(df, "property_type"),
        "locations": M.value_counts(df, "city"),
        "towns": M.value_counts(df, "town"),
        "districts": M.value_counts(df, "district"),
        "property_characteristics": M.property_characteristics(df),
    }
    per_market = {
        "property_type_prices": M.property_type_prices, "city_prices": M.city_prices,
        "bedroom_prices": M.bedroom_prices, "furnished": M.furnished_prices,
    }
    for name, build in per_market.items():
        for market, category in by_market.items():
            out[f"{market}_{name}"] = build(df, category)
    return out


def analysis_rows(results: dict[str, DataFrame]) -> DataFrame:
    """(section, item, measure, value): every number of every result. The item is the result's text or first column; the overview has none."""
    parts = []
    for section, frame in results.items():
        key = None if section == "market_overview" else frame.columns[0]
        measures = [c for c in frame.columns if c != key]
        item = F.lit("") if key is None else F.col(key).cast("string")
        parts.append(stacked(frame.withColumn("section", F.lit(section)).withColumn("item", item), measures, "measure", "value", "double", keep=["section", "item"]))
    return reduce(DataFrame.unionByName, parts).where("value IS NOT NULL")


def bundle_rows(bundle: DataFrame) -> DataFrame:
    """(section, item, measure, value, label): the contents of the records; the item joins a record's key fields.

    Each record is parsed once, and its item is made before its fields become rows. A plain ``explode`` would have Spark add a filter that
    parses every record again to see that it has fields; the row that the outer one makes of a record without fields goes by its missing text.
    """
    parsed = bundle.select("section", F.from_json("record_json", "map<string,string>").alias("fields"))
    item = F.concat_ws("|", *[F.col("fields")[k] for k in OVERVIEW_KEYS])
    cells = parsed.withColumn("item", item).select("section", "item", F.explode_outer("fields").alias("measure", "text"))
    number = F.col("text").try_cast("double")
    return cells.where(~F.col("measure").isin(OVERVIEW_KEYS) & F.col("text").isNotNull()).select(
        "section", "item", "measure", number.alias("value"), F.when(number.isNull(), F.col("text")).alias("label"))
