"""Filters, searches and input rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.functions import scalars as S
from estatelake.functions.stats import group_stats
from estatelake.schema import CATEGORY_BY_MARKET, LEAKAGE_COLUMNS, OFFERING_BY_MARKET, SEARCH_COLUMNS


def market_filter(df: DataFrame, column: str, value: str, normalize: str = "lower") -> DataFrame:
    """Rows of one market: ``lower`` ignores case, ``strip_lower`` also outer blanks, ``exact`` nothing."""
    forms = {
        "lower": lambda: F.lower(F.col(column)) == value.lower(),
        "strip_lower": lambda: F.lower(S.strip(F.col(column))) == value.strip().lower(),
        "exact": lambda: F.col(column) == value,
    }
    return df.where(forms[normalize]())


def search_listings(
    df: DataFrame,
    city: str | None = None,
    property_type: str | None = None,
    listing_type: str | None = None,
    offering_type: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """Newest listings that equal all given texts; an empty text means no condition."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    given = {"city": city, "property_type": property_type, "listing_type": listing_type,
             "offering_type": offering_type}
    tests = [F.col(c) == v.strip() for c, v in given.items() if v and v.strip()]
    found = df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    columns = [c for c in SEARCH_COLUMNS if c in df.columns]
    ties = [F.col(c) for c in columns if c not in ("listed_date", "listing_id")]
    return found.select(*columns).orderBy(F.col("listed_date").desc_nulls_last(), "listing_id", *ties).limit(limit)


def area_price_pairs(df: DataFrame, category: str) -> DataFrame:
    return market_filter(df, "category", category).select("area_value", "price_egp").dropna()


def price_per_sqm_listings(df: DataFrame, category: str) -> DataFrame:
    usable = market_filter(df, "category", category).where((F.col("area_value") > 0) & (F.col("price_egp") > 0))
    return usable.select(
        "property_type", "city", "area_value", "price_egp",
        S.ratio(F.col("price_egp"), F.col("area_value")).alias("price_per_sqm"),
    )


def p99_trim(df: DataFrame, share: float = 0.99) -> DataFrame:
    """Positive (area, price) pairs of both markets without the top of areas, then of prices.

    The price bound is taken over the rows that passed the area bound. The bounds are one row
    for each of the two markets and are broadcast, so no listing is moved to apply them.
    """
    pairs = df.select("category", "area_value", "price_egp").where(
        F.col("category").isin(list(CATEGORY_BY_MARKET.values())) & (F.col("area_value") > 0) & (F.col("price_egp") > 0)
    )

    def below(rows: DataFrame, column: str) -> DataFrame:
        bound = group_stats(rows, ["category"], column, {"_bound": share})
        return rows.join(F.broadcast(bound), "category").where(F.col(column) <= F.col("_bound")).drop("_bound")

    return below(below(pairs, "area_value"), "price_egp")


def city_locations(df: DataFrame, city: str) -> DataFrame:
    """Listings per town and district of one city; no row if the city is unknown."""
    inside = df.where(F.lower(F.col("city")) == city.lower())
    return inside.groupBy("city", "town", "district").agg(F.count(F.lit(1)).alias("listings"))


def page_listings(df: DataFrame, skip: int, limit: int, order_by: list[str]) -> DataFrame:
    """One page with the ``total`` of all rows beside it. The rows skipped pass through the driver: for deep pages see ``page_after``."""
    return df.orderBy(*order_by).offset(skip).limit(limit).withColumn("total", F.lit(df.count()))


def page_after(df: DataFrame, last: dict, limit: int) -> DataFrame:
    """The page that follows the row with the order values ``last`` (column -> value, in order; nulls first).

    The condition is a filter, so a page costs the same at any depth. Rows that tie in all order columns with the last one are
    passed over: end the order with a key.
    """
    later, equal = F.lit(False), F.lit(True)
    for c, v in last.items():
        above = F.col(c).isNotNull() if v is None else F.col(c) > F.lit(v)
        later = later | (equal & F.coalesce(above, F.lit(False)))
        equal = equal & F.col(c).eqNullSafe(F.lit(v))
    return df.where(later).orderBy(*[F.col(c).asc_nulls_first() for c in last]).limit(limit)


def request_rules(requests: DataFrame, market: str = "market_type") -> DataFrame:
    """Valuation requests with ``rejection_reason``: the first broken rule, NULL if none.

    A price-like column rejects every request that fills it.
    """
    present = set(requests.columns)
    market_name = F.lower(S.strip(F.col(market)))
    rules: list[tuple[Column, str]] = [
        (~F.coalesce(market_name.isin(list(OFFERING_BY_MARKET)), F.lit(False)), "market_type must be sale or rent")
    ]
    for c in sorted(present & set(LEAKAGE_COLUMNS)):
        rules.append((F.col(c).isNotNull(), f"forbidden field {c}"))
    kind = F.col("property_type") if "property_type" in present else F.lit(None).cast("string")
    rules.append((kind.isNull(), "property_type is required"))
    rules.append((S.strip(kind) == "", "property_type cannot be empty"))
    for c in ("area_value", "bedrooms", "bathrooms", "images_count", "listing_age_days"):
        if c in present:
            rules += _number_rules(requests, c)
            rules.append((F.col(c).try_cast("double") < 0, f"{c} cannot be negative"))
    if "area_value" in present:
        rules.append((F.col("area_value").try_cast("double") <= 0, "area_value must be greater than zero"))
    for c, bound in (("lat", 90), ("lon", 180)):
        if c in present:
            rules += _number_rules(requests, c)
            number = F.col(c).try_cast("double")
            outside = ~F.isnan(number) & (F.abs(number) > bound)
            rules.append((outside, f"{c} must be between -{bound} and {bound}"))
    if "offering_type" in present:
        expected = reduce(
            lambda acc, kv: acc.when(market_name == kv[0], kv[1].lower()),
            OFFERING_BY_MARKET.items(), F.when(F.lit(False), ""),
        )
        rules.append((F.lower(S.strip(F.col("offering_type"))) != expected, "offering_type does not match market_type"))
    reason = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return requests.withColumn("rejection_reason", reason)


def _number_rules(df: DataFrame, c: str) -> list[tuple[Column, str]]:
    """NaN counts as missing; other texts must be finite numbers."""
    value, dtype = F.col(c), S.dtype_of(df, c)
    if dtype == "string":
        number = value.try_cast("double")
        infinite = F.abs(number) == F.lit(float("inf"))
        return [(value.isNotNull() & number.isNull(), f"{c} must be numeric"), (infinite, f"{c} must be finite")]
    if dtype in ("double", "float"):
        return [(F.abs(value) == F.lit(float("inf")), f"{c} must be finite")]
    return []


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that names a column, ignoring case."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def first_numeric_value(df: DataFrame, candidates: list[str], order_by: list[str]) -> DataFrame:
    """One row: the first present number of the first existing candidate column, in the given order."""
    name = find_column(df, candidates)
    if name is None:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("value"))
    value = S.number_of(df, name)
    rank = F.struct(*order_by, value.alias("_v"))
    return df.agg(F.min_by(value, F.when(value.isNotNull(), rank)).alias("value"))
