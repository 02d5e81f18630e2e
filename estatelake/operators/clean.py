"""Cleaning steps. Each is a projection and a no-op for columns the frame does not have,
so a chain of them collapses into one projection over the scan."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.functions import scalars as S
from estatelake.functions import sqltext as X
from estatelake.operators.dedup import keep_last_by_key
from estatelake.schema import (
    DATE_COLUMNS,
    FLAG_COLUMNS,
    LABEL_COLUMNS,
    LOCATION_COLUMNS,
    NUMBER_COLUMNS,
    SENSITIVE_COLUMNS,
)

# Spellings of the area unit and of the furnished status.
AREA_UNITS = {"sqm": ["sqm", "m2", "m²", "square meter", "square meters"]}
FURNISHED = {
    "furnished": ["yes", "true", "1"],
    "not_furnished": ["no", "false", "0"],
    "partly_furnished": ["partly", "partial"],
}
MAX_AGE_DAYS = 3650


def _with(df: DataFrame, names: list[str], make: Callable[[str, str], str]) -> DataFrame:
    """Replace the present ones of ``names`` in one projection; ``make`` gives SQL text."""
    present = [c for c in names if c in df.columns]
    return df.withColumns({c: F.expr(make(X.name(c), S.dtype_of(df, c))) for c in present}) if present else df


# Steps of one column, each from a quoted name to SQL text. ``trimmed`` says that texts were stripped before.
Steps = dict[str, list[Callable[[str], str]]]


def _apply(df: DataFrame, *parts: Steps) -> DataFrame:
    """The steps of all columns, one projection for each level: every step names a finished column, so nothing is
    computed twice, and a row is copied once a level instead of once a column group and step."""
    of: Steps = {}
    for part in parts:
        for c, steps in part.items():
            of.setdefault(c, []).extend(steps)
    for level in zip_longest(*of.values()):
        df = df.withColumns({c: F.expr(step(X.name(c))) for c, step in zip(of, level) if step})
    return df


def _steps(df: DataFrame, names: list[str], for_texts: list[Callable[[str], str]], for_others: Callable[[str, str], str], trimmed: bool) -> Steps:
    """``for_texts`` where a present column holds texts (behind a strip if not ``trimmed``), else the one expression ``for_others``."""
    out: Steps = {}
    for c in names:
        if c in df.columns:
            dtype = S.dtype_of(df, c)
            text = [*([] if trimmed else [X.strip_cell]), *for_texts]
            out[c] = text if dtype == "string" else [lambda x, t=dtype: for_others(x, t)]
    return out


def standard_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def standardize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[standard_name(c) for c in df.columns])


def _text_steps(df: DataFrame) -> Steps:
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return {c: [X.strip_cell, lambda x: X.null_if_in(x, X.BLANK_TOKENS)] for c in texts}


def clean_text_columns(df: DataFrame) -> DataFrame:
    return _apply(df, _text_steps(df))


def _label_steps(df: DataFrame, trimmed: bool = False) -> Steps:
    found = _steps(df, LABEL_COLUMNS, [], lambda x, _: f"string({x})", trimmed)
    # a stripped text keeps its ends when the white space within becomes blanks
    return {c: [*steps, X.plain_spaces_cell, X.single_spaces] for c, steps in found.items()}


def normalize_categories(df: DataFrame) -> DataFrame:
    return _apply(df, _label_steps(df))


# What a number must satisfy to be kept.
_POSSIBLE = {
    "price_egp": "> 0", "area_value": "> 0", "lat": "BETWEEN -90 AND 90", "lon": "BETWEEN -180 AND 180",
    "images_count": ">= 0",
}


def _number_steps(df: DataFrame, trimmed: bool = False) -> Steps:
    found = _steps(df, NUMBER_COLUMNS, [X.number_text, X.finite_double], X.number, trimmed)
    return {c: [*steps, *([lambda x, c=c: f"CASE WHEN {x} {_POSSIBLE[c]} THEN {x} END"] if c in _POSSIBLE else [])] for c, steps in found.items()}


def clean_numeric_columns(df: DataFrame) -> DataFrame:
    """Numbers as double, first parsed and then kept where possible for the column."""
    return _apply(df, _number_steps(df))


def _flag_steps(df: DataFrame, trimmed: bool = False) -> Steps:
    return _steps(df, FLAG_COLUMNS, [lambda x: f"lower({x})", X.flag_text], X.flag, trimmed)


def normalize_boolean_columns(df: DataFrame) -> DataFrame:
    return _apply(df, _flag_steps(df))


def _date_steps(df: DataFrame, trimmed: bool = False) -> Steps:
    return _steps(df, DATE_COLUMNS, [lambda x: f"try_to_timestamp({x})"], X.utc_timestamp, trimmed)


def parse_dates(df: DataFrame) -> DataFrame:
    return _apply(df, _date_steps(df))


def _room_steps(df: DataFrame) -> Steps:
    return {c: [X.first_number] for c in ("bedrooms", "bathrooms") if c in df.columns}


def extract_room_counts(df: DataFrame) -> DataFrame:
    return _apply(df, _room_steps(df))


def _spelling_steps(df: DataFrame, column: str, spellings: dict[str, list[str]], trimmed: bool = False) -> Steps:
    steps = [lambda x: f"lower(string({x}))", *([] if trimmed else [X.strip_cell]), lambda x: X.respelled(x, spellings)]
    return {column: steps} if column in df.columns else {}


def normalize_area_unit(df: DataFrame) -> DataFrame:
    return _apply(df, _spelling_steps(df, "area_unit", AREA_UNITS))


def normalize_furnished(df: DataFrame) -> DataFrame:
    return _apply(df, _spelling_steps(df, "furnished", FURNISHED))


def price_per_sqm(df: DataFrame) -> DataFrame:
    if not {"price_egp", "area_value"} <= set(df.columns):
        return df
    return df.withColumn(
        "price_per_sqm", F.when(F.col("area_value") > 0, S.ratio(F.col("price_egp"), F.col("area_value")))
    )


def listing_age_days(df: DataFrame, as_of: Column) -> DataFrame:
    if "listed_date" not in df.columns:
        return df
    age = S.elapsed_days(as_of, F.col("listed_date"))
    return df.withColumn("listing_age_days", F.when(age >= 0, age))


def location_key(df: DataFrame) -> DataFrame:
    levels = [X.name(c) for c in LOCATION_COLUMNS if c in df.columns]
    return df.withColumn("location_key", F.expr(X.location_path(levels))) if levels else df


def media_flags(df: DataFrame) -> DataFrame:
    if "images_count" in df.columns:
        df = df.withColumn("has_images", F.coalesce(F.col("images_count") > 0, F.lit(False)))
    if "video_url" in df.columns:
        df = df.withColumn("has_video", F.expr(X.has_text("video_url")))
    return df


def final_quality_rules(df: DataFrame) -> DataFrame:
    rules = {"price_per_sqm": "> 0", "listing_age_days": f"<= {MAX_AGE_DAYS}"}
    return _with(df, list(rules), lambda x, _: f"CASE WHEN {x} {rules[x.strip('`')]} THEN {x} END")


def drop_sensitive_columns(df: DataFrame) -> DataFrame:
    return df.drop(*SENSITIVE_COLUMNS)


def clean_rows(df: DataFrame) -> DataFrame:
    """The row-wise steps before de-duplication (usable on streams too)."""
    df = standardize_column_names(df)
    return _apply(
        df, _text_steps(df), _label_steps(df, True), _number_steps(df, True), _flag_steps(df, True), _date_steps(df, True),
        _room_steps(df), _spelling_steps(df, "area_unit", AREA_UNITS, True), _spelling_steps(df, "furnished", FURNISHED, True),
    )


def derive_columns(df: DataFrame, as_of: Column) -> DataFrame:
    """The row-wise steps after de-duplication."""
    return (
        df.transform(price_per_sqm)
        .transform(listing_age_days, as_of)
        .transform(location_key)
        .transform(media_flags)
        .transform(final_quality_rules)
        .transform(drop_sensitive_columns)
    )


def transform_listings(
    df: DataFrame, as_of: Column, order_by: list[str] | None = None, keep_null_ids: bool = True
) -> DataFrame:
    """Raw listings to processed ones: clean, keep the last row per id, derive, drop contacts.

    All rows without an id count as one id unless ``keep_null_ids`` is off.
    With a named order the last rows are found first, by cleaned copies of the id and of the order
    columns alone; only they are cleaned whole, spread by the shuffle. Without one, the order rests on all cleaned columns.
    """
    if not order_by or "listing_id" not in map(standard_name, df.columns):
        return derive_columns(keep_last_by_key(clean_rows(df), "listing_id", order_by, keep_null_ids), as_of)
    named = standardize_column_names(df).drop(*SENSITIVE_COLUMNS)
    deciding = ["listing_id", *[c for c in order_by if c != "listing_id"]]
    copies = {c: f"_order_{i}" for i, c in enumerate(deciding)}
    # cleaned in one frame of their own names, then put beside the raw columns
    whole = F.struct(*[F.col(X.name(c)) for c in named.columns])
    slim = clean_rows(named.select(*deciding, whole.alias("whole_row")))
    slim = slim.select("whole_row", *[F.col(c).alias(n) for c, n in copies.items()])
    last = keep_last_by_key(slim, copies["listing_id"], [copies[c] for c in order_by], keep_null_ids)
    return derive_columns(clean_rows(last.select("whole_row.*")), as_of)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``numeric`` or ``text`` columns."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    wanted = {
        "numeric": lambda t: t in numbers or t.startswith("decimal"),
        "text": lambda t: t == "string",
    }[kind]
    return [f.name for f in df.schema if wanted(f.dataType.simpleString())]


def select_by_dtype(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_of_type(df, kind))


def price_prepare(df: DataFrame, column: str = "price_egp") -> DataFrame:
    """Numeric price, rows with a positive one only."""
    priced = df.withColumn(column, S.number_of(df, column))
    return priced.where(F.col(column) > 0)
