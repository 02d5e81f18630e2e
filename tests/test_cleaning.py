from datetime import datetime

from pyspark.sql import functions as F

from estatelake.functions import scalars as S
from estatelake.functions import sqltext as X
from estatelake.operators import clean as C


def values(df, column):
    return [r[column] for r in df.collect()]


def test_column_names(frame):
    df = frame("` Price (EGP) ` double, `__City-Name` string", [(1.0, "a")])
    assert C.standardize_column_names(df).columns == ["price_egp", "city_name"]


def test_text_is_stripped_of_unicode_blanks_and_missing_words(frame):
    texts = ["  Cairo\t\n", "  None ", "nan", "null", "NULL", "Null", "", "   ", None, "a  b"]
    df = C.clean_text_columns(frame("n int, city string", list(enumerate(texts))))
    assert values(df.orderBy("n"), "city") == ["Cairo", None, None, None, None, "Null", None, None, None, "a  b"]


def test_labels_are_squeezed(frame):
    df = C.normalize_categories(frame("city string, title string", [(" New \t Cairo ", " x  y ")]))
    assert df.first() == ("New Cairo", " x  y ")


def test_numbers_from_text(frame):
    texts = ["abc", "1d", " 12 ", "1e3", "inf", "nan", "1,000", "0x10", "-3.5", ".5", "1e999", "", "e", "5.", None]
    df = frame("n int, broker_id string", list(enumerate(texts)))
    got = values(C.clean_numeric_columns(df).orderBy("n"), "broker_id")
    assert got == [None, None, 12.0, 1000.0, None, None, None, None, -3.5, 0.5, None, None, None, 5.0, None]


def test_impossible_numbers_become_null(frame):
    df = frame("price_egp double, area_value double, lat double, lon double, images_count double",
               [(0.0, -1.0, 91.0, -180.0, -1.0), (float("nan"), float("inf"), -90.0, 181.0, 0.0)])
    rows = C.clean_numeric_columns(df).collect()
    assert tuple(rows[0]) == (None, None, None, -180.0, None)
    assert tuple(rows[1]) == (None, None, -90.0, None, 0.0)


def test_flags(frame):
    texts = ["TRUE", " 1 ", "1.0", "maybe", None, "N", "f", "0"]
    df = C.normalize_boolean_columns(frame("n int, is_premium string", list(enumerate(texts))))
    assert values(df.orderBy("n"), "is_premium") == [True, True, None, None, None, False, False, False]
    assert C.normalize_boolean_columns(frame("is_premium double", [(1.0,)])).first()[0] is None
    assert C.normalize_boolean_columns(frame("is_premium int", [(1,)])).first()[0] is True


def test_room_counts_units_and_furnished(frame):
    df = frame("bedrooms string, area_unit string, furnished string",
               [("3+ beds", " M² ", "YES"), ("Studio", "Square Meters", "Partly"), ("about 2.5", "sqft", " no ")])
    got = C.normalize_furnished(C.normalize_area_unit(C.extract_room_counts(df))).collect()
    assert [tuple(r) for r in got] == [
        (3.0, "sqm", "furnished"), (None, "sqm", "partly_furnished"), (2.5, "sqft", "not_furnished")]


def test_age_counts_elapsed_days(spark, frame):
    as_of = F.lit("2026-01-02 01:00:00").cast("timestamp")
    df = frame("listed_date timestamp", [(datetime(2026, 1, 1, 23),), (datetime(2026, 1, 3),), (datetime(2016, 1, 1),), (None,)])
    got = values(C.listing_age_days(df, as_of), "listing_age_days")
    assert got == [0, None, 3654, None]
    assert values(C.final_quality_rules(frame("listing_age_days bigint", [(3650,), (3651,)])), "listing_age_days") == [3650, None]
    early = frame("d timestamp", [(datetime(2026, 1, 2, 2),)])
    assert early.select(S.elapsed_days(as_of, F.col("d"))).first()[0] == -1


def test_location_key_keeps_inner_blanks(frame):
    df = frame("city string, town string, district string",
               [("a", None, "c"), (None, None, None), ("|a", "b", None), (" ", None, None)])
    assert values(C.location_key(df), "location_key") == ["a |  | c", None, "a | b", None]


def test_absent_columns_are_no_ops(frame):
    df = frame("other int", [(1,)])
    as_of = F.lit("2026-01-01").cast("timestamp")
    assert C.derive_columns(C.clean_rows(df), as_of).columns == ["other"]


def test_bins_are_closed_on_the_right(frame):
    edges, labels = [60, 100], ["small", "medium", "large"]
    df = frame("n int, x double", [(1, 60.0), (2, 60.1), (3, 100.0), (4, 101.0), (5, None), (6, -5.0)])
    got = values(df.orderBy("n").select(F.expr(X.label_up_to("x", edges, labels)).alias("b")), "b")
    assert got == ["small", "medium", "medium", "large", None, "small"]


def test_cleaning_strips_each_text_once_in_few_projections(spark):
    from estatelake.schema import RAW_COLUMNS

    raw = spark.range(2).select(*[F.concat(F.lit(f" {i}\t"), F.col("id").cast("string")).alias(c) for i, c in enumerate(RAW_COLUMNS)])
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = C.clean_rows(raw)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    copies = [line for line in plan.splitlines() if "Project [" in line]
    assert len(copies) <= 8  # the two of the input and of its names, and one for each level of steps
    assert plan.count("btrim(") == len(RAW_COLUMNS)


def test_strip_of_a_cell_is_the_strip_of_a_text(spark):
    texts = ["", "a", " a", "a ", "　a", "a ", "é", "é ", "\x85é", "a\x1c", "~", "\x7f", "日", " \t\n", "a   b", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = df.selectExpr(X.strip_cell("x"), X.strip("x"), X.plain_spaces_cell("x"), f"translate(x, {X.quoted(X.WHITE_SPACE)}, '{' ' * len(X.WHITE_SPACE)}')").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
    assert [r[0] for r in got] == [t if t is None else t.strip(X.WHITE_SPACE) for t in texts]


def test_queries_keep_generated_methods_within_what_is_compiled(spark):
    from estatelake.registry import QUERIES

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    assert "listing_count" in QUERIES
    try:
        QUERIES["listing_count"](spark, "/nowhere")
    except Exception:  # noqa: BLE001  (no tables are there)
        pass
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
