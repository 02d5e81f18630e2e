import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from estatelake.operators import features as E
from estatelake.operators import filters as FI
from estatelake.plans import training as T
from estatelake.plans import valuation as V
from estatelake.schema import CATEGORICAL_FEATURES, LEAKAGE_COLUMNS, LEGACY_RENT_INPUT, LEGACY_SALE_INPUT, NUMERIC_FEATURES
from estatelake.sources.sample import listings

SMALL_DIR = "/root/testdata/sf0.001"
TINY = T.TreeSettings(market_trees={"sale": 3, "rent": 3}, family_trees=3, tree_depth=3, boost_rounds=3, boost_depth=2,
                      boost_rate=0.2, min_final_rounds=3, bins=32)
REQUEST = {
    "request_id": 1, "market_type": "sale", "property_type": "Apartment", "city": "Cairo", "town": "New Cairo",
    "district": "First Settlement", "subdistrict": "North", "furnished": "No", "listing_level": "Ground",
    "payment_method": "Cash", "lat": 30.0, "lon": 31.0, "bedrooms": 3.0, "bathrooms": 2.0, "area_value": 150.0,
    "is_premium": 0, "is_featured": 0, "images_count": 10.0, "has_view_360": 0, "is_new_construction": 1,
    "is_direct_from_dev": 0, "is_exclusive": 0, "is_verified": 1, "agent_is_super": 1,
    "agent_languages": "English,Arabic", "listed_date": "2026-01-15", "offering_type": None, "price_egp": None,
}
TYPES = ", ".join(f"{k} " + ("int" if k.startswith(("is_", "has_", "agent_is")) or k == "request_id" else
                             "double" if isinstance(v, float) or k == "price_egp" else "string") for k, v in REQUEST.items())


def as_of():
    return F.lit("2026-02-01 10:00:00").cast("timestamp")


def requests(frame, *changes):
    return frame(TYPES, [{**REQUEST, "request_id": i, **c} for i, c in enumerate(changes)])


def test_layouts():
    assert (len(NUMERIC_FEATURES), len(CATEGORICAL_FEATURES)) == (35, 19)
    assert (len(LEGACY_SALE_INPUT), len(LEGACY_RENT_INPUT)) == (56, 26)


def test_features_of_a_request(frame):
    row = E.build_features(requests(frame, {"bedrooms": 0.0}), as_of()).first().asDict()
    assert not set(LEAKAGE_COLUMNS) & set(row)
    assert (row["listing_year"], row["listing_month"], row["listing_day"], row["listing_dayofweek"]) == (2026, 1, 15, 3)
    assert row["log_area"] == pytest.approx(math.log1p(150)) and row["total_rooms"] == 2
    assert row["area_per_bedroom"] is None and row["bed_bath_ratio"] == 0
    assert row["agent_language_count"] == 2 and row["has_video"] == 0 and row["location_completeness"] == 4
    assert row["area_size_category"] == "large" and row["bedroom_category"] == "studio"
    assert row["property_location"] == "Cairo | New Cairo | First Settlement | North"


def test_date_fallbacks(frame):
    df = frame("n int, listed_date string, listing_age_days int", [(1, None, 31), (2, "bad", None), (3, "2024-02-29", 5)])
    got = [tuple(r)[-4:] for r in E.feat_dates(df, as_of()).orderBy("n").collect()]
    assert got == [(2026, 1, 1, 3), (2026, 2, 1, 6), (2024, 2, 29, 3)]


def test_dataset_needs_a_price(frame):
    df = requests(frame, {"price_egp": 2_500_000.0}, {"price_egp": 3_000_000.0}, {"price_egp": 0.0}, {})
    rows = E.ml_dataset(df, as_of()).collect()
    assert len(rows) == 2 and all(math.isfinite(r["label"]) for r in rows)
    with pytest.raises(ValueError):
        E.ml_dataset(df.drop("price_egp"), as_of())


def test_request_rules(frame):
    cases = [
        ({}, None), ({"market_type": "something"}, "market_type must be sale or rent"),
        ({"price_egp": 2.5e6}, "forbidden field price_egp"), ({"property_type": None}, "property_type is required"),
        ({"property_type": " "}, "property_type cannot be empty"), ({"area_value": -100.0}, "area_value cannot be negative"),
        ({"area_value": 0.0}, "area_value must be greater than zero"), ({"area_value": float("inf")}, "area_value must be finite"),
        ({"area_value": float("nan")}, None), ({"bedrooms": -1.0}, "bedrooms cannot be negative"),
        ({"lat": 90.5}, "lat must be between -90 and 90"), ({"lon": float("-inf")}, "lon must be finite"),
        ({"offering_type": " residential FOR sale "}, None),
        ({"offering_type": "Residential for Rent"}, "offering_type does not match market_type"),
    ]
    got = FI.request_rules(requests(frame, *[c for c, _ in cases])).orderBy("request_id").collect()
    assert [r["rejection_reason"] for r in got] == [want for _, want in cases]


def test_routes(frame):
    cases = [("sale", "Chalet", "specialized"), ("sale", "Twin-House", "specialized"), ("sale", "twin_house ", "specialized"),
             ("sale", "Apartment", "market"), ("rent", "Duplex", "specialized"), ("rent", "Twin House", "market"), ("rent", None, "market")]
    df = frame("market_type string, property_type string", [c[:2] for c in cases])
    assert [r["model_resolution"] for r in V.route_model_group(df).collect()] == [c[2] for c in cases]
    only = V.route_model_group(df, trained=[("sale", "twin_house")]).collect()
    assert [r["model_resolution"] for r in only] == ["market", "specialized", "specialized"] + ["market"] * 4


def test_confidence(frame):
    df = frame("p array<double>, r2 double", [([100.0, 100.0], 1.0), ([-1.0, 0.5], 0.0), ([50.0, 150.0], -3.0), ([], 0.5)])
    got = [tuple(r["c"]) for r in df.select(V.confidence(F.col("p"), F.col("r2")).alias("c")).collect()]
    assert got == [(1.0, "high", 1.0, 1.0, 1.0), (0.2, "low", 0.0, 0.5, 0.0), (0.3, "low", 0.5, 0.0, -3.0), (0.0, "low", 0.0, 0.0, 0.5)]


def test_metrics_and_weights(frame):
    rows = [("a", math.log1p(10), math.log1p(12)), ("a", math.log1p(20), math.log1p(17)), ("b", math.log1p(10), -5.0), ("b", math.log1p(30), math.log1p(30))]
    df = T.regression_metrics(frame("model string, y double, p double", rows), "y", "p", ["model"])
    got = {r["model"]: r for r in T.ensemble_weights(df).collect()}
    assert got["a"]["mae_egp"] == pytest.approx(2.5) and got["a"]["rmse_egp"] == pytest.approx(math.sqrt(6.5))
    assert got["a"]["r2"] == pytest.approx(1 - 6.5 / 25) and got["b"]["median_absolute_error_egp"] == pytest.approx(5)
    assert sum(r["ensemble_weight"] for r in got.values()) == pytest.approx(1)


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "listing_id")
    one = {tuple(r) for r in T.split_rows(df.coalesce(1), "listing_id", 70, 15).collect()}
    assert one == {tuple(r) for r in T.split_rows(df.repartition(7), "listing_id", 70, 15).collect()}
    share = sum(s == "train" for _, s in one) / 2000
    assert 0.65 < share < 0.75


def test_fill_values(frame):
    df = frame("x double, c string", [(1.0, "b"), (4.0, "a"), (None, None), (2.0, "b"), (9.0, "a")])
    got = {r[0]: (r[1], r[2]) for r in T.fill_values(df, ["x"], ["c"]).collect()}
    assert got == {"x": (3.0, None), "c": (None, "a")}


def test_train_store_load_and_value(spark, frame, tmp_path):
    from estatelake.registry.features import MODEL_SOURCE

    source = listings(spark, SMALL_DIR, *MODEL_SOURCE)
    rows = T.model_rows(source, as_of())
    family = T.train_model_family(rows.where(F.col("offering_type") == "Residential for Sale"), "sale", None, TINY)
    assert sum(family.weights.values()) == pytest.approx(1) and set(family.models) == set(T.MODEL_NAMES)
    assert set(family.metadata["validation_metrics"]) == set(T.MODEL_NAMES)
    loaded = T.load_family(spark, T.save_family(family, str(tmp_path)))
    sale = rows.where(F.col("offering_type") == "Residential for Sale")
    a, b = (T.batch_predict(sale, f).agg(F.sum("predicted_price"), F.count("*"), F.min("predicted_price")).first() for f in (family, loaded))
    assert a[0] == pytest.approx(b[0]) and a[1] == sale.count() and a[2] >= 0

    rent = T.ModelFamily("rent", None, family.encoder, family.models, family.weights, 0.5, {})
    chalet = T.ModelFamily("sale", "Chalet", family.encoder, family.models, family.weights, 0.65, {})
    villa = T.ModelFamily("sale", "Villa", family.encoder, family.models, family.weights, 0.9, {})
    engine = T.ValuationEngine([family, rent, chalet, villa])
    asked = requests(frame, {}, {"property_type": "Chalet"}, {"property_type": "Villa"}, {"market_type": " Rent "},
                     {"area_value": -1.0}, {"bedrooms": 0.0}, {"city": "somewhere new", "furnished": None})
    valued, rejected = V.batch_valuation(asked, engine, as_of())
    got = {r["request_id"]: r for r in valued.collect()}
    assert sorted(got) == [0, 1, 2, 3, 6]
    assert [got[i]["model_resolution"] for i in (0, 1, 2, 3)] == ["market", "specialized", "market", "market"]
    assert got[3]["market_value"] == "Residential for Rent" and got[1]["confidence"]["reference_r2"] == 0.65
    assert all(r["estimated_value_egp"] >= 0 and len(r["model_predictions"]) == 3 for r in got.values())
    assert {r["request_id"]: r["rejection_reason"] for r in rejected.collect()} == {4: "area_value cannot be negative", 5: V.NON_FINITE}


def test_encoders_read_stored_rows(spark, monkeypatch):
    from estatelake.registry.features import MODEL_SOURCE

    seen = []
    fit = T.fit_encoder
    monkeypatch.setattr(T, "fit_encoder", lambda rows, *a, **k: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fit(rows, *a, **k))
    rows = T.model_rows(listings(spark, SMALL_DIR, *MODEL_SOURCE), as_of())
    T.train_model_family(rows.where(F.col("offering_type") == "Residential for Sale"), "sale", None, TINY, names=("random_forest",))
    T.train_market_models(rows, TINY)
    assert len(seen) == 4 and not any("Join" in plan for plan in seen), "features are derived again for every pass"


def test_request_checks_do_not_repeat_features(frame):
    accepted, rejected = V.check_requests(requests(frame, {}, {"area_value": -1.0}, {"bedrooms": 0.0}), as_of())
    assert [r["request_id"] for r in accepted.collect()] == [0] and accepted.columns.count("rejection_reason") == 1
    assert {r["request_id"]: r["rejection_reason"] for r in rejected.collect()} == {1: "area_value cannot be negative", 2: V.NON_FINITE}
    for part in (accepted, rejected):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        conditions = [line for line in plan.splitlines() if "Filter" in line]
        assert conditions and all("null(rejection_reason#" in line for line in conditions), "the condition repeats the features"


def test_encoder_folds_training_rows_twice(spark, frame, monkeypatch):
    """Medians and categories: every other figure comes from the table of categories, with the same values."""
    cells = [*[f"cast(id % 7 as double) as {c}" for c in T.NUMERIC_FEATURES], *[f"if(id % 3 = 0, null, concat('v', id % 4)) as {c}" for c in T.CATEGORICAL_FEATURES]]
    train = spark.range(200).selectExpr("id as listing_id", "cast(id as double) as label", *cells)
    asked, real = [], T.stacked
    monkeypatch.setattr(T, "stacked", lambda df, columns, *a, **k: asked.append(columns) or real(df, columns, *a, **k))
    encoder = T.fit_encoder(train)
    assert asked == [T.CATEGORICAL_FEATURES, T.NUMERIC_FEATURES]
    assert set(encoder.numbers.values()) == {3.0} and set(encoder.modes.values()) == {"v1"}
    assert all(v == ["v1", "v0", "v2", "v3"] for v in encoder.labels.values()) and encoder.target_means == T.TARGET_MEAN_FEATURES
    assert sum(n for _, n in encoder.totals) == 200 and sum(s for s, _ in encoder.totals) == 199 * 100


def test_small_families_lie_in_few_files(spark):
    rows = spark.range(0, 1000, 1, 8).selectExpr("id as listing_id")
    assert T.stored_parts(rows, "listing_id", count=1000).rdd.getNumPartitions() == 1
    assert T.stored_parts(rows, "listing_id", count=1000).count() == T.stored_parts(rows, "listing_id", count=3 * T.ROWS_A_TASK).count() == 1000
