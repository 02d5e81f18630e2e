"""Sizes that the registered model queries run with, and the order of fits side by side."""

import pytest

from estatelake.plans import training as T
from estatelake.registry import models as M


class Seen(Exception):
    pass


@pytest.fixture()
def made(spark, monkeypatch):
    offering = "if(id % 2 = 0, 'Residential for Sale', 'Residential for Rent') as offering_type"
    monkeypatch.setattr(M, "rows_of", lambda *a: spark.range(20).selectExpr("id as listing_id", offering))


def test_market_forests_have_production_sizes(spark, made, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "train_market_models", lambda rows, settings: seen.append(settings) or {})
    M._market_models(spark, "")
    assert seen == [T.TreeSettings()] and seen[0].market_trees == {"sale": 200, "rent": 300} and seen[0].tree_depth == 30


def test_boosting_has_production_sizes(spark, made, monkeypatch):
    seen = []

    def fit(train, held, settings, **config):
        seen.append((settings, config))
        raise Seen

    encoded = spark.createDataFrame([("train", 1.0, 1.0)], "split string, label double, features double")
    monkeypatch.setattr(T, "stored_parts", lambda rows, *a: rows)
    monkeypatch.setattr(T, "encoded_parts", lambda rows, key: (None, encoded))
    monkeypatch.setattr(T, "fit_boosted", fit)
    with pytest.raises(Seen):
        M._boosted(spark, "")
    assert seen and all(s == (T.TreeSettings(), {}) for s in seen) and seen[0][0].boost_rounds == 3000


def test_tuning_compares_the_settings_as_they_are(spark, made, monkeypatch):
    seen = []

    def tune(rows, settings, market, configs=T.BOOST_CONFIGS):
        seen.append((settings, configs))
        raise Seen

    monkeypatch.setattr(T, "tune_boosted", tune)
    with pytest.raises(Seen):
        M._tune(spark, "")
    assert seen and all(s == (T.TreeSettings(), T.BOOST_CONFIGS) for s in seen)


def test_fits_side_by_side_keep_their_order(spark):
    assert T.side_by_side(spark, lambda n: spark.range(n).count(), [5, 0, 3]) == [5, 0, 3]


def test_stored_rows_are_encoded_in_few_tasks(spark):
    stored = T.stored(spark.range(0, 1000, 1, 8), "few")
    assert T.in_few_tasks(stored).rdd.getNumPartitions() == 1 and T.in_few_tasks(stored.limit(0)).count() == 0
