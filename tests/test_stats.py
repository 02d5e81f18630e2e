import random
from statistics import median

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estatelake.functions import stats
from estatelake.operators import market as M


def by_key(df, key="k"):
    return {r[key]: r for r in df.collect()}


def test_one_hot_key_and_wide_range(spark, frame):
    """One key holds most rows; values span many magnitudes, signs and repeats."""
    rng = random.Random(7)
    rows = [("hot", rng.choice([0.0, 1e6, rng.uniform(-1e9, 1e9), rng.lognormvariate(10, 3)])) for _ in range(6000)]
    rows += [(f"k{i % 50}", rng.gauss(100, 5)) for i in range(1000)] + [("one", 5.0), ("empty", None), (None, 3.0)]
    probs = {"p01": 0.01, "p25": 0.25, "mid": 0.5, "p99": 0.99}
    got = by_key(stats.group_stats(frame("k string, v double", rows), ["k"], "v", probs, count="n", mean="mean",
                                   low="low", high="high", std="std"))
    groups = {}
    for k, v in rows:
        if k is not None:
            groups.setdefault(k, []).extend([] if v is None else [v])
    assert set(got) == set(groups)
    for k, vs in groups.items():
        r = got[k]
        assert r["n"] == len(vs)
        if not vs:
            assert r["mid"] is None and r["mean"] is None and r["low"] is None
            continue
        for name, p in probs.items():
            assert np.isclose(r[name], np.quantile(vs, p), rtol=1e-12, atol=1e-9)
        assert r["low"] == min(vs) and r["high"] == max(vs)
        assert np.isclose(r["mean"], np.mean(vs))
        assert r["std"] is None if len(vs) == 1 else np.isclose(r["std"], np.std(vs, ddof=1))


def test_deviation_is_stable_far_from_zero(frame):
    vs = [1e9 + x for x in (0.1, 0.2, 0.3, 0.4)]
    got = stats.group_stats(frame("v double", [(v,) for v in vs]), [], "v", {"mid": 0.5}, std="std").first()
    assert np.isclose(got["std"], np.std(vs, ddof=1), rtol=1e-4)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=40))
def test_median_equals_plain_median(spark, vs):
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    got = stats.group_stats(df, [], "v", {"mid": 0.5}).first()[0]
    assert np.isclose(got, median(vs), rtol=1e-12, atol=1e-9)


def test_non_finite_values_are_missing(frame):
    df = frame("v double", [(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)])
    got = stats.group_stats(df, [], "v", {"mid": 0.5}, count="n", mean="mean").first()
    assert tuple(got) == (2, 2.0, 2.0)


def test_correlation_of_constants_and_missing(frame):
    df = frame("a double, b double, c double, d double",
               [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, None), (3.0, 7.0, 5.0, None), (None, 1.0, 5.0, None)])
    got = {(r[0], r[1]): r[2] for r in stats.correlations(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16
    assert np.isclose(got[("a", "b")], np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert got[("a", "c")] is None and got[("d", "a")] is None and np.isclose(got[("a", "a")], 1.0)


def test_missing_group_policies(frame):
    df = frame("city string", [("x",), ("x",), (None,)])
    assert {tuple(r) for r in M.value_counts(df, "city").collect()} == {("x", 2), ("nan", 1)}
    assert {tuple(r) for r in M.value_counts(df, "city", nulls="drop").collect()} == {("x", 2)}


def test_group_without_prices_stays(frame):
    df = frame("category string, city string, price_egp double",
               [("BUY", "a", None), ("buy", "b", 4.0), ("rent", "b", 9.0), ("buy", None, 1.0)])
    got = by_key(M.city_prices(df, "buy"), "city")
    assert tuple(got["a"]) == ("a", 0, None, None) and tuple(got["b"]) == ("b", 1, 4.0, 4.0) and len(got) == 2


def test_overview_of_an_empty_table(frame):
    row = M.market_overview(frame("category string, price_egp double", [])).first()
    assert row["total_listings"] == 0 and row["sale_percentage"] == 0 and row["median_sale_price"] is None


def test_histogram_has_fifty_bins_at_most(frame):
    rows = [("buy", float(p)) for p in range(1, 2001)] + [("rent", 5.0)]
    bins = M.log_price_histogram(frame("category string, price_egp double", rows))
    got = bins.groupBy("category").agg(F.max("bin").alias("top"), F.sum("listings").alias("n")).collect()
    assert {tuple(r) for r in got} == {("buy", 49, 2000), ("rent", 0, 1)}


def test_top_values_break_ties_by_name(frame):
    df = frame("city string", [("b",), ("a",), ("c",), ("c",)])
    assert [r[0] for r in M.top_values(df, "city", 2).collect()] == ["c", "a"]


def test_small_values_spread_over_buckets(spark):
    from estatelake.functions.stats import _bucket

    small = spark.range(1, 100_001).select((F.col("id") / 1e12).alias("v"))
    assert small.select(_bucket(F.col("v"))).distinct().count() > 10_000
    far = spark.range(1_000).select((F.col("id") * 1e300).alias("v")).union(spark.range(1_000).select((-F.col("id") * 1e-300).alias("v")))
    pairs = far.orderBy("v").select("v", _bucket(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in pairs] == sorted(r["b"] for r in pairs) and len({r["b"] for r in pairs}) > 1_500


def test_only_values_of_opened_buckets_are_shuffled(spark, frame):
    """The rows meet the opened buckets before any exchange by value."""
    df = spark.range(0, 200_000).selectExpr("id % 7 as k", "pow(1.0001, id % 90000) as v")
    got = stats.group_stats(df, ["k"], "v", {"mid": 0.5, "p99": 0.99}, count="n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line)
    assert all(i < join for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)  # the tree is printed from the top
    rows = got.collect()
    assert len(rows) == 7 and sum(r["n"] for r in rows) == 200_000
    want = df.groupBy("k").agg(F.percentile("v", [0.5, 0.99]).alias("q")).collect()
    assert all(np.allclose([r["mid"], r["p99"]], w["q"], rtol=1e-12) for r, w in zip(sorted(rows), sorted(want)))


def test_correlations_far_from_zero_and_without_generated_rows(frame):
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(size=400)
    y = x * 2 + rng.normal(size=400)
    rows = [(float(a), float(b) if i % 5 else None, 7.0, float("nan")) for i, (a, b) in enumerate(zip(x, y))]
    out = stats.correlations(frame("a double, b double, c double, d double", rows), ["a", "b", "c", "d"])
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    lowest = max(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert not any("Generate" in line or "Expand" in line for line in plan[lowest:])
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    keep = [i for i in range(400) if i % 5]
    assert np.isclose(got["a", "b"], np.corrcoef(x[keep], y[keep])[0, 1], rtol=1e-9) and got["b", "a"] == got["a", "b"]
    assert got["c", "c"] is None and got["a", "c"] is None and got["d", "d"] is None and got["a", "d"] is None and np.isclose(got["a", "a"], 1)
