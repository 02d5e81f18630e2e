import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from estatelake.operators import dedup as D
from estatelake.operators import load as L
from estatelake.operators import quality as Q
from estatelake.operators import runlog as R
from estatelake.plans.ingest import ingest_run
from estatelake.schema import RAW_COLUMNS
from estatelake.sources import files
from estatelake.streaming.incremental import stream_incremental_load

AT = datetime(2026, 1, 1)


def at():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def raw_rows(spark, rows):
    full = [{**{c: None for c in RAW_COLUMNS}, **r} for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in RAW_COLUMNS))


SAMPLE = [
    {"listing_id": "1", "category": "buy", "price_egp": "100", "area_value": "50", "scraped_at": "2025-01-01", "title": "old"},
    {"listing_id": "1", "category": "buy", "price_egp": "120", "area_value": "50", "scraped_at": "2025-02-01", "title": "new"},
    {"listing_id": "2", "category": "rent", "price_egp": "9", "area_value": "0", "scraped_at": "2025-01-01", "agent_email": "x@y"},
    {"listing_id": None, "category": "rent", "price_egp": "7", "scraped_at": "2025-01-01"},
    {"listing_id": None, "category": "rent", "price_egp": "8", "scraped_at": "2025-01-02"},
    {"listing_id": "3", "category": "buy", "bathrooms": "2.5 baths", "scraped_at": "2025-01-01"},
]


def test_keep_last_and_rejects(frame):
    df = frame("listing_id bigint, scraped_at timestamp, v int",
               [(1, AT, 1), (1, datetime(2026, 2, 1), 2), (None, AT, 3), (None, datetime(2026, 3, 1), 4), (2, None, 5)])
    assert {tuple(r)[::2] for r in D.keep_last_by_key(df, "listing_id").collect()} == {(1, 2), (None, 4), (2, 5)}
    kept, rejected = D.dedup_listings(df)
    assert {r["v"] for r in kept.collect()} == {2, 5} and rejected.count() == 2
    with pytest.raises(ValueError):
        D.dedup_listings(df.drop("listing_id"))
    assert D.keep_last_by_key(frame("a int", [(1,), (1,)]), "listing_id").count() == 1


def test_equal_order_keys_give_one_stable_row(frame):
    rows = [(1, AT, v) for v in range(20)]
    one = D.keep_last_by_key(frame("listing_id bigint, scraped_at timestamp, v int", rows), "listing_id").collect()
    two = D.keep_last_by_key(frame("listing_id bigint, scraped_at timestamp, v int", rows[::-1]), "listing_id").collect()
    assert len(one) == 1 and one == two


def test_duplicate_rows_treat_null_as_equal(frame):
    df = frame("a int, b string", [(1, None), (1, None), (1, None), (2, "x"), (None, "x"), (None, "x"), (3, "x")])
    assert D.duplicate_row_count(df).first()[0] == 3
    got = D.duplicate_statistics(df.withColumnRenamed("a", "listing_id")).first()
    assert tuple(got) == (7, 2, 3, 3, 3)
    assert tuple(D.duplicate_statistics(df.limit(0).withColumnRenamed("a", "listing_id")).first()) == (0, 0, 0, 0, 0)


def test_quality_report_parts(spark):
    report = Q.quality_report(raw_rows(spark, SAMPLE)).first().asDict(recursive=True)
    assert report["dataset"] == {"raw_rows": 6, "raw_columns": 53}
    assert report["required_columns"] == {"missing": [], "status": "PASS"}
    assert report["listing_id_validation"]["null_listing_ids"] == 2
    assert report["listing_id_validation"]["status"] == "PASS_WITH_REJECTIONS"
    assert report["duplicates"] == {"duplicate_rows": 0, "duplicate_listing_ids": 2}
    assert report["missing_values"]["listing_id"] == 2 and "category" not in report["missing_values"]
    assert report["numeric_validation"]["invalid_area"] == 1
    assert len(report["sensitive_columns_detected"]) == 8


def test_missing_key_column_fails(frame):
    assert Q.id_status(frame("a int", [(1,)])).first()["status"] == "FAIL"
    assert Q.missing_required_columns(frame("a int", [(1,)]))[0] == "area_value"


def test_conform_types_rejects_fractions(frame):
    df = frame("listing_id string, bedrooms double, is_premium string, price_egp string",
               [("9007199254740993", 2.0, "yes", "1e3"), ("5", 2.5, "no", "7"), ("x", None, None, None)])
    good, bad = L.conform_types(df)
    assert {tuple(r) for r in good.collect()} == {(9007199254740993, 2, True, 1000.0), (None, None, None, None)}
    assert bad.count() == 1


def test_incremental_load(frame, tmp_path):
    target = str(tmp_path / "target")
    df = frame("listing_id bigint, price_egp double", [(1, 1.0), (2, 2.0)])
    assert L.load_new_listings(df.limit(0), target, at())["inserted_rows"] == 0
    assert L.load_new_listings(df, target, at())["inserted_rows"] == 2
    again = L.load_new_listings(df, target, at())
    assert (again["existing_rows"], again["inserted_rows"]) == (2, 0)
    more = L.load_new_listings(frame("listing_id bigint, price_egp double", [(2, 9.0), (3, 3.0)]), target, at())
    assert (more["existing_rows"], more["new_rows"], more["inserted_rows"]) == (1, 1, 1)
    assert df.sparkSession.read.parquet(target).count() == 3
    with pytest.raises(ValueError):
        L.load_new_listings(frame("listing_id bigint, price_egp double", [(None, 1.0)]), target, at())


def test_ingest_run_and_its_log(spark, tmp_path):
    target, log = str(tmp_path / "t"), str(tmp_path / "log")
    raw = raw_rows(spark, SAMPLE)
    first = ingest_run(raw, target, log, at(), at())
    assert (first["source_rows"], first["rejected_rows"], first["processed_rows"]) == (6, 2, 3)
    assert (first["inserted_rows"], first["unfit_rows"], first["target_row_count"]) == (2, 1, 2)
    loaded = {r["listing_id"]: r for r in spark.read.parquet(target).collect()}
    assert loaded[1]["title"] == "new" and loaded[1]["price_per_sqm"] == 2.4 and "agent_email" not in loaded[2]
    second = ingest_run(raw, target, log, at(), at())
    assert second["inserted_rows"] == 0 and second["target_row_count"] == 2
    with pytest.raises(ValueError):
        ingest_run(raw.drop("city"), target, log, at(), at())
    runs = R.read_runs(spark, log)
    assert tuple(R.run_statistics(runs).first())[:3] == (3, 2, 1)
    last = R.latest_run(runs).first()
    assert last["status"] == "FAILED" and "city" in last["error_message"]


def test_empty_run_log(spark, tmp_path):
    assert tuple(R.run_statistics(R.read_runs(spark, str(tmp_path / "none"))).first()) == (0, 0, 0, None)


def test_csv_scan_and_staging(spark, tmp_path):
    path = tmp_path / "in.csv"
    body = {c: "" for c in RAW_COLUMNS} | {"listing_id": "1", "city": "N/A", "title": '"say ""hi""\nthere"'}
    path.write_text(",".join(RAW_COLUMNS) + "\n" + ",".join(body.values()) + "\n")
    row = files.scan_listings(spark, str(path)).first()
    assert (row["listing_id"], row["city"], row["title"], row["town"]) == ("1", None, 'say "hi"\nthere', None)
    with pytest.raises(ValueError):
        files.scan_listings(spark, str(tmp_path / "in.txt"))
    empty = tmp_path / "empty.csv"
    empty.write_text(",".join(RAW_COLUMNS) + "\n")
    with pytest.raises(ValueError):
        files.scan_listings(spark, str(empty))
    done = files.staging_reload(raw_rows(spark, SAMPLE), str(tmp_path / "staging"))
    assert done == {"source_rows": 6, "target_rows": 6}


def test_records_have_no_nan(frame):
    rows = files.records_json(frame("a double, b string", [(float("nan"), None), (float("inf"), "x")])).collect()
    assert [json.loads(r[0]) for r in rows] == [{"a": None, "b": None}, {"a": None, "b": "x"}]


def test_stream_replay_adds_nothing(spark, tmp_path):
    drop, target, log = (str(tmp_path / n) for n in ("drop", "target", "log"))
    raw = raw_rows(spark, SAMPLE)
    raw.limit(3).write.parquet(drop)

    def run(checkpoint):
        query = stream_incremental_load(spark, drop, target, str(tmp_path / checkpoint), at(), at(), log_path=log,
                                        fmt="parquet", schema=raw.schema)
        query.awaitTermination()
        return {(r["listing_id"], r["price_egp"]) for r in spark.read.parquet(target).collect()}

    assert run("c1") == {(1, 120.0), (2, 9.0)}
    raw_rows(spark, [{"listing_id": "1", "price_egp": "5"}, {"listing_id": "4", "price_egp": "6"}]).write.mode("append").parquet(drop)
    assert run("c1") == {(1, 120.0), (2, 9.0), (4, 6.0)}
    assert run("c2") == {(1, 120.0), (2, 9.0), (4, 6.0)}
    assert spark.read.parquet(target).count() == 3


def write_csv(path, header, *rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join([",".join(header), *[",".join(r) for r in rows]]) + "\n")


def test_csv_columns_go_by_name(spark, tmp_path):
    write_csv(tmp_path / "in.csv" / "a.csv", ["City", " Listing ID", "extra", "price_egp"], ["Cairo", "1", "x", "5"])
    write_csv(tmp_path / "in.csv" / "b.csv", ["listing_id", "price_egp", "city"], ["2", "6", "NULL"])
    got = {r["listing_id"]: r for r in files.scan_listings(spark, str(tmp_path / "in.csv")).collect()}
    assert (got["1"]["city"], got["1"]["price_egp"], got["2"]["city"], got["2"]["price_egp"]) == ("Cairo", "5", None, "6")
    assert list(got["1"].asDict()) == RAW_COLUMNS and got["1"]["title"] is None
    write_csv(tmp_path / "in.csv" / "c.csv", ["city", "price_egp"], ["x", "1"])
    with pytest.raises(ValueError, match="listing_id"):
        files.scan_listings(spark, str(tmp_path / "in.csv"))
    write_csv(tmp_path / "twice.csv" / "a.csv", ["listing_id", "city", "City "], ["1", "x", "y"])
    with pytest.raises(ValueError, match="twice"):
        files.scan_listings(spark, str(tmp_path / "twice.csv"))


def test_csv_stream_by_name_with_a_bad_file(spark, tmp_path):
    drop, target, log = tmp_path / "drop", str(tmp_path / "target"), str(tmp_path / "log")
    scratch_before = set(tmp_path.iterdir())

    def run(checkpoint="c"):
        return stream_incremental_load(spark, str(drop), target, str(tmp_path / checkpoint), at(), at(), log_path=log)

    write_csv(drop / "a.csv", ["price_egp", "listing_id", "bathrooms"], ["10", "1", "2"], ["11", "", "1"], ["12", "2", "1.5"])
    run().awaitTermination()
    write_csv(drop / "b.csv", ["listing_id", "city", "price_egp"], ["1", "x", "99"], ["3", "Giza", "20"])
    run().awaitTermination()
    loaded = {r["listing_id"]: (r["price_egp"], r["city"]) for r in spark.read.parquet(target).select("listing_id", "price_egp", "city").collect()}
    assert loaded == {1: (10.0, None), 3: (20.0, "Giza")}
    write_csv(drop / "c.csv", ["city", "price_egp"], ["x", "1"])
    with pytest.raises(Exception, match="listing_id"):
        run().awaitTermination()
    runs = R.read_runs(spark, log).orderBy("run_id").collect()
    assert [r["status"] for r in runs] == ["SUCCESS", "SUCCESS", "FAILED"] and "listing_id" in runs[2]["error_message"]
    assert (runs[0]["source_rows"], runs[0]["null_id_rows"], runs[0]["unfit_rows"], runs[0]["inserted_rows"]) == (3, 1, 1, 1)
    write_csv(drop / "c.csv", ["listing_id", "price_egp"], ["4", "1"])
    run().awaitTermination()
    assert spark.read.parquet(target).count() == 3 and scratch_before <= set(tmp_path.iterdir())


def test_conform_types_parses_each_number_once(frame):
    from estatelake.operators.clean import clean_rows

    raw = frame("listing_id string, bedrooms string, agent_id string", [("1", "2+ beds", "7"), ("2", "baths: 3.5", "8"), (None, None, None)])
    good, bad = L.conform_types(clean_rows(raw))
    assert [tuple(r) for r in good.orderBy("listing_id").collect()] == [(None, None, None), (1, 2, 7)]
    assert [r["listing_id"] for r in bad.collect()] == ["2"] and bad.columns == raw.columns
    for part in (good, bad):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") <= 8, "the condition repeats the cleaning"


def _watched(df):
    """The frame behind a filter that counts the rows it is asked for."""
    seen = df.sparkSession.sparkContext.accumulator(0)
    watch = F.udf(lambda x: (seen.add(1), True)[1], "boolean").asNondeterministic()
    return df.where(watch("listing_id")), seen


def test_a_load_computes_its_rows_once(frame, tmp_path):
    rows = frame("listing_id bigint, price_egp double", [(1, 1.0), (2, 2.0), (3, 3.0)])
    for existing in (0, 3):
        df, seen = _watched(rows)
        assert L.load_new_listings(df, str(tmp_path / "t"), at())["existing_rows"] == existing
        assert seen.value == 3


def test_a_report_reads_the_processed_rows_once(frame):
    raw = frame("listing_id bigint, city string", [(1, "a"), (1, "a"), (2, None)])
    processed, seen = _watched(raw)
    report = Q.quality_report(raw, processed).first()
    assert (report["processed_dataset"]["rows"], report["processed_dataset"]["columns"], report["processed_duplicates"]["duplicate_rows"]) == (3, 2, 1)
    assert seen.value == 3


def test_bundle_records_are_parsed_once(frame):
    """Also records without fields, null fields and broken ones give no rows."""
    from estatelake.plans.bundles import bundle_rows

    records = frame("section string, record_json string", [
        ("a", '{"city": "C", "town": null, "price": 1.5, "signal": "fair", "gone": null}'), ("a", "{}"), ("a", None), ("a", "x"), ("a", '{"price": null}'), ("a", '{"listing_id": 7}')])
    got = bundle_rows(records)
    assert sorted(map(tuple, got.collect())) == [("a", "C", "price", 1.5, None), ("a", "C", "signal", None, "fair")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
