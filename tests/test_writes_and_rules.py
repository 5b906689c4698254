from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hourmart.operators.dims import dense_key, dim_date, dim_hour, ensure_dates
from hourmart.operators.quality import (
    RangeRule, RejectedRows, change_audit, repair, touch, validate,
)
from hourmart.operators.serving import (
    backfill_columns, coverage_by_day, coverage_gaps, last_date, slot_spine,
)
from hourmart.operators.writes import (
    add_column_if_missing, conditional_delete, conditional_update, insert_if_absent,
    latest_per_key, replace_groups, upsert,
)
from hourmart.model import GAUGES
from hourmart.sources.tables import Warehouse
from hourmart.streaming.ingest import IngestJob, ingest_batch

FORECAST = (
    "district_id int, date_id int, hour_id int, temperature_c double, humidity_percent double, "
    "wind_speed_m_s double, rain_mm double, rain_probability double")
KEYS = ["district_id", "date_id", "hour_id"]
NOW = datetime(2026, 4, 29, 0, 5, 12)


def forecast(spark, *values):
    return spark.createDataFrame(list(values), FORECAST)


@pytest.mark.parametrize(("row", "reason"), [
    ((1, 1100, 15, 32.0, 80.0, 4.0, 1.2, 45.0), None),
    ((1, 1100, 11, 50.0, 75.0, 3.5, 0.0, 5.0), "temperature"),
    ((1, 1100, 12, 2.0, 75.0, 3.5, 0.0, 5.0), "temperature"),
    ((1, 1100, 13, 30.0, 120.0, 3.5, 0.0, 5.0), "humidity"),
    ((1, 1100, 13, 50.0, 120.0, 3.5, 0.0, 5.0), "temperature"),
    ((1, 1100, 14, 5.0, 0.0, 3.5, 0.0, 5.0), None),
    ((1, 1100, 14, 45.0, 100.0, 3.5, 0.0, 5.0), None),
    ((1, 1100, 14, None, None, 3.5, 0.0, 5.0), None)])
def test_validation(spark, row, reason):
    accepted, rejected = validate(forecast(spark, row))
    assert accepted.count() == (reason is None)
    assert [r.reason for r in rejected.collect()] == ([reason] if reason else [])


def test_strict_validation_raises(spark):
    bad = forecast(spark, (1, 1100, 11, 50.0, 75.0, 3.5, 0.0, 5.0))
    with pytest.raises(RejectedRows, match="1 rows"):
        validate(bad, strict=True)


def test_repair_and_stamp(spark):
    df = forecast(
        spark, (1, 1100, 14, 30.0, 75.0, 3.5, -5.0, 5.0), (1, 1100, 15, 30.0, 75.0, 3.5, None, 5.0))
    found = touch(repair(df), F.lit(NOW)).orderBy("hour_id").collect()
    assert [r.rain_mm for r in found] == [0.0, None]
    assert found[0].updated_at == datetime(2026, 4, 29, 0, 5, 12)


@pytest.mark.parametrize(("old", "new", "logged"), [
    ((31.5, 0.0), (35.0, 0.0), True), ((35.0, 0.0), (35.2, 0.0), False),
    ((35.0, 0.0), (35.0, 5.0), True), ((32.0, 0.0), (28.0, 2.0), True),
    ((31.5, 0.0), (32.0, 0.0), False), ((None, 0.0), (32.0, 0.0), False),
    ((None, 0.0), (32.0, 1.0), True)])
def test_audit(spark, old, new, logged):
    def row(temp, rain):
        return forecast(spark, (1, 1100, 10, temp, 75.0, 3.5, rain, 5.0))
    found = change_audit(row(*old), row(*new), KEYS, F.lit(NOW)).collect()
    assert len(found) == logged
    if logged:
        r = found[0]
        assert (r.old_temperature_c, r.old_rain_mm) == old
        assert (r.new_temperature_c, r.new_rain_mm) == new


def test_upsert_sets_only_named_columns_and_inserts_whole_rows(spark):
    old = forecast(spark, (1, 1, 10, 30.0, 70.0, 1.0, 0.0, 5.0), (1, 1, 11, 31.0, 71.0, 1.0, 0.0, 5.0))
    new = forecast(spark, (1, 1, 10, 33.0, 99.0, 9.0, 9.0, 9.0), (1, 1, 12, 34.0, 72.0, 2.0, 0.5, 6.0),
                   )
    found = {r.hour_id: r for r in upsert(old, new, KEYS, ["temperature_c"]).collect()}
    assert (found[10].temperature_c, found[10].humidity_percent) == (33.0, 70.0)
    assert found[11].temperature_c == 31.0
    assert (found[12].temperature_c, found[12].rain_mm) == (34.0, 0.5)
    null = forecast(spark, (1, 1, 10, None, 99.0, 9.0, 9.0, 9.0))
    assert upsert(old, null, KEYS, ["temperature_c"]).where("hour_id = 10").first()[3] is None


def test_replace_is_idempotent(spark):
    old = forecast(spark, *[(1, d, h, 30.0, 70.0, 1.0, 0.0, 5.0) for d in (1, 2) for h in range(24)])
    new = forecast(spark, *[(1, 2, h, 20.0, 70.0, 1.0, 0.0, 5.0) for h in range(12)])
    once = replace_groups(old, new, ["district_id", "date_id"])
    twice = replace_groups(once, new, ["district_id", "date_id"])
    for df in (once, twice):
        assert df.count() == 36
        assert df.where("date_id = 2 AND temperature_c = 30.0").isEmpty()


def test_insert_update_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in insert_if_absent(old, new, ["k"]).where("k <> 2").collect()) == [
        (1, "a"), (3, "z")]
    updated = conditional_update(old, F.col("v") == "a", v=F.lit("b")).orderBy("k").collect()
    assert [r.v for r in updated] == ["b", None]
    assert [r.k for r in conditional_delete(old, F.col("v") == "a").collect()] == [2]
    stamped = add_column_if_missing(old, "v", F.lit("no"))
    assert stamped.columns == ["k", "v"]
    assert latest_per_key(new, ["k"], ["v"]).count() == 2


def test_warehouse_rewrites_only_touched_partitions(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    schema = "k int, day date, v double"
    days = [date(2026, 3, d) for d in (1, 2, 3)]
    rows = [(k, d, 1.0) for k in (1, 2) for d in days]
    warehouse.refresh("t", spark.createDataFrame(rows, schema), ["day"])
    first = Path(warehouse.path("t")) / "day=2026-03-01"
    untouched = {p: p.stat().st_mtime_ns for p in first.iterdir()}
    new = spark.createDataFrame([(1, days[1], 5.0), (3, days[1], 6.0)], schema)
    warehouse.upsert("t", new, ["k", "day"], ["v"], "day")
    warehouse.upsert("t", new, ["k", "day"], ["v"], "day")
    found = sorted(
        tuple(r) for r in warehouse.read("t").select("k", "v").where("day = '2026-03-02'").collect())
    assert found == [(1, 5.0), (2, 1.0), (3, 6.0)]
    assert warehouse.read("t").count() == 7
    assert untouched == {p: p.stat().st_mtime_ns for p in first.iterdir()}
    warehouse.replace("t", new, ["k", "day"], "day")
    assert warehouse.read("t").count() == 7
    warehouse.insert_absent("t", spark.createDataFrame([(9, days[2], 9.0)], schema), ["k"], "day")
    assert warehouse.read("t").count() == 8


def test_write_once_ignores_a_second_try(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    df = spark.createDataFrame([(1,), (2,)], "k int")
    for _ in range(2):
        warehouse.write_once("log", df, "batch 1")
    warehouse.write_once("log", df, "batch 2")
    assert warehouse.read("log").count() == 4


def test_a_failing_refresh_leaves_the_old_table(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    warehouse.refresh("t", spark.range(10))
    with pytest.raises(Exception):
        warehouse.refresh("t", spark.range(10).select(F.expr("assert_true(id < 5)").cast("long").alias("id")))
    assert warehouse.read("t").count() == 10
    warehouse.refresh("t", spark.range(3))
    assert warehouse.read("t").count() == 3


def test_two_streams_into_one_table_keep_all_rejects(spark, tmp_path):
    schema = "entity string, full_date date, temp double, hum double, rain double, year int"
    rules = (RangeRule("temperature", "temp", 5.0, 45.0),)
    job = IngestJob(Warehouse(spark, str(tmp_path)), "t", ["entity", "full_date"], ["temp", "rain"], "year", ["temp"], "temp", "rain", rules)
    at = F.lit("2026-03-20 00:05:00").cast("timestamp_ntz")
    for source, name in (("first", "a"), ("second", "b"), ("second", "b")):
        batch = spark.createDataFrame([(name, date(2026, 3, 1), 99.0, 50.0, 0.0, 2026), (name, date(2026, 3, 2), 20.0, 50.0, 0.0, 2026)], schema)
        ingest_batch(job, batch, 0, at, source)
    assert sorted(r.entity for r in job.warehouse.read(job.rejects).collect()) == ["a", "b"]
    assert job.warehouse.read("t").count() == 2


def test_dense_key_is_dense_and_ordered(spark):
    names = [f"n{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    found = dense_key(df, ["name"], "id").orderBy("id").collect()
    assert [r.id for r in found] == list(range(1, 1001))
    assert [r.name for r in found] == sorted(names)


def test_dates_keep_their_keys(spark):
    df = spark.createDataFrame([(datetime(2026, 3, d, 5),) for d in (2, 1, 2)], "t timestamp_ntz")
    dim = dim_date(df, "t")
    more = spark.createDataFrame([(date(2026, 3, d),) for d in (5, 2, 4, 4)], "full_date date")
    found = ensure_dates(dim, more).orderBy("date_id").collect()
    assert [(r.date_id, r.full_date.day) for r in found] == [(1, 1), (2, 2), (3, 4), (4, 5)]
    assert found[2].month_name == "March"


def test_hours(spark):
    found = dim_hour(spark).orderBy("hour").collect()
    assert [r.hour for r in found] == list(range(24))
    assert [found[h].period_of_day for h in (5, 6, 11, 12, 17, 18)] == [
        "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening"]


def test_coverage(spark):
    names = [(f"d{i}",) for i in range(53)]
    entities = spark.createDataFrame(names, "district_name string")
    day = date(2026, 3, 21)
    have = spark.createDataFrame(
        [(n, day, 0) for (n,) in names[:52]], "district_name string, full_date date, hour int")
    gaps = coverage_gaps(entities, have, day, day, GAUGES).collect()
    assert [(r.district_name, r.full_date) for r in gaps] == [("d52", day)]
    row = coverage_by_day(entities, have, day, day, GAUGES).first()
    assert (row.covered, row.expected, row.missing) == (52, 53, True)
    assert slot_spine(entities, day, day, GAUGES).count() == 53 * 24


def test_last_date_falls_back(spark):
    empty = spark.createDataFrame([], "full_date date")
    assert last_date(empty, "full_date", "2026-01-01").first()[0] == date(2026, 1, 1)


def test_backfill_adds_and_orders(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, a double")
    assert backfill_columns(df, ["a", "x", "b"]).first().asDict() == {"a": 2.0, "x": None, "b": 1.0}
