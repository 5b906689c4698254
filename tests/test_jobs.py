"""End-to-end jobs on a small hourly fixture: CSV to forecasts, documents and streams."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hourmart.model import GAUGES, TABLES
from hourmart.operators.quality import RULES, RangeRule
from hourmart.operators.stats import daily_stats
from hourmart.plans import reports
from hourmart.plans.etl import actual_rows, extract, load_star, run_etl
from hourmart.plans.features import build_feature_tables, model_rows
from hourmart.plans.forecast import (
    AUDIT, FORECAST, REJECTS, ForecastJob, _same_day_before, batch_totals, check_days, known_entities, predict_day,
    predict_range, run_batch, run_if_needed, save_day,
)
from hourmart.plans.training import Models, TrainSettings, train
from hourmart.sources.tables import Warehouse
from hourmart.streaming.ingest import IngestJob, ingest_batch

PLACES = ("Ba_Na_Hills", "My_Khe_Beach")
DAYS = [date(y, 3, 1) + timedelta(days=d) for y in (2022, 2023, 2024, 2025) for d in range(20)]
AS_OF = datetime(2026, 4, 29, 0, 5, 12)


def reading(i: int, day: date, hour: int) -> str:
    temp = 18 + i * 2 + (hour - 12) % 7 + day.day % 5 + day.year % 3
    rain = (day.day * hour + day.year + i) % 5 * 0.4
    return f"{PLACES[i]},{day} {hour:02d}:00:00,{temp},{60 + hour},{3 + day.day % 4},{rain:.1f}"


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    lines = ["district,datetime,temperature_C,humidity_percent,wind_speed_m_s,rain_mm"]
    lines += [reading(i, d, h) for i in range(2) for d in DAYS for h in range(24)]
    lines += [reading(0, DAYS[0], 0)] * 3                      # copies
    (root / "readings.csv").write_text("\n".join(lines) + "\n")
    store = Warehouse(spark, str(root / "tables"))
    run_etl(store, str(root / "readings.csv"))
    build_feature_tables(store)
    return store


@pytest.fixture(scope="module")
def job(warehouse):
    table = model_rows(warehouse.read("features/mv_training_features"), GAUGES)
    models, metrics = train(table, GAUGES, TrainSettings.small(trees=3, depth=2))
    assert {r.target for r in metrics.collect()} == {*GAUGES.columns, "is_rainy"}
    actual = actual_rows(warehouse)
    return ForecastJob(
        warehouse, models, warehouse.read("dw/dim_district"), actual,
        warehouse.read("features/agg_daily_weather"), RULES)


def test_bad_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "a,b,c,d,e,f\n"
        "X,2024-01-01 00:00:00,1,2,3,4\n"
        "X,not a date,1,2,3,4\n"
        "X,2024-01-01 01:00:00,warm,2,3,4\n"
        ",2024-01-01 02:00:00,1,2,3,4\n"
        "X,2024-01-01T03:00:00,,NaN,3,4\n"
        "X,2024-01-01 04:00:00,1,2,3\n")
    good, bad = extract(Warehouse(spark, str(tmp_path / "w")), str(tmp_path / "r.csv"))
    found = good.orderBy("datetime").collect()
    assert [(r.datetime.hour, r.temperature_c, r.humidity_percent) for r in found] == [
        (0, 1.0, 2.0), (3, None, None)]
    assert sorted(r.reason for r in bad.collect()) == [
        "datetime", "district", "line", "temperature_c"]


def test_row_counts_follow_places_hours_and_days(warehouse):
    n = len(PLACES) * 24 * len(DAYS)
    fact = warehouse.read("dw/fact_weather_hourly")
    assert fact.count() == n
    assert fact.select("district_id", "date_id", "hour_id").distinct().count() == n
    assert warehouse.read("dw/dim_date").count() == len(DAYS)
    assert [r.district_name for r in warehouse.read("dw/dim_district").orderBy(
        "district_id").collect()] == sorted(PLACES)
    assert warehouse.read("features/agg_daily_weather").count() == n / 24
    assert warehouse.read("features/agg_historical_same_day").count() == n / 24 * 3 / 4
    assert warehouse.read("features/agg_historical_same_day_hour").count() == n * 3 / 4
    assert warehouse.read("features/mv_training_features").count() == n


def test_tables_have_their_schemas(warehouse):
    for table, schema in TABLES.items():
        if table in ("dw/fact_weather_forecast", "dw/forecast_history"):
            continue   # written by the forecast tests
        found = [(f.name, f.dataType) for f in warehouse.read(table).schema]
        assert found == [(f.name, f.dataType) for f in schema], table


def test_forecast_tables_have_their_schemas(job):
    predict_range(job, date(2025, 3, 23), 1, AS_OF)
    warmer = predict_day(job, date(2025, 3, 23)).withColumn(
        "temperature_c", F.col("temperature_c") + 2.0)
    save_day(job, warmer, AS_OF + timedelta(hours=2))
    for table in ("dw/fact_weather_forecast", "dw/forecast_history"):
        found = {(f.name, f.dataType) for f in job.warehouse.read(table).schema}
        assert found == {(f.name, f.dataType) for f in TABLES[table]}, table


def test_loading_again_keeps_forecasts_and_gives_the_same_star(spark, warehouse, tmp_path):
    store, readings = Warehouse(spark, str(tmp_path)), warehouse.read("staging/raw_weather")
    forecast = spark.createDataFrame(
        [("Ba_Na_Hills", DAYS[0], 1, 20.0)],
        "district_name string, full_date date, hour int, temperature_c double")
    store.refresh(FORECAST, forecast, ["full_date"])
    tables = ("dw/dim_district", "dw/dim_date", "dw/fact_weather_hourly")
    seen = []
    for _ in range(2):
        load_star(store, readings)
        seen.append({t: sorted(map(tuple, store.read(t).collect())) for t in tables})
    assert seen[0] == seen[1]
    assert store.read(FORECAST).count() == 1


def test_models_survive_saving(spark, job, tmp_path):
    job.models.save(spark, str(tmp_path / "models"))
    again = Models.load(spark, str(tmp_path / "models"), GAUGES)
    assert again.amount is not None
    day = date(2026, 3, 5)
    first = predict_day(job, day)
    second = predict_day(
        ForecastJob(job.warehouse, again, job.entities, job.actual, job.daily, RULES), day)
    assert first.exceptAll(second).isEmpty()
    assert first.count() == 48


def test_future_day_has_history_features(job):
    found = predict_day(job, date(2026, 3, 10))
    row = found.where("district_name = 'My_Khe_Beach' AND hour = 12").first()
    assert 10 < row.temperature_c < 45
    assert 0 <= row.humidity_percent <= 100
    assert row.rain_mm >= 0
    assert 0 <= row.rain_probability <= 100


def test_chain_replaces_and_audits(spark, job):
    start = date(2025, 3, 21)
    stored = predict_range(job, start, 2, AS_OF)
    assert stored.count() == 2 * 48
    # A warmer forecast for the same day is a change worth a record, once.
    warmer = predict_day(job, start).withColumn("temperature_c", F.col("temperature_c") + 1.0)
    for _ in range(2):
        assert save_day(job, warmer, AS_OF + timedelta(hours=1)).rejects.isEmpty()
    last = start + timedelta(days=1)
    assert job.forecasts().where(F.col("full_date").between(start, last)).count() == 2 * 48
    history = job.warehouse.read(AUDIT).where(F.col("full_date") == start)
    assert history.count() == 48
    row = history.first()
    assert row.new_temperature_c == pytest.approx(row.old_temperature_c + 1.0)


def test_rejected_rows_never_reach_the_table(job):
    day = date(2025, 3, 25)
    hot = predict_day(job, day).withColumn(
        "temperature_c", F.when(F.col("hour") == 3, 50.0).otherwise(F.col("temperature_c")))
    saved = save_day(job, hot, AS_OF)
    assert {r.reason for r in saved.rejects.collect()} == {"temperature"}
    assert (saved.scored, saved.rejected, saved.pairs) == (48, 2, 2)
    assert job.forecasts().where(F.col("full_date") == day).count() == 46


def test_rejects_and_audit_of_every_subset_are_stored(job):
    day, at = date(2025, 3, 27), AS_OF + timedelta(hours=5)
    save_day(job, predict_day(job, day), AS_OF)
    warmer = predict_day(job, day).withColumn(
        "temperature_c", F.when(F.col("hour") == 3, 50.0).otherwise(F.col("temperature_c") + 2.0)).cache()
    names = [r[0] for r in warmer.select("district_name").distinct().collect()]
    for name in [*names, names[0]]:
        save_day(job, warmer.where(F.col("district_name") == name), at)
    audit = job.warehouse.read(AUDIT).where((F.col("full_date") == day) & (F.col("changed_at") == F.lit(at)))
    assert audit.select("district_name").distinct().count() == len(names) == 2
    rejects = job.warehouse.read(REJECTS).where(F.col("full_date") == day)
    assert rejects.count() == 2
    warmer.unpersist()


def test_batch_runs_only_when_days_lack_forecasts(job):
    base = date(2025, 3, 28)
    assert run_if_needed(job, base, AS_OF).stored.count() == 96
    assert run_if_needed(job, base, AS_OF) is None


def test_unknown_names_become_errors(spark, job):
    requests = spark.createDataFrame([("My_Khe_Beach",), ("Atlantis",)], "district_name string")
    found, errors = known_entities(requests, job.entities, GAUGES)
    assert [r.district_name for r in errors.collect()] == ["Atlantis"]
    scored = predict_day(job, date(2025, 4, 1), found)
    assert scored.count() == 24
    assert batch_totals(scored, errors, GAUGES).first().asDict() == {
        "success": 1, "errors": 1, "total_forecasts": 2}


def test_batch_result_names_what_failed(spark, job):
    requests = spark.createDataFrame([("My_Khe_Beach",), ("Atlantis",)], "district_name string")
    rules = (RangeRule("rain", "rain_mm", -1.0, -0.5),)         # every known amount is too high
    strict = ForecastJob(job.warehouse, job.models, job.entities, job.actual, job.daily, rules)
    for who, stored, rejected in ((job, 48, 0), (strict, 0, 48)):
        found = run_batch(who, date(2025, 4, 10), AS_OF, 2, requests)
        assert found.totals.first().asDict() == {
            "forecast_days": 2, "total_forecasts": 4, "success": 2, "errors": 2,
            "rows_scored": 48, "rows_rejected": rejected}
        assert found.stored.count() == (stored or 48)           # a day without a valid row keeps its old one
        assert found.rejected.count() == rejected
        assert sorted((r.district_name, r.full_date.day, r.error) for r in found.errors.collect()) == [
            ("Atlantis", 11, "unknown entity"), ("Atlantis", 12, "unknown entity")]
        details = found.details.orderBy("full_date").collect()
        assert [(r.full_date.day, r.rows_rejected) for r in details] == [(11, rejected // 2), (12, rejected // 2)]
        assert all(r.temp_min <= r.temp_max for r in details)


@pytest.mark.parametrize("days", [0, 8])
def test_horizon_is_checked(job, days):
    with pytest.raises(ValueError, match="number of days"):
        run_batch(job, "2025-03-20", AS_OF, days)
    assert check_days(7) == 7


def test_documents_and_lists(job):
    forecast = job.forecasts()
    name, day = PLACES[1], date(2025, 3, 28) + timedelta(days=1)
    doc = reports.entity_day_document(forecast, GAUGES, name, day)
    text = json.loads(reports.as_json(doc, GAUGES).first().document)
    assert text["district"] == name
    assert text["date"] == str(day)
    assert [h["hour"] for h in text["hourly"]] == list(range(24))
    assert set(text["summary"]) == {
        "temp_min", "temp_max", "temp_avg", "humidity_avg", "rain_total", "wind_max"}
    assert text["hourly"][0]["description"]
    assert reports.entity_document(forecast, GAUGES, "Atlantis").isEmpty()
    seen = reports.entity_document(forecast, GAUGES, name).select("full_date").collect()
    assert [r[0] for r in seen] == sorted(r[0] for r in seen)
    past = reports.entity_day_document(job.actual, GAUGES, name, DAYS[0], actual=True).first()
    assert past.hourly[6].period_of_day == "Morning"
    assert [r.district_name for r in reports.entity_list(job.entities, GAUGES).collect()] == sorted(
        PLACES)


def test_recent_actuals_take_three_days_newest_first(job):
    found = reports.recent_actuals(job.actual, GAUGES).collect()
    assert [(r.full_date, r.district_name) for r in found] == [
        (DAYS[-1] - timedelta(days=d), p) for d in range(3) for p in sorted(PLACES)]


def test_history_of_a_forecast_day_reads_only_that_day(job):
    for rows in (job.actual, job.daily):
        found = _same_day_before(rows, GAUGES, date(2026, 3, 10), job.first_year)
        days = {r.full_date for r in found.select("full_date").distinct().collect()}
        assert days == {date(y, 3, 10) for y in (2022, 2023, 2024, 2025)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [Or(" in plan or "EqualTo(full_date" in plan
    assert _same_day_before(job.actual, GAUGES, date(2024, 2, 29), 2022).isEmpty()


def test_forecast_table_reads_prune_days(job):
    plan = job.forecasts().where("full_date = DATE '2025-03-21'")._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(full_date" in plan.executedPlan().toString()
    assert "fact_weather_forecast/v-" in job.warehouse.path(FORECAST)


def test_ingest_batch_can_be_retried(spark, tmp_path):
    schema = (
        "district_name string, full_date date, hour int, temperature_c double, "
        "humidity_percent double, wind_speed_m_s double, rain_mm double")
    day = date(2026, 3, 20)
    warehouse = Warehouse(spark, str(tmp_path))
    job = IngestJob(warehouse, "forecast", GAUGES.keys, ["temperature_c", "rain_mm"], "full_date",
                    ["temperature_c"])
    first = spark.createDataFrame([("a", day, 1, 30.0, 70.0, 1.0, -2.0)], schema)
    second = spark.createDataFrame(
        [("a", day, 1, 35.0, 99.0, 1.0, 0.0), ("a", day, 2, 60.0, 70.0, 1.0, 0.0)], schema)
    ingest_batch(job, first, 0, F.lit(AS_OF))
    for _ in range(2):
        ingest_batch(job, second, 1, F.lit(AS_OF))
    row = warehouse.read("forecast").first()
    assert warehouse.read("forecast").count() == 1
    assert (row.temperature_c, row.humidity_percent, row.rain_mm) == (35.0, 70.0, 0.0)
    assert warehouse.read("forecast_history").count() == 1
    assert warehouse.read("forecast_rejects").count() == 1


def test_daily_stats_skip_nulls(spark):
    df = spark.createDataFrame(
        [("a", date(2024, 1, 1), 0, 1.0, None, 1.0, 0.0), ("a", date(2024, 1, 1), 1, 3.0, 5.0, 1.0, 0.5)],
        "district_name string, full_date date, hour int, temperature_c double, "
        "humidity_percent double, wind_speed_m_s double, rain_mm double")
    row = daily_stats(df, GAUGES).first()
    assert (row.temp_mean, row.hum_mean, row.hum_std, row.rain_total) == (2.0, 5.0, None, 0.5)
