"""Physical plans: what must not appear in them, and what must reach the scan."""

from __future__ import annotations

import pytest

from hourmart.catalogue import (
    all_queries as queries, chain_queries, job_queries, model_queries, stream_queries,
)
from hourmart.catalogue.bindings import SLOT, lines, slot_rows
from hourmart.model import GAUGES
from hourmart.operators.history import (
    CALENDAR_DAY, by_calendar_day, same_day_history, same_slot_history, with_day_history, with_slot_history,
)
from hourmart.operators.stats import daily_stats
from hourmart.plans.etl import actual_rows, load_star
from hourmart.plans.features import build_feature_tables, training_table
from hourmart.sources.tables import Warehouse

SF = "/root/testdata/sf0.001"
JOBS = {*job_queries.QUERIES, *model_queries.QUERIES, *stream_queries.QUERIES, "chained_linear", "batch_result",
        "batch_result_details"}
# Windows and joins over the fact: nothing may gather in one task.
ROW_LEVEL = (
    "fact_load", "dedup_fact", "merge_readings", "daily_stats", "hist_same_day",
    "hist_same_day_slot", "calendar_lags", "rolling_features", "rolling_frames",
    "training_table", "source_priority", "serving_slot_history", "partition_replace", "upsert",
    "insert_if_absent", "change_audit", "forecast_summary", "hourly_document")


def plan(spark, name: str) -> str:
    df = queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - JOBS))
def test_no_pairing_of_all_rows_and_no_python(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython",
                     "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert operator not in text


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_rows_never_gather_in_one_task(spark, name):
    assert "SinglePartition" not in plan(spark, name)


def test_daily_stats_is_one_aggregate_over_pruned_columns(spark):
    text = plan(spark, "daily_stats")
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_stddev_samp" in text
    for unused in ("l_orderkey", "l_returnflag", "l_linestatus", "s_acctbal", "n_regionkey"):
        assert unused not in text


def test_lags_take_one_shuffle_after_the_merge(spark):
    text = plan(spark, "calendar_lags")
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Window [") == 1


def test_filters_reach_the_scan(spark):
    text = plan(spark, "forecast_summary")
    assert "EqualTo(l_linestatus,O)" in text


def text_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    warehouse = Warehouse(spark, str(tmp_path_factory.mktemp("stored")))
    load_star(warehouse, warehouse.refresh("staging/raw_weather", job_queries._readings(spark, "/root/testdata/sf0.01")))
    build_feature_tables(warehouse)
    return warehouse


def test_histories_from_buckets_take_no_shuffle(stored):
    rows = stored.read_buckets("features/calendar_rows")
    daily = daily_stats(rows, GAUGES, CALENDAR_DAY)
    for df in (daily, same_day_history(daily, GAUGES), same_slot_history(rows, GAUGES), with_slot_history(rows, GAUGES)):
        assert "Exchange" not in text_of(df)
    assert "Exchange hashpartitioning" not in text_of(with_day_history(rows, daily, GAUGES))
    # lags run along the days, so they have the only shuffle
    assert text_of(training_table(rows, daily, GAUGES)).count("Exchange hashpartitioning") == 1


def test_another_session_is_told_of_the_buckets(stored):
    version = stored.version("features/calendar_rows")
    stored.spark.sql(f"DROP TABLE {stored._name(version)}")      # external: the files stay
    again = stored.read_buckets("features/calendar_rows")
    assert again.count() == stored.read("dw/fact_weather_hourly").count()
    assert "Exchange" not in text_of(again.groupBy("district_name", "month_day", "hour").count())


def test_training_from_raw_rows_shuffles_them_by_calendar_day_and_for_lags(spark):
    assert plan(spark, "training_table").count("Exchange hashpartitioning") == 3
    rows = by_calendar_day(lines(spark, SF), SLOT)
    together = text_of(training_table(slot_rows(spark, SF), daily_stats(rows, SLOT, CALENDAR_DAY), SLOT))
    assert "CartesianProduct" not in together


def test_serving_lags_read_the_lines_once(spark):
    text = plan(spark, "serving_lags")
    assert text.count("lineitem.parquet") == 1
    assert text.count("Exchange hashpartitioning") == 2


def test_a_day_of_the_fact_lies_in_few_files(stored):
    fact = stored.read("dw/fact_weather_hourly")
    day = fact.groupBy("full_date").count().orderBy("full_date").collect()[1000].full_date
    at = fact.where(f"full_date = DATE '{day}' AND year = {day.year}").select("_metadata.file_path").distinct().count()
    assert at <= 2
    text = text_of(actual_rows(stored).where(f"full_date = DATE '{day}' AND year = {day.year}"))
    assert "PartitionFilters: [isnotnull(year" in text and "EqualTo(full_date" in text


def test_text_is_parsed_once(spark, tmp_path):
    from hourmart.plans.etl import extract

    (tmp_path / "r.csv").write_text("a,b,c,d,e,f\n" + "X,2024-01-01 00:00:00,1,2,3,4\n" * 50)
    good, bad = extract(Warehouse(spark, str(tmp_path / "w")), str(tmp_path / "r.csv"))
    assert (good.count(), bad.count()) == (50, 0)
    for df in (good, bad):
        assert "FileScan csv" not in text_of(df)


def test_every_chain_query_has_sql():
    assert set(chain_queries.QUERIES) == set(chain_queries.ORACLES)
