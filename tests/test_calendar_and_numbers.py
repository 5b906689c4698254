from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from hourmart.functions.calendar import (
    calendar_parts, clock_hour, cyclic_parts, iso_date, month_day, period_of_day,
)
from hourmart.functions.labels import describe, display_name
from hourmart.functions.numeric import (
    clip, known_count, nan_to_null, report_round, row_mean, row_std, score_round, wet_flag,
)
from hourmart.model import GAUGES, feature_columns


def test_feature_list_has_86_names_in_order():
    names = feature_columns(GAUGES)
    assert len(names) == len(set(names)) == 86
    assert names[:6] == ["district_id", "month", "day", "day_of_year", "day_of_week", "hour"]
    assert names[29:32] == ["hist_h_temp_mean", "hist_h_temp_std", "hist_h_hum_mean"]
    assert names[38:42] == ["lag_1d_temp", "lag_1d_hum", "lag_1d_wind", "lag_1d_rain"]
    assert names[-1] == "recent_rain_count"


@pytest.mark.parametrize(("day", "key", "week", "weekday"), [
    (date(2026, 3, 20), 320, 12, 5), (date(2021, 1, 3), 103, 53, 7),
    (date(2024, 2, 29), 229, 9, 4)])
def test_calendar_parts(spark, day, key, week, weekday):
    df = spark.createDataFrame([(day,)], "d date")
    row = df.select(*[c.alias(n) for n, c in calendar_parts(F.col("d")).items()]).first()
    assert (row.month_day, row.week_of_year, row.day_of_week) == (key, week, weekday)
    assert row.is_weekend == (weekday >= 6)
    assert row.month_name == day.strftime("%B")
    assert row.day_of_year == day.timetuple().tm_yday
    assert df.select(month_day(F.col("d"))).first()[0] == key


@pytest.mark.parametrize(("hour", "sin", "cos", "period"), [
    (0, 0, 1, "Night"), (6, 1, 0, "Morning"), (12, 0, -1, "Afternoon"),
    (23, -0.2588, 0.9659, "Evening")])
def test_cyclic_hour_and_period(spark, hour, sin, cos, period):
    df = spark.createDataFrame([(hour, date(2024, 1, 1))], "hour int, full_date date")
    parts = cyclic_parts(GAUGES, F.col("full_date"))
    row = df.select(
        parts["hour_sin"].alias("s"), parts["hour_cos"].alias("c"),
        period_of_day(F.col("hour")).alias("p")).first()
    assert row.s == pytest.approx(sin, abs=1e-4)
    assert row.c == pytest.approx(cos, abs=1e-4)
    assert row.p == period


def test_rounding_kinds(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (-0.125,)], "x double")
    found = df.select(report_round(F.col("x"), 2), score_round(F.col("x"), 2)).collect()
    assert [tuple(r) for r in found] == [(0.13, 0.12), (2.68, 2.68), (-0.13, -0.12)]


def test_clip_keeps_null_and_bounds(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (50.0,), (101.0,)], "x double")
    assert [r[0] for r in df.select(clip(F.col("x"), 0.0, 100.0)).collect()] == [
        None, 0.0, 50.0, 100.0]


def test_wet_threshold_is_strict_and_null_is_dry(spark):
    df = spark.createDataFrame([(0.1,), (0.11,), (None,), (float("nan"),)], "x double")
    flags = nan_to_null(df, ["x"]).select(wet_flag(F.col("x"), 0.1)).collect()
    assert [r[0] for r in flags] == [0, 1, 0, 0]


@pytest.mark.parametrize(("values", "mean", "std"), [
    ((1.0, 2.0, 4.0), 7 / 3, 1.5275252), ((1.0, None, 4.0), 2.5, 2.1213203),
    ((3.0, None, None), 3.0, None), ((None, None, None), None, None)])
def test_row_statistics_skip_nulls(spark, values, mean, std):
    df = spark.createDataFrame([values], "a double, b double, c double")
    columns = [F.col(c) for c in "abc"]
    n = known_count(columns)
    m = row_mean(columns, n)
    row = df.select(m.alias("m"), row_std(columns, n, m).alias("s")).first()
    assert row.m == (None if mean is None else pytest.approx(mean))
    assert row.s == (None if std is None else pytest.approx(std))


@pytest.mark.parametrize(("values", "label"), [
    ((13.8, 91.9, 7.4, 0.0, 4.7), "Mat me, do am cao"),
    ((25.0, 50.0, 16.0, 5.1, 0.0), "Mua to, gio manh"),
    ((25.0, 50.0, 11.0, 5.0, 0.0), "Mua nhe, gio vua"),
    ((25.0, 50.0, 10.0, 0.2, 0.0), "Mua phun"),
    ((25.0, 85.0, 0.0, 0.1, 62.5), "Co the mua (62%)"),
    ((34.0, 50.0, 0.0, 0.0, 40.0), "Nang nong"),
    ((28.5, 50.0, 0.0, 0.0, None), "Nang")])
def test_labels(spark, values, label):
    df = spark.createDataFrame(
        [values], "temp double, hum double, wind double, rain double, prob double")
    cols = [F.col(c) for c in ("temp", "hum", "wind", "rain", "prob")]
    assert df.select(describe(*cols)).first()[0] == label


def test_text_formats(spark):
    df = spark.createDataFrame([("My_Khe_Beach", date(2026, 3, 5), 7)], "n string, d date, h int")
    row = df.select(
        display_name(F.col("n")), iso_date(F.col("d")), clock_hour(F.col("h"))).first()
    assert tuple(row) == ("My Khe Beach", "2026-03-05", "07:00")
