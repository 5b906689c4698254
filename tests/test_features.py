from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from tests.twins import same_day_history_join, same_slot_history_join

from hourmart.catalogue.bindings import DAY, OFF_HALF, SLOT, lines, slot_rows
from hourmart.model import Panel, rolling_columns
from hourmart.operators.facts import dedup_fact
from hourmart.operators.history import (
    day_history_for, same_day_history, same_slot_history, slot_history_for,
)
from hourmart.operators.lags import (
    calendar_lags, calendar_lags_join, lags_for, lags_for_day, rolling_by_frames, with_flags,
    with_rolling,
)
from hourmart.operators.serving import prefer_actual
from hourmart.operators.stats import daily_stats, split_date
from hourmart.plans.features import serving_features, serving_features_for_day, training_table
from hourmart.plans.training import sample_weights, time_split

SF = "/root/testdata/sf0.001"
ONE = Panel("place", "d", None, (("temp", "t"), ("rain", "r")))
HOURLY = Panel("place", "d", "hour", (("temp", "t"), ("rain", "r")))


def frame(spark, values, panel=ONE):
    slot = "hour int, " if panel.slot else ""
    return spark.createDataFrame(values, f"place string, d date, {slot}t double, r double")


def same(a, b, digits=6):
    def shown(df):
        return sorted(
            tuple(round(v + OFF_HALF, digits) + 0.0 if isinstance(v, float) else str(v)
                  for v in row)
            for row in df.select(*sorted(a.columns)).collect())
    return shown(a) == shown(b)


def test_calendar_gap_gives_null_not_the_nearest_day(spark, rows):
    df = frame(spark, [("a", date(2024, 1, d), float(d), 0.0) for d in (1, 2, 4, 5)])
    found = {r["d"].day: r for r in rows(calendar_lags(df, ONE))}
    assert [found[4][f"lag_{n}d_temp"] for n in (1, 2, 3, 4)] == [None, 2.0, 1.0, None]
    assert found[5]["lag_1d_temp"] == 4.0


@pytest.mark.parametrize("block_days", [7, 8, 64])
def test_lags_do_not_depend_on_the_blocks(spark, block_days):
    days = [date(1969, 12, 20) + timedelta(days=d) for d in range(60) if d % 11]
    df = frame(spark, [(p, d, float(d.toordinal() + i), 0.2 * i) for i, p in enumerate("ab")
                       for d in days])
    assert same(calendar_lags(df, ONE, block_days=block_days), calendar_lags_join(df, ONE))


def test_a_block_shorter_than_the_horizon_is_refused(spark):
    with pytest.raises(ValueError, match="block"):
        calendar_lags(frame(spark, [("a", date(2024, 1, 1), 1.0, 0.0)]), ONE, block_days=3)


def test_rolling_forms_agree(spark):
    days = [date(2024, 1, 1) + timedelta(days=d) for d in range(40) if d % 7 != 3]
    df = frame(spark, [("a", d, float(d.day % 9), 0.3 * (d.day % 3)) for d in days])
    columns = ["place", "d", *rolling_columns(ONE)]
    by_lags = with_rolling(with_flags(calendar_lags(df, ONE), ONE), ONE).select(*columns)
    assert same(by_lags, rolling_by_frames(df, ONE).select(*columns))


def test_trend_and_flags(spark):
    df = frame(spark, [("a", date(2024, 1, d), t, r) for d, t, r in (
        (1, 22.0, 0.1), (2, 23.0, 0.2), (3, 25.0, 5.0), (4, 0.0, 0.0))])
    row = with_rolling(with_flags(calendar_lags(df, ONE), ONE), ONE).where(
        "d = '2024-01-04'").first()
    assert row.trend_3d_temp == 3.0
    assert (row.lag_1d_is_rainy, row.lag_2d_is_rainy, row.lag_3d_is_rainy) == (1, 1, 0)
    assert row.recent_rain_count == 2


def _years(values, month=3, day=20):
    return [("a", date(2023 + i, month, day), v, 0.0) for i, v in enumerate(values)]


def test_history_of_earlier_years(spark, rows):
    df = frame(spark, _years([24.1, 25.3, 23.8, 99.0]))
    found = rows(same_day_history(daily_stats(df, ONE), ONE), "year")
    assert [r["year"] for r in found] == [2024, 2025, 2026]
    assert found[-1]["hist_temp_mean"] == pytest.approx(24.4)
    assert found[-1]["years_count"] == 3
    assert found[-1]["hist_temp_std"] is None   # one reading per day has no deviation


def test_leap_day_matches_leap_years_only(spark):
    df = frame(spark, [("a", date(2024, 2, 29), 1.0, 0.0), ("a", date(2025, 2, 28), 2.0, 0.0)])
    assert same_day_history(daily_stats(df, ONE), ONE).count() == 0


def test_hourly_history(spark):
    df = spark.createDataFrame(
        [("a", date(2023 + i, 3, 20), 14, t, r) for i, (t, r) in enumerate(
            ((28.5, 0.0), (30.1, 0.0), (27.8, 1.2), (0.0, 0.0)))],
        "place string, d date, hour int, t double, r double")
    row = same_slot_history(df, HOURLY).where("year = 2026").first()
    assert row.hist_h_temp_mean == pytest.approx(28.8)
    assert row.hist_h_rain_prob == pytest.approx(1 / 3)
    one = same_slot_history(df, HOURLY).where("year = 2024").first()
    assert one.hist_h_temp_mean == 28.5
    assert one.hist_h_temp_std is None


def test_history_windows_equal_the_joins(spark):
    daily = daily_stats(lines(spark, SF), DAY)
    assert same(same_day_history(daily, DAY), same_day_history_join(daily, DAY))
    slots = slot_rows(spark, SF)
    assert same(same_slot_history(slots, SLOT), same_slot_history_join(slots, SLOT))


def test_future_days_get_history_and_do_not_count_themselves(spark):
    df = frame(spark, [("a", date(2023, 3, 20), 14, 10.0, 0.5), ("a", date(2024, 3, 20), 14, 20.0,
                                                              0.0)], HOURLY)
    target = spark.createDataFrame([("a", date(2025, 3, 20), 14), ("a", date(2026, 3, 20), 14)],
                                   "place string, d date, hour int")
    slot = {r.d.year: r for r in slot_history_for(df, target, HOURLY).collect()}
    assert slot[2026].hist_h_temp_mean == 15.0
    assert slot[2026].hist_h_rain_prob == 0.5
    day = {r.d.year: r for r in day_history_for(daily_stats(df, HOURLY), target, HOURLY).collect()}
    assert day[2025].years_count == day[2026].years_count == 2


def test_no_future_leaks_into_history_or_lags(spark):
    days = [date(y, 3, d) for y in (2023, 2024, 2025) for d in range(1, 20)]
    values = [("a", d, float(d.day), 0.0) for d in days]
    changed = [(p, d, t + (1000.0 if d > date(2024, 3, 10) else 0.0), r) for p, d, t, r in values]
    keep = "d <= '2024-03-10'"
    tables = [
        training_table(frame(spark, v), daily_stats(frame(spark, v), ONE), ONE).where(keep)
        for v in (values, changed)]
    assert same(*tables)


def test_training_and_serving_agree(spark):
    """The same keys through the training table and the serving features."""
    days = [date(y, 3, d) for y in (2023, 2024, 2025) for d in range(1, 15)]
    df = frame(spark, [
        (p, d, h, float(d.day * 3 % 7 + h + d.year % 5), 0.05 * (d.day % 4))
        for p in "ab" for d in days for h in (0, 12)], HOURLY)
    daily = daily_stats(df, HOURLY)
    trained = with_rolling(training_table(df, daily, HOURLY), HOURLY)
    target = df.select("place", "d", "hour")
    served = serving_features(target, df, df, daily, HOURLY)
    columns = [c for c in served.columns if c in trained.columns]
    assert len(columns) > 40
    assert same(served.select(*columns), trained.select(*columns))
    day = date(2025, 3, 14)
    one = serving_features_for_day(target.where(F.col("d") == day), day, df, df, daily, HOURLY)
    assert same(one.select(*columns), trained.where(F.col("d") == day).select(*columns))


def test_lag_source_prefers_actual_and_falls_back(spark):
    actual = frame(spark, [("a", date(2026, 3, d), float(d), 0.0) for d in range(13, 21)])
    forecast = frame(spark, [("a", date(2026, 3, d), 100.0 + d, 0.0) for d in (19, 20, 21)])
    target = spark.createDataFrame([("a", date(2026, 3, 22))], "place string, d date")
    source = prefer_actual(actual, forecast, ONE)
    row = lags_for(source, target, ONE).first()
    assert [row[f"lag_{n}d_temp"] for n in range(1, 8)] == [121, 20, 19, 18, 17, 16, 15]
    assert source.where("source = 'forecast'").count() == 1
    pivot = lags_for_day(source, ONE, date(2026, 3, 22)).first()
    assert [pivot[c] for c in row.asDict() if c.startswith("lag")] == [
        v for c, v in row.asDict().items() if c.startswith("lag")]


def test_actual_row_wins_whole_even_where_it_is_null(spark):
    actual = frame(spark, [("a", date(2026, 3, 1), None, 1.0)])
    forecast = frame(spark, [("a", date(2026, 3, 1), 5.0, 2.0)])
    row = prefer_actual(actual, forecast, ONE).first()
    assert (row.t, row.r, row.source) == (None, 1.0, "actual")


def test_dedup_keeps_one_whole_row(spark):
    df = frame(spark, [("a", date(2024, 1, 1), t, r) for t, r in ((2.0, 0.0), (1.0, 9.0))] * 50)
    assert [tuple(r)[2:] for r in dedup_fact(df, ONE).collect()] == [(1.0, 9.0)]


@pytest.mark.parametrize(("n", "expected"), [
    (10, date(2024, 1, 9)), (2, date(2024, 1, 2)), (1, date(2024, 1, 1))])
def test_split_day(spark, n, expected):
    df = frame(spark, [("a", date(2024, 1, 1) + timedelta(days=d), 0.0, 0.0) for d in range(n)])
    assert split_date(df, "d").first()[0] == expected
    earlier, later = time_split(df, "d", expected)
    assert earlier.count() + later.count() == n


def test_weights(spark):
    df = spark.createDataFrame([(2025,), (2026,)], "year int")
    assert [r.weight for r in sample_weights(df).orderBy("year").collect()] == [1.0, 3.0]
    assert sample_weights(df.where("year = 2025")).first().weight == 1.0
