"""Operators against plain-Python models on generated series."""

from __future__ import annotations

from datetime import date, timedelta
from statistics import mean, stdev

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hourmart.model import Panel
from hourmart.operators.history import same_day_history
from hourmart.operators.lags import calendar_lags, with_flags, with_rolling
from hourmart.operators.serving import prefer_actual
from hourmart.operators.stats import daily_stats
from hourmart.operators.writes import insert_if_absent, replace_groups, upsert

FEW = settings(
    max_examples=6, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
PANEL = Panel("place", "d", None, (("temp", "t"), ("rain", "r")))
SCHEMA = "place string, d date, t double, r double"

value = st.one_of(st.none(), st.integers(-20, 45).map(float))
rain = st.one_of(st.none(), st.sampled_from([0.0, 0.1, 0.2, 5.0]))
START = date(2023, 11, 20)
series = st.dictionaries(
    st.tuples(st.sampled_from("abc"), st.integers(0, 150).map(lambda n: START + timedelta(days=n))),
    st.tuples(value, rain), min_size=1, max_size=120)
sparse = st.dictionaries(
    st.tuples(st.sampled_from("ab"), st.builds(
        date, st.integers(2019, 2026), st.just(3), st.integers(1, 3))),
    st.tuples(st.integers(-20, 45).map(float), st.sampled_from([0.0, 0.2])), min_size=1)
keyed = st.dictionaries(st.integers(0, 30), st.tuples(value, rain), max_size=25)


def frame(spark, found):
    return spark.createDataFrame([(*k, *v) for k, v in found.items()], SCHEMA)


@FEW
@given(found=series)
def test_lags_and_rolling_follow_the_calendar(spark, found):
    df = with_rolling(with_flags(calendar_lags(frame(spark, found), PANEL), PANEL), PANEL)
    rows = df.collect()
    assert len(rows) == len(found)
    for row in rows:
        back = [found.get((row.place, row.d - timedelta(days=n)), (None, None))
                for n in range(1, 8)]
        assert [row[f"lag_{n}d_temp"] for n in range(1, 8)] == [b[0] for b in back]
        assert [row[f"lag_{n}d_rain"] for n in range(1, 8)] == [b[1] for b in back]
        near = [b[0] for b in back[:3] if b[0] is not None]
        assert row.rolling_3d_temp_mean == (pytest.approx(mean(near)) if near else None)
        assert row.rolling_3d_temp_std == (
            pytest.approx(stdev(near), abs=1e-9) if len(near) > 1 else None)
        assert row.recent_rain_count == sum((b[1] or 0) > 0.1 for b in back[:3])


@FEW
@given(found=sparse)
def test_history_uses_earlier_years_only(spark, found):
    rows = same_day_history(daily_stats(frame(spark, found), PANEL), PANEL).collect()
    expected = {}
    for (place, day), _ in found.items():
        past = [v[0] for (p, e), v in found.items()
                if p == place and (e.month, e.day) == (day.month, day.day) and e.year < day.year]
        if past:
            expected[place, day.year, day.month * 100 + day.day] = (mean(past), len(past))
    assert {(r.place, r.year, r.month_day): (pytest.approx(r.hist_temp_mean), r.years_count)
            for r in rows} == expected


@FEW
@given(actual=series, forecast=series)
def test_actual_comes_first(spark, actual, forecast):
    rows = prefer_actual(frame(spark, actual), frame(spark, forecast), PANEL).collect()
    assert {(r.place, r.d): (r.t, r.r) for r in rows} == {**forecast, **actual}


@FEW
@given(old=keyed, new=keyed)
def test_writes_are_dictionary_updates(spark, old, new):
    def table(found):
        return spark.createDataFrame([(k, *v) for k, v in found.items()], "k int, t double, r double")

    def back(df):
        return {r.k: (r.t, r.r) for r in df.collect()}

    a, b = table(old), table(new)
    assert back(upsert(a, b, ["k"], ["t", "r"])) == {**old, **new}
    only_t = {k: (new[k][0], old[k][1]) if k in new and k in old else v
              for k, v in {**old, **new}.items()}
    assert back(upsert(a, b, ["k"], ["t"])) == only_t
    assert back(insert_if_absent(a, b, ["k"])) == {**new, **old}
    assert back(replace_groups(a, b, ["k"])) == {**old, **new}


def test_one_dominant_series_spreads_over_tasks(spark):
    """A third of the rows in one series still ends up in many window groups."""
    days = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50))
        .alias("place"), F.date_add(F.lit(START), F.col("id").cast("int")).alias("d"),
        F.col("id").cast("double").alias("t"), F.lit(0.0).alias("r"))
    lagged = calendar_lags(days, PANEL, horizon=3)
    hot = lagged.where("place = 'hot'")
    assert hot.where("lag_3d_temp = t - 3").count() == 10_000 - 1
    tasks = hot.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
