"""Whole jobs: CSV extract, and the star and feature tables built from raw readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import LINES, SHORTS, WET, daily, lines, r6_all, rounded, with_
from hourmart.catalogue.feature_queries import DATED_SLOTS, DAY_HISTORY, SLOT_HISTORY, TRAINING_WIDE
from hourmart.catalogue.stream_queries import scratch
from hourmart.model import (
    GAUGES, WET_ABOVE, day_history_columns, lag_columns, slot_history_columns,
)
from hourmart.operators.stats import column_profile, row_counts
from hourmart.plans.etl import extract, load_star
from hourmart.plans.features import build_feature_tables
from hourmart.sources.tables import Warehouse

_RENAMED = dict(zip(SHORTS, GAUGES.columns, strict=True))
TABLES = (
    "dw/dim_district", "dw/dim_date", "dw/dim_hour", "dw/fact_weather_hourly",
    "features/agg_daily_weather", "features/agg_historical_same_day",
    "features/agg_historical_same_day_hour", "features/mv_training_features")


def _readings(spark, d):
    """Lines as raw readings; the line number is the hour."""
    moment = F.col("full_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("slot"))
    return lines(spark, d).withColumnsRenamed(_RENAMED).select(
        F.col("entity").alias("district"), moment.alias("datetime"),
        *GAUGES.columns)


def q_csv_extract(spark, d):
    """Readings written as CSV and extracted from it again."""
    warehouse = Warehouse(spark, scratch(spark))
    path = f"{warehouse.root}/csv"
    _readings(spark, d).write.option("header", True).csv(path)
    return rounded(extract(warehouse, path)[0])


def _refreshed(spark, d) -> dict:
    """The star and feature tables after a full refresh."""
    warehouse = Warehouse(spark, scratch(spark))
    readings = warehouse.refresh("staging/raw_weather", _readings(spark, d))
    load_star(warehouse, readings)
    build_feature_tables(warehouse)
    return {t: warehouse.read(t) for t in TABLES}


def q_warehouse_refresh(spark, d):
    return row_counts(_refreshed(spark, d))


def q_warehouse_contents(spark, d):
    """Values and sum of every column of every table after a full refresh."""
    found = column_profile(_refreshed(spark, d))
    return found.withColumn("total", F.round("total", 3) + F.lit(0.0))


QUERIES = {
    "csv_extract": q_csv_extract, "warehouse_refresh": q_warehouse_refresh,
    "warehouse_contents": q_warehouse_contents}

_OUT = r6_all(*GAUGES.columns)
_KEYED = """
slots AS (
  SELECT entity, full_date, slot, temp, hum, wind, rain FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, full_date, slot ORDER BY temp, hum, wind, rain) AS rn FROM lines)
  WHERE rn = 1)"""
_NUMBERED = """
districts AS (
  SELECT entity, row_number() OVER (ORDER BY entity) AS district_id FROM (SELECT DISTINCT entity FROM lines)),
dates AS (
  SELECT full_date, row_number() OVER (ORDER BY full_date) AS date_id FROM (SELECT DISTINCT full_date FROM lines))"""
_AT_RAIN = str(WET_ABOVE)       # the hourly panel's own threshold


def _contents(name: str, source: str, columns: dict[str, str]) -> str:
    cells = ", ".join(f"{{'c': '{c}', 'n': count({e}), 't': sum({e})::DOUBLE}}" for c, e in columns.items())
    return f"""
SELECT '{name}' AS "table", x.c AS "column", x.n AS n_known, round(x.t, 3) + 0.0::DOUBLE AS total
FROM (SELECT unnest([{cells}]) AS x FROM {source})"""


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_EPOCH = "(full_date - DATE '1970-01-01')"
_PARTS = {
    "month": "month(full_date)", "day": "day(full_date)", "day_of_year": "dayofyear(full_date)",
    "day_of_week": "isodow(full_date)", "is_weekend": "CAST(isodow(full_date) IN (6, 7) AS INTEGER)",
    "year": "year(full_date)", "month_day": "(month(full_date) * 100 + day(full_date))"}
_TURNS = {
    f"{name}_{f}": f"{f}(2 * pi() * {value} / {period}::DOUBLE)"
    for name, value, period in (("hour", "slot", 24.0), ("doy", "dayofyear(full_date)", 365.25), ("month", "month(full_date)", 12.0))
    for f in ("sin", "cos")}
_MEASURES = {c: s for s, c in _RENAMED.items()}
_NAMED = {"district_name": "length(entity)"}
_STATS = _same(*[f"{s}_{k}" for s in SHORTS for k in ("mean", "std", "min", "max")], "rain_total")
_FLAGS = {f"lag_{n}d_is_rainy": f"CASE WHEN lag_{n}d_rain > {_AT_RAIN} THEN 1 ELSE 0 END" for n in (1, 2, 3)}
_CONTENTS = with_(
    LINES, _KEYED, _NUMBERED, daily("slots"), DAY_HISTORY, DATED_SLOTS, SLOT_HISTORY.replace(str(WET), _AT_RAIN),
    TRAINING_WIDE.replace("wide AS (", "wide AS MATERIALIZED (")) + " UNION ALL ".join((
        _contents("dw/dim_district", "districts", {"district_id": "district_id", **_NAMED}),
        _contents("dw/dim_date", "dates", {
            "date_id": "date_id", "full_date": _EPOCH, **_PARTS, "week_of_year": "weekofyear(full_date)",
            "quarter": "quarter(full_date)", "month_name": "length(monthname(full_date))"}),
        _contents("dw/dim_hour", "range(24) r(h)", {
            "hour_id": "h", "hour": "h",
            "period_of_day": "CASE WHEN h < 6 THEN 5 WHEN h < 12 THEN 7 WHEN h < 18 THEN 9 ELSE 7 END"}),
        _contents("dw/fact_weather_hourly", "slots JOIN districts USING (entity) JOIN dates USING (full_date)", {
            "district_id": "district_id", "date_id": "date_id", "hour_id": "slot", **_MEASURES,
            "full_date": _EPOCH, "year": _PARTS["year"]}),
        _contents("features/agg_daily_weather", "daily", {
            **_NAMED, "full_date": _EPOCH, **_STATS, **_same("year", "month_day")}),
        _contents("features/agg_historical_same_day", "day_history", {
            **_NAMED, **_same("year", "month_day", *day_history_columns(GAUGES))}),
        _contents("features/agg_historical_same_day_hour", "slot_history", {
            **_NAMED, **_same("year", "month_day", *slot_history_columns(GAUGES), "years_count"), "hour": "slot"}),
        _contents("features/mv_training_features", "wide JOIN districts USING (entity)", {
            "district_id": "district_id", **_NAMED, "full_date": _EPOCH, "hour": "slot", **_PARTS, **_TURNS,
            **_same(*day_history_columns(GAUGES), *slot_history_columns(GAUGES), *lag_columns(GAUGES)), **_FLAGS,
            **_MEASURES, "is_rainy": f"CASE WHEN rain > {_AT_RAIN} THEN 1 ELSE 0 END"})))
ORACLES = {
    "warehouse_contents": _CONTENTS,
    "csv_extract": with_(LINES) + f"""
SELECT district, datetime, {_OUT} FROM (
  SELECT entity AS district, full_date + to_hours(slot) AS datetime,
         {", ".join(f"{s} AS {c}" for s, c in _RENAMED.items())} FROM lines)""",
    "warehouse_refresh": with_(LINES, """
slots AS (SELECT DISTINCT entity, full_date, slot FROM lines)""", """
days AS (SELECT DISTINCT entity, full_date FROM lines)""", """
counts AS (
  SELECT (SELECT count(DISTINCT entity) FROM lines) AS n_entity,
         (SELECT count(DISTINCT full_date) FROM lines) AS n_date,
         (SELECT count(*) FROM slots) AS n_slot, (SELECT count(*) FROM days) AS n_day,
         (SELECT count(*) FROM days c WHERE EXISTS (
            SELECT 1 FROM days p WHERE p.entity = c.entity
              AND month(p.full_date) = month(c.full_date) AND day(p.full_date) = day(c.full_date)
              AND year(p.full_date) < year(c.full_date))) AS n_hist_day,
         (SELECT count(*) FROM slots c WHERE EXISTS (
            SELECT 1 FROM slots p WHERE p.entity = c.entity AND p.slot = c.slot
              AND month(p.full_date) = month(c.full_date) AND day(p.full_date) = day(c.full_date)
              AND year(p.full_date) < year(c.full_date))) AS n_hist_slot)""")
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", {n} AS row_count FROM counts""" for t, n in zip(
            TABLES, ("n_entity", "n_date", "24", "n_slot", "n_day", "n_hist_day",
                     "n_hist_slot", "n_slot"), strict=True)),
}
