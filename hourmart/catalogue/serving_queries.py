"""Spines, source fallback, serving lags and histories, coverage, forecast errors."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import (
    ACTUAL, ACTUAL_SLOTS, DAY, FORECAST, FORECAST_SLOTS, HOUR, HOURS, LINES, MONTH_DAY, SHORTS, SLOT, YEAR,
    actual_days, actual_slots, daily, forecast_days, forecast_rows, hour_rows, lines, r6, r6_all,
    rounded, table, with_,
)
from hourmart.catalogue.feature_queries import SLOT_STATS, lag_joins
from hourmart.model import LAG_DAYS, day_history_columns, lag_columns, slot_history_columns
from hourmart.operators.history import day_history_for, slot_history_for
from hourmart.operators.lags import lags_at, lags_for, lags_for_day
from hourmart.operators.serving import (
    backfill_columns, coverage_by_day, coverage_gaps, day_spine, days_present, last_date, prefer_actual,
    prefer_actual_ranked, prefer_actual_tagged, slot_spine,
)
from hourmart.operators.stats import daily_stats, error_metrics
from hourmart.plans.forecast import batch_details, batch_totals, forecast_errors, known_entities


def _source(spark, d):
    return prefer_actual(actual_days(spark, d), forecast_days(spark, d), DAY)


def _span(df):
    """First and last day, as scalars of the plan."""
    return tuple(df.agg(f("full_date")).scalar() for f in (F.min, F.max))


def _entities(spark, d):
    return lines(spark, d).select("entity").distinct()


def q_source_priority(spark, d):
    return rounded(_source(spark, d))


def q_source_priority_ranked(spark, d):
    return rounded(prefer_actual_ranked(actual_days(spark, d), forecast_days(spark, d), DAY))


def q_serving_lags(spark, d):
    """Lags of every forecast day, from actuals where there are any."""
    source = prefer_actual_tagged(lines(spark, d), DAY, F.col("status") == "F")
    return rounded(lags_at(source, DAY, F.col("has_forecast")))


def q_serving_lags_for(spark, d):
    """The same for targets given beside the history."""
    return rounded(lags_for(_source(spark, d), forecast_days(spark, d), DAY))


def q_known_columns(spark, d):
    """Serving rows with every trained column, those that are missing as NULL."""
    return rounded(backfill_columns(actual_days(spark, d), ["entity", "full_date", "rain", "gust", "temp"]).select(
        "entity", "full_date", "temp", "rain", "gust"))


def q_serving_lags_next_day(spark, d):
    """Lags of the day after the last one known."""
    last = last_date(lines(spark, d), "full_date", "1970-01-01").first()[0]
    return rounded(lags_for_day(_source(spark, d), DAY, last + timedelta(days=1)))


def q_serving_day_history(spark, d):
    """Same-day history for every entity and day of the calendar, measured or not."""
    rows = lines(spark, d)
    targets = day_spine(_entities(spark, d), *_span(rows), DAY)
    return rounded(day_history_for(
        daily_stats(rows.where("status = 'F'"), DAY), targets, DAY))


def q_serving_slot_history(spark, d):
    """Same-day-and-slot history from actuals for every forecast row."""
    return rounded(slot_history_for(actual_slots(spark, d), forecast_rows(spark, d), SLOT))


def q_day_spine(spark, d):
    return day_spine(_entities(spark, d), *_span(lines(spark, d)), DAY)


def q_slot_gaps(spark, d):
    """Hours without an event per event type and day, between the first and the last day."""
    rows = hour_rows(spark, d)
    spine = slot_spine(rows.select("entity").distinct(), *_span(rows), HOUR, slots=24)
    return (
        spine.join(rows.select(*HOUR.keys), HOUR.keys, "left_anti").groupBy("entity", "full_date")
        .agg(F.count(F.lit(1)).alias("missing_slots")))


def q_coverage_gaps(spark, d):
    forecast = forecast_days(spark, d)
    return coverage_gaps(_entities(spark, d), forecast, *_span(forecast), DAY)


def q_coverage_by_day(spark, d):
    forecast = forecast_days(spark, d)
    return coverage_by_day(_entities(spark, d), forecast, *_span(forecast), DAY)


def q_days_present(spark, d):
    """Order days on which something was shipped."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("full_date"))
    return days_present(days.distinct(), lines(spark, d), "full_date")


def q_last_date(spark, d):
    return last_date(lines(spark, d).where("status = 'F'"), "full_date", "1970-01-01")


def _errors(spark, d):
    return forecast_errors(forecast_days(spark, d), actual_days(spark, d), DAY)


def q_forecast_errors(spark, d):
    return rounded(_errors(spark, d))


def q_error_metrics(spark, d):
    return rounded(error_metrics(_errors(spark, d), DAY, "entity"))


def q_batch_details(spark, d):
    return batch_details(forecast_rows(spark, d), SLOT)


def q_batch_totals(spark, d):
    """Forecasts for all nations; region names are asked for too and fail."""
    requests = (
        table(spark, d, "nation").select(F.col("n_name").alias("entity"))
        .unionByName(table(spark, d, "region").select(F.col("r_name").alias("entity"))))
    _, errors = known_entities(requests, _entities(spark, d), SLOT)
    return batch_totals(forecast_rows(spark, d), errors, SLOT)


QUERIES = {
    "source_priority": q_source_priority,
    "source_priority_ranked": q_source_priority_ranked,
    "serving_lags": q_serving_lags,
    "serving_lags_for": q_serving_lags_for,
    "known_columns": q_known_columns,
    "serving_lags_next_day": q_serving_lags_next_day,
    "serving_day_history": q_serving_day_history,
    "serving_slot_history": q_serving_slot_history,
    "day_spine": q_day_spine,
    "slot_gaps": q_slot_gaps,
    "coverage_gaps": q_coverage_gaps,
    "coverage_by_day": q_coverage_by_day,
    "days_present": q_days_present,
    "last_date": q_last_date,
    "forecast_errors": q_forecast_errors,
    "error_metrics": q_error_metrics,
    "batch_details": q_batch_details,
    "batch_totals": q_batch_totals,
}

# --------------------------------------------------------------------------
_SOURCE = """
source AS (
  SELECT entity, full_date, temp, hum, wind, rain, 'actual' AS source FROM actual
  UNION ALL
  SELECT entity, full_date, temp, hum, wind, rain, 'forecast' FROM forecast ANTI JOIN actual USING (entity, full_date))"""
_PRIORITY = with_(LINES, ACTUAL, FORECAST, _SOURCE) + f"""
SELECT entity, full_date, {r6_all(*SHORTS)}, source FROM source"""
_lags, _joins = lag_joins("source", SHORTS)
_CALENDAR = """
spine AS (
  SELECT entity, CAST(d AS DATE) AS full_date
  FROM (SELECT DISTINCT entity FROM lines),
       (SELECT unnest(generate_series(min(full_date), max(full_date), INTERVAL 1 DAY)) AS d
        FROM {table}))"""
_HIST = ", ".join(
    f"avg(p.{s}_mean) AS hist_{s}_mean, avg(p.{s}_std) AS hist_{s}_std, "
    f"min(p.{s}_min) AS hist_{s}_min, max(p.{s}_max) AS hist_{s}_max" for s in SHORTS)
_HIST_OUT = [c for c in day_history_columns(DAY) if c != "years_count"]
_MATCHED_STATS = SLOT_STATS.replace(   # an unmatched row is neither wet nor dry
    "ELSE 0.0::DOUBLE END", "WHEN p.entity IS NOT NULL THEN 0.0::DOUBLE END")
_NEXT = ", ".join(
    f"max(CASE WHEN target - full_date = {n} THEN {s} END) AS lag_{n}d_{s}"
    for n in range(1, LAG_DAYS + 1) for s in SHORTS)
_ERRORS = """
errors AS (
  SELECT entity, full_date, """ + ", ".join(
    f"f.{s} AS {s}_pred, a.{s} AS {s}, f.{s} - a.{s} AS {s}_error" for s in SHORTS) + """
  FROM forecast f JOIN actual a USING (entity, full_date))"""

_SERVING_LAGS = with_(LINES, ACTUAL, FORECAST, _SOURCE, f"""
lagged AS (SELECT f.entity, f.full_date, {_lags} FROM forecast f {_joins})""") + f"""
SELECT entity, full_date, {r6_all(*lag_columns(DAY))} FROM lagged"""

ORACLES = {
    "source_priority": _PRIORITY,
    "source_priority_ranked": _PRIORITY,
    "serving_lags": _SERVING_LAGS,
    "serving_lags_for": _SERVING_LAGS,
    "known_columns": with_(LINES, ACTUAL) + f"""
SELECT entity, full_date, {r6_all("temp", "rain")}, CAST(NULL AS DOUBLE) AS gust FROM actual""",
    "serving_lags_next_day": with_(LINES, ACTUAL, FORECAST, _SOURCE, f"""
lagged AS (
  SELECT entity, {_NEXT}
  FROM source, (SELECT max(full_date) + 1 AS target FROM source)
  WHERE full_date >= target - 7 AND full_date < target GROUP BY entity)""") + f"""
SELECT entity, {r6_all(*lag_columns(DAY))} FROM lagged""",
    "serving_day_history": with_(
        LINES, _CALENDAR.format(table="lines"), "open_lines AS (SELECT * FROM lines WHERE "
        "status = 'F')", daily("open_lines"), f"""
found AS (
  SELECT c.entity, c.full_date, {_HIST}, count(DISTINCT p.year) AS years_count
  FROM spine c JOIN daily p ON p.entity = c.entity AND p.year < year(c.full_date)
    AND p.month_day = month(c.full_date) * 100 + day(c.full_date)
  GROUP BY c.entity, c.full_date)""") + f"""
SELECT entity, full_date, {r6_all(*_HIST_OUT)}, years_count FROM found""",
    "serving_slot_history": with_(LINES, ACTUAL_SLOTS, FORECAST_SLOTS, f"""
past AS (SELECT *, {YEAR} AS year, {MONTH_DAY} AS month_day FROM actual_slots)""", f"""
target AS (SELECT *, {YEAR} AS year, {MONTH_DAY} AS month_day FROM forecast_slots)""", f"""
found AS (
  SELECT c.entity, c.full_date, c.slot,
         {_MATCHED_STATS}
  FROM target c LEFT JOIN past p ON p.entity = c.entity AND p.slot = c.slot
                               AND p.month_day = c.month_day AND p.year < c.year
  GROUP BY c.entity, c.full_date, c.slot)""") + f"""
SELECT entity, full_date, slot, {r6_all(*slot_history_columns(SLOT))} FROM found""",
    "day_spine": with_(LINES, _CALENDAR.format(table="lines")) + "SELECT * FROM spine",
    "slot_gaps": with_(HOURS, """
span AS (SELECT min(full_date) AS low, max(full_date) AS high FROM hours),
spine AS (
  SELECT entity, CAST(low + CAST(i AS INTEGER) AS DATE) AS full_date, CAST(h AS INTEGER) AS hour
  FROM (SELECT DISTINCT entity FROM hours), span, range(high - low + 1) days(i), range(24) r(h))""") + """
SELECT entity, full_date, count(*) AS missing_slots
FROM (SELECT entity, full_date, hour FROM spine EXCEPT SELECT entity, full_date, hour FROM hours)
GROUP BY entity, full_date""",
    "coverage_gaps": with_(LINES, FORECAST, _CALENDAR.format(table="forecast")) + """
SELECT entity, full_date FROM spine ANTI JOIN forecast USING (entity, full_date)""",
    "coverage_by_day": with_(LINES, FORECAST, _CALENDAR.format(table="forecast")) + """
SELECT full_date, count(f.temp) AS covered, count(*) AS expected,
       count(f.temp) < count(*) AS missing
FROM spine LEFT JOIN forecast f USING (entity, full_date) GROUP BY full_date""",
    "days_present": with_(LINES) + """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS full_date FROM orders
WHERE CAST(o_orderdate AS DATE) IN (SELECT full_date FROM lines)""",
    "last_date": with_(LINES)
    + "SELECT max(full_date) AS last_date FROM lines WHERE status = 'F'",
    "forecast_errors": with_(LINES, ACTUAL, FORECAST, _ERRORS) + f"""
SELECT entity, full_date,
       {r6_all(*[s + k for s in SHORTS for k in ("_pred", "", "_error")])} FROM errors""",
    "error_metrics": with_(LINES, ACTUAL, FORECAST, _ERRORS) + " UNION ALL ".join(f"""
SELECT '{s}' AS target, entity, count(*) AS n, {r6(f"avg(abs({s}_error))", "mae")},
       {r6(f"sqrt(avg({s}_error ** 2))", "rmse")},
       {r6(f"1 - sum({s}_error ** 2) / (var_pop({s}) * count(*))", "r2")}
FROM errors GROUP BY entity""" for s in SHORTS),
    "batch_details": with_(LINES, FORECAST_SLOTS) + """
SELECT entity, full_date,
       round_even(CAST(min(temp) AS DECIMAL(18,6)), 1)::DOUBLE AS temp_min,
       round_even(CAST(max(temp) AS DECIMAL(18,6)), 1)::DOUBLE AS temp_max,
       round_even(CAST(sum(rain) AS DECIMAL(18,6)), 2)::DOUBLE AS rain_total
FROM forecast_slots GROUP BY entity, full_date""",
    "batch_totals": with_(LINES, """
counts AS (
  SELECT (SELECT count(*) FROM (SELECT DISTINCT entity, full_date FROM lines
                                WHERE status = 'O')) AS success,
         (SELECT count(*) FROM (SELECT n_name AS name FROM nation
                                UNION SELECT r_name FROM region)
          WHERE name NOT IN (SELECT entity FROM lines)) AS errors)""") + """
SELECT success, errors, success + errors AS total_forecasts FROM counts""",
}
