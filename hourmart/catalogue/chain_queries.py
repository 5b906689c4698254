"""Chained forecasts at slot grain by the closed-form scorer, so that SQL can say the whole chain."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import (
    LINES, MONTH_DAY, SHORTS, SLOT, SLOTS, WET, YEAR, daily, lines, r6, rounded, slot_rows, table, with_,
)
from hourmart.catalogue.feature_queries import SLOT_STATS, lag_joins
from hourmart.catalogue.stream_queries import scratch
from hourmart.catalogue.write_queries import RULES
from hourmart.model import day_history_columns, feature_columns, slot_history_columns
from hourmart.operators.dims import dim_entity
from hourmart.operators.serving import last_date, slot_spine
from hourmart.operators.stats import daily_stats
from hourmart.plans.features import serving_features
from hourmart.plans.forecast import ForecastJob, run_batch
from hourmart.plans.scoring import PROBABILITY, LinearScorer
from hourmart.session import written
from hourmart.sources.tables import Warehouse

DAYS_AHEAD, SLOTS_A_DAY = 3, 8
AS_OF = datetime(2026, 3, 20, 0, 5)

# The weights of the registered chain.
BASE = {"temp": 6.0, "hum": 8.0, "wind": 0.01, "rain": 0.02, PROBABILITY: 0.1}
WEIGHTS = {
    "temp": {"lag_1d_temp": 0.5, "lag_2d_temp": 0.2, "rolling_3d_temp_mean": 0.3, "trend_3d_temp": 0.15,
             "hist_h_temp_mean": 0.35, "rolling_3d_temp_std": 0.1, "doy_sin": 2.0},
    "hum": {"lag_1d_hum": 0.6, "rolling_7d_hum_mean": 0.4, "hist_hum_mean": 0.3, "recent_rain_count": 4.0,
            "hist_hum_max": 0.2, "month_cos": 3.0},
    "wind": {"lag_1d_wind": 0.4, "hist_h_wind_mean": 0.3, "day_of_week": 0.002, "hour_sin": 0.01},
    "rain": {"rolling_3d_rain_mean": 0.5, "hist_h_rain_max": 0.3, "lag_7d_rain": 0.2},
}
CHANCE = {"recent_rain_count": 0.25, "hist_h_rain_prob": 0.4, "lag_1d_is_rainy": 0.2, "slot": 0.01}


def _job(spark, d) -> ForecastJob:
    rows = lines(spark, d)
    entities = written(dim_entity(rows, "entity", "entity_id"), "entities")
    actual = written(slot_rows(spark, d), "actual")
    stats = written(daily_stats(rows, SLOT), "daily")
    scorer = LinearScorer(SLOT, BASE, WEIGHTS, CHANCE)
    return ForecastJob(
        Warehouse(spark, scratch(spark)), scorer, entities, actual, stats, RULES, SLOTS_A_DAY)


def q_chained_linear(spark, d):
    """Three days after the last measured one, rules on, each day seeing the ones before it as lags."""
    stored = run_batch(_job(spark, d), None, AS_OF, DAYS_AHEAD).stored
    return rounded(stored.select(*SLOT.keys, *SLOT.columns, "rain_probability"))


def _asked(spark, d):
    """All nations, and the regions, which no forecast knows."""
    return (
        table(spark, d, "nation").select(F.col("n_name").alias("entity"))
        .unionByName(table(spark, d, "region").select(F.col("r_name").alias("entity"))))


def q_batch_result(spark, d):
    """The totals of a run in which some names are unknown and some rows are rejected."""
    return run_batch(_job(spark, d), None, AS_OF, DAYS_AHEAD, _asked(spark, d)).totals


def q_batch_result_details(spark, d):
    """Ranges and rejected rows by entity and day of the same run, with the names that failed."""
    found = run_batch(_job(spark, d), None, AS_OF, DAYS_AHEAD, _asked(spark, d))
    return rounded(found.details.unionByName(found.errors, allowMissingColumns=True))


def q_serving_features(spark, d):
    """All model inputs of the day after the last measured one, for every entity and slot."""
    rows = lines(spark, d)
    entities = written(dim_entity(rows, "entity", "entity_id"), "entities")
    actual = slot_rows(spark, d)
    day = F.date_add(last_date(rows, "full_date", "1970-01-01").scalar(), 1)
    targets = slot_spine(entities, day, day, SLOT, SLOTS_A_DAY)
    found = serving_features(targets, actual, actual, daily_stats(rows, SLOT), SLOT)
    return rounded(_whole(found.select(*SLOT.keys, *[c for c in feature_columns(SLOT) if c != "slot"])))


def _whole(df):
    return df.withColumns({c: F.col(c).cast("int") for c in df.columns if c in _WHOLE})


_WHOLE = ("month", "day", "day_of_year", "day_of_week", "recent_rain_count", "entity_id",
          "lag_1d_is_rainy", "lag_2d_is_rainy", "lag_3d_is_rainy")

QUERIES = {
    "chained_linear": q_chained_linear,
    "batch_result": q_batch_result,
    "batch_result_details": q_batch_result_details,
    "serving_features": q_serving_features,
}

# --------------------------------------------------------------------------
_HIST = ", ".join(
    f"avg(p.{s}_mean) AS hist_{s}_mean, avg(p.{s}_std) AS hist_{s}_std, "
    f"min(p.{s}_min) AS hist_{s}_min, max(p.{s}_max) AS hist_{s}_max" for s in SHORTS)
_DATED = f"past AS (SELECT *, {YEAR} AS year, {MONTH_DAY} AS month_day FROM slots)"
_BASE_DAY = "base AS (SELECT max(full_date) AS day FROM lines)"
_ENTITIES = """
entities AS (
  SELECT entity, CAST(row_number() OVER (ORDER BY entity) AS INTEGER) AS entity_id
  FROM (SELECT DISTINCT entity FROM lines))"""


def _cycles() -> str:
    found = []
    for name, value, period in (("hour", "slot", 24.0), ("doy", "dayofyear(full_date)", 365.25),
                                ("month", "month(full_date)", 12.0)):
        angle = f"2 * pi() * {value} / {period}::DOUBLE"
        found += [f"sin({angle}) AS {name}_sin", f"cos({angle}) AS {name}_cos"]
    return ", ".join(found)


def _features(k: int, known: str) -> tuple[str, ...]:
    """CTEs up to features_<k>: the inputs of the k-th day, lags from the rows of ``known``."""
    columns, joins = lag_joins(f"known_{k}", SHORTS, "slot", base="t")
    near = {s: "[" + ", ".join(f"lag_{n}d_{s}" for n in range(1, 4)) + "]" for s in SHORTS}
    far = {s: "[" + ", ".join(f"lag_{n}d_{s}" for n in range(1, 8)) + "]" for s in SHORTS}
    flags = ", ".join(
        f"CAST(CASE WHEN lag_{n}d_rain > {WET} THEN 1 ELSE 0 END AS INTEGER) AS lag_{n}d_is_rainy" for n in (1, 2, 3))
    rolling = ", ".join(
        f"list_avg({near[s]}) AS rolling_3d_{s}_mean, list_avg({far[s]}) AS rolling_7d_{s}_mean, "
        f"list_stddev_samp({near[s]}) AS rolling_3d_{s}_std, lag_1d_{s} - lag_3d_{s} AS trend_3d_{s}" for s in SHORTS)
    return (
        f"known_{k} AS ({known})",
        f"""targets_{k} AS (
  SELECT entity, entity_id, CAST(day + {k} AS DATE) AS full_date, CAST(h AS INTEGER) AS slot
  FROM entities, base, range({SLOTS_A_DAY}) r(h))""",
        f"""days_{k} AS (
  SELECT entity, full_date, {_HIST}, count(DISTINCT p.year) AS years_count
  FROM (SELECT DISTINCT entity, full_date FROM targets_{k}) c
  JOIN (SELECT * RENAME (full_date AS measured) FROM daily) p USING (entity)
  WHERE p.month_day = month(c.full_date) * 100 + day(c.full_date) AND p.year < year(c.full_date) GROUP BY ALL)""",
        f"""hours_{k} AS (
  SELECT c.entity, c.full_date, c.slot, {SLOT_STATS}
  FROM targets_{k} c JOIN past p ON p.entity = c.entity AND p.slot = c.slot
   AND p.month_day = month(c.full_date) * 100 + day(c.full_date) AND p.year < year(c.full_date) GROUP BY ALL)""",
        f"""lagged_{k} AS (SELECT t.*, {columns} FROM targets_{k} t {joins})""",
        f"""flagged_{k} AS (SELECT *, {flags} FROM lagged_{k})""",
        f"""features_{k} AS (
  SELECT *, CAST(month(full_date) AS INTEGER) AS month, CAST(day(full_date) AS INTEGER) AS day,
    CAST(dayofyear(full_date) AS INTEGER) AS day_of_year, CAST(isodow(full_date) AS INTEGER) AS day_of_week,
    {_cycles()}, {rolling},
    lag_1d_is_rainy + lag_2d_is_rainy + lag_3d_is_rainy AS recent_rain_count
  FROM flagged_{k} LEFT JOIN days_{k} USING (entity, full_date) LEFT JOIN hours_{k} USING (entity, full_date, slot))""")


def _linear(base: float, weights: dict[str, float]) -> str:
    return " + ".join([f"{base}::DOUBLE", *[f"coalesce({c}, 0) * {w}::DOUBLE" for c, w in weights.items()]])


def _half_even(value: str, digits: int) -> str:
    """Rounded to even on six exact decimals."""
    scaled = f"(CAST({value} AS DECIMAL(18,6)) * {10 ** digits})"
    low = f"floor({scaled})"
    up = f"({scaled} - {low} > 0.5 OR {scaled} - {low} = 0.5 AND CAST({low} AS BIGINT) % 2 <> 0)"
    return f"(CAST({low} AS BIGINT) + CASE WHEN {up} THEN 1 ELSE 0 END) / {10 ** digits}::DOUBLE"


def _day(k: int) -> tuple[str, ...]:
    """CTEs up to scored_<k> and stored_<k>; a stored day is part of what the next one looks back on."""
    known = "SELECT entity, full_date, slot, temp, hum, wind, rain FROM slots" + "".join(
        f" UNION ALL SELECT entity, full_date, slot, temp, hum, wind, rain FROM stored_{i}" for i in range(1, k))
    return (*_features(k, known), f"""
raw_{k} AS (
  SELECT entity, full_date, slot, {_linear(BASE["temp"], WEIGHTS["temp"])} AS temp,
    greatest(0, least(100, {_linear(BASE["hum"], WEIGHTS["hum"])})) AS hum,
    {_linear(BASE["wind"], WEIGHTS["wind"])} AS wind, {_linear(BASE["rain"], WEIGHTS["rain"])} AS amount,
    greatest(0, least(1, {_linear(BASE[PROBABILITY], CHANCE)})) AS chance
  FROM features_{k})""", f"""
scored_{k} AS (
  SELECT entity, full_date, slot, {_half_even("temp", 2)} AS temp, {_half_even("hum", 2)} AS hum,
    {_half_even("wind", 2)} AS wind,
    {_half_even("CASE WHEN chance > 0.5 THEN greatest(amount, 0) ELSE 0 END", 2)} AS rain,
    {_half_even("chance * 100", 1)} AS rain_probability
  FROM raw_{k})""", f"""
stored_{k} AS (
  SELECT * REPLACE (greatest(rain, 0) AS rain) FROM scored_{k}
  WHERE temp BETWEEN 5 AND 45 AND hum BETWEEN 0 AND 100)""")


_START = (LINES, SLOTS, daily(), _DATED, _BASE_DAY, _ENTITIES)
_CHAIN = with_(*_START, *[c for k in range(1, DAYS_AHEAD + 1) for c in _day(k)])
_ASKED = "(SELECT n_name AS entity FROM nation UNION SELECT r_name FROM region)"


def _days(name: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {name}_{k}" for k in range(1, DAYS_AHEAD + 1))


_FEATURES_OUT = [c for c in feature_columns(SLOT) if c != "slot"]
_EXACT = {*_WHOLE, "years_count"}
assert {*day_history_columns(SLOT), *slot_history_columns(SLOT)} <= set(_FEATURES_OUT)

ORACLES = {
    "chained_linear": _CHAIN + f"""
SELECT entity, full_date, slot, {", ".join(r6(c) for c in (*SHORTS, "rain_probability"))} FROM ({_days("stored")})""",
    "batch_result": _CHAIN + f"""
SELECT {DAYS_AHEAD} AS forecast_days, good + bad AS total_forecasts, good AS success, bad AS errors, rows_scored, rows_rejected
FROM (
  SELECT (SELECT count(*) * {DAYS_AHEAD} FROM {_ASKED} WHERE entity IN (SELECT entity FROM entities)) AS good,
         (SELECT count(*) * {DAYS_AHEAD} FROM {_ASKED} WHERE entity NOT IN (SELECT entity FROM entities)) AS bad,
         (SELECT count(*) FROM ({_days("scored")})) AS rows_scored,
         (SELECT count(*) FROM ({_days("scored")})) - (SELECT count(*) FROM ({_days("stored")})) AS rows_rejected)""",
    "batch_result_details": _CHAIN + f"""
SELECT entity, full_date, {r6("CAST(t0 AS DOUBLE)", "temp_min")}, {r6("CAST(t1 AS DOUBLE)", "temp_max")},
       {r6("CAST(r AS DOUBLE)", "rain_total")}, rows_rejected, CAST(NULL AS VARCHAR) AS error
FROM (
  SELECT entity, full_date, {_half_even("min(temp)", 1)} AS t0, {_half_even("max(temp)", 1)} AS t1, {_half_even("sum(rain)", 2)} AS r,
         count(*) FILTER (NOT (temp BETWEEN 5 AND 45 AND hum BETWEEN 0 AND 100)) AS rows_rejected
  FROM ({_days("scored")}) GROUP BY ALL)
UNION ALL
SELECT entity, CAST(day + CAST(k AS INTEGER) AS DATE), NULL, NULL, NULL, NULL, 'unknown entity'
FROM {_ASKED}, base, range(1, {DAYS_AHEAD + 1}) r(k) WHERE entity NOT IN (SELECT entity FROM entities)""",
    "serving_features": with_(*_START, *_features(
        1, "SELECT entity, full_date, slot, temp, hum, wind, rain FROM slots")) + f"""
SELECT entity, full_date, slot, {", ".join(c if c in _EXACT else r6(c) for c in _FEATURES_OUT)} FROM features_1""",
}
