"""Histories, lags, rolling features, training tables and training statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import (
    DAY, DAYS, HOUR, HOURS, LINES, MONTH_DAY, SHORTS, SLOT, SLOTS, WET, YEAR, daily, day_rows,
    hour_rows, lines, r6, r6_all, rounded, slot_rows, with_,
)
from hourmart.functions.numeric import wet_flag
from hourmart.model import (
    LAG_DAYS, day_history_columns, feature_columns, flag_columns, lag_columns, rolling_columns,
    slot_history_columns,
)
from hourmart.operators.facts import merge_readings
from hourmart.operators.history import (
    CALENDAR_DAY, by_calendar_day, same_day_history, same_slot_history,
)
from hourmart.operators.lags import (
    calendar_lags, calendar_lags_join, rolling_by_frames, with_flags, with_rolling,
)
from hourmart.operators.stats import (
    class_balance, classification_metrics, daily_stats, error_metrics, split_date, wet_share,
    year_bounds,
)
from hourmart.operators.dims import dim_entity
from hourmart.plans.features import model_rows, training_table
from hourmart.plans.training import sample_weights
from hourmart.session import written


def _daily(spark, d):
    return daily_stats(lines(spark, d), DAY)


def q_hist_same_day(spark, d):
    return rounded(same_day_history(_daily(spark, d), DAY))


def q_hist_same_day_slot(spark, d):
    return rounded(same_slot_history(slot_rows(spark, d), SLOT))


def q_calendar_lags(spark, d):
    return rounded(calendar_lags(day_rows(spark, d), DAY))


def q_calendar_lags_join(spark, d):
    return rounded(calendar_lags_join(day_rows(spark, d), DAY))


def q_hourly_lags(spark, d):
    return rounded(calendar_lags(hour_rows(spark, d), HOUR))


def q_rolling_features(spark, d):
    rows = with_rolling(with_flags(calendar_lags(day_rows(spark, d), DAY), DAY), DAY)
    return rounded(rows.select(*DAY.keys, *flag_columns(DAY), *rolling_columns(DAY)))


def q_rolling_frames(spark, d):
    rows = rolling_by_frames(day_rows(spark, d), DAY)
    return rounded(rows.select(*DAY.keys, *rolling_columns(DAY)))


def _training(spark, d):
    rows = by_calendar_day(lines(spark, d), SLOT)
    return training_table(
        merge_readings(rows, SLOT, CALENDAR_DAY), daily_stats(rows, SLOT, CALENDAR_DAY), SLOT)


def q_training_table(spark, d):
    whole = ("year", "month", "day", "day_of_year", "day_of_week", "month_day")
    table = _training(spark, d)
    return rounded(table.withColumns({c: F.col(c).cast("int") for c in whole}))


_COMPLETE = ["years_count", "hist_h_temp_std", "lag_1d_temp", "lag_3d_rain"]


def q_complete_rows(spark, d):
    """Training rows in which none of a set of history and lag columns is missing."""
    rows = _training(spark, d).dropna(subset=_COMPLETE)
    return rounded(rows.select(*SLOT.keys, *_COMPLETE))


def q_model_rows(spark, d):
    """What the models learn from: all inputs and targets, only rows in which nothing is missing."""
    rows = by_calendar_day(lines(spark, d), DAY)
    actual = merge_readings(rows, DAY, CALENDAR_DAY)
    entities = written(dim_entity(rows, "entity", "entity_id"), "entities")
    table = training_table(actual.join(entities, "entity"), daily_stats(rows, DAY, CALENDAR_DAY), DAY)
    found = model_rows(table, DAY).select(*dict.fromkeys(
        ["entity", "full_date", *feature_columns(DAY), *SHORTS]))
    whole = ("month", "day", "day_of_year", "day_of_week")
    return rounded(found.withColumns({c: F.col(c).cast("int") for c in whole}))


def q_time_split_counts(spark, d):
    rows = written(day_rows(spark, d), "days")     # read once for the split and once for the counts
    at = split_date(rows, "full_date").scalar()
    earlier, later = (
        F.count_if(F.col("full_date") <= at), F.count_if(F.col("full_date") > at))
    return rows.agg(
        at.alias("split_date"), earlier.alias("train_rows"), later.alias("test_rows"))


def q_sample_weights(spark, d):
    rows = written(day_rows(spark, d), "days").withColumn("year", F.year("full_date"))
    return rounded(sample_weights(rows).select("entity", "full_date", "weight"))


def q_class_balance(spark, d):
    return rounded(class_balance(day_rows(spark, d), F.col("rain") > WET))


def q_year_bounds(spark, d):
    return year_bounds(day_rows(spark, d).withColumn("year", F.year("full_date")))


def q_wet_share(spark, d):
    rows = lines(spark, d).groupBy("entity", "full_date").agg(
        wet_share(F.col("rain"), WET).alias("wet_share"))
    return rounded(rows)


def _naive(spark, d):
    """Each day predicted by the day before."""
    lagged = calendar_lags(day_rows(spark, d), DAY, horizon=1)
    return lagged.withColumnsRenamed({f"lag_1d_{s}": f"{s}_pred" for s in SHORTS})


def q_metric_table(spark, d):
    return rounded(error_metrics(_naive(spark, d), DAY))


def q_wet_metrics(spark, d):
    rows = _naive(spark, d).where("rain_pred IS NOT NULL").select(
        "entity", wet_flag(F.col("rain"), WET).alias("a"),
        wet_flag(F.col("rain_pred"), WET).alias("p"))
    return rounded(classification_metrics(rows, "a", "p", "entity"))


QUERIES = {
    "hist_same_day": q_hist_same_day,
    "hist_same_day_slot": q_hist_same_day_slot,
    "calendar_lags": q_calendar_lags,
    "calendar_lags_join": q_calendar_lags_join,
    "hourly_lags": q_hourly_lags,
    "rolling_features": q_rolling_features,
    "rolling_frames": q_rolling_frames,
    "training_table": q_training_table,
    "complete_rows": q_complete_rows,
    "model_rows": q_model_rows,
    "time_split_counts": q_time_split_counts,
    "sample_weights": q_sample_weights,
    "class_balance": q_class_balance,
    "year_bounds": q_year_bounds,
    "wet_share": q_wet_share,
    "metric_table": q_metric_table,
    "wet_metrics": q_wet_metrics,
}

# --------------------------------------------------------------------------
_HIST = ", ".join(
    f"avg(p.{s}_mean) AS hist_{s}_mean, avg(p.{s}_std) AS hist_{s}_std, "
    f"min(p.{s}_min) AS hist_{s}_min, max(p.{s}_max) AS hist_{s}_max" for s in SHORTS)
DAY_HISTORY = f"""
day_history AS (
  SELECT c.entity, c.year, c.month_day, {_HIST}, count(DISTINCT p.year) AS years_count
  FROM daily c JOIN daily p ON p.entity = c.entity AND p.month_day = c.month_day
                           AND p.year < c.year
  GROUP BY c.entity, c.year, c.month_day)"""
SLOT_STATS = ", ".join(
    [f"avg(p.{s}) AS hist_h_{s}_mean, stddev_samp(p.{s}) AS hist_h_{s}_std"
     for s in SHORTS if s != "rain"]
    + ["avg(p.rain) AS hist_h_rain_mean, max(p.rain) AS hist_h_rain_max, "
       f"avg(CASE WHEN p.rain > {WET} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hist_h_rain_prob"])
DATED_SLOTS = (
    f"dated AS (SELECT *, {YEAR} AS year, {MONTH_DAY} AS month_day FROM slots)")
SLOT_HISTORY = f"""
slot_history AS (
  SELECT c.entity, c.year, c.month_day, c.slot, {SLOT_STATS},
         count(DISTINCT p.year) AS years_count
  FROM dated c JOIN dated p ON p.entity = c.entity AND p.slot = c.slot
                           AND p.month_day = c.month_day AND p.year < c.year
  GROUP BY c.entity, c.year, c.month_day, c.slot)"""


def lag_joins(source: str, shorts: tuple[str, ...], slot: str | None = None, lags=LAG_DAYS,
              base: str = "f") -> tuple[str, str]:
    """Select list and left joins that give calendar lags 1..n of a table."""
    columns, joins = [], []
    for n in range(1, lags + 1):
        columns += [f"l{n}.{s} AS lag_{n}d_{s}" for s in shorts]
        same_slot = f" AND l{n}.{slot} = {base}.{slot}" if slot else ""
        joins.append(
            f"LEFT JOIN {source} l{n} ON l{n}.entity = {base}.entity{same_slot} "
            f"AND l{n}.full_date = {base}.full_date - {n}")
    return ", ".join(columns), "\n".join(joins)


def _lagged(source: str, shorts=SHORTS, slot=None, lags=LAG_DAYS) -> str:
    columns, joins = lag_joins(source, shorts, slot, lags)
    return f"lagged AS (SELECT f.*, {columns} FROM {source} f {joins})"


def _flag(n: int) -> str:
    return f"CASE WHEN lag_{n}d_rain > {WET} THEN 1 ELSE 0 END"


def _rolling_select() -> str:
    parts = []
    for s in SHORTS:
        near = "[" + ", ".join(f"lag_{n}d_{s}" for n in range(1, 4)) + "]"
        far = "[" + ", ".join(f"lag_{n}d_{s}" for n in range(1, 8)) + "]"
        parts += [
            r6(f"list_avg({near})", f"rolling_3d_{s}_mean"),
            r6(f"list_avg({far})", f"rolling_7d_{s}_mean"),
            r6(f"list_stddev_samp({near})", f"rolling_3d_{s}_std"),
            r6(f"lag_1d_{s} - lag_3d_{s}", f"trend_3d_{s}"),
        ]
    counted = " + ".join(_flag(n) for n in (1, 2, 3))
    return ",\n       ".join(parts) + f",\n       CAST({counted} AS INTEGER) AS recent_rain_count"


_FLAGS = ", ".join(f"CAST({_flag(n)} AS INTEGER) AS lag_{n}d_is_rainy" for n in (1, 2, 3))
_HIST_OUT = [c for c in day_history_columns(DAY) if c != "years_count"]
_SLOT_OUT = slot_history_columns(SLOT)
_HIST_SQL = with_(LINES, daily(), DAY_HISTORY) + f"""
SELECT entity, year, month_day, {r6_all(*_HIST_OUT)}, years_count FROM day_history"""
_SLOT_SQL = with_(LINES, SLOTS, DATED_SLOTS, SLOT_HISTORY) + f"""
SELECT entity, year, month_day, slot, {r6_all(*_SLOT_OUT)}, years_count FROM slot_history"""
_LAG_SQL = with_(LINES, DAYS, _lagged("days")) + f"""
SELECT entity, full_date, {r6_all(*SHORTS, *lag_columns(DAY))} FROM lagged"""
_slot_lags, _slot_joins = lag_joins("dated", SHORTS, "slot")
TRAINING_WIDE = f"""
wide AS (
  SELECT f.*, {", ".join("h." + c for c in day_history_columns(DAY))},
         {", ".join("hh." + c for c in _SLOT_OUT)}, {_slot_lags}
  FROM dated f
  LEFT JOIN day_history h ON h.entity = f.entity AND h.year = f.year
                         AND h.month_day = f.month_day
  LEFT JOIN slot_history hh ON hh.entity = f.entity AND hh.year = f.year
                           AND hh.month_day = f.month_day AND hh.slot = f.slot
  {_slot_joins})"""
_TRAINING = with_(LINES, SLOTS, daily(), DAY_HISTORY, DATED_SLOTS, SLOT_HISTORY, TRAINING_WIDE)


def _cycle(value: str, period: str, name: str) -> str:
    angle = f"2 * pi() * {value} / {period}::DOUBLE"
    return f"{r6(f'sin({angle})', f'{name}_sin')}, {r6(f'cos({angle})', f'{name}_cos')}"


def _rolling_plain() -> str:
    return ", ".join(
        f"list_avg([{near}]) AS rolling_3d_{s}_mean, list_avg([{far}]) AS rolling_7d_{s}_mean, "
        f"list_stddev_samp([{near}]) AS rolling_3d_{s}_std, lag_1d_{s} - lag_3d_{s} AS trend_3d_{s}"
        for s in SHORTS
        for near, far in [(", ".join(f"lag_{n}d_{s}" for n in range(1, 4)), ", ".join(f"lag_{n}d_{s}" for n in range(1, 8)))])


_MODEL_WHOLE = {"entity_id": "entity_id", "years_count": "years_count", "month": "CAST(month(full_date) AS INTEGER)",
                "day": "CAST(day(full_date) AS INTEGER)", "day_of_year": "CAST(dayofyear(full_date) AS INTEGER)",
                "day_of_week": "CAST(isodow(full_date) AS INTEGER)",
                "recent_rain_count": "CAST(" + " + ".join(_flag(n) for n in (1, 2, 3)) + " AS INTEGER)",
                **{f"lag_{n}d_is_rainy": f"CAST({_flag(n)} AS INTEGER)" for n in (1, 2, 3)}}
_MODEL_CYCLES = {
    f"{name}_{f}": f"{f}(2 * pi() * {value}(full_date) / {period}::DOUBLE)"
    for name, value, period in (("doy", "dayofyear", 365.25), ("month", "month", 12.0)) for f in ("sin", "cos")}
_day_lags, _day_joins = lag_joins("days", SHORTS)
_REQUIRED = [c for c in feature_columns(DAY) if c in {*lag_columns(DAY), *day_history_columns(DAY)}]
MODEL_ROWS = with_(LINES, DAYS, daily(), DAY_HISTORY, """
entities AS (
  SELECT entity, CAST(row_number() OVER (ORDER BY entity) AS INTEGER) AS entity_id
  FROM (SELECT DISTINCT entity FROM lines))""", f"""
wide AS (
  SELECT f.*, entity_id, {", ".join("h." + c for c in day_history_columns(DAY))}, {_day_lags}
  FROM days f JOIN entities e ON e.entity = f.entity
  LEFT JOIN day_history h ON h.entity = f.entity AND h.year = year(f.full_date)
                         AND h.month_day = month(f.full_date) * 100 + day(f.full_date)
  {_day_joins})""", f"""
rolled AS (SELECT *, {_rolling_plain()} FROM wide)""") + f"""
SELECT entity, full_date, {", ".join(
    f"{_MODEL_WHOLE[c]} AS {c}" if c in _MODEL_WHOLE else r6(_MODEL_CYCLES.get(c, c), c) for c in feature_columns(DAY))},
  {r6_all(*SHORTS)}
FROM rolled WHERE {" AND ".join(f"{c} IS NOT NULL" for c in (*_REQUIRED, *SHORTS))}"""


ORACLES = {
    "model_rows": MODEL_ROWS,
    "hist_same_day": _HIST_SQL,
    "hist_same_day_slot": _SLOT_SQL,
    "calendar_lags": _LAG_SQL,
    "calendar_lags_join": _LAG_SQL,
    "hourly_lags": with_(HOURS, _lagged("hours", ("value",), "hour")) + f"""
SELECT entity, full_date, hour, {r6_all("value", *lag_columns(HOUR))} FROM lagged""",
    "rolling_features": with_(LINES, DAYS, _lagged("days")) + f"""
SELECT entity, full_date, {_FLAGS},
       {_rolling_select()} FROM lagged""",
    "rolling_frames": with_(LINES, DAYS, _lagged("days")) + f"""
SELECT entity, full_date,
       {_rolling_select()} FROM lagged""",
    "training_table": _TRAINING + f"""
SELECT entity, full_date, slot, year, CAST(month(full_date) AS INTEGER) AS month,
       CAST(day(full_date) AS INTEGER) AS day,
       CAST(dayofyear(full_date) AS INTEGER) AS day_of_year,
       CAST(isodow(full_date) AS INTEGER) AS day_of_week,
       isodow(full_date) IN (6, 7) AS is_weekend, month_day,
       {_cycle("slot", "24.0", "hour")}, {_cycle("dayofyear(full_date)", "365.25", "doy")},
       {_cycle("month(full_date)", "12.0", "month")},
       {r6_all(*_HIST_OUT)}, years_count, {r6_all(*_SLOT_OUT)},
       {r6_all(*lag_columns(SLOT))}, {_FLAGS}, {r6_all(*SHORTS)},
       CAST(CASE WHEN rain > {WET} THEN 1 ELSE 0 END AS INTEGER) AS is_rainy
FROM wide""",
    "complete_rows": _TRAINING + f"""
SELECT entity, full_date, slot, years_count,
       {r6_all("hist_h_temp_std", "lag_1d_temp", "lag_3d_rain")}
FROM wide WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _COMPLETE)}""",
    "time_split_counts": with_(LINES, DAYS, """
split AS (
  SELECT DATE '1970-01-01' + CAST(floor(quantile_cont(
           CAST(full_date - DATE '1970-01-01' AS DOUBLE), 0.85) + 0.5) AS INTEGER) AS split_date
  FROM days)""") + """
SELECT split_date, count(*) FILTER (full_date <= split_date) AS train_rows,
       count(*) FILTER (full_date > split_date) AS test_rows
FROM days, split GROUP BY split_date""",
    "sample_weights": with_(LINES, DAYS) + f"""
SELECT entity, full_date, {r6('''1.0::DOUBLE + 2.0::DOUBLE
  * (year(full_date) - min(year(full_date)) OVER ())
  / (max(year(full_date)) OVER () - min(year(full_date)) OVER ())''', "weight")} FROM days""",
    "class_balance": with_(LINES, DAYS) + f"""
SELECT n_pos, n_neg, {r6("n_neg::DOUBLE / greatest(n_pos, 1)", "scale_pos")},
       {r6("n_pos::DOUBLE / (n_pos + n_neg)", "wet_ratio")}
FROM (SELECT count(*) FILTER (rain > {WET}) AS n_pos,
             count(*) FILTER (NOT rain > {WET}) AS n_neg FROM days)""",
    "year_bounds": with_(LINES) + f"""
SELECT min({YEAR}) AS min_year, max({YEAR}) AS max_year FROM lines""",
    "wet_share": with_(LINES) + f"""
SELECT entity, full_date,
       {r6(f"avg(CASE WHEN rain > {WET} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "wet_share")}
FROM lines GROUP BY entity, full_date""",
    "metric_table": with_(LINES, DAYS, _lagged("days", lags=1)) + " UNION ALL ".join(f"""
SELECT '{s}' AS target, count(*) AS n, {r6(f"avg(abs({s} - lag_1d_{s}))", "mae")},
       {r6(f"sqrt(avg(({s} - lag_1d_{s}) ** 2))", "rmse")},
       {r6(f"1 - sum(({s} - lag_1d_{s}) ** 2) / (var_pop({s}) * count(*))", "r2")}
FROM lagged WHERE lag_1d_{s} IS NOT NULL""" for s in SHORTS),
    "wet_metrics": with_(LINES, DAYS, _lagged("days", lags=1), f"""
flags AS (SELECT entity, CASE WHEN rain > {WET} THEN 1 ELSE 0 END AS a,
                 CASE WHEN lag_1d_rain > {WET} THEN 1 ELSE 0 END AS p
          FROM lagged WHERE lag_1d_rain IS NOT NULL)""") + f"""
SELECT entity, {r6("avg(CASE WHEN a = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "accuracy")},
       {r6('''coalesce(2.0::DOUBLE * sum(a * p)
       / nullif(2.0::DOUBLE * sum(a * p) + sum(a * (1 - p)) + sum((1 - a) * p), 0), 0)''', "f1")}
FROM flags GROUP BY entity""",
}
