"""Reports, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import (
    ACTUAL_SLOTS, DAY, FORECAST_SLOTS, LINES, SHORTS, SLOT, actual_slots, daily, forecast_rows,
    lines, r6, r6_all, r6_value, rounded, table, with_,
)
from hourmart.catalogue.star_queries import q_dim_district
from hourmart.functions.calendar import clock_hour, iso_date
from hourmart.functions.labels import describe, display_name
from hourmart.operators.stats import daily_stats
from hourmart.plans import reports


def q_forecast_summary(spark, d):
    return reports.forecast_summary(forecast_rows(spark, d), SLOT)


def q_dashboard_summary(spark, d):
    return reports.dashboard_summary(forecast_rows(spark, d), SLOT)


def q_day_summary(spark, d):
    return reports.day_summary(actual_slots(spark, d), SLOT)


def q_recent_actuals(spark, d):
    return reports.recent_actuals(actual_slots(spark, d), SLOT)


def q_health_numbers(spark, d):
    return reports.health(actual_slots(spark, d), forecast_rows(spark, d), SLOT)


def q_saved_index(spark, d):
    return rounded(reports.saved_index(forecast_rows(spark, d), SLOT))


def q_forecast_hours(spark, d):
    return reports.forecast_hours(forecast_rows(spark, d), SLOT)


def q_actual_hours(spark, d):
    return reports.actual_hours(actual_slots(spark, d), SLOT)


def q_hourly_document(spark, d):
    """Forecast documents opened up again: one row per entry, with the day's summary."""
    documents = reports.forecast_documents(forecast_rows(spark, d), SLOT)
    return documents.select(
        "entity", "full_date", F.posexplode("hourly").alias("position", "_hour"), "summary"
    ).select(
        "entity", "full_date", "position", "_hour.slot", "_hour.temp", "_hour.rain_probability",
        "_hour.description", F.col("summary.temp_avg").alias("temp_avg"),
        F.col("summary.rain_total").alias("rain_total"))


def q_actual_documents(spark, d):
    """Documents of measured days opened up again: one row per entry, with the day's summary."""
    documents = reports.actual_documents(actual_slots(spark, d), SLOT)
    return documents.select("entity", "full_date", F.inline("hourly"), "summary").select(
        "entity", "full_date", "slot", *SHORTS, "period_of_day",
        *[F.col(f"summary.{c}").alias(c) for c in ("temp_min", "temp_max", "temp_avg", "wind_max")])


PLACE, DAY_ASKED = "NATION_12", "1995-04-26"      # what a reader asks for


def q_entity_document(spark, d):
    """All forecast days of one place as JSON, in day order."""
    return reports.as_json(reports.entity_document(forecast_rows(spark, d), SLOT, PLACE), SLOT)


def q_entity_day_document(spark, d):
    """One place on one day as JSON."""
    return reports.as_json(reports.entity_day_document(forecast_rows(spark, d), SLOT, PLACE, DAY_ASKED), SLOT)


def q_document_json(spark, d):
    return reports.as_json(reports.forecast_documents(forecast_rows(spark, d), SLOT), SLOT)


def q_forecast_days(spark, d):
    return reports.forecast_days(forecast_rows(spark, d), SLOT)


def q_forecast_listing(spark, d):
    return rounded(reports.forecast_listing(forecast_rows(spark, d), SLOT))


def q_entity_list(spark, d):
    return reports.entity_list(q_dim_district(spark, d), DAY)


def q_top_days(spark, d):
    daily_rows = daily_stats(lines(spark, d), DAY).select("entity", "full_date", "temp_max",
                                                          "rain_total")
    return rounded(reports.top_days(rounded(daily_rows), DAY, "rain_total", 50))


def q_describe_labels(spark, d):
    """A label for every line item, measures scaled to reach each branch."""
    temp, hum = F.col("l_quantity"), F.col("l_extendedprice") / 1000.0
    wind, rain = F.col("l_discount") * 199.9, F.col("l_tax") * 99.7
    label = describe(temp, hum, wind, rain, F.col("l_discount") * 999.7)
    return table(spark, d, "lineitem").groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


def q_display_names(spark, d):
    """Names and clock texts as shown to readers."""
    hour = F.hour("ts")
    return table(spark, d, "events").groupBy(
        display_name(F.concat_ws("_", "event_type", iso_date(F.col("ts")))).alias("name"),
        clock_hour(hour).alias("clock")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "forecast_summary": q_forecast_summary,
    "dashboard_summary": q_dashboard_summary,
    "day_summary": q_day_summary,
    "recent_actuals": q_recent_actuals,
    "health_numbers": q_health_numbers,
    "saved_index": q_saved_index,
    "forecast_hours": q_forecast_hours,
    "actual_hours": q_actual_hours,
    "hourly_document": q_hourly_document,
    "actual_documents": q_actual_documents,
    "entity_document": q_entity_document,
    "entity_day_document": q_entity_day_document,
    "document_json": q_document_json,
    "forecast_days": q_forecast_days,
    "forecast_listing": q_forecast_listing,
    "entity_list": q_entity_list,
    "top_days": q_top_days,
    "describe_labels": q_describe_labels,
    "display_names": q_display_names,
}


def _up(expression: str, digits: int, name: str) -> str:
    return f"round(CAST({expression} AS DECIMAL(18,6)), {digits})::DOUBLE AS {name}"


def _even(expression: str, digits: int, name: str) -> str:
    return f"round_even(CAST({expression} AS DECIMAL(18,6)), {digits})::DOUBLE AS {name}"


def _label(temp: str, hum: str, wind: str, rain: str, prob: str) -> str:
    return f"""concat_ws(', ',
    CASE WHEN {rain} > 5 THEN 'Mua to' WHEN {rain} > 1 THEN 'Mua nhe'
         WHEN {rain} > 0.1 THEN 'Mua phun'
         WHEN {prob} > 40 THEN 'Co the mua (' || CAST(round_even({prob}, 0) AS INTEGER) || '%)'
         WHEN {temp} > 33 THEN 'Nang nong' WHEN {temp} > 28 THEN 'Nang' ELSE 'Mat me' END,
    CASE WHEN {hum} > 85 THEN 'do am cao' END,
    CASE WHEN {wind} > 15 THEN 'gio manh' WHEN {wind} > 10 THEN 'gio vua' END)"""


_SUMMARY_PARTS = [
    _even("min(temp)", 1, "temp_min"), _even("max(temp)", 1, "temp_max"),
    _even("avg(temp)", 1, "temp_avg"), _even("avg(hum)", 1, "humidity_avg"),
    _even("sum(rain)", 2, "rain_total"), _even("max(wind)", 1, "wind_max")]
_SUMMARY = ", ".join(_SUMMARY_PARTS)
_SHOWN = ", ".join(_even(s, 2 if s == "rain" else 1, s) for s in SHORTS)
_SLOT_LABEL = _label("temp", "hum", "wind", "rain", "rain_probability")
_FORECAST = with_(LINES, FORECAST_SLOTS)


def _field(text: str) -> str:
    """``expression AS name`` as a struct entry."""
    expression, name = text.rsplit(" AS ", 1)
    return f"'{name}': {expression}"


_summary_fields = ", ".join(_field(t) for t in _SUMMARY_PARTS)
_entry_fields = ", ".join(
    [_field(_even(s, 2 if s == "rain" else 1, s)) for s in SHORTS]
    + [_field(_even("rain_probability", 1, "rain_probability"))])


def _documents(where: str = "") -> str:
    return _FORECAST + f"""
SELECT entity, full_date, CAST(to_json({{
         'district': entity, 'date': strftime(full_date, '%Y-%m-%d'),
         'hourly': list({{'slot': slot, {_entry_fields},
                         'description': description}} ORDER BY slot),
         'summary': {{{_summary_fields}}}}}) AS VARCHAR) AS document
FROM (SELECT *, {_SLOT_LABEL} AS description FROM forecast_slots {where})
GROUP BY entity, full_date"""


ORACLES = {
    "forecast_summary": _FORECAST + f"""
SELECT entity, full_date, {_up("min(temp)", 1, "temp_min")}, {_up("max(temp)", 1, "temp_max")},
       {_up("avg(temp)", 1, "temp_avg")}, {_up("avg(hum)", 1, "humidity_avg")},
       {_up("sum(rain)", 2, "rain_total")}, {_up("max(wind)", 1, "wind_max")},
       {_up("avg(rain_probability)", 1, "rain_prob_avg")}
FROM forecast_slots GROUP BY entity, full_date""",
    "dashboard_summary": _FORECAST + f"""
SELECT entity, full_date, {_up("min(temp)", 1, "t_min")}, {_up("max(temp)", 1, "t_max")},
       {_up("avg(hum)", 1, "hum")}, {_up("sum(rain)", 2, "rain")}, {_up("max(wind)", 1, "wind")}
FROM forecast_slots GROUP BY entity, full_date""",
    "day_summary": with_(LINES, ACTUAL_SLOTS) + f"""
SELECT entity, full_date, {_SUMMARY} FROM actual_slots GROUP BY entity, full_date""",
    "recent_actuals": with_(LINES, ACTUAL_SLOTS) + f"""
SELECT entity, full_date, {_up("min(temp)", 1, "t_min")}, {_up("max(temp)", 1, "t_max")},
       {_up("avg(hum)", 1, "hum")}, {_up("sum(rain)", 2, "rain")}
FROM actual_slots WHERE full_date >= (SELECT max(full_date) - 2 FROM actual_slots)
GROUP BY entity, full_date ORDER BY full_date DESC, entity LIMIT 120""",
    "health_numbers": with_(LINES) + """
SELECT max(full_date) FILTER (status = 'F') AS last_actual_date,
       count(DISTINCT entity || '-' || full_date) FILTER (status = 'O') AS forecasts_in_dw
FROM lines""",
    "saved_index": _FORECAST + f"""
SELECT entity, full_date, count(*) AS hours_count, {r6("min(temp)", "temp_min")},
       {r6("max(temp)", "temp_max")}, {r6("sum(rain)", "rain_total")},
       max(predicted_at) AS predicted_at
FROM forecast_slots GROUP BY entity, full_date""",
    "forecast_hours": _FORECAST + f"""
SELECT entity, full_date, slot, {_SHOWN},
       {_even("rain_probability", 1, "rain_probability")}, {_SLOT_LABEL} AS description
FROM forecast_slots""",
    "actual_hours": with_(LINES, ACTUAL_SLOTS) + f"""
SELECT entity, full_date, slot, {_SHOWN},
       CASE WHEN slot < 6 THEN 'Night' WHEN slot < 12 THEN 'Morning'
            WHEN slot < 18 THEN 'Afternoon' ELSE 'Evening' END AS period_of_day
FROM actual_slots""",
    "hourly_document": _FORECAST + f"""
SELECT entity, full_date,
       CAST(row_number() OVER (PARTITION BY entity, full_date ORDER BY slot) - 1 AS INTEGER)
         AS position,
       slot, {_even("temp", 1, "temp")}, {_even("rain_probability", 1, "rain_probability")},
       {_SLOT_LABEL} AS description,
       {_even("avg(temp) OVER (PARTITION BY entity, full_date)", 1, "temp_avg")},
       {_even("sum(rain) OVER (PARTITION BY entity, full_date)", 2, "rain_total")}
FROM forecast_slots""",
    "actual_documents": with_(LINES, ACTUAL_SLOTS) + f"""
SELECT a.entity, a.full_date, slot, {_SHOWN},
       CASE WHEN slot < 6 THEN 'Night' WHEN slot < 12 THEN 'Morning'
            WHEN slot < 18 THEN 'Afternoon' ELSE 'Evening' END AS period_of_day,
       temp_min, temp_max, temp_avg, wind_max
FROM actual_slots a JOIN (
  SELECT entity, full_date, {", ".join(p for p in _SUMMARY_PARTS if "hum" not in p and "rain" not in p)}
  FROM actual_slots GROUP BY entity, full_date) s ON s.entity = a.entity AND s.full_date = a.full_date""",
    "document_json": _documents(),
    "entity_document": _documents(f"WHERE entity = '{PLACE}'"),
    "entity_day_document": _documents(f"WHERE entity = '{PLACE}' AND full_date = DATE '{DAY_ASKED}'"),
    "forecast_days": with_(LINES)
    + "SELECT DISTINCT full_date FROM lines WHERE status = 'O' ORDER BY full_date",
    "forecast_listing": _FORECAST + f"""
SELECT entity, full_date, slot, {r6_all(*SHORTS, "rain_probability")}, predicted_at
FROM forecast_slots ORDER BY entity, full_date, slot""",
    "entity_list": with_(LINES) + """
SELECT CAST(row_number() OVER (ORDER BY entity) AS INTEGER) AS entity_id, entity
FROM (SELECT DISTINCT entity FROM lines) ORDER BY entity""",
    "top_days": with_(LINES, daily()) + f"""
SELECT entity, full_date, {r6("temp_max")}, {r6("rain_total")}
FROM daily ORDER BY {r6_value("daily.rain_total")} DESC, entity, full_date LIMIT 50""",
    "describe_labels": f"""
SELECT {_label("l_quantity", "(l_extendedprice / 1000.0::DOUBLE)",
               "(l_discount * 199.9::DOUBLE)", "(l_tax * 99.7::DOUBLE)",
               "(l_discount * 999.7::DOUBLE)")} AS label, count(*) AS n
FROM lineitem GROUP BY label""",
    "display_names": """
SELECT replace(event_type || '_' || strftime(ts, '%Y-%m-%d'), '_', ' ') AS name,
       strftime(ts, '%H:00') AS clock, count(*) AS n
FROM events GROUP BY ALL""",
}
