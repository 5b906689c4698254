"""Reports over forecasts and actuals, for all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourmart.functions.calendar import iso_date, period_of_day
from hourmart.functions.labels import describe
from hourmart.functions.numeric import report_round, score_round
from hourmart.model import RECENT_DAYS, Panel
from hourmart.operators.stats import distinct_pairs


def _columns(panel: Panel) -> dict[str, str]:
    return dict(panel.measures)


def forecast_summary(forecast: DataFrame, panel: Panel) -> DataFrame:
    """Per entity and day: rounded ranges, means, rain total and mean wet probability."""
    c = _columns(panel)
    return forecast.groupBy(panel.entity, panel.date).agg(
        report_round(F.min(c["temp"]), 1).alias("temp_min"),
        report_round(F.max(c["temp"]), 1).alias("temp_max"),
        report_round(F.avg(c["temp"]), 1).alias("temp_avg"),
        report_round(F.avg(c["hum"]), 1).alias("humidity_avg"),
        report_round(F.sum(c["rain"]), 2).alias("rain_total"),
        report_round(F.max(c["wind"]), 1).alias("wind_max"),
        F.coalesce(report_round(F.avg("rain_probability"), 1), F.lit(0.0)).alias("rain_prob_avg"))


def dashboard_summary(forecast: DataFrame, panel: Panel) -> DataFrame:
    """The columns of the forecast summary that the overview shows."""
    return forecast_summary(forecast, panel).select(
        panel.entity, panel.date, F.col("temp_min").alias("t_min"),
        F.col("temp_max").alias("t_max"), F.col("humidity_avg").alias("hum"),
        F.col("rain_total").alias("rain"), F.col("wind_max").alias("wind"))


def day_summary(rows: DataFrame, panel: Panel) -> DataFrame:
    """Per entity and day, rounded half to even as documents are."""
    return rows.groupBy(panel.entity, panel.date).agg(*_summary(panel))


def _summary(panel: Panel) -> list[Column]:
    c = _columns(panel)
    return [
        score_round(F.min(c["temp"]), 1).alias("temp_min"),
        score_round(F.max(c["temp"]), 1).alias("temp_max"),
        score_round(F.avg(c["temp"]), 1).alias("temp_avg"),
        score_round(F.avg(c["hum"]), 1).alias("humidity_avg"),
        score_round(F.sum(c["rain"]), 2).alias("rain_total"),
        score_round(F.max(c["wind"]), 1).alias("wind_max"),
    ]


def _rounded(panel: Panel) -> dict[str, Column]:
    return {c: score_round(F.col(c), 2 if s == panel.wet else 1) for s, c in panel.measures}


def _forecast_shown(panel: Panel) -> dict[str, Column]:
    c = _columns(panel)
    chance = F.coalesce("rain_probability", F.lit(0.0))
    label = describe(*[F.col(c[s]) for s in ("temp", "hum", "wind", "rain")], chance)
    return {
        **_rounded(panel), "rain_probability": score_round(chance, 1), "description": label}


def _actual_shown(panel: Panel) -> dict[str, Column]:
    return {**_rounded(panel), "period_of_day": period_of_day(F.col(panel.slot))}


def forecast_hours(forecast: DataFrame, panel: Panel) -> DataFrame:
    """Forecast rows as shown: rounded values, probability 0 if unknown, and a label."""
    return forecast.select(
        *panel.keys, *[v.alias(n) for n, v in _forecast_shown(panel).items()])


def actual_hours(actual: DataFrame, panel: Panel) -> DataFrame:
    """Measured rows as shown: rounded values and the period of day."""
    return actual.select(
        *panel.keys, *[v.alias(n) for n, v in _actual_shown(panel).items()])


def _day_documents(rows: DataFrame, shown: dict[str, Column], panel: Panel) -> DataFrame:
    """One row per entity and day: its slots in order, and the summary, in one pass.

    Rows are unique by key, so a document holds at most one entry per slot.
    """
    entry = F.struct(panel.slot, *[v.alias(n) for n, v in shown.items()])
    days = rows.withColumn("_entry", entry).groupBy(panel.entity, panel.date).agg(
        F.array_sort(F.collect_list("_entry")).alias("hourly"), *_summary(panel))
    parts = [c for c in days.columns if c not in (panel.entity, panel.date, "hourly")]
    return days.select(panel.entity, panel.date, "hourly", F.struct(*parts).alias("summary"))


def forecast_documents(forecast: DataFrame, panel: Panel) -> DataFrame:
    """(entity, day, hourly array, summary) for every forecast day."""
    return _day_documents(forecast, _forecast_shown(panel), panel)


def actual_documents(actual: DataFrame, panel: Panel) -> DataFrame:
    """(entity, day, hourly array, summary) for every measured day."""
    return _day_documents(actual, _actual_shown(panel), panel)


def entity_document(forecast: DataFrame, panel: Panel, name: str) -> DataFrame:
    """All forecast days of one entity, in day order; empty if there is none."""
    return forecast_documents(
        forecast.where(F.col(panel.entity) == name), panel).orderBy(panel.date)


def entity_day_document(rows: DataFrame, panel: Panel, name: str, day, actual: bool = False
                        ) -> DataFrame:
    """One entity on one day; both filters reach the scan."""
    found = rows.where(
        (F.col(panel.entity) == name) & (F.col(panel.date) == F.lit(day).cast("date")))
    return (actual_documents if actual else forecast_documents)(found, panel)


def as_json(documents: DataFrame, panel: Panel) -> DataFrame:
    """Documents as one JSON text per entity and day, as they are sent."""
    body = F.struct(
        F.col(panel.entity).alias("district"), iso_date(F.col(panel.date)).alias("date"),
        "hourly", "summary")
    return documents.select(panel.entity, panel.date, F.to_json(body).alias("document"))


def entity_list(districts: DataFrame, panel: Panel) -> DataFrame:
    return districts.select(panel.entity_id, panel.entity).orderBy(panel.entity)


def forecast_days(forecast: DataFrame, panel: Panel) -> DataFrame:
    """Days that have a forecast, in order."""
    return forecast.select(panel.date).distinct().orderBy(panel.date)


def forecast_listing(forecast: DataFrame, panel: Panel) -> DataFrame:
    """Every forecast row in reading order."""
    return forecast.orderBy(panel.entity, panel.date, *([panel.slot] if panel.slot else []))


def recent_actuals(actual: DataFrame, panel: Panel, days: int = RECENT_DAYS,
                   limit: int | None = None) -> DataFrame:
    """Daily summary of the last days that have measurements, newest first; all rows unless a limit is named."""
    c = _columns(panel)
    newest = actual.agg(F.date_sub(F.max(panel.date), days)).scalar()
    daily = (
        actual.where(F.col(panel.date) >= newest)
        .groupBy(panel.entity, panel.date)
        .agg(
            report_round(F.min(c["temp"]), 1).alias("t_min"),
            report_round(F.max(c["temp"]), 1).alias("t_max"),
            report_round(F.avg(c["hum"]), 1).alias("hum"),
            report_round(F.sum(c["rain"]), 2).alias("rain"))
        .orderBy(F.desc(panel.date), panel.entity)
    )
    return daily if limit is None else daily.limit(limit)


def top_days(daily: DataFrame, panel: Panel, by: str, n: int) -> DataFrame:
    """The n greatest days by a statistic, ties in key order."""
    return daily.orderBy(F.desc(by), panel.entity, panel.date).limit(n)


def health(actual: DataFrame, forecast: DataFrame, panel: Panel) -> DataFrame:
    """Last measured day and the number of forecast (entity, day) pairs."""
    pairs = distinct_pairs(forecast, panel.entity, panel.date).select("pairs").scalar()
    return actual.agg(F.max(panel.date).alias("last_actual_date")).withColumn(
        "forecasts_in_dw", pairs)


def saved_index(forecast: DataFrame, panel: Panel) -> DataFrame:
    """What is stored per entity and day, and when it was predicted."""
    c = _columns(panel)
    return forecast.groupBy(panel.entity, panel.date).agg(
        F.count(F.lit(1)).alias("hours_count"),
        F.min(c["temp"]).alias("temp_min"), F.max(c["temp"]).alias("temp_max"),
        F.sum(c["rain"]).alias("rain_total"), F.max("predicted_at").alias("predicted_at"))
