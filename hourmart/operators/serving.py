"""Target spines, actual-over-forecast fallback and coverage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourmart.model import Panel


def _as_date(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def day_spine(entities: DataFrame, start, end, panel: Panel) -> DataFrame:
    """Every entity on every day from start to end, generated row by row."""
    days = F.sequence(_as_date(start), _as_date(end))
    return entities.withColumn(panel.date, F.explode(days))


def slot_spine(entities: DataFrame, start, end, panel: Panel, slots: int = 24) -> DataFrame:
    """Every entity, day and slot from start to end."""
    hours = F.sequence(F.lit(0), F.lit(slots - 1))
    return day_spine(entities, start, end, panel).withColumn(panel.slot, F.explode(hours))


def tagged_sources(actual: DataFrame, forecast: DataFrame, panel: Panel) -> DataFrame:
    """Both sources stacked, each row naming where it came from."""
    columns = [*panel.keys, *panel.columns]
    return (
        actual.select(*columns).withColumn("source", F.lit("actual"))
        .unionByName(forecast.select(*columns).withColumn("source", F.lit("forecast")))
    )


def prefer_actual(actual: DataFrame, forecast: DataFrame, panel: Panel) -> DataFrame:
    """Per key the actual row if there is one, else the forecast row, whole.

    A conditional aggregate instead of a ranking: it combines on the map side
    and needs no sort. Each source has one row per key.
    """
    both = tagged_sources(actual, forecast, panel)
    is_actual = F.col("source") == "actual"
    picked = both.groupBy(*panel.keys).agg(
        F.max(is_actual).alias("_has_actual"),
        *[F.max(F.when(is_actual, F.col(c))).alias(f"_a_{c}") for c in panel.columns],
        *[F.max(F.when(~is_actual, F.col(c))).alias(f"_f_{c}") for c in panel.columns])
    has = F.col("_has_actual")
    return picked.select(
        *panel.keys,
        *[F.when(has, F.col(f"_a_{c}")).otherwise(F.col(f"_f_{c}")).alias(c)
          for c in panel.columns],
        F.when(has, "actual").otherwise("forecast").alias("source"))


def prefer_actual_tagged(readings: DataFrame, panel: Panel, is_actual: Column) -> DataFrame:
    """The same from one table that holds the raw readings of both sources: one scan, one shuffle.

    Measures are averaged per key and source. ``has_forecast`` says whether the forecast has the key.
    """
    picked = readings.withColumn("_is_actual", is_actual).groupBy(*panel.keys).agg(
        F.max("_is_actual").alias("_has_actual"), F.max(~F.col("_is_actual")).alias("has_forecast"),
        *[F.avg(F.when(F.col("_is_actual"), F.col(c))).alias(f"_a_{c}") for c in panel.columns],
        *[F.avg(F.when(~F.col("_is_actual"), F.col(c))).alias(f"_f_{c}") for c in panel.columns])
    has = F.col("_has_actual")
    return picked.select(
        *panel.keys,
        *[F.when(has, F.col(f"_a_{c}")).otherwise(F.col(f"_f_{c}")).alias(c) for c in panel.columns],
        F.when(has, "actual").otherwise("forecast").alias("source"), "has_forecast")


def prefer_actual_ranked(actual: DataFrame, forecast: DataFrame, panel: Panel) -> DataFrame:
    """The same result by ranking the stacked rows of each key by source."""
    order = F.when(F.col("source") == "actual", 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(*panel.keys).orderBy(order))
    return (
        tagged_sources(actual, forecast, panel)
        .withColumn("_rn", rank).where("_rn = 1").drop("_rn")
    )


def coverage_gaps(entities: DataFrame, forecast: DataFrame, start, end, panel: Panel) -> DataFrame:
    """(entity, day) pairs in the range that have no forecast."""
    wanted = day_spine(entities.select(panel.entity).distinct(), start, end, panel)
    have = forecast.select(panel.entity, panel.date).distinct()
    return wanted.join(have, [panel.entity, panel.date], "left_anti")


def coverage_by_day(entities: DataFrame, forecast: DataFrame, start, end, panel: Panel
                    ) -> DataFrame:
    """Per day in the range: distinct entities forecast, expected, and whether some lack."""
    wanted = day_spine(entities.select(panel.entity).distinct(), start, end, panel)
    have = (
        forecast.select(panel.entity, panel.date).distinct().withColumn("_have", F.lit(1)))
    counted = (
        wanted.join(have, [panel.entity, panel.date], "left")
        .groupBy(panel.date)
        .agg(F.count("_have").alias("covered"), F.count(F.lit(1)).alias("expected"))
    )
    return counted.withColumn("missing", F.col("covered") < F.col("expected"))


def days_present(days: DataFrame, fact: DataFrame, on: str) -> DataFrame:
    """Dimension days that occur in the fact."""
    return days.join(fact.select(on).distinct(), on, "left_semi")


def last_date(fact: DataFrame, date: str, fallback) -> DataFrame:
    """The latest day, or ``fallback`` for an empty fact."""
    return fact.agg(F.coalesce(F.max(date), _as_date(fallback)).alias("last_date"))


def backfill_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns`` in that order; those that are missing come as NULL."""
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])
