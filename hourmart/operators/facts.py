"""Fact loading, the star view, and one-row-per-key reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourmart.model import Panel


def load_fact(readings: DataFrame, districts: DataFrame, dates: DataFrame,
              measures: list[str]) -> DataFrame:
    """Raw readings with dimension keys in place of names and timestamps.

    Joins carry no hint: the optimizer broadcasts a dimension only when its
    known size is under the threshold, and otherwise shuffles with skew
    splitting.
    """
    day = dates.select("date_id", F.col("full_date").alias("_day"))
    return (
        readings.withColumn("_day", F.to_date("datetime"))
        .join(districts.withColumnRenamed("district_name", "district"), "district")
        .join(day, "_day")
        .select("district_id", "date_id", F.hour("datetime").cast("smallint").alias("hour_id"),
                *measures)
    )


def fact_orphans(readings: DataFrame, districts: DataFrame) -> DataFrame:
    """Readings no dimension row matches; an inner join would drop them silently."""
    return readings.join(
        districts.withColumnRenamed("district_name", "district"), "district", "left_anti")


def star_view(fact: DataFrame, districts: DataFrame, dates: DataFrame,
              hours: DataFrame) -> DataFrame:
    """Fact rows with the attributes of all three dimensions."""
    return (
        fact.join(districts, "district_id").join(dates, "date_id")
        .join(F.broadcast(hours), "hour_id")   # 24 rows
    )


def dedup_fact(df: DataFrame, panel: Panel, prefer: list[str] | None = None) -> DataFrame:
    """One whole row per key, always the same one.

    The row smallest in ``prefer`` (default: the measures) wins. Taken as an
    aggregate, not by ranking, so copies collapse on the map side and a key
    with very many copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in panel.keys]
    order = list(dict.fromkeys((prefer or panel.columns) + rest))
    kept = df.groupBy(*panel.keys).agg(F.min(F.struct(*order)).alias("_row"))
    return kept.select(*panel.keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def merge_readings(df: DataFrame, panel: Panel, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per key holding the mean of each measure.

    ``within`` names columns that follow from the key; rows that already lie together by some of
    them are not shuffled again.
    """
    return df.groupBy(*within, *panel.keys).agg(*[F.avg(c).alias(c) for c in panel.columns])
