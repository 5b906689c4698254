"""How the test tables play the part of a measurement panel.

==========  =====================  ==================  =========================
binding     entity                 time                measures
==========  =====================  ==================  =========================
lines       nation of the supplier ship date, line no. quantity, price in thousands,
                                                       discount, tax
day / slot  the same, one row per (entity, day) or (entity, day, line no.)
events      event type             hour of the event   value
actual / forecast   the lines with status F / O, one row per (entity, day)
==========  =====================  ==================  =========================

The wet threshold lies off the lattice of averaged taxes, so no average can
fall on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourmart.model import Panel
from hourmart.operators.facts import merge_readings

WET = 0.0501
_FOUR = (("temp", "temp"), ("hum", "hum"), ("wind", "wind"), ("rain", "rain"))
DAY = Panel("entity", "full_date", None, _FOUR, wet_above=WET, entity_id="entity_id")
SLOT = Panel("entity", "full_date", "slot", _FOUR, wet_above=WET, entity_id="entity_id")
HOUR = Panel("entity", "full_date", "hour", (("value", "value"),), wet=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings of the supplier's nation.

    Joined from the fact outward and without hints: each side is broadcast only
    if the optimizer knows it to be small.
    """
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("entity"), F.to_date("l_shipdate").alias("full_date"),
            F.col("l_linenumber").alias("slot"), F.col("l_quantity").alias("temp"),
            (F.col("l_extendedprice") / 1000.0).alias("hum"),
            F.col("l_discount").alias("wind"), F.col("l_tax").alias("rain"), F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").alias("datetime"))
    )


def day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_readings(lines(spark, sf_dir), DAY)


def slot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_readings(lines(spark, sf_dir), SLOT)


def actual_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_readings(lines(spark, sf_dir).where("status = 'F'"), DAY)


def forecast_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_readings(lines(spark, sf_dir).where("status = 'O'"), DAY)


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines as stored forecasts, one per key; the probability is a multiple of the discount off its lattice."""
    return (
        merge_readings(lines(spark, sf_dir).where("status = 'O'"), SLOT)
        .withColumns({
            "rain_probability": F.col("wind") * 999.7,
            "predicted_at": F.col("full_date").cast("timestamp_ntz")})
    )


def actual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_readings(lines(spark, sf_dir).where("status = 'F'"), SLOT)


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("district"), F.col("ts").alias("datetime"), "value")


def hour_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = event_readings(spark, sf_dir).select(
        F.col("district").alias("entity"), F.to_date("datetime").alias("full_date"),
        F.hour("datetime").alias("hour"), "value")
    return merge_readings(readings, HOUR)


# Means of values on a decimal lattice often end in exactly half of the last
# digit kept, where the order of summation would decide. This moves them off it.
OFF_HALF = 3e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Computed doubles rounded, so that summation order does not show."""
    return df.select(*[
        (F.round(F.col(c) + OFF_HALF, digits) + F.lit(0.0)).alias(c) if t == "double"
        else F.col(c) for c, t in df.dtypes])


# --------------------------------------------------------------------------
# The same bindings in SQL.
# --------------------------------------------------------------------------
SHORTS = ("temp", "hum", "wind", "rain")
LINES = """
lines AS (
  SELECT n_name AS entity, CAST(l_shipdate AS DATE) AS full_date, l_linenumber AS slot,
         l_quantity AS temp, l_extendedprice / 1000.0::DOUBLE AS hum, l_discount AS wind,
         l_tax AS rain, l_linestatus AS status, l_shipdate AS datetime
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey)"""
_AVG = ", ".join(f"avg({s}) AS {s}" for s in SHORTS)
DAYS = f"days AS (SELECT entity, full_date, {_AVG} FROM lines GROUP BY ALL)"
SLOTS = f"slots AS (SELECT entity, full_date, slot, {_AVG} FROM lines GROUP BY ALL)"
ACTUAL = (
    f"actual AS (SELECT entity, full_date, {_AVG} FROM lines WHERE status = 'F' GROUP BY ALL)")
FORECAST = (
    f"forecast AS (SELECT entity, full_date, {_AVG} FROM lines WHERE status = 'O' GROUP BY ALL)")
FORECAST_SLOTS = f"""
forecast_slots AS (
  SELECT *, wind * 999.7 AS rain_probability, CAST(full_date AS TIMESTAMP) AS predicted_at
  FROM (SELECT entity, full_date, slot, {_AVG} FROM lines WHERE status = 'O' GROUP BY ALL))"""
ACTUAL_SLOTS = (
    f"actual_slots AS (SELECT entity, full_date, slot, {_AVG} FROM lines "
    "WHERE status = 'F' GROUP BY ALL)")
HOURS = """
hours AS (
  SELECT event_type AS entity, CAST(ts AS DATE) AS full_date,
         CAST(hour(ts) AS INTEGER) AS hour, avg(value) AS value
  FROM events GROUP BY ALL)"""
_STATS = ", ".join(
    f"avg({s}) AS {s}_mean, stddev_samp({s}) AS {s}_std, min({s}) AS {s}_min, max({s}) AS {s}_max"
    for s in SHORTS)
MONTH_DAY = "CAST(month(full_date) * 100 + day(full_date) AS INTEGER)"
YEAR = "CAST(year(full_date) AS INTEGER)"


def daily(source: str = "lines", name: str = "daily") -> str:
    return f"""{name} AS (
  SELECT entity, full_date, {YEAR} AS year, {MONTH_DAY} AS month_day,
         {_STATS}, sum(rain) AS rain_total
  FROM {source} GROUP BY entity, full_date)"""


def r6_value(expression: str) -> str:
    return f"round(({expression}) + {OFF_HALF}::DOUBLE, 6) + 0.0::DOUBLE"


def r6(expression: str, name: str | None = None) -> str:
    return f"{r6_value(expression)} AS {name or expression}"


def r6_all(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
