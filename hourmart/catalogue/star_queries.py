"""Dimensions, fact loading and plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import (
    DAY, HOUR, LINES, MONTH_DAY, SHORTS, SLOTS, daily, event_readings, hour_rows,
    lines, r6, r6_all, rounded, slot_rows, table, with_,
)
from hourmart.functions.calendar import with_cyclic
from hourmart.model import GAUGES, Panel
from hourmart.operators.dims import dim_date, dim_entity, dim_hour, ensure_dates, lookup_key
from hourmart.operators.facts import dedup_fact, fact_orphans, load_fact, star_view
from hourmart.operators.stats import daily_stats, row_counts
from hourmart.session import written

_RENAMED = dict(zip(SHORTS, GAUGES.columns, strict=True))


def _raw(spark, d):
    """Lines under the column names of the raw readings table."""
    named = lines(spark, d).withColumnRenamed("entity", "district")
    return named.withColumnsRenamed(_RENAMED).select("district", "datetime", *GAUGES.columns)


def _districts(readings):
    return written(
        dim_entity(readings.withColumnRenamed("district", "district_name"), "district_name"))


def q_dim_district(spark, d):
    return dim_entity(lines(spark, d), "entity", "entity_id")


def q_dim_date(spark, d):
    return dim_date(lines(spark, d), "datetime")


def q_dim_hour(spark, d):
    """Event counts on the hour dimension."""
    per_hour = (
        hour_rows(spark, d).groupBy("hour")
        .agg(F.count(F.lit(1)).alias("slots"), F.count_distinct("full_date").alias("days")))
    return dim_hour(spark).join(per_hour, "hour", "left").select(
        F.col("hour_id").cast("int"), F.col("hour").cast("int"), "period_of_day", "slots", "days")


def q_ensure_dates(spark, d):
    """The ship-date dimension extended by the order dates it lacks."""
    dim = written(dim_date(lines(spark, d), "datetime"))
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("full_date"))
    return ensure_dates(dim, orders).select("date_id", "full_date", "month_day", "is_weekend")


def q_lookup_key(spark, d):
    """Region and nation names asked for as entities: how many rows match or miss."""
    dim = _districts(_raw(spark, d))
    names = (
        table(spark, d, "nation").select(F.col("n_name").alias("district_name"))
        .unionByName(table(spark, d, "region").select(F.col("r_name").alias("district_name"))))
    found, missed = lookup_key(names, dim, "district_name")
    return found.select("district_name", "district_id").unionByName(
        missed.withColumn("district_id", F.lit(None).cast("int")))


def q_fact_load(spark, d):
    raw = _raw(spark, d)
    return load_fact(
        raw, _districts(raw), written(dim_date(raw, "datetime")), GAUGES.columns)


def q_fact_orphans(spark, d):
    """Orders no line item belongs to."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("district"), F.col("o_orderdate").alias("datetime"))
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("district_name"))
    return fact_orphans(orders, known.distinct()).withColumnRenamed("district", "o_orderkey")


def q_star_view(spark, d):
    """Events loaded as a fact and read back through all three dimensions."""
    readings = event_readings(spark, d)
    districts = _districts(readings)
    dates = written(dim_date(readings, "datetime"))
    fact = load_fact(readings, districts, dates, ["value"])
    return star_view(fact, districts, dates, dim_hour(spark)).select(
        "district_id", "district_name", "full_date", F.col("hour").cast("int").alias("hour"),
        "period_of_day", F.col("week_of_year").cast("int").alias("week_of_year"), "value")


def q_dedup_fact(spark, d):
    """Repeated (order, line number) pairs reduced to their smallest row."""
    panel = Panel("l_orderkey", "l_linenumber", None, (
        ("temp", "l_quantity"), ("hum", "l_extendedprice"), ("wind", "l_discount"),
        ("rain", "l_tax")))
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_suppkey")
    return dedup_fact(rows, panel)


def q_merge_readings(spark, d):
    return rounded(slot_rows(spark, d))


def q_daily_stats(spark, d):
    return rounded(daily_stats(lines(spark, d), DAY))


def q_cyclic_features(spark, d):
    return rounded(with_cyclic(hour_rows(spark, d), HOUR).drop("value"))


def q_warehouse_counts(spark, d):
    rows = lines(spark, d)
    return row_counts({
        "actual": rows.where("status = 'F'"), "forecast": rows.where("status = 'O'"),
        "districts": rows.select("entity").distinct(),
        "dates": rows.select("full_date").distinct()})


QUERIES = {
    "dim_district": q_dim_district,
    "dim_date": q_dim_date,
    "dim_hour": q_dim_hour,
    "ensure_dates": q_ensure_dates,
    "lookup_key": q_lookup_key,
    "fact_load": q_fact_load,
    "fact_orphans": q_fact_orphans,
    "star_view": q_star_view,
    "dedup_fact": q_dedup_fact,
    "merge_readings": q_merge_readings,
    "daily_stats": q_daily_stats,
    "cyclic_features": q_cyclic_features,
    "warehouse_counts": q_warehouse_counts,
}

_NUMBERED_NATIONS = """
districts AS (
  SELECT CAST(row_number() OVER (ORDER BY entity) AS INTEGER) AS district_id,
         entity AS district_name
  FROM (SELECT DISTINCT entity FROM lines))"""
_NUMBERED_DATES = """
dates AS (
  SELECT CAST(row_number() OVER (ORDER BY full_date) AS INTEGER) AS date_id, full_date
  FROM (SELECT DISTINCT full_date FROM lines))"""

ORACLES = {
    "dim_district": with_(LINES, _NUMBERED_NATIONS)
    + "SELECT district_id AS entity_id, district_name AS entity FROM districts",
    "dim_date": with_(LINES, _NUMBERED_DATES) + f"""
SELECT date_id, full_date, CAST(year(full_date) AS SMALLINT) AS year,
       CAST(month(full_date) AS SMALLINT) AS month, CAST(day(full_date) AS SMALLINT) AS day,
       CAST(dayofyear(full_date) AS SMALLINT) AS day_of_year,
       CAST(isodow(full_date) AS SMALLINT) AS day_of_week,
       CAST(weekofyear(full_date) AS SMALLINT) AS week_of_year,
       CAST(quarter(full_date) AS SMALLINT) AS quarter, monthname(full_date) AS month_name,
       isodow(full_date) IN (6, 7) AS is_weekend, CAST({MONTH_DAY} AS SMALLINT) AS month_day
FROM dates""",
    "dim_hour": """
SELECT CAST(h AS INTEGER) AS hour_id, CAST(h AS INTEGER) AS hour,
       CASE WHEN h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning'
            WHEN h < 18 THEN 'Afternoon' ELSE 'Evening' END AS period_of_day,
       slots, days
FROM range(24) AS r(h) LEFT JOIN (
  SELECT hour(ts) AS hr, count(DISTINCT (event_type, CAST(ts AS DATE))) AS slots,
         count(DISTINCT CAST(ts AS DATE)) AS days
  FROM events GROUP BY hour(ts)) ON hr = h""",
    "ensure_dates": with_(LINES, _NUMBERED_DATES, f"""
missing AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS full_date FROM orders
  WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT full_date FROM dates)),
together AS (
  SELECT * FROM dates UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY full_date) + (SELECT max(date_id) FROM dates)
              AS INTEGER), full_date FROM missing)""") + f"""
SELECT date_id, full_date, CAST({MONTH_DAY} AS SMALLINT) AS month_day,
       isodow(full_date) IN (6, 7) AS is_weekend FROM together""",
    "lookup_key": with_(LINES, _NUMBERED_NATIONS, """
names AS (SELECT n_name AS district_name FROM nation
          UNION ALL SELECT r_name FROM region)""")
    + "SELECT district_name, district_id FROM names LEFT JOIN districts USING (district_name)",
    "fact_load": with_(LINES, _NUMBERED_NATIONS, _NUMBERED_DATES) + """
SELECT district_id, date_id, CAST(hour(datetime) AS SMALLINT) AS hour_id,
       temp AS temperature_c, hum AS humidity_percent, wind AS wind_speed_m_s, rain AS rain_mm
FROM lines JOIN districts ON district_name = entity JOIN dates USING (full_date)""",
    "fact_orphans": """
SELECT o_orderkey, o_orderdate AS datetime FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "star_view": """
WITH districts AS (
  SELECT CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS district_id,
         event_type AS district_name FROM (SELECT DISTINCT event_type FROM events))
SELECT district_id, district_name, CAST(ts AS DATE) AS full_date,
       CAST(hour(ts) AS INTEGER) AS hour,
       CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning'
            WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END AS period_of_day,
       CAST(weekofyear(ts) AS INTEGER) AS week_of_year, value
FROM events JOIN districts ON district_name = event_type""",
    "dedup_fact": """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_suppkey
FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         l_tax, l_suppkey, row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_suppkey) AS rn
  FROM lineitem)
WHERE rn = 1""",
    "merge_readings": with_(LINES, SLOTS)
    + f"SELECT entity, full_date, slot, {r6_all(*SHORTS)} FROM slots",
    "daily_stats": with_(LINES, daily()) + f"""
SELECT entity, full_date, year, month_day,
       {r6_all(*[f"{s}_{k}" for s in SHORTS for k in ("mean", "std", "min", "max")])},
       {r6("rain_total")} FROM daily""",
    "cyclic_features": f"""
SELECT DISTINCT event_type AS entity, CAST(ts AS DATE) AS full_date,
       CAST(hour(ts) AS INTEGER) AS hour,
       {r6("sin(2 * pi() * hour(ts) / 24.0::DOUBLE)", "hour_sin")},
       {r6("cos(2 * pi() * hour(ts) / 24.0::DOUBLE)", "hour_cos")},
       {r6("sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE)", "doy_sin")},
       {r6("cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE)", "doy_cos")},
       {r6("sin(2 * pi() * month(ts) / 12.0::DOUBLE)", "month_sin")},
       {r6("cos(2 * pi() * month(ts) / 12.0::DOUBLE)", "month_cos")}
FROM events""",
    "warehouse_counts": with_(LINES) + """
SELECT 'actual' AS "table", count(*) AS row_count FROM lines WHERE status = 'F'
UNION ALL SELECT 'forecast', count(*) FROM lines WHERE status = 'O'
UNION ALL SELECT 'districts', count(DISTINCT entity) FROM lines
UNION ALL SELECT 'dates', count(DISTINCT full_date) FROM lines""",
}
