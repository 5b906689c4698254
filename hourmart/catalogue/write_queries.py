"""Write semantics and row rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import (
    ACTUAL, DAY, FORECAST, LINES, SHORTS, actual_days, forecast_days, r6, r6_all, rounded,
    table, with_,
)
from hourmart.operators.quality import RangeRule, change_audit, repair, touch, validate
from hourmart.operators.writes import (
    add_column_if_missing, conditional_delete, conditional_update, delete_keys,
    insert_if_absent, latest_per_key, replace_groups, upsert,
)
from hourmart.plans.scoring import in_range, two_stage
from hourmart.session import shared_folder, written
from hourmart.sources.tables import Warehouse

KEYS = DAY.keys
RULES = (RangeRule("temperature", "temp", 5.0, 45.0), RangeRule("humidity", "hum", 0.0, 100.0))
STAMP = "2026-03-20 00:05:00"


def stamp():
    return F.lit(STAMP).cast("timestamp_ntz")


def _both(spark, d):
    return actual_days(spark, d), forecast_days(spark, d)


def q_partition_replace(spark, d):
    return rounded(replace_groups(*_both(spark, d), KEYS))


def q_insert_if_absent(spark, d):
    return rounded(insert_if_absent(*_both(spark, d), KEYS))


def q_upsert(spark, d):
    return rounded(upsert(*_both(spark, d), KEYS, ["temp", "rain"]))


def q_latest_per_key(spark, d):
    """The dearest order of each customer and day."""
    orders = table(spark, d, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("full_date"), "o_totalprice", "o_orderkey",
        "o_orderpriority")
    return latest_per_key(orders, ["o_custkey", "full_date"], ["o_totalprice", "o_orderkey"])


def q_conditional_update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return rounded(conditional_update(
        orders, urgent, o_totalprice=F.col("o_totalprice") * 1.01))


def q_conditional_delete(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return conditional_delete(orders, F.col("o_orderstatus").isin("F", "P"))


def q_delete_keys(spark, d):
    return rounded(delete_keys(*_both(spark, d), KEYS))


def q_add_column(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    once = add_column_if_missing(rows, "updated_at", stamp())
    return add_column_if_missing(once, "updated_at", F.lit(None).cast("timestamp_ntz"))


def guarded_rows(spark, d):
    """Line items with price in thousands as humidity and discount less 0.02 as rain."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("temp"),
        (F.col("l_extendedprice") / 1000.0).alias("hum"),
        (F.col("l_discount") - 0.02).alias("rain"))


def q_validate_accepted(spark, d):
    return rounded(validate(guarded_rows(spark, d), RULES)[0])


def q_validate_rejected(spark, d):
    return rounded(validate(guarded_rows(spark, d), RULES)[1])


def q_repair(spark, d):
    return rounded(repair(guarded_rows(spark, d), "rain"))


def q_change_audit(spark, d):
    return rounded(change_audit(*_both(spark, d), KEYS, stamp(), "temp", "rain"))


def q_touch_stamp(spark, d):
    return rounded(touch(forecast_days(spark, d), stamp()))


def _stored(spark, d):
    """Actual days as a stored table by year, and the forecast days that come in."""
    actual, forecast = (df.withColumn("year", F.year("full_date")) for df in _both(spark, d))
    warehouse = Warehouse(spark, f"{shared_folder(spark).rstrip('/')}/hourmart/{uuid.uuid4().hex}")
    warehouse.refresh("days", actual, ["year"])
    return warehouse, written(forecast, "forecast")


def _days_of(warehouse):
    return rounded(warehouse.read("days").drop("year"))


def q_stored_replace(spark, d):
    """Partition replace on stored files: only the years that come in are rewritten."""
    warehouse, forecast = _stored(spark, d)
    warehouse.replace("days", forecast, KEYS, "year")
    return _days_of(warehouse)


def q_stored_insert(spark, d):
    warehouse, forecast = _stored(spark, d)
    warehouse.insert_absent("days", forecast, KEYS, "year")
    return _days_of(warehouse)


def q_stored_upsert(spark, d):
    warehouse, forecast = _stored(spark, d)
    warehouse.upsert("days", forecast, KEYS, ["temp", "rain"], "year")
    return _days_of(warehouse)


def q_two_stage_rule(spark, d):
    """Rain from a wet probability and an amount, and humidity kept in its range, line by line."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        two_stage(F.col("l_discount") * 9.99, F.col("l_tax") * 10.0 - 0.2).alias("rain"),
        in_range("hum", F.col("l_quantity") * 2.5 - 5.0).alias("hum"))
    return rounded(rows)


QUERIES = {
    "stored_replace": q_stored_replace,
    "stored_insert": q_stored_insert,
    "stored_upsert": q_stored_upsert,
    "two_stage_rule": q_two_stage_rule,
    "partition_replace": q_partition_replace,
    "insert_if_absent": q_insert_if_absent,
    "upsert": q_upsert,
    "latest_per_key": q_latest_per_key,
    "conditional_update": q_conditional_update,
    "conditional_delete": q_conditional_delete,
    "delete_keys": q_delete_keys,
    "add_column": q_add_column,
    "validate_accepted": q_validate_accepted,
    "validate_rejected": q_validate_rejected,
    "repair": q_repair,
    "change_audit": q_change_audit,
    "touch_stamp": q_touch_stamp,
}

_AF = with_(LINES, ACTUAL, FORECAST)
_OUT = f"SELECT entity, full_date, {r6_all(*SHORTS)}"
_GUARDED = """
WITH guarded AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS temp, l_extendedprice / 1000.0::DOUBLE AS hum,
         l_discount - 0.02::DOUBLE AS rain FROM lineitem)"""
_BAD_TEMP, _BAD_HUM = "(temp < 5 OR temp > 45)", "(hum < 0 OR hum > 100)"
_AT = f"TIMESTAMP '{STAMP}'"

_REPLACED = _AF + f"""{_OUT} FROM (
  SELECT * FROM actual ANTI JOIN forecast USING (entity, full_date)
  UNION ALL SELECT * FROM forecast)"""
_INSERTED = _AF + f"""{_OUT} FROM (
  SELECT * FROM actual
  UNION ALL SELECT * FROM forecast ANTI JOIN actual USING (entity, full_date))"""
_UPSERTED = _AF + f"""{_OUT} FROM (
  SELECT entity, full_date, CASE WHEN f.temp IS NULL THEN a.temp ELSE f.temp END AS temp,
         CASE WHEN a.temp IS NULL THEN f.hum ELSE a.hum END AS hum,
         CASE WHEN a.temp IS NULL THEN f.wind ELSE a.wind END AS wind,
         CASE WHEN f.temp IS NULL THEN a.rain ELSE f.rain END AS rain
  FROM actual a FULL JOIN forecast f USING (entity, full_date))"""

ORACLES = {
    "partition_replace": _REPLACED,
    "stored_replace": _REPLACED,
    "insert_if_absent": _INSERTED,
    "stored_insert": _INSERTED,
    "upsert": _UPSERTED,
    "stored_upsert": _UPSERTED,
    "two_stage_rule": f"""
SELECT l_orderkey, l_linenumber,
  {r6("CASE WHEN l_discount * 9.99::DOUBLE > 0.5 THEN greatest(l_tax * 10.0::DOUBLE - 0.2::DOUBLE, 0) ELSE 0 END", "rain")},
  {r6("greatest(0, least(100, l_quantity * 2.5::DOUBLE - 5.0::DOUBLE))", "hum")}
FROM lineitem""",
    "latest_per_key": """
SELECT o_custkey, full_date, o_totalprice, o_orderkey, o_orderpriority FROM (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS full_date, o_totalprice, o_orderkey,
         o_orderpriority, row_number() OVER (
           PARTITION BY o_custkey, CAST(o_orderdate AS DATE)
           ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn
  FROM orders)
WHERE rn = 1""",
    "conditional_update": f"""
SELECT o_orderkey, o_orderpriority, {r6('''
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 1.01::DOUBLE
              ELSE o_totalprice END''', "o_totalprice")}
FROM orders""",
    "conditional_delete": """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'P')""",
    "delete_keys": _AF + f"{_OUT} FROM actual ANTI JOIN forecast USING (entity, full_date)",
    "add_column": f"SELECT s_suppkey, s_acctbal, {_AT} AS updated_at FROM supplier",
    "validate_accepted": _GUARDED + f"""
SELECT l_orderkey, l_linenumber, {r6_all("temp", "hum", "rain")}
FROM guarded WHERE NOT {_BAD_TEMP} AND NOT {_BAD_HUM}""",
    "validate_rejected": _GUARDED + f"""
SELECT l_orderkey, l_linenumber, {r6_all("temp", "hum", "rain")},
       CASE WHEN {_BAD_TEMP} THEN 'temperature' ELSE 'humidity' END AS reason
FROM guarded WHERE {_BAD_TEMP} OR {_BAD_HUM}""",
    "repair": _GUARDED + f"""
SELECT l_orderkey, l_linenumber, {r6_all("temp", "hum")},
       {r6("CASE WHEN rain < 0 THEN 0.0::DOUBLE ELSE rain END", "rain")}
FROM guarded""",
    "change_audit": _AF + f"""
SELECT entity, full_date, {r6_all("old_temp", "new_temp", "old_rain", "new_rain")},
       {_AT} AS changed_at
FROM (SELECT entity, full_date, a.temp AS old_temp, f.temp AS new_temp, a.rain AS old_rain,
             f.rain AS new_rain
      FROM actual a JOIN forecast f USING (entity, full_date))
WHERE abs(new_temp - old_temp) > 0.5 OR abs(new_rain - old_rain) > 0.1""",
    "touch_stamp": with_(LINES, FORECAST) + f"{_OUT}, {_AT} AS updated_at FROM forecast",
}
