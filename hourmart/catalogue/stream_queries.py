"""Streaming jobs run over everything available and compared with their batch twins."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hourmart.catalogue.bindings import HOUR, YEAR, r6_all, rounded, table
from hourmart.catalogue.write_queries import RULES, STAMP, stamp
from hourmart.operators.quality import RangeRule
from hourmart.operators.stats import stats_of_moments
from hourmart.operators.writes import latest_per_key
from hourmart.session import shared_folder
from hourmart.sources.tables import Warehouse
from hourmart.streaming.daily import (
    current_daily_stats, run_daily_stats, run_moments, stream_daily_stats,
)
from hourmart.streaming.ingest import IngestJob, run_ingest


def scratch(spark) -> str:
    """A folder of its own for one run, below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/hourmart/{uuid.uuid4().hex}"


def _stream(spark, d, name):
    """A table folder or file as a file stream; the pattern matches either."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def q_stream_daily(spark, d):
    events = _stream(spark, d, "events").withColumnRenamed("event_type", "entity")
    path = f"{scratch(spark)}/daily"
    run_daily_stats(stream_daily_stats(events, HOUR, "ts"), HOUR, path)
    return rounded(current_daily_stats(spark.read.parquet(path), HOUR))


_COLUMNS = ["entity", "full_date", "temp", "hum", "rain", "year"]


def _guarded(spark, d, lineitem, status):
    """Lines of one status as rows to store, without reducing them to one per key."""
    return (
        lineitem.where(F.col("l_linestatus") == status)
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("entity"), F.to_date("l_shipdate").alias("full_date"),
            F.col("l_quantity").alias("temp"), (F.col("l_extendedprice") / 1000.0).alias("hum"),
            (F.col("l_discount") - 0.02).alias("rain"), F.year("l_shipdate").alias("year")))


def q_stream_upsert(spark, d):
    """Open lines streamed into the table of finished ones."""
    keys, order = ["entity", "full_date"], ["temp", "hum", "rain"]
    warehouse = Warehouse(spark, scratch(spark))
    finished = _guarded(spark, d, table(spark, d, "lineitem"), "F")
    warehouse.refresh(
        "forecast",
        latest_per_key(finished, keys, order).withColumn(
            "updated_at", F.lit(None).cast("timestamp_ntz")),
        partition_by=["year"])
    job = IngestJob(
        warehouse, "forecast", keys, ["temp", "rain"], "year", order, "temp", "rain", RULES)
    stream = _guarded(spark, d, _stream(spark, d, "lineitem"), "O").select(*_COLUMNS)
    run_ingest(job, stream, stamp(), f"{warehouse.root}/progress")
    return rounded(warehouse.read("forecast").select(*_COLUMNS, "updated_at"))


PIECES = 4


def _in_pieces(spark, d, root) -> str:
    """Events written as files that arrive one after the other, so that all days get late rows."""
    events = table(spark, d, "events")
    for i in range(PIECES):
        events.where(F.col("event_id") % PIECES == i).coalesce(1).write.mode("append").parquet(f"{root}/arriving")
    return f"{root}/arriving"


def _piecewise(spark, path):
    """A stream that takes one file a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def q_stream_moments(spark, d):
    """Daily statistics from several micro-batches, merged into one row per event type and day."""
    warehouse = Warehouse(spark, scratch(spark))
    stream = _piecewise(spark, _in_pieces(spark, d, warehouse.root)).select(
        F.col("event_type").alias("entity"), F.to_date("ts").alias("full_date"), "value")
    run_moments(stream, HOUR, warehouse, "stats", f"{warehouse.root}/progress")
    return rounded(stats_of_moments(warehouse.read("stats"), HOUR))


@dataclass(frozen=True)
class _LostOnce(Warehouse):
    """A warehouse whose job is lost once, after its audit rows are stored and before its table changes."""

    def upsert(self, table, incoming, keys, update, partition):
        files, mark = self._hadoop(f"{self.root}/lost")
        if self.version(table) is not None and not files.exists(mark):
            files.create(mark, False).close()
            raise RuntimeError("the job is lost here")
        super().upsert(table, incoming, keys, update, partition)


EVENT_RULES = (RangeRule("temperature", "temp", 5.0, 95.0), RangeRule("humidity", "hum", 0.0, 100.0))


def q_stream_restart(spark, d):
    """Events ingested file by file, lost between audit and upsert, and gone on with from the checkpoint.

    The table, its audit and its rejects, told apart by ``kind``.
    """
    keys, measures = HOUR.keys, ["temp", "hum", "rain"]
    warehouse = _LostOnce(spark, scratch(spark))
    stream = _piecewise(spark, _in_pieces(spark, d, warehouse.root)).select(
        F.col("event_type").alias("entity"), F.to_date("ts").alias("full_date"), F.hour("ts").alias("hour"),
        F.col("value").alias("temp"), (F.col("user_id") % 110).cast("double").alias("hum"),
        (F.col("value") / 10.0 - 1.0).alias("rain"))
    job = IngestJob(warehouse, "readings", keys, ["temp", "rain"], "full_date", measures, "temp", "rain", EVENT_RULES)
    for _ in range(2):
        try:
            run_ingest(job, stream, stamp(), f"{warehouse.root}/progress")
        except StreamingQueryException:
            continue
    stored = warehouse.read("readings").select(F.lit("table").alias("kind"), *keys, *measures)
    audit = warehouse.read(job.audit).select(
        F.lit("audit").alias("kind"), *keys, "old_temp", "new_temp", "old_rain", "new_rain")
    rejects = warehouse.read(job.rejects).select(F.lit("reject").alias("kind"), *keys, *measures, "reason")
    return rounded(stored.unionByName(audit, allowMissingColumns=True).unionByName(rejects, allowMissingColumns=True))


QUERIES = {
    "stream_daily": q_stream_daily, "stream_upsert": q_stream_upsert,
    "stream_moments": q_stream_moments, "stream_restart": q_stream_restart}

_LATEST = """{name} AS (
  SELECT entity, full_date, temp, hum, rain FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, full_date
                                 ORDER BY temp DESC, hum DESC, rain DESC) AS rn FROM {source})
  WHERE rn = 1)"""
_DAILY = f"""
SELECT entity, full_date, {r6_all("value_mean", "value_std", "value_min", "value_max")}
FROM (SELECT event_type AS entity, CAST(ts AS DATE) AS full_date, avg(value) AS value_mean,
             stddev_samp(value) AS value_std, min(value) AS value_min, max(value) AS value_max
      FROM events GROUP BY ALL)"""
_KEYS = "entity, full_date, hour"


def _piece(i: int) -> str:
    """CTEs of one micro-batch: its newest valid rows, the audit against what is stored, the table after it."""
    return f"""
new_{i} AS (
  SELECT {_KEYS}, temp, hum, rain FROM (
    SELECT * REPLACE (CASE WHEN rain < 0 THEN 0 ELSE rain END AS rain),
           row_number() OVER (PARTITION BY {_KEYS} ORDER BY temp DESC, hum DESC, CASE WHEN rain < 0 THEN 0 ELSE rain END DESC) AS rn
    FROM arriving WHERE piece = {i} AND reason IS NULL)
  WHERE rn = 1),
audit_{i} AS (
  SELECT {_KEYS}, o.temp AS old_temp, n.temp AS new_temp, o.rain AS old_rain, n.rain AS new_rain
  FROM stored_{i} o JOIN new_{i} n USING ({_KEYS})
  WHERE abs(n.temp - o.temp) > 0.5 OR abs(n.rain - o.rain) > 0.1),
stored_{i + 1} AS (
  SELECT {_KEYS}, coalesce(n.temp, o.temp) AS temp, coalesce(o.hum, n.hum) AS hum, coalesce(n.rain, o.rain) AS rain
  FROM stored_{i} o FULL JOIN new_{i} n USING ({_KEYS}))"""


_ARRIVING = """
WITH rows AS (
  SELECT event_type AS entity, CAST(ts AS DATE) AS full_date, CAST(hour(ts) AS INTEGER) AS hour, value AS temp,
         (user_id % 110)::DOUBLE AS hum, value / 10.0::DOUBLE - 1.0::DOUBLE AS rain, event_id % 4 AS piece FROM events),
arriving AS (
  SELECT *, CASE WHEN temp < 5 OR temp > 95 THEN 'temperature' WHEN hum < 0 OR hum > 100 THEN 'humidity' END AS reason FROM rows),
stored_0 AS (SELECT entity, full_date, hour, temp, hum, rain FROM rows WHERE false),"""
_NONE = "CAST(NULL AS DOUBLE)"

ORACLES = {
    "stream_daily": _DAILY,
    "stream_moments": _DAILY,
    "stream_restart": _ARRIVING + ",".join(_piece(i) for i in range(PIECES)) + f"""
SELECT 'table' AS kind, {_KEYS}, {r6_all("temp", "hum", "rain")}, {_NONE} AS old_temp, {_NONE} AS new_temp,
       {_NONE} AS old_rain, {_NONE} AS new_rain, CAST(NULL AS VARCHAR) AS reason FROM stored_{PIECES}
UNION ALL
SELECT 'audit', {_KEYS}, NULL, NULL, NULL, {r6_all("old_temp", "new_temp", "old_rain", "new_rain")}, NULL
FROM ({" UNION ALL ".join(f"SELECT * FROM audit_{i}" for i in range(PIECES))})
UNION ALL
SELECT 'reject', {_KEYS}, {r6_all("temp", "hum", "rain")}, NULL, NULL, NULL, NULL, reason FROM arriving WHERE reason IS NOT NULL""",
    "stream_upsert": f"""
WITH guarded AS (
  SELECT n_name AS entity, CAST(l_shipdate AS DATE) AS full_date, l_quantity AS temp,
         l_extendedprice / 1000.0::DOUBLE AS hum, l_discount - 0.02::DOUBLE AS rain,
         l_linestatus AS status
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
finished AS (SELECT * FROM guarded WHERE status = 'F'),
opened AS (
  SELECT entity, full_date, temp, hum, CASE WHEN rain < 0 THEN 0 ELSE rain END AS rain
  FROM guarded WHERE status = 'O' AND temp BETWEEN 5 AND 45 AND hum BETWEEN 0 AND 100),
{_LATEST.format(name="old", source="finished")},
{_LATEST.format(name="new", source="opened")}
SELECT entity, full_date, {YEAR} AS year, {r6_all("temp", "hum", "rain")}, updated_at FROM (
  SELECT entity, full_date, coalesce(n.temp, o.temp) AS temp, coalesce(o.hum, n.hum) AS hum,
         coalesce(n.rain, o.rain) AS rain,
         CASE WHEN n.temp IS NOT NULL THEN TIMESTAMP '{STAMP}' END AS updated_at
  FROM old o FULL JOIN new n USING (entity, full_date))""",
}
