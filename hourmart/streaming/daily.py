"""Daily statistics kept up to date from a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourmart.model import Panel
from hourmart.operators.stats import merged_moments, moments
from hourmart.session import shared_folder, written
from hourmart.sources.tables import Warehouse

_DAY_SECONDS = 86400


def stream_daily_stats(readings: DataFrame, panel: Panel, event_time: str,
                       lateness: str = "1 day") -> DataFrame:
    """Mean, deviation, min, max (and wet total) by entity and day window.

    Watermarks need TIMESTAMP, so each row carries midnight of its calendar day
    as one, counted from the epoch whatever the session's time zone. State older
    than the watermark is dropped, and rows later than that with it.
    """
    midnight = F.timestamp_seconds(
        F.unix_date(F.to_date(event_time)).cast("bigint") * _DAY_SECONDS)
    stats = []
    for s, c in panel.measures:
        stats += [
            F.avg(c).alias(f"{s}_mean"), F.stddev_samp(c).alias(f"{s}_std"),
            F.min(c).alias(f"{s}_min"), F.max(c).alias(f"{s}_max")]
    if panel.wet_column:
        stats.append(F.sum(panel.wet_column).alias(f"{panel.wet}_total"))
    return (
        readings.withColumn("_at", midnight)
        .withWatermark("_at", lateness)
        .groupBy(panel.entity, F.window("_at", "1 day").alias("_day")).agg(*stats)
        .withColumn(panel.date, F.date_from_unix_date(
            F.floor(F.unix_seconds("_day.start") / _DAY_SECONDS).cast("int")))
        .drop("_day")
    )


def merge_batch(warehouse: Warehouse, table: str, batch: DataFrame, batch_id: int, panel: Panel) -> None:
    """Merge one micro-batch into the stored moments; safe to run again.

    Each day is a partition and carries the number of the last batch merged into it. A batch that was
    lost half-way has replaced some days whole and others not at all; run again, it merges only
    into days whose number is lower than its own.
    """
    fresh = written(moments(batch, panel), "moments")
    if fresh.isEmpty():
        return
    schema = fresh.withColumn("merged_upto", F.lit(0).cast("long")).schema
    stored = warehouse.read(table, schema)
    days = stored.join(fresh.select(panel.date).distinct(), panel.date, "left_semi")
    done = days.where(F.col("merged_upto") >= batch_id).select(panel.date).distinct()
    fresh = fresh.join(done, panel.date, "left_anti")
    old = days.where(F.col("merged_upto") < batch_id).drop("merged_upto")
    merged = merged_moments(old, fresh, panel).withColumn("merged_upto", F.lit(batch_id).cast("long"))
    rows = written(merged.select(*schema.names), "merged")
    if not rows.isEmpty():
        warehouse.overwrite_partitions(table, rows, [panel.date])


def run_moments(stream: DataFrame, panel: Panel, warehouse: Warehouse, table: str, checkpoint: str) -> None:
    """Process what is available; the table holds one row per entity and day, however many batches come.

    Rows of any age are merged, so nothing is dropped as late, and the stream keeps no state. One
    stream with its checkpoint feeds a table.
    """
    shared_folder(stream.sparkSession)
    query = (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: merge_batch(warehouse, table, batch, batch_id, panel))
        .start()
    )
    query.awaitTermination()


def run_daily_stats(stream: DataFrame, panel: Panel, path: str, checkpoint: str | None = None
                    ) -> None:
    """Process what is available; each micro-batch writes the groups it changed.

    A micro-batch owns one partition of ``path`` and overwrites it, so a retry
    leaves the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        )

    spark = stream.sparkSession
    shared_folder(spark)
    query = (
        stream.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or f"{path}_progress")
        .foreachBatch(write).start()
    )
    query.awaitTermination()


def current_daily_stats(updates: DataFrame, panel: Panel) -> DataFrame:
    """The newest version of each group in what :func:`run_daily_stats` wrote."""
    values = [c for c in updates.columns if c not in (panel.entity, panel.date, "batch_id")]
    newest = updates.groupBy(panel.entity, panel.date).agg(
        F.max(F.struct("batch_id", *values)).alias("_row"))
    return newest.select(
        panel.entity, panel.date, *[F.col(f"_row.{v}").alias(v) for v in values])
