"""Dimensions, their surrogate keys and key lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hourmart.functions.calendar import calendar_parts, period_of_day
from hourmart.session import written


def dense_key(df: DataFrame, order_by: list[str], key: str) -> DataFrame:
    """Number rows 1..n in ``order_by`` order without a single-task sort.

    Rows are range-partitioned and sorted, and their (partition, position) is
    frozen in a written step; the offset of each partition is then the running
    total of the sizes before it. Only that size list, one row per partition,
    is broadcast.
    """
    placed = written(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id()),
        "keys")
    # The id holds the partition number above bit 33 and the position below it.
    placed = placed.withColumns({
        "_part": F.shiftright("_at", 33),
        "_pos": F.col("_at").bitwiseAND(F.lit(2**33 - 1)),
    })
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_part", "_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(key, (F.col("_offset") + F.col("_pos") + 1).cast("int"))
        .select(key, *df.columns)
    )


def dim_entity(readings: DataFrame, name: str, key: str = "district_id") -> DataFrame:
    """Distinct names, keyed densely in name order."""
    names = readings.select(name).where(F.col(name).isNotNull()).distinct()
    return dense_key(names, [name], key)


def dim_date(readings: DataFrame, timestamp: str, date: str = "full_date") -> DataFrame:
    """Distinct days with their calendar parts, keyed densely in day order.

    Days are few by nature (one row per calendar day), so one window is enough.
    """
    days = readings.select(F.to_date(timestamp).alias(date)).dropna().distinct()
    return _describe_days(days, date, F.row_number().over(Window.orderBy(date)))


def _describe_days(days: DataFrame, date: str, date_id) -> DataFrame:
    return days.select(
        date_id.cast("int").alias("date_id"), date,
        *[c.alias(n) for n, c in calendar_parts(F.col(date)).items()],
    )


def dim_hour(spark: SparkSession) -> DataFrame:
    """The 24 hours with their period of day."""
    hour = F.col("id").cast("smallint")
    return spark.range(24).select(
        hour.alias("hour_id"), hour.alias("hour"), period_of_day(hour).alias("period_of_day"))


def ensure_dates(dim: DataFrame, dates: DataFrame, date: str = "full_date") -> DataFrame:
    """The date dimension plus the days it lacks; keys already given stay as they are."""
    missing = dates.select(date).distinct().join(dim, date, "left_anti")
    top = dim.agg(F.coalesce(F.max("date_id"), F.lit(0))).scalar()
    fresh = F.row_number().over(Window.orderBy(date)) + top
    return dim.unionByName(_describe_days(missing, date, fresh))


def lookup_key(requests: DataFrame, dim: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Requests with their dimension row, and the requests nothing matches."""
    return requests.join(dim, name), requests.join(dim, name, "left_anti")
