"""Plain-join forms of the history operators, to compare the window forms with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourmart.functions.calendar import month_day
from hourmart.functions.numeric import wet_flag
from hourmart.model import Panel


def same_day_history_join(daily: DataFrame, panel: Panel) -> DataFrame:
    """The same result by self-join on entity and calendar day with an earlier-year filter."""
    current = daily.select(panel.entity, "month_day", "year")
    earlier = daily.withColumnRenamed("year", "_year")
    stats = []
    for s, _ in panel.measures:
        stats += [
            F.avg(f"{s}_mean").alias(f"hist_{s}_mean"), F.avg(f"{s}_std").alias(f"hist_{s}_std"),
            F.min(f"{s}_min").alias(f"hist_{s}_min"), F.max(f"{s}_max").alias(f"hist_{s}_max"),
        ]
    return (
        current.join(earlier, [panel.entity, "month_day"]).where(F.col("_year") < F.col("year"))
        .groupBy(panel.entity, "year", "month_day")
        .agg(*stats, F.count_distinct("_year").alias("years_count"))
    )


def same_slot_history_join(fact: DataFrame, panel: Panel) -> DataFrame:
    """The same result by self-join on entity, slot and calendar day."""
    day = F.col(panel.date)
    rows = fact.withColumns({"year": F.year(day), "month_day": month_day(day)})
    current = rows.select(*panel.series, "month_day", "year")
    earlier = rows.select(
        *panel.series, "month_day", F.col("year").alias("_year"), *panel.columns)
    stats = []
    for s, column in panel.measures:
        stats.append(F.avg(column).alias(f"hist_h_{s}_mean"))
        if s == panel.wet:
            flag = wet_flag(F.col(column), panel.wet_above).cast("double")
            stats += [F.max(column).alias(f"hist_h_{s}_max"), F.avg(flag).alias(f"hist_h_{s}_prob")]
        else:
            stats.append(F.stddev_samp(column).alias(f"hist_h_{s}_std"))
    return (
        current.join(earlier, [*panel.series, "month_day"])
        .where(F.col("_year") < F.col("year"))
        .groupBy(panel.entity, "year", "month_day", panel.slot)
        .agg(*stats, F.count_distinct("_year").alias("years_count"))
    )
