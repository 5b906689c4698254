"""Statistics of the same calendar day, and same day and slot, in strictly earlier years.

Each is one window over years: a group holds one row per year, whatever the
size of the entity, so no pairs are built and a dominant entity still spreads
over its calendar days and slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourmart.functions.calendar import month_day
from hourmart.functions.numeric import wet_flag
from hourmart.model import Panel, day_history_columns, slot_history_columns


def _earlier_years(*by: str):
    return (
        Window.partitionBy(*by).orderBy("year")
        .rangeBetween(Window.unboundedPreceding, -1)
    )


CALENDAR_DAY = ("year", "month_day")


def by_calendar_day(rows: DataFrame, panel: Panel) -> DataFrame:
    """Rows with year and month-day, those of one entity and calendar day lying together.

    The one shuffle that slot history, daily statistics and their history take between them.
    """
    day = F.col(panel.date)
    parts = {"year": F.year(day).cast("smallint"), "month_day": month_day(day).cast("smallint")}
    return rows.withColumns(parts).repartition(panel.entity, "month_day")


def _day_history(panel: Panel, over) -> dict[str, Column]:
    """Mean of daily means, mean of daily deviations, min of mins, max of maxes."""
    found = {}
    for s, _ in panel.measures:
        found[f"hist_{s}_mean"] = F.avg(f"{s}_mean").over(over)
        found[f"hist_{s}_std"] = F.avg(f"{s}_std").over(over)
        found[f"hist_{s}_min"] = F.min(f"{s}_min").over(over)
        found[f"hist_{s}_max"] = F.max(f"{s}_max").over(over)
    return found


def same_day_history(daily: DataFrame, panel: Panel) -> DataFrame:
    """Per entity, year and calendar day: the earlier years' daily statistics.

    Days without an earlier year have no row. ``daily`` is one row per entity
    and day, as :func:`daily_stats` gives.
    """
    over = _earlier_years(panel.entity, "month_day")
    return (
        daily.withColumns({**_day_history(panel, over), "years_count": F.count("year").over(over)})
        .where(F.col("years_count") > 0)
        .select(panel.entity, "year", "month_day", *day_history_columns(panel))
    )


def with_day_history(rows: DataFrame, daily: DataFrame, panel: Panel) -> DataFrame:
    """Rows with the same-day history columns; NULL without an earlier year.

    The history of an entity and calendar day is one row with an entry a year, so the join is by
    entity and calendar day alone: rows that lie together by these, like :func:`by_calendar_day`
    leaves them, are not shuffled for it.
    """
    names = day_history_columns(panel)
    entry = F.struct(F.col("year").cast("int").alias("year"), F.struct(*names).alias("history"))
    years = (
        same_day_history(daily, panel).groupBy(panel.entity, "month_day")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("_years")))
    found = rows.join(years, [panel.entity, "month_day"], "left").withColumn(
        "_history", F.try_element_at("_years", F.col("year").cast("int")))
    return found.select(*rows.columns, *[F.col(f"_history.{n}").alias(n) for n in names])


def _slot_history(panel: Panel, over, known: Column | None = None) -> dict[str, Column]:
    found = {}
    for s, column in panel.measures:
        value = F.col(column)
        found[f"hist_h_{s}_mean"] = F.avg(value).over(over)
        if s == panel.wet:
            flag = wet_flag(value, panel.wet_above).cast("double")
            if known is not None:
                flag = F.when(known, flag)
            found[f"hist_h_{s}_max"] = F.max(value).over(over)
            found[f"hist_h_{s}_prob"] = F.avg(flag).over(over)
        else:
            found[f"hist_h_{s}_std"] = F.stddev_samp(value).over(over)
    return found


def with_slot_history(fact: DataFrame, panel: Panel) -> DataFrame:
    """Fact rows with the same-day-and-slot history columns; NULL without an earlier year.

    ``fact`` has one row per key and carries ``year`` and ``month_day``.
    """
    over = _earlier_years(*panel.series, "month_day")
    return fact.withColumns(_slot_history(panel, over))


def same_slot_history(fact: DataFrame, panel: Panel) -> DataFrame:
    """Per entity, year, calendar day and slot: the earlier years' raw values."""
    over = _earlier_years(*panel.series, "month_day")
    day = F.col(panel.date)
    parts = {"year": F.year(day), "month_day": month_day(day)}
    return (
        fact.withColumns({n: c for n, c in parts.items() if n not in fact.columns})
        .withColumns({**_slot_history(panel, over), "years_count": F.count("year").over(over)})
        .where(F.col("years_count") > 0)
        .select(panel.entity, "year", "month_day", panel.slot,
                *slot_history_columns(panel), "years_count")
    )


def _only_days_of(rows: DataFrame, targets: DataFrame, panel: Panel) -> DataFrame:
    """Rows on a calendar day some target falls on; at most 366 days are broadcast."""
    days = targets.select(month_day(F.col(panel.date)).alias("month_day")).distinct()
    return rows.join(F.broadcast(days), "month_day", "left_semi")


def day_history_for(daily: DataFrame, targets: DataFrame, panel: Panel) -> DataFrame:
    """Same-day history for target (entity, day) pairs, whether or not they were measured."""
    keys = [panel.entity, panel.date]
    day = F.col(panel.date)
    spine = (
        targets.select(*keys).distinct()
        .withColumns({"year": F.year(day), "month_day": month_day(day), "_target": F.lit(True)})
    )
    measured = _only_days_of(daily, targets, panel).withColumn("_target", F.lit(False))
    over = _earlier_years(panel.entity, "month_day")
    years = F.count(F.when(~F.col("_target"), F.col("year"))).over(over)
    return (
        measured.unionByName(spine, allowMissingColumns=True)
        .withColumns({**_day_history(panel, over), "years_count": years})
        .where(F.col("_target") & (F.col("years_count") > 0))
        .select(*keys, *day_history_columns(panel))
    )


def slot_history_for(fact: DataFrame, targets: DataFrame, panel: Panel) -> DataFrame:
    """Same-day-and-slot history for target keys, whether or not they were measured.

    Target rows carry no measures and are kept out of every count and share.
    """
    day = F.col(panel.date)
    parts = {"year": F.year(day), "month_day": month_day(day)}
    spine = targets.select(*panel.keys).distinct().withColumns({**parts, "_target": F.lit(True)})
    measured = _only_days_of(
        fact.select(*panel.keys, *panel.columns).withColumns(parts), targets, panel
    ).withColumn("_target", F.lit(False))
    over = _earlier_years(*panel.series, "month_day")
    history = _slot_history(panel, over, known=~F.col("_target"))
    return (
        measured.unionByName(spine, allowMissingColumns=True)
        .withColumns(history).where("_target")
        .select(*panel.keys, *slot_history_columns(panel))
    )
