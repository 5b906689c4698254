"""Exact calendar lags and the row-wise features built on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourmart.functions.numeric import known_count, row_mean, row_std, total, wet_flag
from hourmart.model import (
    FLAG_LAGS, LAG_DAYS, LONG_SPAN, SHORT_SPAN, Panel, flag_columns, rolling_columns,
)

BLOCK_DAYS = 64


def _over_blocks(rows: DataFrame, panel: Panel, reach: int, block_days: int, columns
                 ) -> DataFrame:
    """Window columns that look back at most ``reach`` days, one shuffle for all of them.

    A series is cut into blocks of ``block_days``; the last ``reach`` days of a
    block are also sent to the next one as lead-in. No task needs more than
    ``block_days + reach`` rows of a series, and a long or dominant series
    spreads over its blocks. ``columns`` maps the series window to expressions.
    """
    if block_days < reach:
        raise ValueError("a block must be at least as long as the reach")
    day = F.unix_date(panel.date)
    own = F.floor(day / block_days).cast("int")
    is_tail = F.pmod(day, F.lit(block_days)) >= block_days - reach
    blocks = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
    cut = rows.withColumns({"_day": day, "_own": own}).withColumn("_block", F.explode(blocks))
    series = Window.partitionBy(*panel.series, "_block").orderBy("_day")
    found = cut.withColumns(columns(series)).where(F.col("_block") == F.col("_own"))
    return found.drop("_day", "_own", "_block")


def calendar_lags(rows: DataFrame, panel: Panel, horizon: int = LAG_DAYS,
                  block_days: int = BLOCK_DAYS) -> DataFrame:
    """Every measure exactly 1..horizon calendar days earlier in the same series.

    ``rows`` has one row per key; a missing day gives NULL, never the nearest day.
    """
    def lags(series):
        return {
            panel.lag(n, short): F.first(column).over(series.rangeBetween(-n, -n))
            for n in range(1, horizon + 1) for short, column in panel.measures}

    return _over_blocks(rows, panel, horizon, block_days, lags)


def calendar_lags_join(rows: DataFrame, panel: Panel, horizon: int = LAG_DAYS) -> DataFrame:
    """The same result by one self-join per lag on the shifted date."""
    result = rows
    for n in range(1, horizon + 1):
        shifted = rows.select(
            *panel.series, F.date_add(panel.date, n).alias(panel.date),
            *[F.col(c).alias(panel.lag(n, s)) for s, c in panel.measures])
        result = result.join(shifted, panel.keys, "left")
    return result


def lags_for_day(history: DataFrame, panel: Panel, target_date: date | str,
                 horizon: int = LAG_DAYS) -> DataFrame:
    """Lags of one target day, one row per series: the last days pivoted by distance.

    The half-open date range reaches the scan, so only those days are read.
    """
    target = F.lit(target_date).cast("date")
    day = F.col(panel.date)
    recent = history.where((day >= F.date_sub(target, horizon)) & (day < target))
    days_back = F.date_diff(target, day)
    lags = [
        F.max(F.when(days_back == n, F.col(c))).alias(panel.lag(n, s))
        for n in range(1, horizon + 1) for s, c in panel.measures
    ]
    return recent.groupBy(*panel.series).agg(*lags)


def lags_for(history: DataFrame, targets: DataFrame, panel: Panel, horizon: int = LAG_DAYS
             ) -> DataFrame:
    """Lags for any set of target keys, whether or not they were measured.

    Only the days the targets can look back on are read from ``history``.
    """
    spine = targets.select(*panel.keys).distinct().withColumn("_target", F.lit(True))
    day = F.col(panel.date)
    # both bounds from one pass over the targets
    bounds = targets.agg(F.struct(
        F.date_sub(F.min(panel.date), horizon).alias("first"), F.max(panel.date).alias("last"))).scalar()
    known = history.select(*panel.keys, *panel.columns).where(
        day.between(bounds.getField("first"), bounds.getField("last")))
    rows = known.join(spine, panel.keys, "full_outer")
    lagged = calendar_lags(rows, panel, horizon)
    return lagged.where("_target").drop("_target", *panel.columns)


def lags_at(rows: DataFrame, panel: Panel, is_target: Column, horizon: int = LAG_DAYS) -> DataFrame:
    """Lags of those rows of a history that are targets themselves: no join, no second read."""
    columns = [*panel.keys, *[panel.lag(n, s) for n in range(1, horizon + 1) for s, _ in panel.measures]]
    lagged = calendar_lags(rows.withColumn("_target", is_target), panel, horizon)
    return lagged.where("_target").select(*columns)


def with_flags(df: DataFrame, panel: Panel) -> DataFrame:
    """Wet flags of the nearest lags; an unknown lag counts as dry."""
    names = flag_columns(panel)
    return df.withColumns({
        name: wet_flag(F.col(panel.lag(n, panel.wet)), panel.wet_above)
        for n, name in enumerate(names, start=1)
    }) if names else df


def with_rolling(df: DataFrame, panel: Panel) -> DataFrame:
    """Rolling means, deviation, trend and recent wet count from the lag columns.

    Plain arithmetic on the row, so training and serving share it and it stays
    in generated code. Counts and means are columns of a first step, which the
    deviations of the second step refer to instead of repeating them.
    """
    spans = {
        (s, span): [F.col(panel.lag(n, s)) for n in range(1, span + 1)]
        for s, _ in panel.measures for span in (SHORT_SPAN, LONG_SPAN)}
    counted = df.withColumns({
        f"_known_{span}_{s}": known_count(lags) for (s, span), lags in spans.items()})
    averaged = counted.withColumns({
        f"rolling_{span}d_{s}_mean": row_mean(lags, F.col(f"_known_{span}_{s}"))
        for (s, span), lags in spans.items()})
    found = {}
    for s, _ in panel.measures:
        near = spans[s, SHORT_SPAN]
        found[f"rolling_{SHORT_SPAN}d_{s}_std"] = row_std(
            near, F.col(f"_known_{SHORT_SPAN}_{s}"), F.col(f"rolling_{SHORT_SPAN}d_{s}_mean"))
        found[f"trend_{SHORT_SPAN}d_{s}"] = near[0] - near[-1]
    flags = flag_columns(panel)
    if flags:
        found["recent_rain_count"] = total([F.col(c) for c in flags])
    return averaged.withColumns(found).select(*df.columns, *rolling_columns(panel))


def rolling_by_frames(rows: DataFrame, panel: Panel, block_days: int = BLOCK_DAYS) -> DataFrame:
    """The rolling columns straight from date-range frames, without lag columns."""
    def columns(series):
        near, far = series.rangeBetween(-SHORT_SPAN, -1), series.rangeBetween(-LONG_SPAN, -1)
        found = {}
        for s, c in panel.measures:
            found[f"rolling_{SHORT_SPAN}d_{s}_mean"] = F.avg(c).over(near)
            found[f"rolling_{LONG_SPAN}d_{s}_mean"] = F.avg(c).over(far)
            found[f"rolling_{SHORT_SPAN}d_{s}_std"] = F.stddev_samp(c).over(near)
            found[f"trend_{SHORT_SPAN}d_{s}"] = (
                F.first(c).over(series.rangeBetween(-1, -1))
                - F.first(c).over(series.rangeBetween(-SHORT_SPAN, -SHORT_SPAN)))
        if panel.wet_column:
            flag = wet_flag(F.col(panel.wet_column), panel.wet_above)
            frame = series.rangeBetween(-FLAG_LAGS, -1)
            found["recent_rain_count"] = F.coalesce(F.sum(flag).over(frame), F.lit(0))
        return found

    return _over_blocks(rows, panel, LONG_SPAN, block_days, columns)
