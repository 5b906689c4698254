"""The wide training table, the stored feature tables, and serving features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourmart.functions.calendar import with_calendar, with_cyclic
from hourmart.functions.numeric import wet_flag
from hourmart.model import (
    GAUGES, Panel, cyclic_columns, day_history_columns, feature_columns, flag_columns,
    lag_columns, rolling_columns, slot_history_columns,
)
from hourmart.operators.history import (
    CALENDAR_DAY, by_calendar_day, day_history_for, same_day_history, same_slot_history, slot_history_for,
    with_day_history, with_slot_history,
)
from hourmart.operators.lags import calendar_lags, lags_for, lags_for_day, with_flags, with_rolling
from hourmart.operators.stats import daily_stats
from hourmart.plans.etl import actual_rows
from hourmart.sources.tables import Warehouse


def training_table(fact: DataFrame, daily: DataFrame, panel: Panel) -> DataFrame:
    """One row per fact row with calendar, history, lag, flag and target columns.

    Slot history and lags are windows over the fact itself, so the fact is read
    once and joined only to the far smaller daily history. If fact and daily rows lie
    together by entity and calendar day, neither history shuffles them. The step that adds
    the most columns comes last, which keeps the earlier shuffles narrow.
    """
    rows = with_calendar(fact, panel)
    if panel.slot:
        rows = with_slot_history(rows, panel)
    rows = with_day_history(rows, daily, panel)
    rows = with_flags(calendar_lags(rows, panel), panel)
    rows = with_cyclic(rows, panel)
    carried = [c for c in (panel.entity_id,) if c in fact.columns]
    columns = [
        *carried, *panel.keys,
        "year", "month", "day", "day_of_year", "day_of_week", "is_weekend", "month_day",
        *cyclic_columns(panel), *day_history_columns(panel),
        *(slot_history_columns(panel) if panel.slot else []),
        *lag_columns(panel), *flag_columns(panel), *panel.columns,
    ]
    rows = rows.select(*columns)
    if panel.wet_column:
        rows = rows.withColumn("is_rainy", wet_flag(F.col(panel.wet_column), panel.wet_above))
    return rows


def model_rows(table: DataFrame, panel: Panel) -> DataFrame:
    """Training table with rolling features, only rows where nothing is missing.

    Rolling columns are known wherever all lags are, so rows are dropped before
    they are computed.
    """
    rolling = set(rolling_columns(panel))
    required = [c for c in feature_columns(panel) if c not in rolling]
    return with_rolling(table.dropna(subset=[*required, *panel.columns]), panel)


def serving_features(targets: DataFrame, source: DataFrame, fact: DataFrame, daily: DataFrame,
                     panel: Panel) -> DataFrame:
    """The model inputs for target keys, by the same functions training uses.

    ``source`` gives the lags (actual over forecast); ``fact`` and ``daily``
    give the history, which is computed for the target itself and so exists
    for days not measured yet. ``targets`` may carry the entity id.
    """
    return _assemble(targets, lags_for(source, targets, panel), fact, daily, panel, panel.keys)


def serving_features_for_day(targets: DataFrame, day, source: DataFrame, fact: DataFrame,
                             daily: DataFrame, panel: Panel) -> DataFrame:
    """The same for targets that all fall on one day: the lags are a pivot of seven days."""
    lags = lags_for_day(source, panel, day)
    return _assemble(targets, lags, fact, daily, panel, panel.series)


def _assemble(targets, lags, fact, daily, panel: Panel, lag_keys: list[str]) -> DataFrame:
    rows = targets.join(lags, lag_keys, "left")
    rows = rows.join(
        day_history_for(daily, targets, panel), [panel.entity, panel.date], "left")
    if panel.slot:
        rows = rows.join(slot_history_for(fact, targets, panel), panel.keys, "left")
    rows = with_cyclic(with_calendar(rows, panel), panel)
    return with_rolling(with_flags(rows, panel), panel)


def build_feature_tables(warehouse: Warehouse, panel: Panel = GAUGES) -> None:
    """Daily statistics, both histories and the training table, each stored once.

    The fact is shuffled once, into buckets by entity and calendar day. Statistics and histories come
    from there without another shuffle; only lags, which run along the days, need their own.
    """
    fact = actual_rows(warehouse).select(panel.entity_id, *panel.keys, *panel.columns)
    rows = warehouse.refresh_buckets(
        "features/calendar_rows", by_calendar_day(fact, panel), [panel.entity, "month_day"])
    daily = daily_stats(rows, panel, CALENDAR_DAY)
    warehouse.refresh(
        "features/agg_daily_weather", daily, partition_by=["year"], sort_by=[panel.date])
    warehouse.refresh("features/agg_historical_same_day", same_day_history(daily, panel))
    warehouse.refresh(
        "features/agg_historical_same_day_hour", same_slot_history(rows, panel))
    warehouse.refresh(
        "features/mv_training_features", training_table(rows, daily, panel),
        partition_by=["year"], sort_by=[panel.date])
