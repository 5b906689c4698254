"""Calendar parts, cyclic encodings and date formatting as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourmart.model import DAYS_PER_YEAR, MONTHS_PER_YEAR, Panel


def month_day(date: Column) -> Column:
    """month * 100 + day: equal for the same calendar day of different years."""
    return F.month(date) * 100 + F.dayofmonth(date)


def iso_weekday(date: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(date) + 1


def calendar_parts(date: Column) -> dict[str, Column]:
    """Every attribute of the date dimension, by column name."""
    return {
        "year": F.year(date).cast("smallint"),
        "month": F.month(date).cast("smallint"),
        "day": F.dayofmonth(date).cast("smallint"),
        "day_of_year": F.dayofyear(date).cast("smallint"),
        "day_of_week": iso_weekday(date).cast("smallint"),
        "week_of_year": F.weekofyear(date).cast("smallint"),
        "quarter": F.quarter(date).cast("smallint"),
        "month_name": F.date_format(date, "MMMM"),
        "is_weekend": iso_weekday(date).isin(6, 7),
        "month_day": month_day(date).cast("smallint"),
    }


def period_of_day(hour: Column) -> Column:
    return (
        F.when(hour < 6, "Night").when(hour < 12, "Morning")
        .when(hour < 18, "Afternoon").otherwise("Evening")
    )


def _turn(value: Column, period: float) -> Column:
    return F.lit(2.0) * F.pi() * value / F.lit(period)


def cyclic_parts(panel: Panel, date: Column) -> dict[str, Column]:
    """Sine/cosine pairs for hour, day of year and month."""
    phases = {}
    if panel.slot:
        phases["hour"] = _turn(F.col(panel.slot), panel.slot_period)
    phases["doy"] = _turn(F.dayofyear(date), DAYS_PER_YEAR)
    phases["month"] = _turn(F.month(date), MONTHS_PER_YEAR)
    parts = {}
    for name, angle in phases.items():
        parts[f"{name}_sin"] = F.sin(angle)
        parts[f"{name}_cos"] = F.cos(angle)
    return parts


def with_calendar(df: DataFrame, panel: Panel) -> DataFrame:
    """The calendar parts that ``df`` does not have yet."""
    parts = calendar_parts(F.col(panel.date))
    return df.withColumns({n: c for n, c in parts.items() if n not in df.columns})


def with_cyclic(df: DataFrame, panel: Panel) -> DataFrame:
    return df.withColumns(cyclic_parts(panel, F.col(panel.date)))


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def clock_hour(hour: Column) -> Column:
    """``HH:00``"""
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))
