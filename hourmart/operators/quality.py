"""Row rules that guard the forecast table: validate, repair, stamp, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hourmart.functions.numeric import is_true
from hourmart.model import (
    AUDIT_RAIN, AUDIT_TEMPERATURE, HUMIDITY_RANGE, TEMPERATURE_RANGE,
)


@dataclass(frozen=True)
class RangeRule:
    """Values below ``low`` or above ``high`` are rejected; NULL passes."""

    name: str
    column: str
    low: float
    high: float

    @property
    def broken(self) -> Column:
        value = F.col(self.column)
        return is_true((value < self.low) | (value > self.high))


class RejectedRows(ValueError):
    """Raised in strict mode when a batch holds rows that break a rule."""


RULES = (
    RangeRule("temperature", "temperature_c", *TEMPERATURE_RANGE),
    RangeRule("humidity", "humidity_percent", *HUMIDITY_RANGE),
)


def _reason(rules: tuple[RangeRule, ...]) -> Column:
    """Name of the first broken rule, or NULL."""
    names = [F.when(r.broken, F.lit(r.name)) for r in rules]
    return F.coalesce(F.lit(None).cast("string"), *names)


def marked(rows: DataFrame, rules: tuple[RangeRule, ...] = RULES) -> DataFrame:
    """Rows with the first rule they break as ``reason``; NULL for those that keep every rule."""
    return rows.withColumn("reason", _reason(rules))


def split_marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without ``reason``, and rejected rows with it."""
    return (rows.where(F.col("reason").isNull()).drop("reason"),
            rows.where(F.col("reason").isNotNull()))


def validate(rows: DataFrame, rules: tuple[RangeRule, ...] = RULES, strict: bool = False
             ) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the first rule they break.

    ``strict`` raises instead of setting rows aside, as a statement would abort.
    """
    accepted, rejected = split_marked(marked(rows, rules))
    if strict:
        broken = rejected.count()
        if broken:
            raise RejectedRows(f"{broken} rows are out of range")
    return accepted, rejected


def repair(rows: DataFrame, rain: str = "rain_mm") -> DataFrame:
    """Negative rain becomes 0; NULL stays."""
    return rows.withColumn(rain, F.when(F.col(rain) < 0, 0.0).otherwise(F.col(rain)))


def touch(rows: DataFrame, as_of: Column, column: str = "updated_at") -> DataFrame:
    """Stamp written rows."""
    return rows.withColumn(column, as_of)


def change_audit(old: DataFrame, new: DataFrame, keys: list[str], changed_at: Column,
                 temp: str = "temperature_c", rain: str = "rain_mm") -> DataFrame:
    """Keys present on both sides whose temperature or rain moved beyond its threshold."""
    before = old.select(*keys, F.col(temp).alias(f"old_{temp}"), F.col(rain).alias(f"old_{rain}"))
    after = new.select(*keys, F.col(temp).alias(f"new_{temp}"), F.col(rain).alias(f"new_{rain}"))
    warmer = F.abs(F.col(f"new_{temp}") - F.col(f"old_{temp}")) > AUDIT_TEMPERATURE
    wetter = F.abs(F.col(f"new_{rain}") - F.col(f"old_{rain}")) > AUDIT_RAIN
    return (
        before.join(after, keys).where(is_true(warmer) | is_true(wetter))
        .select(*keys, f"old_{temp}", f"new_{temp}", f"old_{rain}", f"new_{rain}",
                changed_at.alias("changed_at"))
    )
