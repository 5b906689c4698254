"""Null-aware arithmetic: rounding, clipping, flags and row-wise statistics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F


def _decimal(value: Column) -> Column:
    """Six decimals: enough for measures, and blind to the order of summation."""
    return value.cast("decimal(18,6)")


def report_round(value: Column, digits: int) -> Column:
    """Half away from zero, as SQL reports round."""
    return F.round(_decimal(value), digits).cast("double")


def score_round(value: Column, digits: int) -> Column:
    """Half to even, as scored values and documents round."""
    return F.bround(_decimal(value), digits).cast("double")


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds on a value; NULL stays NULL (greatest/least would skip it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(F.lit(low), bounded)
    if high is not None:
        bounded = F.least(F.lit(high), bounded)
    return F.when(value.isNotNull(), bounded)


def null_if_nan(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it must not reach a threshold."""
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: null_if_nan(F.col(c)) for c in columns})


def wet_flag(value: Column, above: float) -> Column:
    """1 when strictly above; 0 when not or unknown."""
    return F.when(value > above, 1).otherwise(0)


def is_true(predicate: Column) -> Column:
    """A predicate where unknown counts as false."""
    return F.coalesce(predicate, F.lit(False))


def total(values: list[Column]) -> Column:
    return reduce(add, values)


def known_count(values: list[Column]) -> Column:
    return total([F.when(v.isNotNull(), 1).otherwise(0) for v in values])


def row_mean(values: list[Column], known: Column) -> Column:
    """Mean over the ``known`` number of values that are not NULL; NULL when none is."""
    return F.try_divide(total([F.coalesce(v, F.lit(0.0)) for v in values]), known.cast("double"))


def row_std(values: list[Column], known: Column, mean: Column) -> Column:
    """Sample deviation over the values that are not NULL; NULL below two of them."""
    squares = total([F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values])
    return F.when(known > 1, F.sqrt(squares / F.greatest(known - 1, F.lit(1))))
