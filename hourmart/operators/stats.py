"""Daily statistics and other plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourmart.functions.calendar import month_day
from hourmart.functions.numeric import wet_flag
from hourmart.model import TRAIN_QUANTILE, Panel


def daily_stats(fact: DataFrame, panel: Panel, within: tuple[str, ...] = ()) -> DataFrame:
    """Mean, sample deviation, min and max of each measure by entity and day.

    One hash aggregate with map-side combine; year and month-day are derived
    from the date afterwards instead of widening the grouping key. Where ``within``
    names them, rows that already lie together by them are not shuffled again.
    """
    stats = []
    for short, column in panel.measures:
        stats += [
            F.avg(column).alias(f"{short}_mean"), F.stddev_samp(column).alias(f"{short}_std"),
            F.min(column).alias(f"{short}_min"), F.max(column).alias(f"{short}_max"),
        ]
    if panel.wet_column:
        stats.append(F.sum(panel.wet_column).alias(f"{panel.wet}_total"))
    day = F.col(panel.date)
    parts = {"year": F.year(day), "month_day": month_day(day)}
    return (
        fact.groupBy(*within, panel.entity, panel.date).agg(*stats)
        .withColumns({n: c for n, c in parts.items() if n not in within})
    )


_MOMENTS = ("n", "mean", "m2", "min", "max", "sum")


def moments(fact: DataFrame, panel: Panel) -> DataFrame:
    """Per entity and day the moments of each measure: two of them can be merged into one.

    ``<short>_n`` counts known values, ``_mean`` is their mean, ``_m2`` the sum of squared
    deviations from it, beside ``_min``, ``_max`` and ``_sum``.
    """
    found = []
    for s, c in panel.measures:
        values = (F.count(c), F.avg(c), F.var_pop(c) * F.count(c), F.min(c), F.max(c), F.sum(c))
        found += [v.alias(f"{s}_{k}") for k, v in zip(_MOMENTS, values, strict=True)]
    return fact.groupBy(panel.entity, panel.date).agg(*found)


def merged_moments(old: DataFrame, new: DataFrame, panel: Panel) -> DataFrame:
    """Moments of both sides together; each side has one row per entity and day.

    The squared deviations are merged by the difference of the means, not from sums of squares,
    so nothing cancels out.
    """
    keys = [panel.entity, panel.date]
    joined = old.alias("o").join(new.alias("w"), keys, "full_outer")
    found = []
    for s, _ in panel.measures:
        a, b = ({k: F.col(f"{side}.{s}_{k}") for k in _MOMENTS} for side in "ow")
        na, nb = F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0))
        gap = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
        m2 = (F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0))
              + F.coalesce(F.try_divide(gap * gap * na * nb, na + nb), F.lit(0.0)))
        mean = F.coalesce(a["mean"] + F.try_divide(gap * nb, na + nb), a["mean"], b["mean"])
        together = (
            na + nb, mean, F.when(na + nb > 0, m2), F.least(a["min"], b["min"]), F.greatest(a["max"], b["max"]),
            F.coalesce(a["sum"] + b["sum"], a["sum"], b["sum"]))
        found += [v.alias(f"{s}_{k}") for k, v in zip(_MOMENTS, together, strict=True)]
    return joined.select(*keys, *found)


def stats_of_moments(rows: DataFrame, panel: Panel) -> DataFrame:
    """The daily statistics that moments stand for, as :func:`daily_stats` gives them."""
    found = []
    for s, _ in panel.measures:
        spread = F.when(F.col(f"{s}_n") > 1, F.sqrt(F.col(f"{s}_m2") / (F.col(f"{s}_n") - 1)))
        found += [F.col(f"{s}_mean"), spread.alias(f"{s}_std"), F.col(f"{s}_min"), F.col(f"{s}_max")]
    if panel.wet_column:
        found.append(F.col(f"{panel.wet}_sum").alias(f"{panel.wet}_total"))
    return rows.select(panel.entity, panel.date, *found)


def wet_share(value: Column, above: float) -> Column:
    """Share of wet rows; an unknown value counts as dry."""
    return F.avg(wet_flag(value, above).cast("double"))


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column the number of values, and their sum: lengths of texts, days since the epoch of dates.

    One aggregate per table; equal profiles mean equal contents for all but chance.
    """
    def value(name: str, kind: str) -> Column:
        column = F.col(name)
        if kind == "string":
            return F.length(column)
        return F.unix_date(column) if kind == "date" else column.cast("int") if kind == "boolean" else column

    found = []
    for table, df in tables.items():
        cells = F.array(*[
            F.struct(F.lit(name).alias("column"), value(name, kind).cast("double").alias("value")) for name, kind in df.dtypes])
        found.append(
            df.select(F.inline(cells)).groupBy("column")
            .agg(F.count("value").alias("n_known"), F.sum("value").alias("total"))
            .select(F.lit(table).alias("table"), "column", "n_known", "total"))
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table"), "row_count")
        for n, df in tables.items()
    ]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Number of distinct combinations of ``columns``."""
    return df.agg(F.count_distinct(F.struct(*columns)).alias("pairs"))


def split_date(rows: DataFrame, date: str, quantile: float = TRAIN_QUANTILE) -> DataFrame:
    """The day at a quantile of all rows, interpolated and rounded half up.

    The exact percentile counts occurrences per distinct day, so its state is
    bounded by the length of the calendar.
    """
    position = F.percentile(F.unix_date(date), quantile)
    day = F.date_from_unix_date(F.floor(position + 0.5).cast("int"))
    return rows.agg(day.alias("split_date"))


def year_bounds(rows: DataFrame, year: str = "year") -> DataFrame:
    return rows.agg(F.min(year).alias("min_year"), F.max(year).alias("max_year"))


def class_balance(rows: DataFrame, wet: Column) -> DataFrame:
    """Counts of both classes, dry-to-wet ratio and wet share."""
    flag = F.when(wet, 1).otherwise(0)
    counted = rows.agg(
        F.coalesce(F.sum(flag), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(1 - flag), F.lit(0)).alias("n_neg"))
    return counted.select(
        "n_pos", "n_neg",
        (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("scale_pos"),
        F.try_divide(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")).alias("wet_ratio"))


def regression_metrics(rows: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """MAE, RMSE and R2, over all rows or by group; rows lacking either side are left out."""
    error = F.col(actual) - F.col(predicted)
    known = rows.where(error.isNotNull())
    spread = F.var_pop(actual) * F.count(actual)
    metrics = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), spread)).alias("r2"),
    ]
    return (known.groupBy(*by) if by else known).agg(*metrics)


def classification_metrics(rows: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """Accuracy and the F1 of the positive class from 0/1 columns."""
    a, p = F.col(actual), F.col(predicted)
    tp = F.sum(a * p)
    wrong = F.sum(a * (1 - p)) + F.sum((1 - a) * p)
    metrics = [
        F.avg(F.when(a == p, 1.0).otherwise(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0)).alias("f1"),
    ]
    return (rows.groupBy(*by) if by else rows).agg(*metrics)


def error_metrics(errors: DataFrame, panel: Panel, *by: str) -> DataFrame:
    """MAE, RMSE and R2 per measure and the given columns, in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("target"), F.col(c).alias("actual"),
                 F.col(f"{c}_pred").alias("predicted"))
        for c in panel.columns])
    long = errors.select(*by, F.inline(pairs))
    return regression_metrics(long, "actual", "predicted", "target", *by)
