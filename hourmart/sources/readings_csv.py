"""Raw hourly readings from CSV files with a header row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hourmart.functions.numeric import null_if_nan
from hourmart.model import GAUGES

_BROKEN = "_broken_line"
_NAMES = ["district", "datetime", *GAUGES.columns]


def marked_readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as text, their converted values, and why a line is rejected.

    Columns are taken by position, whatever the header says. Fields are read as text and converted one by one, so a value that does not
    parse is told apart from one that is absent. A row is rejected, with a
    reason, if its line has the wrong number of fields, its name or timestamp
    is unusable, or a measure is not a number. NaN measures become NULL.
    """
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*_NAMES, _BROKEN]])
    lines = (
        spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    when = F.col("datetime").try_cast("timestamp_ntz")
    numbers = {c: F.col(c).try_cast("double") for c in GAUGES.columns}
    bad_number = [
        F.when(F.col(c).isNotNull() & n.isNull(), F.lit(c)) for c, n in numbers.items()]
    reason = F.coalesce(
        F.when(F.col(_BROKEN).isNotNull(), F.lit("line")),
        F.when(F.col("district").isNull(), F.lit("district")),
        F.when(when.isNull(), F.lit("datetime")),
        *bad_number)
    kept = F.struct("district", when.alias("datetime"), *[null_if_nan(n).alias(c) for c, n in numbers.items()])
    return lines.select(
        F.when(reason.isNull(), kept).alias("reading"),
        F.when(reason.isNotNull(), F.struct(*_NAMES, reason.alias("reason"))).alias("reject"))


def split_readings(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings, and rejected lines with their reason."""
    return (marked.where(F.col("reading").isNotNull()).select("reading.*"),
            marked.where(F.col("reject").isNotNull()).select("reject.*"))
