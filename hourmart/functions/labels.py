"""Text shown to readers: condition labels and display names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The label texts and their thresholds.
#   rain  > 5    Mua to
#   rain  > 1    Mua nhe
#   rain  > 0.1  Mua phun
#   prob  > 40   Co the mua (N%)
#   temp  > 33   Nang nong
#   temp  > 28   Nang
#   else         Mat me
#   hum   > 85   do am cao
#   wind  > 15   gio manh
#   wind  > 10   gio vua


def describe(temp: Column, hum: Column, wind: Column, rain: Column, prob: Column) -> Column:
    """One condition, then humidity and wind remarks, comma-separated."""
    chance = F.coalesce(prob, F.lit(0.0))
    percent = F.bround(chance, 0).cast("int").cast("string")
    sky = (
        F.when(rain > 5, "Mua to")
        .when(rain > 1, "Mua nhe")
        .when(rain > 0.1, "Mua phun")
        .when(chance > 40, F.concat(F.lit("Co the mua ("), percent, F.lit("%)")))
        .when(temp > 33, "Nang nong")
        .when(temp > 28, "Nang")
        .otherwise("Mat me")
    )
    air = F.when(hum > 85, "do am cao")
    breeze = F.when(wind > 15, "gio manh").when(wind > 10, "gio vua")
    return F.concat_ws(", ", sky, air, breeze)


def display_name(name: Column) -> Column:
    return F.translate(name, "_", " ")
