"""CSV to star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hourmart.model import FACT_HOURLY, GAUGES, Panel
from hourmart.operators.dims import dim_date, dim_entity, dim_hour
from hourmart.operators.facts import dedup_fact, load_fact, star_view
from hourmart.session import written
from hourmart.sources.readings_csv import marked_readings, split_readings
from hourmart.sources.tables import Warehouse

_KEYED = Panel(entity="district_id", date="date_id", slot="hour_id", measures=GAUGES.measures)


def extract(warehouse: Warehouse, csv_path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Load CSV files into staging; rejected lines are kept beside it.

    The text is parsed once: marked rows are written, and both tables come from there.
    """
    readings, rejects = split_readings(written(marked_readings(warehouse.spark, csv_path), "marked"))
    return (
        warehouse.refresh("staging/raw_weather", readings),
        warehouse.refresh("staging/raw_weather_rejects", rejects),
    )


def load_star(warehouse: Warehouse, readings: DataFrame) -> None:
    """Dimensions, then the fact, from staged readings.

    Dimensions are stored before the fact joins them, so their sizes are known.
    Forecasts are keyed by name and date and are not touched by a reload. The
    fact is stored by year, dealt out by ranges of days, so that a day lies in a few
    files, and sorted by day inside them, one row per key.
    """
    named = readings.withColumnRenamed("district", "district_name")
    districts = warehouse.refresh("dw/dim_district", dim_entity(named, "district_name"))
    dates = warehouse.refresh("dw/dim_date", dim_date(readings, "datetime"))
    warehouse.refresh("dw/dim_hour", dim_hour(warehouse.spark))

    fact = dedup_fact(load_fact(readings, districts, dates, GAUGES.columns), _KEYED)
    keyed = fact.join(dates.select("date_id", "full_date", "year"), "date_id")
    keyed = keyed.select(*FACT_HOURLY.names)
    warehouse.refresh(
        "dw/fact_weather_hourly", keyed, partition_by=["year"], sort_by=["full_date"],
        range_by=["year", "full_date"])


def actual_rows(warehouse: Warehouse) -> DataFrame:
    """The fact with dimension attributes, as features and reports read it.

    Day and year come from the stored fact, so filters on them prune its
    folders and row groups.
    """
    return star_view(
        warehouse.read("dw/fact_weather_hourly"), warehouse.read("dw/dim_district"),
        warehouse.read("dw/dim_date").drop("full_date", "year"), warehouse.read("dw/dim_hour"))


def run_etl(warehouse: Warehouse, csv_path: str | list[str]) -> None:
    readings, _ = extract(warehouse, csv_path)
    load_star(warehouse, readings)
