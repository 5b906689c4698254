"""Batch scoring, chained multi-day forecasts, backfill and forecast errors."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from hourmart.functions.numeric import score_round
from hourmart.model import (
    FORECAST_DAYS, LAG_DAYS, MAX_FORECAST_DAYS, MAX_RANGE_DAYS, Panel,
)
from hourmart.operators.quality import (
    RULES, RangeRule, change_audit, marked, repair, split_marked, touch,
)
from hourmart.operators.serving import (
    coverage_by_day, day_spine, last_date, prefer_actual, slot_spine,
)
from hourmart.plans.features import serving_features_for_day
from hourmart.plans.scoring import PROBABILITY, Scorer
from hourmart.session import written
from hourmart.sources.tables import Warehouse

FORECAST, AUDIT, REJECTS = (
    "dw/fact_weather_forecast", "dw/forecast_history", "dw/forecast_rejects")


def check_date(value: str | date) -> date:
    """A date given as such or as YYYY-MM-DD."""
    return value if isinstance(value, date) else date.fromisoformat(value)


def check_days(days: int, most: int = MAX_FORECAST_DAYS) -> int:
    if not 1 <= days <= most:
        raise ValueError(f"number of days must be 1..{most}, not {days}")
    return days


@dataclass
class ForecastJob:
    """Where a forecast reads from and writes to.

    ``entities`` has the panel's entity and entity id; ``actual`` one measured
    row per key; ``daily`` its daily statistics. All are stored tables, so each
    forecast day starts from files and no lineage grows with the horizon.
    """

    warehouse: Warehouse
    models: Scorer
    entities: DataFrame
    actual: DataFrame
    daily: DataFrame
    rules: tuple[RangeRule, ...] = RULES
    slots: int = 24

    @property
    def panel(self) -> Panel:
        return self.models.panel

    @cached_property
    def first_year(self) -> int | None:
        """The earliest year there is history for."""
        return self.daily.agg(F.min(F.year(self.panel.date))).first()[0]

    def forecasts(self) -> DataFrame:
        return self.warehouse.read(FORECAST, self._schema())

    def _schema(self):
        known = self.actual.select(*self.panel.keys, *self.panel.columns)
        return known.withColumns({
            "rain_probability": F.lit(0.0), "predicted_at": F.current_timestamp(),
            "updated_at": F.current_timestamp()}).schema


def known_entities(requests: DataFrame, entities: DataFrame, panel: Panel
                   ) -> tuple[DataFrame, DataFrame]:
    """Requested entities with their id, and an error row for each unknown one."""
    wanted = requests.select(panel.entity).distinct()
    errors = (
        wanted.join(entities, panel.entity, "left_anti")
        .withColumn("error", F.lit("unknown entity")))
    return wanted.join(entities, panel.entity), errors


def _between(rows: DataFrame, panel: Panel, start: date, end: date) -> DataFrame:
    """Days from start up to but not including end; prunes by year where rows have it."""
    day = F.col(panel.date)
    found = rows.where((day >= F.lit(start)) & (day < F.lit(end)))
    if "year" in rows.columns:
        found = found.where(F.col("year").between(start.year, end.year))
    return found


def _same_day_before(rows: DataFrame, panel: Panel, day: date, first_year: int | None
                     ) -> DataFrame:
    """The same calendar day of each earlier year.

    Written as one equality per year, all of which reach the scan, so a table
    sorted by day gives up a few row groups instead of its whole history.
    """
    found = F.lit(False)
    for year in range(first_year or day.year, day.year):
        try:
            found = found | (F.col(panel.date) == F.lit(day.replace(year=year)))
        except ValueError:      # 29 February of a common year
            continue
    return rows.where(found)


def predict_day(job: ForecastJob, day: date, entities: DataFrame | None = None) -> DataFrame:
    """Scores for all entities and slots of one day, rounded as they are stored."""
    panel = job.panel
    entities = job.entities if entities is None else entities
    if panel.slot:
        targets = slot_spine(entities, day, day, panel, job.slots)
    else:
        targets = day_spine(entities, day, day, panel)
    start = day - timedelta(days=LAG_DAYS)
    source = prefer_actual(
        _between(job.actual, panel, start, day), _between(job.forecasts(), panel, start, day),
        panel)
    fact, daily = (
        _same_day_before(rows, panel, day, job.first_year) for rows in (job.actual, job.daily))
    features = serving_features_for_day(
        targets, day, source, fact, daily, panel)
    scored = job.models.score(features, panel.keys)
    columns = [score_round(F.col(f"{c}_pred"), 2).alias(c) for c in panel.columns]
    chance = F.lit(None).cast("double")
    if job.models.gives_chance:
        chance = score_round(F.col(PROBABILITY) * 100, 1)
    return scored.select(*panel.keys, *columns, chance.alias("rain_probability"))


@dataclass(frozen=True)
class SavedDay:
    """One day as it was saved: all scored rows with their ``reason``, and what was counted meanwhile.

    ``scored`` and ``rejected`` are rows, ``pairs`` the (entity, day) pairs among the scored ones.
    """

    rows: DataFrame
    scored: int
    rejected: int
    pairs: int

    @property
    def rejects(self) -> DataFrame:
        return split_marked(self.rows)[1]


def save_day(job: ForecastJob, scored: DataFrame, as_of: datetime) -> SavedDay:
    """Replace the forecast of each (entity, day) in ``scored``.

    Rows are validated and written once; the counts of a run and the digest that names the batch
    are observed while they are written, so no further pass is made for them. Rejected rows and what
    the new rows change beyond the thresholds are stored first, then the day's partition is
    rewritten. Run again with the same rows and ``as_of``, it changes nothing.
    """
    panel, seen = job.panel, Observation()
    # a pair is counted at its first slot; the digest names the batch by the keys it is for, so other
    # entities of that day are another batch
    first = F.col(panel.slot) == 0 if panel.slot else F.lit(True)
    checked = marked(scored, job.rules).observe(
        seen, F.count(F.lit(1)).alias("scored"), F.count("reason").alias("rejected"),
        F.count_if(first).alias("pairs"),
        F.coalesce(F.sum(F.xxhash64(*panel.keys).cast("decimal(38,0)")), F.lit(0)).alias("digest"))
    checked = written(checked, "scored")
    counts = seen.get
    stamp, name = F.lit(as_of), f"forecast {as_of:%F %T} of {counts['digest']}"
    accepted, rejected = split_marked(checked)
    if panel.wet_column:
        accepted = repair(accepted, panel.wet_column)
    rows = written(
        touch(touch(accepted, stamp, "predicted_at"), stamp, "updated_at"), "forecast")
    temp = dict(panel.measures).get("temp")
    if temp and panel.wet_column:
        old = job.warehouse.touched(FORECAST, rows, panel.date)
        changes = change_audit(old, rows, panel.keys, stamp, temp, panel.wet_column)
        job.warehouse.write_once(AUDIT, changes, name)
    job.warehouse.write_once(REJECTS, rejected, name)
    job.warehouse.replace(FORECAST, rows, [panel.entity, panel.date], panel.date)
    return SavedDay(checked, counts["scored"], counts["rejected"], counts["pairs"])


def _saved_days(job: ForecastJob, start: date, days: int, as_of: datetime,
                entities: DataFrame | None) -> list[SavedDay]:
    """Consecutive days; each reads the ones before it as lags, so they follow one another."""
    return [save_day(job, predict_day(job, start + timedelta(days=i), entities), as_of)
            for i in range(days)]


def _stored(job: ForecastJob, start: date, days: int, entities: DataFrame | None) -> DataFrame:
    day, last = F.col(job.panel.date), start + timedelta(days=days - 1)
    stored = job.forecasts().where((day >= F.lit(start)) & (day <= F.lit(last)))
    if entities is not None:
        stored = stored.join(entities.select(job.panel.entity), job.panel.entity, "left_semi")
    return stored


def predict_range(job: ForecastJob, start: str | date, days: int, as_of: datetime,
                  entities: DataFrame | None = None, most: int = MAX_RANGE_DAYS) -> DataFrame:
    """Forecast consecutive days; the result is what is stored for them afterwards."""
    start, days = check_date(start), check_days(days, most)
    _saved_days(job, start, days, as_of, entities)
    return _stored(job, start, days, entities)


@dataclass(frozen=True)
class BatchResult:
    """What a batch did.

    ``stored``: the forecasts kept. ``details``: temperature range and rain total of each scored
    (entity, day), and how many of its rows were rejected. ``rejected``: rejected rows with their
    reason. ``errors``: an unknown name on each day asked for. ``totals``: one row, counted while the
    batch was written.
    """

    stored: DataFrame
    details: DataFrame
    rejected: DataFrame
    errors: DataFrame
    totals: DataFrame


def run_batch(job: ForecastJob, base_date: str | date | None, as_of: datetime,
              days: int = FORECAST_DAYS, requests: DataFrame | None = None) -> BatchResult:
    """The days after ``base_date`` (default: the last measured day).

    ``requests`` has the entity names asked for (default: all that are known). Names nobody knows
    end up in ``errors`` and count as failed.
    """
    days, panel = check_days(days), job.panel
    if base_date is None:
        base_date = last_date(job.actual, panel.date, as_of.date()).first()[0]
    start = check_date(base_date) + timedelta(days=1)
    known, unknown, failed = None, None, 0
    if requests is not None:
        found, missing = known_entities(requests, job.entities, panel)
        known, unknown = written(found, "known"), written(missing, "unknown")
        failed = days * unknown.count()
    saved = _saved_days(job, start, days, as_of, known)
    rows = reduce(DataFrame.unionByName, [day.rows for day in saved])
    if unknown is None:
        unknown = job.entities.limit(0).select(panel.entity, F.lit("").alias("error"))
    errors = day_spine(unknown, start, start + timedelta(days=days - 1), panel)
    pairs = sum(day.pairs for day in saved)
    totals = job.warehouse.spark.range(1).select(
        F.lit(days).alias("forecast_days"), F.lit(pairs + failed).cast("long").alias("total_forecasts"),
        F.lit(pairs).cast("long").alias("success"), F.lit(failed).cast("long").alias("errors"),
        F.lit(sum(day.scored for day in saved)).cast("long").alias("rows_scored"),
        F.lit(sum(day.rejected for day in saved)).cast("long").alias("rows_rejected"))
    details = batch_details(rows, panel, F.count("reason").alias("rows_rejected"))
    return BatchResult(
        _stored(job, start, days, known), details, split_marked(rows)[1], errors, totals)


def run_if_needed(job: ForecastJob, base_date: str | date, as_of: datetime,
                  days: int = FORECAST_DAYS) -> BatchResult | None:
    """Forecast the days after ``base_date`` if any entity lacks one of them, else None."""
    base = check_date(base_date)
    coverage = coverage_by_day(
        job.entities, job.forecasts(), base + timedelta(days=1), base + timedelta(days=days),
        job.panel)
    if coverage.where("missing").isEmpty():
        return None
    return run_batch(job, base, as_of, days)


def batch_details(scored: DataFrame, panel: Panel, *more: Column) -> DataFrame:
    """Temperature range and rain total per entity and day of a batch, and further aggregates."""
    columns = dict(panel.measures)
    return scored.groupBy(panel.entity, panel.date).agg(
        score_round(F.min(columns["temp"]), 1).alias("temp_min"),
        score_round(F.max(columns["temp"]), 1).alias("temp_max"),
        score_round(F.sum(columns["rain"]), 2).alias("rain_total"), *more)


def batch_totals(scored: DataFrame, errors: DataFrame, panel: Panel) -> DataFrame:
    """Requested, succeeded and failed (entity, day) pairs; unknown names count as failed."""
    done = scored.agg(F.count_distinct(F.struct(panel.entity, panel.date))).scalar()
    failed = errors.agg(F.count(F.lit(1))).scalar()
    counts = scored.sparkSession.range(1).select(
        done.alias("success"), failed.alias("errors"))
    return counts.withColumn("total_forecasts", F.col("success") + F.col("errors"))


def forecast_errors(forecast: DataFrame, actual: DataFrame, panel: Panel) -> DataFrame:
    """Forecast and measured values of the same key, with their differences."""
    left = forecast.select(*panel.keys, *[F.col(c).alias(f"{c}_pred") for c in panel.columns])
    right = actual.select(*panel.keys, *panel.columns)
    return left.join(right, panel.keys).withColumns({
        f"{c}_error": F.col(f"{c}_pred") - F.col(c) for c in panel.columns})
