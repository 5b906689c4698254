"""Model fitting, scoring and chained forecasts by trees; SQL can say only what survives saving."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hourmart.catalogue.bindings import DAY, day_rows, lines
from hourmart.catalogue.feature_queries import MODEL_ROWS
from hourmart.catalogue.stream_queries import scratch
from hourmart.catalogue.write_queries import RULES
from hourmart.operators.dims import dim_entity
from hourmart.operators.stats import daily_stats, split_date
from hourmart.plans.features import model_rows, training_table
from hourmart.plans.forecast import ForecastJob, run_batch
from hourmart.plans.training import (
    Models, TrainSettings, fit_all, fit_prepare, fit_rain, fit_values, sample_weights, score, time_split,
    train, vectors,
)
from hourmart.session import written
from hourmart.sources.tables import Warehouse

SETTINGS = TrainSettings.small(trees=5, depth=3)


def _prepared(spark, d):
    """Entities, one row per entity and day, daily statistics, complete model rows."""
    rows = lines(spark, d)
    entities = written(dim_entity(rows, "entity", "entity_id"), "entities")
    actual = written(day_rows(spark, d), "actual")
    daily = written(daily_stats(rows, DAY), "daily")
    table = training_table(actual.join(entities, "entity"), daily, DAY)
    return entities, actual, daily, model_rows(table, DAY)


def _halves(rows):
    """The fitted vector step, weighted vectors up to the split day, and rows after it."""
    stored = written(rows, "model_rows")
    earlier, later = time_split(
        stored, DAY.date, split_date(stored, DAY.date).first()["split_date"])
    prepare = fit_prepare(earlier, DAY)
    fit_on = vectors(sample_weights(earlier), prepare, DAY, [*DAY.columns, "weight"])
    return prepare, written(fit_on, "vectors"), later


def q_gbt_forecast(spark, d):
    """Hold-out rows scored by the three value models."""
    prepare, fit_on, later = _halves(_prepared(spark, d)[3])
    models = Models(DAY, prepare, fit_values(fit_on, DAY, SETTINGS))
    return score(later, models, [*DAY.keys, "temp", "hum", "wind"])


def q_two_stage(spark, d):
    """Hold-out rows scored by the wet classifier and the amount model."""
    prepare, fit_on, later = _halves(_prepared(spark, d)[3])
    wet, amount = fit_rain(fit_on, DAY, SETTINGS)
    return score(later, Models(DAY, prepare, wet=wet, amount=amount), [*DAY.keys, "rain"])


def q_model_metrics(spark, d):
    return train(_prepared(spark, d)[3], DAY, SETTINGS)[1]


def q_chained_forecast(spark, d):
    """Two days after the last measured one, the second seeing the first as its lag."""
    entities, actual, daily, rows = _prepared(spark, d)
    models, _ = train(rows, DAY, SETTINGS)
    warehouse = Warehouse(spark, scratch(spark))
    job = ForecastJob(warehouse, models, entities, actual, daily, RULES)
    return run_batch(job, None, datetime(2026, 3, 20, 0, 5), days=2).stored


def q_models_reloaded(spark, d):
    """Every model row scored by models as fitted and as loaded again: how many rows differ."""
    rows = written(_prepared(spark, d)[3], "model_rows")
    prepare = fit_prepare(rows, DAY)
    fit_on = written(vectors(sample_weights(rows), prepare, DAY, [*DAY.columns, "weight"]), "vectors")
    models, folder = fit_all(fit_on, DAY, TrainSettings.small(trees=2, depth=3), prepare), f"{scratch(spark)}/models"
    models.save(spark, folder)
    keep = [*DAY.keys]
    before, after = (m.score(rows, keep) for m in (models, Models.load(spark, folder, DAY)))
    same = F.lit(True)
    for c in before.columns:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    return before.alias("b").join(after.alias("a"), DAY.keys).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(~same).alias("different"))


QUERIES = {
    "models_reloaded": q_models_reloaded,
    "gbt_forecast": q_gbt_forecast,
    "two_stage": q_two_stage,
    "model_metrics": q_model_metrics,
    "chained_forecast": q_chained_forecast,
}
ORACLES = {
    "models_reloaded": f"SELECT count(*) AS scored, CAST(0 AS BIGINT) AS different FROM ({MODEL_ROWS})"}
