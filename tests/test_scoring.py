"""The closed-form scorer, and trees behind the same interface."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hourmart.model import Panel
from hourmart.plans.scoring import PROBABILITY, LinearScorer, two_stage

PANEL = Panel("entity", "full_date", None, (("temp", "t"), ("hum", "h"), ("rain", "r")))


def scored(spark, scorer, rows):
    df = spark.createDataFrame(rows, "entity string, a double, b int")
    return [tuple(r) for r in scorer.score(df, ["entity"]).orderBy("entity").collect()]


def test_missing_features_count_as_zero_and_humidity_stays_in_range(spark):
    scorer = LinearScorer(PANEL, {"t": 1.0, "h": 90.0, "r": 0.5}, {"t": {"a": 2.0, "b": -1.0}, "h": {"a": 30.0}})
    assert not scorer.gives_chance
    assert scored(spark, scorer, [("x", 1.0, 2), ("y", None, None), ("z", -4.0, 1)]) == [
        ("x", 1.0, 100.0, 0.5), ("y", 1.0, 90.0, 0.5), ("z", -8.0, 0.0, 0.5)]


def test_rain_comes_where_the_chance_passes_its_cut(spark):
    scorer = LinearScorer(
        PANEL, {"t": 0.0, "h": 0.0, "r": -1.0, PROBABILITY: 0.25}, {"r": {"a": 2.0}}, {"b": 0.25})
    assert scorer.gives_chance
    found = scored(spark, scorer, [("w", 3.0, 1), ("x", 3.0, 2), ("y", 0.25, 9), ("z", None, -9)])
    assert [(r[0], r[3], r[4]) for r in found] == [("w", 0.0, 0.5), ("x", 5.0, 0.75), ("y", 0.0, 1.0), ("z", 0.0, 0.0)]


@pytest.mark.parametrize("chance, amount, rain", [(0.5, 2.0, 0.0), (0.51, 2.0, 2.0), (0.9, -1.0, 0.0), (None, 2.0, 0.0)])
def test_two_stages(spark, chance, amount, rain):
    found = spark.range(1).select(two_stage(F.lit(chance).cast("double"), F.lit(amount)).alias("r"))
    assert found.first().r == rain
