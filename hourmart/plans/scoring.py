"""What turns feature rows into predictions: the interface forecasts use, and a closed-form scorer."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from hourmart.functions.numeric import clip, total
from hourmart.model import HUMIDITY_RANGE, WET_PROBABILITY, Panel

PROBABILITY = "rain_prob"


class Scorer(Protocol):
    """Fitted trees and closed-form weights alike: any of them can drive a forecast job."""

    panel: Panel

    @property
    def gives_chance(self) -> bool:
        """Whether scores come with a wet probability."""

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns, ``<measure>_pred`` per measure and, if given, the wet probability."""


def in_range(short: str, value: Column) -> Column:
    """A prediction as it may be stored: humidity within its range."""
    return clip(value, *HUMIDITY_RANGE) if short == "hum" else value


def two_stage(chance: Column, amount: Column) -> Column:
    """The amount where the wet probability passes its cut, never below 0; 0 elsewhere."""
    return F.when(chance > WET_PROBABILITY, F.greatest(amount, F.lit(0.0))).otherwise(0.0)


@dataclass(frozen=True)
class LinearScorer:
    """A base and a weight for some of the features, for each measure and the wet probability.

    A missing feature counts as 0. Without weights for the wet probability rain is the plain sum.
    """

    panel: Panel
    base: Mapping[str, float]
    weights: Mapping[str, Mapping[str, float]]
    chance: Mapping[str, float] = field(default_factory=dict)

    @property
    def gives_chance(self) -> bool:
        return bool(self.chance)

    @staticmethod
    def _sum(base: float, weights: Mapping[str, float]) -> Column:
        return total([F.lit(base), *[
            F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w for name, w in weights.items()]])

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        chance = clip(self._sum(self.base.get(PROBABILITY, 0.0), self.chance), 0.0, 1.0)
        rows = rows.withColumn(PROBABILITY, chance) if self.chance else rows
        found = []
        for short, column in self.panel.measures:
            value = in_range(short, self._sum(self.base[column], self.weights.get(column, {})))
            if self.chance and column == self.panel.wet_column:
                value = two_stage(F.col(PROBABILITY), value)
            found.append(value.alias(f"{column}_pred"))
        return rows.select(*keep, *found, *([PROBABILITY] if self.chance else []))
