"""Spark-native warehouse, feature store and forecaster for hourly measurements."""

from hourmart.model import GAUGES, Panel

__all__ = ["GAUGES", "Panel"]
