"""Table schemas, fixed values and the panel description shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Results depend on these, so they are stated as they are.
# ---------------------------------------------------------------------------
WET_ABOVE = 0.1              # a slot is wet when rain is strictly above this
LAG_DAYS = 7                 # calendar lags 1..7
FLAG_LAGS = 3                # wet flags for lags 1..3
SHORT_SPAN, LONG_SPAN = 3, 7  # rolling spans, in lags
HOURS_PER_DAY, DAYS_PER_YEAR, MONTHS_PER_YEAR = 24.0, 365.25, 12.0
TRAIN_QUANTILE = 0.85
WET_PROBABILITY = 0.5        # two-stage cut, strict
HUMIDITY_RANGE = (0.0, 100.0)
TEMPERATURE_RANGE = (5.0, 45.0)
AUDIT_TEMPERATURE, AUDIT_RAIN = 0.5, 0.1
FORECAST_DAYS = 2
MAX_FORECAST_DAYS, MAX_RANGE_DAYS = 7, 30
RECENT_DAYS = 2


@dataclass(frozen=True)
class Panel:
    """Names the columns of an hourly (or daily) measurement panel.

    ``measures`` lists (short name, column); ``wet`` is the short name of the
    measure that gets wet flags and totals. ``slot`` is None at day grain.
    """

    entity: str
    date: str
    slot: str | None
    measures: tuple[tuple[str, str], ...]
    wet: str | None = "rain"
    wet_above: float = WET_ABOVE
    entity_id: str = "district_id"
    slot_period: float = HOURS_PER_DAY

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.date] + ([self.slot] if self.slot else [])

    @property
    def series(self) -> list[str]:
        """Columns that identify one daily-spaced series."""
        return [self.entity] + ([self.slot] if self.slot else [])

    @property
    def columns(self) -> list[str]:
        return [c for _, c in self.measures]

    @property
    def wet_column(self) -> str | None:
        return dict(self.measures).get(self.wet)

    def lag(self, n: int, short: str) -> str:
        return f"lag_{n}d_{short}"


GAUGES = Panel(
    entity="district_name",
    date="full_date",
    slot="hour",
    measures=(
        ("temp", "temperature_c"),
        ("hum", "humidity_percent"),
        ("wind", "wind_speed_m_s"),
        ("rain", "rain_mm"),
    ),
)


# ---------------------------------------------------------------------------
# Feature names, in the order the models are trained on.
# ---------------------------------------------------------------------------
def day_history_columns(panel: Panel) -> list[str]:
    stats = ("mean", "std", "min", "max")
    return [f"hist_{s}_{k}" for s, _ in panel.measures for k in stats] + ["years_count"]


def slot_history_columns(panel: Panel) -> list[str]:
    names = []
    for s, _ in panel.measures:
        kinds = ("mean", "max", "prob") if s == panel.wet else ("mean", "std")
        names += [f"hist_h_{s}_{k}" for k in kinds]
    return names


def lag_columns(panel: Panel, horizon: int = LAG_DAYS) -> list[str]:
    return [panel.lag(n, s) for n in range(1, horizon + 1) for s, _ in panel.measures]


def flag_columns(panel: Panel) -> list[str]:
    return [f"lag_{n}d_is_rainy" for n in range(1, FLAG_LAGS + 1)] if panel.wet_column else []


def rolling_columns(panel: Panel) -> list[str]:
    names = []
    for s, _ in panel.measures:
        names += [
            f"rolling_{SHORT_SPAN}d_{s}_mean", f"rolling_{LONG_SPAN}d_{s}_mean",
            f"rolling_{SHORT_SPAN}d_{s}_std", f"trend_{SHORT_SPAN}d_{s}",
        ]
    return names + (["recent_rain_count"] if panel.wet_column else [])


def cyclic_columns(panel: Panel) -> list[str]:
    slot = ["hour_sin", "hour_cos"] if panel.slot else []
    return slot + ["doy_sin", "doy_cos", "month_sin", "month_cos"]


def feature_columns(panel: Panel) -> list[str]:
    """All model inputs; 86 names for the hourly four-measure panel."""
    return (
        [panel.entity_id, "month", "day", "day_of_year", "day_of_week"]
        + ([panel.slot] if panel.slot else [])
        + cyclic_columns(panel)
        + day_history_columns(panel)
        + (slot_history_columns(panel) if panel.slot else [])
        + lag_columns(panel)
        + flag_columns(panel)
        + rolling_columns(panel)
    )


# ---------------------------------------------------------------------------
# Table schemas. Measures are DOUBLE end to end (no float4 storage steps).
# ---------------------------------------------------------------------------
def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


_D, _I, _S = T.DoubleType(), T.IntegerType(), T.ShortType()
_MEASURES = tuple((c, _D) for c in GAUGES.columns)

RAW_READINGS = _fields(
    ("district", T.StringType()), ("datetime", T.TimestampNTZType()), *_MEASURES)
DIM_DISTRICT = _fields(("district_id", _I), ("district_name", T.StringType()))
DIM_DATE = _fields(
    ("date_id", _I), ("full_date", T.DateType()), ("year", _S), ("month", _S), ("day", _S),
    ("day_of_year", _S), ("day_of_week", _S), ("week_of_year", _S), ("quarter", _S),
    ("month_name", T.StringType()), ("is_weekend", T.BooleanType()), ("month_day", _S))
DIM_HOUR = _fields(("hour_id", _S), ("hour", _S), ("period_of_day", T.StringType()))
FACT_HOURLY = _fields(
    ("district_id", _I), ("date_id", _I), ("hour_id", _S), *_MEASURES,
    ("full_date", T.DateType()), ("year", _I))   # stored by year
FORECAST_HISTORY = _fields(
    ("district_name", T.StringType()), ("full_date", T.DateType()), ("hour", _I),
    ("old_temperature_c", _D), ("new_temperature_c", _D),
    ("old_rain_mm", _D), ("new_rain_mm", _D), ("changed_at", T.TimestampType()),
    ("batch", T.StringType()))                   # stored by batch
FACT_FORECAST = _fields(
    ("district_name", T.StringType()), ("hour", _I), *_MEASURES, ("rain_probability", _D),
    ("predicted_at", T.TimestampType()), ("updated_at", T.TimestampType()),
    ("full_date", T.DateType()))                 # stored by day

TABLES = {
    "staging/raw_weather": RAW_READINGS,
    "dw/dim_district": DIM_DISTRICT,
    "dw/dim_date": DIM_DATE,
    "dw/dim_hour": DIM_HOUR,
    "dw/fact_weather_hourly": FACT_HOURLY,
    "dw/fact_weather_forecast": FACT_FORECAST,
    "dw/forecast_history": FORECAST_HISTORY,
}
