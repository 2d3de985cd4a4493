"""Weather-derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
# heat-index style polynomial for T >= 20 C:
#   c0 + c1*T + c2*R + c3*T*R + c4*T^2 + c5*R^2
HEAT_POLY = (-8.78469475556, 1.61139411, 2.33854883889, -0.14611605, -0.012308094,
             -0.0164248277778)
HEAT_POLY_MIN_T = 20.0
COLD_DRY_R = 50.0          # below this humidity a cold day feels colder
COLD_DRY_STEP = 0.05
COMFORT_T = 25.0
COOLING_FROM, COOLING_RATE = 22.0, 1.5
HEATING_BELOW, HEATING_RATE = 18.0, 1.2
TEMPERATURE_BANDS = [(10, "cold"), (20, "cool"), (25, "comfortable"), (30, "warm")]
TEMPERATURE_TOP = "hot"
HUMIDITY_BANDS = [(40, "dry"), (60, "moderate"), (80, "humid")]
HUMIDITY_TOP = "very_humid"
HEAT_HUMIDITY_WEIGHTS = (0.7, 0.09)
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def apparent_temperature(temperature, humidity) -> Column:
    """Felt temperature rounded half-even to 1 decimal.

    The value is first cleaned to 9 decimals so that a result one ulp
    below a .x5 boundary rounds the same way in every engine (Python's
    ``round`` on the raw binary value can differ there)."""
    t, r = _c(temperature), _c(humidity)
    c0, c1, c2, c3, c4, c5 = HEAT_POLY
    hot = c0 + c1 * t + c2 * r + c3 * t * r + c4 * t * t + c5 * r * r
    cold = F.when(r < COLD_DRY_R, t - (F.lit(COLD_DRY_R) - r) * COLD_DRY_STEP).otherwise(t)
    return F.bround(F.round(F.when(t >= HEAT_POLY_MIN_T, hot).otherwise(cold), 9), 1)


def thermal_comfort_index(temperature) -> Column:
    return _c(temperature) - COMFORT_T


def heating_cooling_index(temperature) -> Column:
    t = _c(temperature)
    return (F.when(t > COOLING_FROM, (t - COOLING_FROM) * COOLING_RATE)
             .when(t < HEATING_BELOW, (F.lit(HEATING_BELOW) - t) * HEATING_RATE)
             .otherwise(F.lit(0.0)))


def _bands(x: Column, bands, top: str) -> Column:
    expr = None
    for edge, name in bands:
        expr = F.when(x < edge, name) if expr is None else expr.when(x < edge, name)
    return expr.otherwise(top)


def temperature_category(temperature) -> Column:
    return _bands(_c(temperature), TEMPERATURE_BANDS, TEMPERATURE_TOP)


def humidity_category(humidity) -> Column:
    return _bands(_c(humidity), HUMIDITY_BANDS, HUMIDITY_TOP)


def heat_humidity_index(temperature, humidity) -> Column:
    a, b = HEAT_HUMIDITY_WEIGHTS
    return _c(temperature) * a + _c(humidity) * b
