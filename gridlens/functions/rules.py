"""Deterministic rule scores (baseline load, what-if score, confidence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
BASE_LOAD = 1500.0
# hour factor: (first hour, last hour, factor); other hours 0.85
HOUR_FACTORS = [(7, 9, 1.15), (10, 16, 1.05), (17, 21, 1.25), (22, 23, 0.95)]
HOUR_FACTOR_OTHER = 0.85
HOLIDAY_FACTOR = 0.85
WEEKEND_FACTOR = 0.92
MIN_LOAD = 500.0
WHATIF_BASE = 2500.0
WHATIF_HOT_FROM, WHATIF_HOT_RATE = 25.0, 15.0
WHATIF_COLD_BELOW, WHATIF_COLD_RATE = 15.0, 10.0
WHATIF_DAY_HOURS = (8, 22)
WHATIF_HOUR_EFFECT = 200.0
WHATIF_WORKDAY_EFFECT = 150.0
WHATIF_DEFAULTS = {"temperature": 25.0, "hour": 12, "is_workday": 1}
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rule_baseline_load(ts, hour, temperature, is_holiday, season_col) -> Column:
    """Deterministic calendar/temperature baseline (no noise)."""
    h, t, s = _c(hour), _c(temperature), _c(season_col)
    hf = None
    for lo, hi, f in HOUR_FACTORS:
        hf = F.when(h.between(lo, hi), f) if hf is None else hf.when(h.between(lo, hi), f)
    hf = hf.otherwise(HOUR_FACTOR_OTHER)
    holf = F.when(_c(is_holiday), HOLIDAY_FACTOR).otherwise(1.0)
    wkf = F.when(F.weekday(_c(ts)) >= 5, WEEKEND_FACTOR).otherwise(1.0)
    sf = (F.when(s == "summer", F.when(t > 25, 1.0 + (t - 25) * 0.03).otherwise(1.0 - (25 - t) * 0.01))
           .when(s == "winter", F.when(t < 15, 1.0 + (15 - t) * 0.025).otherwise(1.0 - (t - 15) * 0.01))
           .when(s.isin("spring", "autumn"), F.when(t.between(15, 25), 0.95).otherwise(1.0))
           .otherwise(1.0))
    sens = F.when((t > 35) | (t < 5), 1.2).when((t > 30) | (t < 10), 1.1).otherwise(1.0)
    load = F.lit(BASE_LOAD) * hf * holf * wkf * sf
    bump = (F.when((s == "summer") & (t > 25), (t - 25) * 15 * sens)
             .when((s == "winter") & (t < 15), (15 - t) * 12 * sens)
             .otherwise(0.0))
    return F.greatest(load + bump, F.lit(MIN_LOAD))


def whatif_rule_score(temperature=None, hour=None, is_workday=None) -> Column:
    """Rule score of a scenario; missing inputs take the defaults."""
    t = F.coalesce(_c(temperature).cast("double"), F.lit(WHATIF_DEFAULTS["temperature"])) \
        if temperature is not None else F.lit(WHATIF_DEFAULTS["temperature"])
    h = F.coalesce(_c(hour), F.lit(WHATIF_DEFAULTS["hour"])) if hour is not None \
        else F.lit(WHATIF_DEFAULTS["hour"])
    w = F.coalesce(_c(is_workday), F.lit(WHATIF_DEFAULTS["is_workday"])) if is_workday is not None \
        else F.lit(WHATIF_DEFAULTS["is_workday"])
    temp_eff = (F.when(t > WHATIF_HOT_FROM, (t - WHATIF_HOT_FROM) * WHATIF_HOT_RATE)
                 .when(t < WHATIF_COLD_BELOW, (F.lit(WHATIF_COLD_BELOW) - t) * WHATIF_COLD_RATE)
                 .otherwise(0.0))
    hour_eff = F.when(h.between(*WHATIF_DAY_HOURS), WHATIF_HOUR_EFFECT).otherwise(-WHATIF_HOUR_EFFECT)
    wd_eff = F.when(w == 1, WHATIF_WORKDAY_EFFECT).otherwise(-WHATIF_WORKDAY_EFFECT)
    return F.greatest(F.lit(WHATIF_BASE) + temp_eff + hour_eff + wd_eff, F.lit(MIN_LOAD))


def confidence_score(prediction, lower, upper) -> Column:
    """``max(0, 100 - half-width / prediction * 100)``; null when prediction is 0."""
    half = (_c(upper) - _c(lower)) / 2
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.try_divide(half, _c(prediction)) * 100)
