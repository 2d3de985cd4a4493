"""Calendar columns: season, holiday rule, date parts, cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
# months per season
SEASON_MONTHS = {"spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}
SEASON_OTHER = "winter"
# holiday calendar: (month, first day, last day), inclusive; weekends count too
HOLIDAY_RANGES = [(1, 1, 1), (1, 21, 27), (2, 1, 6), (4, 4, 6), (5, 1, 3), (10, 1, 7)]
# cyclic periods
PERIODS = {"hour": 24, "day_of_week": 7, "month": 12, "day_of_month": 31}
# hour-of-day periods: (first hour, last hour, label); other hours -> night_early
TIME_PERIODS = [(0, 5, "night_late"), (6, 8, "morning_peak"), (9, 11, "morning"),
                (12, 13, "noon"), (14, 16, "afternoon"), (17, 20, "evening_peak")]
TIME_PERIOD_OTHER = "night_early"
# peak windows used for pattern tags: morning 7-9, evening 17-21, valley 0-5
MORNING_PEAK = (7, 9)
EVENING_PEAK = (17, 21)
NIGHT_VALLEY = (0, 5)
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season(ts) -> Column:
    m = F.month(_c(ts))
    expr = F.when(m.isin(*SEASON_MONTHS["spring"]), "spring")
    for name in ("summer", "autumn"):
        expr = expr.when(m.isin(*SEASON_MONTHS[name]), name)
    return expr.otherwise(SEASON_OTHER)


def holiday_flag(ts, ranges=HOLIDAY_RANGES) -> Column:
    """Weekend or a date inside one of the (month, from, to) ranges."""
    t = _c(ts)
    m, d = F.month(t), F.dayofmonth(t)
    cond = F.weekday(t) >= 5
    for mon, lo, hi in ranges:
        cond = cond | ((m == mon) & d.between(lo, hi))
    return cond


def date_parts(ts) -> dict[str, Column]:
    """``hour``, ``day_of_week`` (Monday = 0), ``month``, ``day_of_month``."""
    t = _c(ts)
    return {"hour": F.hour(t), "day_of_week": F.weekday(t),
            "month": F.month(t), "day_of_month": F.dayofmonth(t)}


def cyclic(x, period: float) -> tuple[Column, Column]:
    ang = F.lit(2 * math.pi) * _c(x) / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def workday_flag(is_weekend, is_holiday) -> Column:
    return (~_c(is_weekend) & ~_c(is_holiday)).cast("int")


def time_period(hour) -> Column:
    h = _c(hour)
    expr = None
    for lo, hi, name in TIME_PERIODS:
        cond = h.between(lo, hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(TIME_PERIOD_OTHER)


def is_peak_hour(hour) -> Column:
    h = _c(hour)
    return h.between(*MORNING_PEAK) | h.between(*EVENING_PEAK)


def calendar_columns(ts) -> dict[str, Column]:
    """Base calendar columns added before training: hour, day_of_week,
    is_weekend, is_holiday, season, date."""
    t = _c(ts)
    parts = date_parts(t)
    return {"hour": parts["hour"], "day_of_week": parts["day_of_week"],
            "is_weekend": F.weekday(t) >= 5, "is_holiday": holiday_flag(t),
            "season": season(t), "date": F.to_date(t)}


def calendar_patterns(season_col, temperature, is_workday, is_weekend, is_holiday, hour) -> Column:
    """Array of pattern tags: season (+ heat / cold warning), day type, peak."""
    s, t, h = _c(season_col), _c(temperature), _c(hour)
    tags = [
        F.when(s == "summer", F.lit("summer heat pattern"))
         .when(s == "winter", F.lit("winter cold pattern")),
        F.when((s == "summer") & (t > 30),
               F.format_string("heat warning: %s C, strong cooling demand", t))
         .when((s == "winter") & (t < 10),
               F.format_string("cold warning: %s C, strong heating demand", t)),
        F.when(_c(is_workday) == 1, F.lit("workday load profile"))
         .when(_c(is_weekend), F.lit("weekend load profile"))
         .when(_c(is_holiday), F.lit("holiday load profile")),
        F.when(h.between(*MORNING_PEAK), F.lit("morning peak hours"))
         .when(h.between(*EVENING_PEAK), F.lit("evening peak hours"))
         .when(h.between(*NIGHT_VALLEY), F.lit("night valley hours")),
    ]
    return F.filter(F.array(*tags), lambda x: x.isNotNull())
