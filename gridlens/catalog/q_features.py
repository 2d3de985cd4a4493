"""Queries: scalar functions (§2.3), projections (§2.2), windows (§2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import rules
from ..functions import weather as wx
from ..operators import features as feat
from ..operators import insight
from ..operators import standardize as std
from ..operators import windows as win
from ..operators import text as txt
from ..sources import fixtures as fx
from . import fixture_sql as fs
from .registry import register, round6, sql

HCAL = fs.HOURLY + f""",
hcal AS (
  SELECT *, CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
         CAST(month(datetime) AS INTEGER) AS month, CAST(day(datetime) AS INTEGER) AS day_of_month,
         isodow(datetime) >= 6 AS is_weekend, {fs.holiday_sql('datetime')} AS is_holiday,
         {fs.season_sql('datetime')} AS season
  FROM hourly)"""

WORKDAY_SQL = "CAST(NOT is_weekend AND NOT is_holiday AS INTEGER)"


def _hcal(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    t = F.col("datetime")
    return h.withColumns({**cal.date_parts(t), "is_weekend": F.weekday(t) >= 5,
                          "is_holiday": cal.holiday_flag(t), "season": cal.season(t)})


def _case_bands(x, bands, top):
    whens = " ".join(f"WHEN {x} < {e} THEN '{n}'" for e, n in bands)
    return f"(CASE {whens} ELSE '{top}' END)"


def _between_case(x, ranges, other):
    whens = " ".join(f"WHEN {x} BETWEEN {lo} AND {hi} THEN '{n}'" for lo, hi, n in ranges)
    return f"(CASE {whens} ELSE '{other}' END)"


APPARENT_SQL = ("round_even(round(CASE WHEN temperature >= 20 THEN {0} + {1} * temperature + {2} * humidity "
                "+ ({3}) * temperature * humidity + ({4}) * temperature * temperature "
                "+ ({5}) * humidity * humidity "
                "WHEN humidity < 50 THEN temperature - (50 - humidity) * 0.05 ELSE temperature END, 9), 1)"
                ).format(*wx.HEAT_POLY)
HCI_SQL = ("CASE WHEN temperature > 22 THEN (temperature - 22) * 1.5 "
           "WHEN temperature < 18 THEN (18 - temperature) * 1.2 ELSE 0.0 END")
TCAT_SQL = _case_bands("temperature", wx.TEMPERATURE_BANDS, wx.TEMPERATURE_TOP)
HCAT_SQL = _case_bands("humidity", wx.HUMIDITY_BANDS, wx.HUMIDITY_TOP)
TPERIOD_SQL = _between_case("hour", cal.TIME_PERIODS, cal.TIME_PERIOD_OTHER)
PI = "pi()"


# ---------------------------------------------------------------- §2.3 scalars
@register("season", sql(HCAL, "SELECT datetime, season FROM hcal"))
def q_season(spark, sf_dir):
    return _hcal(spark, sf_dir).select("datetime", "season")


@register("holiday_flag", sql(HCAL, "SELECT datetime, is_holiday FROM hcal"))
def q_holiday(spark, sf_dir):
    return _hcal(spark, sf_dir).select("datetime", "is_holiday")


@register("date_parts", sql(HCAL, "SELECT datetime, hour, day_of_week, month, day_of_month FROM hcal"))
def q_date_parts(spark, sf_dir):
    return _hcal(spark, sf_dir).select("datetime", "hour", "day_of_week", "month", "day_of_month")


_CYC = ", ".join(f"sin(2 * {PI} * {c} / {p}) AS {c}_sin, cos(2 * {PI} * {c} / {p}) AS {c}_cos"
                 for c, p in cal.PERIODS.items())
_CYC_COLS = [f"{c}_{f}" for c in cal.PERIODS for f in ("sin", "cos")]


@register("cyclic_encoding", sql(HCAL, f"SELECT datetime, {_CYC} FROM hcal", _CYC_COLS))
def q_cyclic(spark, sf_dir):
    h = _hcal(spark, sf_dir)
    cols = []
    for c, p in cal.PERIODS.items():
        s, co = cal.cyclic(c, p)
        cols += [s.alias(f"{c}_sin"), co.alias(f"{c}_cos")]
    return round6(h.select("datetime", *cols))


@register("workday_flag", sql(HCAL, f"SELECT datetime, {WORKDAY_SQL} AS is_workday FROM hcal"))
def q_workday(spark, sf_dir):
    return _hcal(spark, sf_dir).select("datetime", cal.workday_flag("is_weekend", "is_holiday")
                                       .alias("is_workday"))


PIN6 = "(SELECT * REPLACE (round(temperature, 6) AS temperature, round(humidity, 6) AS humidity) FROM hcal)"


def _pin6(df):
    return df.withColumns({"temperature": F.round("temperature", 6), "humidity": F.round("humidity", 6)})


@register("apparent_temperature", sql(HCAL, f"SELECT datetime, {APPARENT_SQL} AS apparent_temperature FROM {PIN6}",
                                      ["apparent_temperature"]))
def q_apparent(spark, sf_dir):
    return round6(_pin6(_hcal(spark, sf_dir)).select(
        "datetime", wx.apparent_temperature("temperature", "humidity").alias("apparent_temperature")))


@register("thermal_comfort_index", sql(HCAL, "SELECT datetime, temperature - 25 AS thermal_comfort_index FROM hcal",
                                       ["thermal_comfort_index"]))
def q_tci(spark, sf_dir):
    return round6(_hcal(spark, sf_dir).select(
        "datetime", wx.thermal_comfort_index("temperature").alias("thermal_comfort_index")))


@register("heating_cooling_index", sql(HCAL, f"SELECT datetime, {HCI_SQL} AS heating_cooling_index FROM hcal",
                                       ["heating_cooling_index"]))
def q_hci(spark, sf_dir):
    return round6(_hcal(spark, sf_dir).select(
        "datetime", wx.heating_cooling_index("temperature").alias("heating_cooling_index")))


@register("temperature_category", sql(HCAL, f"SELECT datetime, {TCAT_SQL} AS temperature_category FROM hcal"))
def q_tcat(spark, sf_dir):
    return _hcal(spark, sf_dir).select("datetime", wx.temperature_category("temperature")
                                       .alias("temperature_category"))


@register("humidity_category", sql(HCAL, f"SELECT datetime, {HCAT_SQL} AS humidity_category FROM hcal"))
def q_hcat(spark, sf_dir):
    return _hcal(spark, sf_dir).select("datetime", wx.humidity_category("humidity")
                                       .alias("humidity_category"))


@register("time_period", sql(HCAL, f"SELECT datetime, {TPERIOD_SQL} AS time_period FROM hcal"))
def q_time_period(spark, sf_dir):
    return _hcal(spark, sf_dir).select("datetime", cal.time_period("hour").alias("time_period"))


_INTER_COLS = ["temperature_squared", "temp_workday_interaction", "temp_humidity_interaction",
               "heat_humidity_index"]


@register("interaction_features", sql(HCAL, f"""
SELECT datetime, temperature * temperature AS temperature_squared,
       temperature * {WORKDAY_SQL} AS temp_workday_interaction,
       temperature * humidity / 100 AS temp_humidity_interaction,
       temperature * 0.7 + humidity * 0.09 AS heat_humidity_index FROM hcal""", _INTER_COLS))
def q_interactions(spark, sf_dir):
    h = _hcal(spark, sf_dir)
    t, hu = F.col("temperature"), F.col("humidity")
    wd = cal.workday_flag("is_weekend", "is_holiday")
    return round6(h.select("datetime", (t * t).alias("temperature_squared"),
                           (t * wd).alias("temp_workday_interaction"),
                           (t * hu / 100).alias("temp_humidity_interaction"),
                           wx.heat_humidity_index(t, hu).alias("heat_humidity_index")))


_HF = " ".join(f"WHEN hour BETWEEN {lo} AND {hi} THEN {f}" for lo, hi, f in rules.HOUR_FACTORS)
BASELINE_SQL = f"""greatest(1500.0 * (CASE {_HF} ELSE 0.85 END)
  * (CASE WHEN is_holiday THEN 0.85 ELSE 1.0 END) * (CASE WHEN is_weekend THEN 0.92 ELSE 1.0 END)
  * (CASE WHEN season = 'summer' THEN (CASE WHEN temperature > 25 THEN 1.0 + (temperature - 25) * 0.03
                                            ELSE 1.0 - (25 - temperature) * 0.01 END)
          WHEN season = 'winter' THEN (CASE WHEN temperature < 15 THEN 1.0 + (15 - temperature) * 0.025
                                            ELSE 1.0 - (temperature - 15) * 0.01 END)
          WHEN season IN ('spring', 'autumn') THEN (CASE WHEN temperature BETWEEN 15 AND 25 THEN 0.95 ELSE 1.0 END)
          ELSE 1.0 END)
  + (CASE WHEN season = 'summer' AND temperature > 25 THEN (temperature - 25) * 15 * SENS
          WHEN season = 'winter' AND temperature < 15 THEN (15 - temperature) * 12 * SENS
          ELSE 0.0 END), 500.0)""".replace(
    "SENS", "(CASE WHEN temperature > 35 OR temperature < 5 THEN 1.2 "
            "WHEN temperature > 30 OR temperature < 10 THEN 1.1 ELSE 1.0 END)")


@register("rule_baseline_load", sql(HCAL, f"SELECT datetime, {BASELINE_SQL} AS baseline_load FROM hcal",
                                    ["baseline_load"]))
def q_baseline(spark, sf_dir):
    h = _hcal(spark, sf_dir)
    return round6(h.select("datetime", rules.rule_baseline_load(
        "datetime", "hour", "temperature", "is_holiday", "season").alias("baseline_load")))


WHATIF_SQL = """greatest(2500.0
  + (CASE WHEN coalesce({T}, 25.0) > 25 THEN (coalesce({T}, 25.0) - 25) * 15
          WHEN coalesce({T}, 25.0) < 15 THEN (15 - coalesce({T}, 25.0)) * 10 ELSE 0.0 END)
  + (CASE WHEN coalesce({H}, 12) BETWEEN 8 AND 22 THEN 200.0 ELSE -200.0 END)
  + (CASE WHEN coalesce({W}, 1) = 1 THEN 150.0 ELSE -150.0 END), 500.0)"""


@register("whatif_rule_score", sql(HCAL, "SELECT datetime, " + WHATIF_SQL.format(
    T="temperature", H="hour", W=WORKDAY_SQL) + " AS score FROM hcal", ["score"]))
def q_whatif_score(spark, sf_dir):
    h = _hcal(spark, sf_dir)
    return round6(h.select("datetime", rules.whatif_rule_score(
        "temperature", "hour", cal.workday_flag("is_weekend", "is_holiday")).alias("score")))


PATTERNS_SQL = f"""concat_ws('|',
  CASE WHEN season = 'summer' THEN 'summer heat pattern' WHEN season = 'winter' THEN 'winter cold pattern' END,
  CASE WHEN season = 'summer' AND temperature > 30 THEN 'heat warning: ' || CAST(temperature AS VARCHAR) || ' C, strong cooling demand'
       WHEN season = 'winter' AND temperature < 10 THEN 'cold warning: ' || CAST(temperature AS VARCHAR) || ' C, strong heating demand' END,
  CASE WHEN {WORKDAY_SQL} = 1 THEN 'workday load profile' WHEN is_weekend THEN 'weekend load profile'
       WHEN is_holiday THEN 'holiday load profile' END,
  CASE WHEN hour BETWEEN 7 AND 9 THEN 'morning peak hours' WHEN hour BETWEEN 17 AND 21 THEN 'evening peak hours'
       WHEN hour BETWEEN 0 AND 5 THEN 'night valley hours' END)"""


@register("calendar_patterns", sql(HCAL, f"""SELECT datetime, {PATTERNS_SQL} AS patterns,
  (hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 21) AS is_peak_hour
FROM (SELECT * REPLACE (round(temperature, 1) AS temperature) FROM hcal)"""))
def q_patterns(spark, sf_dir):
    h = _hcal(spark, sf_dir)
    # temperature is formatted through a 1-decimal round so both engines print alike
    h = h.withColumn("temperature", F.round("temperature", 1))
    p = cal.calendar_patterns("season", "temperature", cal.workday_flag("is_weekend", "is_holiday"),
                              "is_weekend", "is_holiday", "hour")
    return h.select("datetime", F.concat_ws("|", p).alias("patterns"),
                    cal.is_peak_hour("hour").alias("is_peak_hour"))


@register("confidence_score", sql(fs.PRED, """
SELECT datetime, greatest(0.0, 100.0 - ((greatest(predicted_load, load_lag_1h) - least(predicted_load, load_lag_1h)) / 2)
       / nullif(predicted_load, 0) * 100) AS confidence FROM pred""", ["confidence"]))
def q_confidence(spark, sf_dir):
    p = fx.predictions_naive(spark, sf_dir)
    lo = F.least("predicted_load", "load_lag_1h")
    hi = F.greatest("predicted_load", "load_lag_1h")
    return round6(p.select("datetime", rules.confidence_score("predicted_load", lo, hi).alias("confidence")))


_NAMES_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in txt.DISPLAY_NAMES.items())


@register("display_name_map", sql(fs.CONTRIB + f""",
names(feature, display_name) AS (VALUES {_NAMES_VALUES})""", """
SELECT c.row_id, c.feature, coalesce(n.display_name, c.feature) AS display_name
FROM contributions c LEFT JOIN names n USING (feature)"""))
def q_display_names(spark, sf_dir):
    c = fx.contributions_linear(spark, sf_dir)
    return txt.display_names(c, "feature").select("row_id", "feature", "display_name")


STRIP_SQL = r"""CASE WHEN starts_with(regexp_replace(text, '^\s+|\s+$', '', 'g'), '```')
  THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
        '^```[^\n]*(\n|$)', ''), '(^|\n)```[^\n]*$', ''), '^\s+|\s+$', '', 'g')
  ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END"""


@register("strip_code_fence", sql(fs.QUESTIONS, f"SELECT conv_id, turn, {STRIP_SQL} AS clean_text FROM questions"))
def q_strip(spark, sf_dir):
    c = fx.questions(spark, sf_dir)
    return c.select("conv_id", "turn", txt.strip_code_fence("text").alias("clean_text"))


# ----------------------------------------------------------- §2.2 projections
_STD = fs.HOURLY + """,
hourly_text AS (
  SELECT strftime(datetime, '%Y-%m-%d %H:%M:%S') AS Datetime,
         CASE WHEN ((day(datetime) - 1) * 24 + hour(datetime)) % 50 = 49 THEN 'n/a' ELSE CAST(load AS VARCHAR) END AS load_MW,
         temperature AS db_temp, humidity AS rh
  FROM hourly),
std AS (
  SELECT CAST(Datetime AS TIMESTAMP) AS datetime, TRY_CAST(load_MW AS DOUBLE) AS load,
         db_temp AS temperature, rh AS humidity, CAST(isodow(CAST(Datetime AS TIMESTAMP)) - 1 AS INTEGER) AS day_of_week,
         isodow(CAST(Datetime AS TIMESTAMP)) >= 6 AS is_holiday
  FROM hourly_text)"""


def _std(spark, sf_dir):
    return std.standardize_columns(fx.hourly_text(spark, sf_dir))


@register("standardize_columns", sql(_STD, "SELECT * FROM std", ["load", "temperature", "humidity"]))
def q_standardize(spark, sf_dir):
    return round6(_std(spark, sf_dir))


@register("coerce_numeric", sql(_STD, "SELECT datetime, load FROM std", ["load"]))
def q_coerce(spark, sf_dir):
    return round6(_std(spark, sf_dir).select("datetime", "load"))


@register("drop_null_target", sql(_STD, "SELECT * FROM std WHERE load IS NOT NULL",
                                  ["load", "temperature", "humidity"]))
def q_drop_null_target(spark, sf_dir):
    return round6(std.drop_null_target(_std(spark, sf_dir)))


@register("impute_temperature_from_load", sql(fs.HOURLY, """
SELECT datetime, load, 20 + (load - avg(load) OVER ()) / 100 AS temperature FROM hourly""",
                                               ["load", "temperature"]))
def q_impute_temp(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime", "load")
    return round6(std.impute_temperature_from_load(h))


@register("default_missing_columns", sql(fs.HOURLY, """
SELECT datetime, load, 0.0 AS temperature, 50.0 AS humidity, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
       isodow(datetime) >= 6 AS is_holiday FROM hourly""", ["load", "temperature", "humidity"]))
def q_default_missing(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime", "load")
    out = std.default_missing_columns(h).select(*std.CONTRACT)
    return round6(out)


@register("convert_timezone", sql(fs.HOURLY, """
SELECT CAST(timezone('America/New_York', timezone('UTC', datetime)) AS TIMESTAMP) AS datetime, load FROM hourly""",
                                  ["load"]))
def q_convert_tz(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime", "load")
    return round6(std.convert_timezone(h))


@register("base_calendar_columns", sql(HCAL, "SELECT datetime, hour, is_weekend, season, CAST(datetime AS DATE) AS date FROM hcal"))
def q_base_calendar(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime")
    return std.base_calendar_columns(h)


@register("range_filter", sql(fs.HOURLY, """
SELECT * FROM hourly WHERE datetime >= TIMESTAMP '2024-01-08 00:00:00' AND datetime <= TIMESTAMP '2024-01-15 00:00:00'""",
                              ["load", "temperature", "humidity"]))
def q_range_filter(spark, sf_dir):
    # bounds pushed to the parquet scan; the operator keeps the exact rule
    h = fx.hourly(spark, sf_dir, start="2024-01-08 00:00:00", end="2024-01-15 00:00:00")
    return round6(std.range_filter(h, "2024-01-08", "2024-01-15"))


@register("latest_features", sql(fs.HOURLY_KEYED, """
SELECT event_type, max(datetime) AS datetime, arg_max(temperature, datetime) AS temperature,
       arg_max(humidity, datetime) AS humidity FROM hourly_keyed GROUP BY event_type""",
                                 ["temperature", "humidity"]))
def q_latest_features(spark, sf_dir):
    return round6(std.latest_features(fx.hourly_keyed(spark, sf_dir), keys=["event_type"]))


_PF_COLS = ["temperature", "humidity", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos",
            "month_sin", "month_cos", "day_of_month_sin", "day_of_month_cos", "load_lag_1h", "load_lag_24h",
            "load_lag_168h", "load_same_hour_last_week", "load_change_1h", "load_change_24h", "load_ma_3h",
            "load_ma_24h", "apparent_temperature", "thermal_comfort_index", "heating_cooling_index",
            "temperature_squared", "temp_workday_interaction", "temp_humidity_interaction",
            "heat_humidity_index"]


@register("prediction_features", sql(fs.REQUESTS, f"""
SELECT datetime, hour, day_of_week, temperature, humidity,
  sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
  sin(2 * pi() * day_of_week / 7) AS day_of_week_sin, cos(2 * pi() * day_of_week / 7) AS day_of_week_cos,
  CAST(month(datetime) AS INTEGER) AS month, sin(2 * pi() * month(datetime) / 12) AS month_sin,
  cos(2 * pi() * month(datetime) / 12) AS month_cos, CAST(day(datetime) AS INTEGER) AS day_of_month,
  sin(2 * pi() * day(datetime) / 31) AS day_of_month_sin, cos(2 * pi() * day(datetime) / 31) AS day_of_month_cos,
  CAST(NOT (day_of_week >= 5) AND NOT coalesce(is_holiday, false) AS INTEGER) AS is_workday,
  coalesce(load_lag_1h, 1500.0) AS load_lag_1h, coalesce(load_lag_24h, 1500.0) AS load_lag_24h,
  coalesce(load_lag_168h, 1500.0) AS load_lag_168h, coalesce(load_lag_168h, 1500.0) AS load_same_hour_last_week,
  0.0 AS load_change_1h, 0.0 AS load_change_24h,
  (coalesce(load_lag_1h, 1500.0) + 1500.0 * 2) / 3 AS load_ma_3h,
  (coalesce(load_lag_24h, 1500.0) + 1500.0 * 23) / 24 AS load_ma_24h,
  {APPARENT_SQL} AS apparent_temperature, temperature - 25 AS thermal_comfort_index,
  {HCI_SQL} AS heating_cooling_index, temperature * temperature AS temperature_squared,
  temperature * CAST(NOT (day_of_week >= 5) AND NOT coalesce(is_holiday, false) AS INTEGER) AS temp_workday_interaction,
  temperature * humidity / 100 AS temp_humidity_interaction, temperature * 0.7 + humidity * 0.09 AS heat_humidity_index
FROM requests""", _PF_COLS))
def q_prediction_features(spark, sf_dir):
    return round6(std.prediction_features(fx.requests(spark, sf_dir)))


@register("request_validation", sql(fs.REQUESTS, """
SELECT datetime, (hour BETWEEN 0 AND 23) AND (day_of_week BETWEEN 0 AND 6) AND (humidity BETWEEN 0 AND 100)
       AND temperature IS NOT NULL AND humidity IS NOT NULL AS valid FROM requests"""))
def q_request_validation(spark, sf_dir):
    return std.request_validation(fx.requests(spark, sf_dir)).select("datetime", "valid")


_SCALER_SRC = fs.HOURLY_IDX


@register("standard_scaler", sql(_SCALER_SRC, """
SELECT 'temperature' AS feature, avg(temperature) AS mean, stddev_pop(temperature) AS scale FROM hourly_idx
UNION ALL SELECT 'humidity', avg(humidity), stddev_pop(humidity) FROM hourly_idx
UNION ALL SELECT 'load_lag_1h', avg(load_lag_1h), stddev_pop(load_lag_1h) FROM hourly_idx
UNION ALL SELECT 'load_lag_24h', avg(load_lag_24h), stddev_pop(load_lag_24h) FROM hourly_idx
UNION ALL SELECT 'load_lag_168h', avg(load_lag_168h), stddev_pop(load_lag_168h) FROM hourly_idx""",
                                 ["mean", "scale"]))
def q_standard_scaler(spark, sf_dir):
    return round6(std.standard_scaler(fx.hourly_indexed(spark, sf_dir)))


# ---------------------------------------------------------------- §2.4 windows
_LAG_COLS = ["load_lag_1h", "load_lag_24h", "load_lag_168h", "load_same_hour_last_week",
             "load_change_1h", "load_change_24h", "load_ma_3h", "load_ma_24h"]


def _pct(cur, prev):
    return f"(CASE WHEN {prev} = 0 AND {cur} <> 0 THEN 0.0 ELSE {cur} / nullif({prev}, 0) - 1 END)"


LAGS_SQL = fs.HOURLY + f""",
lags AS (
  SELECT datetime, load,
    lag(load, 1) OVER w AS load_lag_1h, lag(load, 24) OVER w AS load_lag_24h,
    lag(load, 168) OVER w AS load_lag_168h, lag(load, 168) OVER w AS load_same_hour_last_week,
    {_pct('load', 'lag(load, 1) OVER w')} AS load_change_1h,
    {_pct('load', 'lag(load, 24) OVER w')} AS load_change_24h,
    avg(load) OVER (ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS load_ma_3h,
    avg(load) OVER (ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS load_ma_24h
  FROM hourly WINDOW w AS (ORDER BY datetime))"""


@register("lag_features", sql(LAGS_SQL, "SELECT datetime, " + ", ".join(_LAG_COLS) + " FROM lags", _LAG_COLS))
def q_lag_features(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime", "load")
    return round6(win.lag_features(h).select("datetime", *_LAG_COLS))


_GAP_ROWS = """
gaps AS (
  SELECT datetime, CASE WHEN day(datetime) IN (5, 6) OR day(datetime) BETWEEN 12 AND 19 THEN NULL ELSE load END AS load FROM hourly),
padded AS (
  SELECT *, last_value(load IGNORE NULLS) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS pad FROM gaps)"""


@register("lag_features_gaps", sql(fs.HOURLY + "," + _GAP_ROWS, f"""
SELECT datetime, load, lag(load, 24) OVER w AS load_lag_24h,
  {_pct('pad', 'lag(pad, 1) OVER w')} AS load_change_1h, {_pct('pad', 'lag(pad, 24) OVER w')} AS load_change_24h,
  avg(load) OVER (ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS load_ma_24h
FROM padded WINDOW w AS (ORDER BY datetime)""", ["load", "load_lag_24h", "load_change_1h", "load_change_24h", "load_ma_24h"]))
def q_lag_features_gaps(spark, sf_dir):
    out = win.lag_features(fx.hourly_gaps(spark, sf_dir), chunk=200)
    return round6(out.select("datetime", "load", "load_lag_24h", "load_change_1h", "load_change_24h", "load_ma_24h"))


@register("pct_change", sql(fs.HOURLY_KEYED, f"""
SELECT event_type, datetime,
  {_pct('load', 'lag(load, 1) OVER w')} AS load_change_1h,
  {_pct('load', 'lag(load, 24) OVER w')} AS load_change_24h
FROM hourly_keyed WINDOW w AS (PARTITION BY event_type ORDER BY datetime)""",
                            ["load_change_1h", "load_change_24h"]))
def q_pct_change(spark, sf_dir):
    h = fx.hourly_keyed(spark, sf_dir)
    out = win.lag_features(h, keys=["event_type"])
    return round6(out.select("event_type", "datetime", "load_change_1h", "load_change_24h"))


@register("rolling_mean", sql(fs.HOURLY_KEYED, """
SELECT event_type, datetime,
  avg(load) OVER (PARTITION BY event_type ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS load_ma_3,
  avg(load) OVER (PARTITION BY event_type ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS load_ma_24,
  avg(load) OVER (PARTITION BY event_type ORDER BY datetime ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS load_ma_24_leakfree
FROM hourly_keyed""", ["load_ma_3", "load_ma_24", "load_ma_24_leakfree"]))
def q_rolling_mean(spark, sf_dir):
    h = fx.hourly_keyed(spark, sf_dir).select("event_type", "datetime", "load")
    k = ["event_type"]
    out = win.rolling_mean(h, "load", 3, keys=k)
    out = win.rolling_mean(out, "load", 24, keys=k)
    out = win.rolling_mean(out, "load", 24, out="load_ma_24_leakfree", keys=k, leak_free=True)
    return round6(out.select("event_type", "datetime", "load_ma_3", "load_ma_24", "load_ma_24_leakfree"))


@register("diff", sql(fs.HOURLY, "SELECT datetime, load - lag(load) OVER (ORDER BY datetime) AS diff FROM hourly",
                      ["diff"]))
def q_diff(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime", "load")
    return round6(win.diff(h, "load").select("datetime", "diff"))


@register("ffill_then_dropna", sql(fs.HOURLY_NULLS + """,
fl AS (
  SELECT datetime, load,
    last_value(temperature IGNORE NULLS) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS temperature,
    last_value(humidity IGNORE NULLS) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS humidity,
    last_value(lag1 IGNORE NULLS) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS load_lag_1h
  FROM (SELECT *, lag(load) OVER (ORDER BY datetime) AS lag1 FROM hourly_nulls))""",
                                   "SELECT * FROM fl WHERE temperature IS NOT NULL AND humidity IS NOT NULL "
                                   "AND load_lag_1h IS NOT NULL AND load IS NOT NULL",
                                   ["load", "temperature", "humidity", "load_lag_1h"]))
def q_ffill_dropna(spark, sf_dir):
    h = fx.hourly_nulls(spark, sf_dir)
    lagged = win.add_lags(h, "load", {"load_lag_1h": 1})
    return round6(win.ffill_then_dropna(lagged).select("datetime", "load", "temperature", "humidity",
                                                       "load_lag_1h"))


@register("linear_interpolate", sql(fs.HOURLY_NULLS + """,
ix AS (SELECT *, row_number() OVER (ORDER BY datetime) AS i FROM hourly_nulls),
nb AS (
  SELECT *,
    last_value(CASE WHEN temperature IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS t_pi,
    last_value(temperature IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS t_pv,
    first_value(CASE WHEN temperature IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t_ni,
    first_value(temperature IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t_nv,
    last_value(CASE WHEN humidity IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS h_pi,
    last_value(humidity IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS h_pv,
    first_value(CASE WHEN humidity IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h_ni,
    first_value(humidity IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h_nv
  FROM ix)""", """
SELECT datetime, load,
  coalesce(temperature, t_pv + (t_nv - t_pv) * (i - t_pi) / (t_ni - t_pi), t_pv, t_nv,
           (SELECT median(temperature) FROM hourly_nulls)) AS temperature,
  coalesce(humidity, h_pv + (h_nv - h_pv) * (i - h_pi) / (h_ni - h_pi), h_pv, h_nv,
           (SELECT median(humidity) FROM hourly_nulls)) AS humidity
FROM nb""", ["load", "temperature", "humidity"]))
def q_linear_interpolate(spark, sf_dir):
    h = fx.hourly_nulls(spark, sf_dir)
    return round6(win.linear_interpolate(h, ["temperature", "humidity"]).select(
        "datetime", "load", "temperature", "humidity"))


_TREND_SQL = fs.HOURLY + """,
t0 AS (
  SELECT datetime, load, row_number() OVER (ORDER BY datetime) AS rn,
         lag(load) OVER (ORDER BY datetime) AS prev FROM hourly),
t1 AS (
  SELECT *, CASE WHEN prev = 0 AND load > 0 THEN 'increasing' WHEN prev = 0 AND load < 0 THEN 'decreasing'
                 WHEN load / nullif(prev, 0) - 1 > 0.02 THEN 'increasing'
                 WHEN load / nullif(prev, 0) - 1 < -0.02 THEN 'decreasing'
                 WHEN load / nullif(prev, 0) - 1 IS NOT NULL THEN 'stable' END AS dir FROM t0),
t2 AS (SELECT *, CASE WHEN lag(dir) OVER (ORDER BY rn) IS DISTINCT FROM dir THEN 1 ELSE 0 END AS new
       FROM t1 WHERE dir IS NOT NULL),
t3 AS (SELECT *, sum(new) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM t2),
t4 AS (SELECT run, any_value(dir) AS trend_type, count(*) AS duration, arg_min(load, rn) AS start_value,
              arg_max(load, rn) AS end_value, min(datetime) AS start_time, max(datetime) AS end_time
       FROM t3 GROUP BY run),
trends AS (
  SELECT start_time, end_time, trend_type, duration, start_value, end_value, end_value - start_value AS change_absolute,
         CASE WHEN start_value <> 0 THEN (end_value - start_value) / start_value ELSE 0.0 END AS change_rate
  FROM t4 WHERE duration >= 6)"""
_TREND_COLS = ["start_value", "end_value", "change_absolute", "change_rate", "confidence"]


@register("trend_runs", sql(_TREND_SQL.replace("duration >= 6", "duration >= 2"), """
SELECT *, least(1.0, duration / 24 * 0.5 + abs(change_rate) * 5) AS confidence FROM trends""", _TREND_COLS))
def q_trend_runs(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime", "load")
    return round6(insight.trend_runs(h, min_duration=2))


_TREND_GAPS_SQL = (fs.HOURLY + "," + _GAP_ROWS + _TREND_SQL[_TREND_SQL.index(",\nt0 AS"):]
                   .replace("lag(load) OVER (ORDER BY datetime) AS prev FROM hourly)", "lag(pad) OVER (ORDER BY datetime) AS prev, pad FROM padded)")
                   .replace("prev = 0 AND load", "prev = 0 AND pad").replace("load / nullif(prev, 0)", "pad / nullif(prev, 0)")
                   .replace("duration >= 6", "duration >= 2"))


@register("trend_runs_gaps", sql(_TREND_GAPS_SQL, """
SELECT *, least(1.0, duration / 24 * 0.5 + abs(change_rate) * 5) AS confidence FROM trends""", _TREND_COLS))
def q_trend_runs_gaps(spark, sf_dir):
    return round6(insight.trend_runs(fx.hourly_gaps(spark, sf_dir), min_duration=2, chunk=50))


_GAPS_SQL = fs.HOURLY_KEYED + """,
gp AS (
  SELECT event_type, lag(datetime) OVER (PARTITION BY event_type ORDER BY datetime) AS gap_start,
         datetime AS gap_end,
         date_diff('second', lag(datetime) OVER (PARTITION BY event_type ORDER BY datetime), datetime) / 3600.0 AS hours_gap
  FROM hourly_keyed)"""


@register("time_gaps", sql(_GAPS_SQL, "SELECT * FROM gp WHERE hours_gap > 2", ["hours_gap"]))
def q_time_gaps(spark, sf_dir):
    from ..operators import profile
    return round6(profile.time_gaps(fx.hourly_keyed(spark, sf_dir), keys=["event_type"]))


@register("time_continuity_summary", sql(_GAPS_SQL, """
SELECT event_type, count(*) FILTER (WHERE hours_gap > 2) = 0 AS is_continuous,
       count(*) FILTER (WHERE hours_gap > 2) AS n_gaps,
       sum(hours_gap) - count(hours_gap) AS total_missing_hours
FROM gp GROUP BY event_type""", ["total_missing_hours"]))
def q_time_continuity(spark, sf_dir):
    from ..operators import profile
    return round6(profile.time_continuity_summary(fx.hourly_keyed(spark, sf_dir), keys=["event_type"]))


@register("tail_n", sql(fs.HOURLY, "SELECT * FROM hourly ORDER BY datetime DESC LIMIT 168",
                        ["load", "temperature", "humidity"]))
def q_tail_n(spark, sf_dir):
    return round6(win.tail_n(fx.hourly(spark, sf_dir), 168))


@register("train_test_split", sql(fs.HOURLY, """
SELECT datetime, CAST(row_number() OVER (ORDER BY datetime) - 1 AS BIGINT) AS row_id,
       CASE WHEN row_number() OVER (ORDER BY datetime) - 1 < floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
FROM hourly"""))
def q_train_test_split(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime")
    return feat.train_test_split(h).select("datetime", "row_id", "split")


@register("timeseries_cv_folds", sql(fs.HOURLY, """
SELECT CAST(f.fold AS INTEGER) AS fold, r.row_id,
       CASE WHEN r.row_id < r.n - (5 - f.fold) * (r.n // 6) THEN 'train' ELSE 'test' END AS role
FROM (SELECT CAST(row_number() OVER (ORDER BY datetime) - 1 AS BIGINT) AS row_id, count(*) OVER () AS n FROM hourly) r
CROSS JOIN range(5) f(fold)
WHERE r.row_id < r.n - (5 - f.fold) * (r.n // 6) + (r.n // 6)"""))
def q_cv_folds(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("datetime")
    return feat.timeseries_cv_folds(h).select("fold", "row_id", "role")


@register("sequence_windows", sql(fs.HOURLY_IDX, """
SELECT row_id, load AS target,
  avg(load) OVER (ORDER BY row_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seq_mean_load,
  first_value(load) OVER (ORDER BY row_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seq_first_load,
  lag(load) OVER (ORDER BY row_id) AS seq_last_load,
  avg(temperature) OVER (ORDER BY row_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seq_mean_temperature
FROM hourly_idx QUALIFY row_id >= 24""", ["target", "seq_mean_load", "seq_first_load", "seq_last_load",
                                          "seq_mean_temperature"]))
def q_sequence_windows(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    s = feat.sequence_windows(h, ["load", "temperature"])
    return round6(s.select(
        "row_id", "target",
        F.aggregate(F.transform("sequence", lambda x: x[0]), F.lit(0.0), lambda a, b: a + b).alias("_s"),
        F.col("sequence")[0][0].alias("seq_first_load"),
        F.col("sequence")[23][0].alias("seq_last_load"),
        (F.aggregate(F.transform("sequence", lambda x: x[1]), F.lit(0.0), lambda a, b: a + b) / 24)
        .alias("seq_mean_temperature"))
        .withColumn("seq_mean_load", F.col("_s") / 24).drop("_s"))


@register("seasonal_abs_diff", sql(fs.HOURLY, """
SELECT count(*) AS n,
  CASE WHEN count(*) > 24 THEN avg(abs(load - l24)) ELSE avg(abs(load - l1)) END AS scale
FROM (SELECT load, lag(load, 24) OVER (ORDER BY datetime) AS l24, lag(load, 1) OVER (ORDER BY datetime) AS l1 FROM hourly)""",
                                   ["scale"]))
def q_seasonal_abs_diff(spark, sf_dir):
    return round6(feat.seasonal_abs_diff(fx.hourly(spark, sf_dir)))


@register("history_trim", sql("", """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 4"""))
def q_history_trim(spark, sf_dir):
    return txt.history_trim(fx.conversations(spark, sf_dir), max_turns=2).select("conv_id", "turn", "role")


_CF_DOUBLES = ["load", "temperature", "humidity", "load_lag_1h", "load_lag_24h", "load_lag_168h",
               "load_ma_3h", "load_ma_24h", "load_same_hour_last_week", "load_change_1h",
               "load_change_24h", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos",
               "month_sin", "month_cos", "day_of_month_sin", "day_of_month_cos",
               "apparent_temperature", "thermal_comfort_index", "heating_cooling_index",
               "temperature_squared", "temp_workday_interaction", "temp_humidity_interaction",
               "heat_humidity_index"]
_CF_SQL = LAGS_SQL + f""",
cf0 AS (
  SELECT l.*, round(h.temperature, 6) AS temperature, round(h.humidity, 6) AS humidity,
         CAST(isodow(l.datetime) - 1 AS INTEGER) AS day_of_week, isodow(l.datetime) >= 6 AS is_holiday,
         CAST(hour(l.datetime) AS INTEGER) AS hour, isodow(l.datetime) >= 6 AS is_weekend,
         CAST(month(l.datetime) AS INTEGER) AS month, CAST(day(l.datetime) AS INTEGER) AS day_of_month
  FROM lags l JOIN hourly h USING (datetime)),
cf1 AS (SELECT *, {WORKDAY_SQL} AS is_workday FROM cf0)"""
_CF_BODY = f"""
SELECT datetime, load, temperature, humidity, day_of_week, is_holiday, load_lag_1h, load_lag_24h, load_lag_168h,
  load_ma_3h, load_ma_24h, load_same_hour_last_week, load_change_1h, load_change_24h, hour, is_weekend,
  {_CYC}, month, day_of_month, is_workday,
  {APPARENT_SQL} AS apparent_temperature, temperature - 25 AS thermal_comfort_index,
  {HCI_SQL} AS heating_cooling_index, temperature * temperature AS temperature_squared,
  {TCAT_SQL} AS temperature_category, {HCAT_SQL} AS humidity_category,
  temperature * is_workday AS temp_workday_interaction, temperature * humidity / 100 AS temp_humidity_interaction,
  temperature * 0.7 + humidity * 0.09 AS heat_humidity_index, {TPERIOD_SQL} AS time_period
FROM cf1 WHERE load_lag_168h IS NOT NULL"""


@register("create_features", sql(_CF_SQL, _CF_BODY, _CF_DOUBLES))
def q_create_features(spark, sf_dir):
    base = std.standardize_columns(_pin6(fx.hourly(spark, sf_dir)))
    return round6(feat.create_features(base))


@register("trend_runs_daily", sql(_TREND_SQL.replace("FROM hourly)", "FROM daily_orders)")
                                  .replace(fs.HOURLY.strip(), fs.DAILY_ORDERS.strip())
                                  .replace("duration >= 6", "duration >= 3"),
                                  """SELECT *, least(1.0, duration / 24 * 0.5 + abs(change_rate) * 5) AS confidence
FROM trends""", _TREND_COLS))
def q_trend_runs_daily(spark, sf_dir):
    d = fx.daily_orders(spark, sf_dir)
    return round6(insight.trend_runs(d, min_duration=3))
