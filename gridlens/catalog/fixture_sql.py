"""DuckDB twins of ``gridlens.sources.fixtures`` (oracle side only).

SQL fragments for rule columns are generated from the same fixed-value
tables the Spark functions use, so both engines evaluate one rule."""

from __future__ import annotations

from ..functions import calendar as cal
from ..sources.fixtures import LINEAR_WEIGHTS, QUESTION_TEXT


def holiday_sql(t: str) -> str:
    parts = [f"isodow({t}) >= 6"]
    for m, lo, hi in cal.HOLIDAY_RANGES:
        parts.append(f"(month({t}) = {m} AND day({t}) BETWEEN {lo} AND {hi})")
    return "(" + " OR ".join(parts) + ")"


def season_sql(t: str) -> str:
    whens = " ".join(f"WHEN month({t}) IN ({', '.join(map(str, ms))}) THEN '{name}'"
                     for name, ms in cal.SEASON_MONTHS.items())
    return f"(CASE {whens} ELSE '{cal.SEASON_OTHER}' END)"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


HOURLY = """
hourly AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
         SUM(value) AS load,
         AVG(CAST(json_extract_string(props, '$.k') AS DOUBLE)) * 0.5 - 5 AS temperature,
         100.0 * SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / COUNT(*) AS humidity
  FROM events GROUP BY 1)"""

HOURLY_KEYED = """
hourly_keyed AS (
  SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
         SUM(value) AS load,
         AVG(CAST(json_extract_string(props, '$.k') AS DOUBLE)) * 0.5 - 5 AS temperature,
         100.0 * SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / COUNT(*) AS humidity
  FROM events GROUP BY 1, 2)"""

HOURLY_IDX = HOURLY + """,
hourly_idx AS (
  SELECT *, CAST(row_number() OVER (ORDER BY datetime) - 1 AS BIGINT) AS row_id,
         lag(load, 1) OVER (ORDER BY datetime) AS load_lag_1h,
         lag(load, 24) OVER (ORDER BY datetime) AS load_lag_24h,
         lag(load, 168) OVER (ORDER BY datetime) AS load_lag_168h
  FROM hourly)"""

HOURLY_NULLS = HOURLY + """,
hourly_nulls AS (
  SELECT datetime, load,
         CASE WHEN (hour(datetime) * 7 + day(datetime)) % 11 = 3 THEN NULL ELSE temperature END AS temperature,
         CASE WHEN (hour(datetime) + day(datetime)) % 13 = 5 THEN NULL ELSE humidity END AS humidity
  FROM hourly)"""

PRED = HOURLY_IDX + f""",
pred AS (
  SELECT datetime, load AS actual_load, load_lag_24h AS predicted_load, temperature, humidity,
         load_lag_1h, CAST(hour(datetime) AS INTEGER) AS hour, CAST(month(datetime) AS INTEGER) AS month,
         isodow(datetime) >= 6 AS is_weekend, {holiday_sql('datetime')} AS is_holiday,
         CAST(NOT (isodow(datetime) >= 6) AND NOT {holiday_sql('datetime')} AS INTEGER) AS is_workday
  FROM hourly_idx WHERE load_lag_24h IS NOT NULL)"""

MODEL_PRED = HOURLY + """,
mp_wide AS (
  SELECT CAST(row_number() OVER w - 1 AS BIGINT) AS row_id, load AS y,
         lag(load, 1) OVER w AS lag_1, lag(load, 24) OVER w AS lag_24,
         avg(load) OVER (ORDER BY datetime ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS mean_24
  FROM hourly WINDOW w AS (ORDER BY datetime)),
model_pred AS (
  SELECT 'lag_1' AS model, row_id, y, lag_1 AS yhat FROM mp_wide WHERE row_id >= 24
  UNION ALL SELECT 'lag_24', row_id, y, lag_24 FROM mp_wide WHERE row_id >= 24
  UNION ALL SELECT 'mean_24', row_id, y, mean_24 FROM mp_wide WHERE row_id >= 24)"""

QUESTIONS = f"""
questions AS (SELECT conv_id, turn, role, {QUESTION_TEXT} AS text FROM conversations)"""

DAILY_ORDERS = """
daily_orders AS (
  SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS datetime, SUM(o_totalprice) AS load
  FROM orders GROUP BY 1)"""

SUPPLIER_DAILY = """
supplier_daily AS (
  SELECT l_suppkey, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS datetime,
         SUM(l_extendedprice) AS load
  FROM lineitem GROUP BY 1, 2)"""

REQUESTS = HOURLY_IDX + f""",
requests AS (
  SELECT datetime, CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
         temperature, humidity, {holiday_sql('datetime')} AS is_holiday, {season_sql('datetime')} AS season,
         load_lag_1h, load_lag_24h, load_lag_168h, load AS actual_load
  FROM hourly_idx)"""

_W = ", ".join(f"('{k}', {v})" for k, v in LINEAR_WEIGHTS.items())
_FEATS = " UNION ALL ".join(
    f"SELECT row_id, datetime, '{f}' AS feature, CAST({f} AS DOUBLE) AS feature_value FROM every_hour"
    for f in LINEAR_WEIGHTS)
CONTRIB = HOURLY_IDX + f""",
every_hour AS (
  SELECT *, CAST(hour(datetime) AS DOUBLE) AS hour, CAST(isodow(datetime) - 1 AS DOUBLE) AS day_of_week
  FROM hourly_idx),
c_long AS ({_FEATS}),
c_w(feature, w) AS (VALUES {_W}),
contrib AS (
  SELECT l.row_id, l.datetime, l.feature,
         w.w * (l.feature_value - avg(l.feature_value) OVER (PARTITION BY l.feature)) AS shap_value,
         l.feature_value
  FROM c_long l JOIN c_w w USING (feature)),
contributions AS (
  SELECT row_id, datetime, feature, shap_value, feature_value,
         CASE WHEN shap_value > 0 THEN 'positive' ELSE 'negative' END AS direction,
         abs(shap_value) AS abs_contribution
  FROM contrib)"""

_CORRS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(corr({'CAST(hour(datetime) AS DOUBLE)' if f == 'hour' else 'CAST(isodow(datetime) - 1 AS DOUBLE)' if f == 'day_of_week' else f}, load)) AS gain FROM hourly_idx"
    for f in LINEAR_WEIGHTS)
IMPORTANCES = CONTRIB + f""",
i_stats AS (
  SELECT c.feature, avg(c.abs_contribution) AS shap, stddev_pop(c.feature_value) AS sd, any_value(w.w) AS w
  FROM contributions c JOIN c_w w USING (feature) GROUP BY c.feature),
i_gain AS ({_CORRS}),
importances AS (
  SELECT 'SHAP' AS method, feature, shap AS score FROM i_stats
  UNION ALL SELECT 'LIME', feature, abs(w) * sd FROM i_stats
  UNION ALL SELECT 'Gain', feature, gain FROM i_gain
  UNION ALL SELECT 'Permutation', feature, w * w * sd * sd FROM i_stats)"""
