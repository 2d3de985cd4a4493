"""Queries: scans, fixtures, slice-1 anomaly insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import insight
from ..operators import windows as win
from ..plans.quantiles import quantile_columns
from ..sources import fixtures as fx
from . import fixture_sql as fs
from .registry import register, round6, sql


@register("parquet_series_scan", sql(fs.HOURLY, "SELECT * FROM hourly",
                                     ["load", "temperature", "humidity"]))
def q_parquet_series_scan(spark, sf_dir):
    return round6(fx.hourly(spark, sf_dir))


@register("parquet_series_scan_keyed", sql(fs.HOURLY_KEYED, "SELECT * FROM hourly_keyed",
                                           ["load", "temperature", "humidity"]))
def q_parquet_series_scan_keyed(spark, sf_dir):
    return round6(fx.hourly_keyed(spark, sf_dir))


@register("daily_orders_scan", sql(fs.DAILY_ORDERS, "SELECT * FROM daily_orders", ["load"]))
def q_daily_orders(spark, sf_dir):
    return round6(fx.daily_orders(spark, sf_dir))


@register("supplier_daily_scan", sql(fs.SUPPLIER_DAILY, "SELECT * FROM supplier_daily", ["load"]))
def q_supplier_daily(spark, sf_dir):
    return round6(fx.supplier_daily(spark, sf_dir))


# ------------------------------------------------ many series: one a supplier
_SUP_LAGS = ["load_lag_1h", "load_change_1h", "load_ma_3h"]


@register("supplier_lag_features", sql(fs.SUPPLIER_DAILY, """
SELECT l_suppkey, datetime, lag(load) OVER w AS load_lag_1h,
  CASE WHEN lag(load) OVER w = 0 AND load <> 0 THEN 0.0 ELSE load / nullif(lag(load) OVER w, 0) - 1 END AS load_change_1h,
  avg(load) OVER (PARTITION BY l_suppkey ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS load_ma_3h
FROM supplier_daily WINDOW w AS (PARTITION BY l_suppkey ORDER BY datetime)""", _SUP_LAGS))
def q_supplier_lags(spark, sf_dir):
    out = win.lag_features(fx.supplier_daily(spark, sf_dir), keys=["l_suppkey"])
    return round6(out.select("l_suppkey", "datetime", *_SUP_LAGS))


@register("supplier_quantiles", sql(fs.SUPPLIER_DAILY, """
SELECT l_suppkey, quantile_cont(load, 0.05) AS q05, quantile_cont(load, 0.5) AS median, quantile_cont(load, 0.95) AS q95
FROM supplier_daily GROUP BY 1""", ["q05", "median", "q95"]))
def q_supplier_quantiles(spark, sf_dir):
    return round6(quantile_columns(fx.supplier_daily(spark, sf_dir), "load", {"q05": 0.05, "median": 0.5, "q95": 0.95}, ["l_suppkey"]))


@register("supplier_cv_folds", sql(fs.SUPPLIER_DAILY, """
SELECT r.l_suppkey, CAST(f.fold AS INTEGER) AS fold, r.row_id,
       CASE WHEN r.row_id < r.n - (5 - f.fold) * (r.n // 6) THEN 'train' ELSE 'test' END AS role
FROM (SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY datetime) - 1 AS BIGINT) AS row_id,
             count(*) OVER (PARTITION BY l_suppkey) AS n FROM supplier_daily) r
CROSS JOIN range(5) f(fold)
WHERE r.row_id < r.n - (5 - f.fold) * (r.n // 6) + (r.n // 6)"""))
def q_supplier_folds(spark, sf_dir):
    d = fx.supplier_daily(spark, sf_dir).select("l_suppkey", "datetime")
    return feat.timeseries_cv_folds(d, keys=["l_suppkey"]).select("l_suppkey", "fold", "row_id", "role")


@register("supplier_trend_runs", sql(fs.SUPPLIER_DAILY, """
SELECT l_suppkey, trend_type, min(datetime) AS start_time, max(datetime) AS end_time, count(*) AS duration FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN lag(trend_type) OVER (PARTITION BY l_suppkey ORDER BY datetime) IS DISTINCT FROM trend_type THEN 1 ELSE 0 END AS fresh FROM (
      SELECT l_suppkey, datetime, CASE WHEN change > 0.02 THEN 'increasing' WHEN change < -0.02 THEN 'decreasing' ELSE 'stable' END AS trend_type FROM (
        SELECT *, load / lag(load) OVER (PARTITION BY l_suppkey ORDER BY datetime) - 1 AS change FROM supplier_daily)
      WHERE change IS NOT NULL)))
GROUP BY l_suppkey, run, trend_type HAVING count(*) >= 4"""))
def q_supplier_trends(spark, sf_dir):
    out = insight.trend_runs(fx.supplier_daily(spark, sf_dir), keys=["l_suppkey"], min_duration=4)
    return out.select("l_suppkey", "trend_type", "start_time", "end_time", "duration")


_ANOM = """
SELECT datetime, actual_load AS actual_value, predicted_load AS predicted_value,
       actual_load - predicted_load AS error,
       abs(actual_load - predicted_load) / predicted_load * 100 AS error_percentage,
       CASE WHEN abs(actual_load - predicted_load) / predicted_load > 0.3 THEN 'high'
            WHEN abs(actual_load - predicted_load) / predicted_load > 0.2 THEN 'medium'
            ELSE 'low' END AS severity,
       CASE WHEN abs(actual_load - predicted_load) / predicted_load > 0.3 THEN 0
            WHEN abs(actual_load - predicted_load) / predicted_load > 0.2 THEN 1
            ELSE 2 END AS severity_rank,
       CASE WHEN actual_load - predicted_load > 0 THEN 'high_error' ELSE 'low_error' END AS anomaly_type,
       coalesce(nullif(concat_ws('; ',
         CASE WHEN temperature > 35 THEN '{hot}' WHEN temperature < 5 THEN '{cold}' END,
         CASE WHEN load_lag_1h IS NULL THEN '{lag_missing}' END,
         CASE WHEN coalesce(is_holiday, false) THEN '{holiday}'
              WHEN coalesce(is_weekend, false) THEN '{weekend}' END,
         CASE WHEN month IN (6, 7, 8) AND actual_load - predicted_load > 0 THEN '{summer}'
              WHEN month IN (12, 1, 2) AND actual_load - predicted_load > 0 THEN '{winter}' END), ''),
         '{unknown}') AS causes
FROM pred
WHERE predicted_load <> 0 AND abs(actual_load - predicted_load) / predicted_load > 0.15
""".format(**insight.CAUSE_TEXT)


@register("anomaly_insights", sql(fs.PRED, _ANOM,
                                  ["actual_value", "predicted_value", "error", "error_percentage"]))
def q_anomaly_insights(spark, sf_dir):
    a = insight.anomaly_insights(fx.predictions_naive(spark, sf_dir))
    return round6(a.withColumn("causes", F.concat_ws("; ", "possible_causes"))
                   .drop("possible_causes"))
