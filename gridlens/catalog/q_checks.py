"""Queries: validation (§2.8), joins (§2.5), sorting / ranking (§2.7),
metrics, ensembles and rank agreement (§2.9 / §2.10, SQL-expressible part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import metrics as met
from ..operators import ranking as rk
from ..operators import validation as val
from ..operators import insight
from ..sources import fixtures as fx
from . import fixture_sql as fs
from .registry import register, round6, sql

_VCOLS = ["check", "column", "status", "n_bad"]


def _v(df):
    return df.select(*_VCOLS)


# ------------------------------------------------------------- §2.8 validation
@register("validate_columns")
def q_validate_columns(spark, sf_dir):
    return _v(val.validate_columns(fx.hourly_nulls(spark, sf_dir)))


@register("validate_dtypes")
def q_validate_dtypes(spark, sf_dir):
    return _v(val.validate_dtypes(fx.hourly_text(spark, sf_dir).withColumnRenamed("Datetime", "datetime")))


_VR = fs.HOURLY_NULLS + """,
vr AS (SELECT *, hour(datetime) AS hour, isodow(datetime) - 1 AS day_of_week FROM hourly_nulls)"""
_RANGE_SQL = " UNION ALL ".join(
    f"""SELECT 'ranges' AS "check", '{c}' AS "column",
       CASE WHEN count({c}) = 0 THEN 'warning' WHEN count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) > 0 THEN 'error'
            ELSE 'passed' END AS status,
       count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_bad FROM vr"""
    for c, (lo, hi) in val.RANGE_RULES.items())


@register("validate_ranges", sql(_VR, _RANGE_SQL))
def q_validate_ranges(spark, sf_dir):
    h = fx.hourly_nulls(spark, sf_dir)
    h = h.withColumns({"hour": F.hour("datetime"), "day_of_week": F.weekday("datetime")})
    return _v(val.validate_ranges(h))


_MISS_SQL = " UNION ALL ".join(
    f"""SELECT 'missing' AS "check", '{c}' AS "column",
       CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 'passed'
            WHEN count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) > 10 THEN 'error' ELSE 'warning' END AS status,
       count(*) FILTER (WHERE {c} IS NULL) AS n_bad FROM hourly_nulls"""
    for c in ("datetime", "load", "temperature", "humidity"))


@register("validate_missing", sql(fs.HOURLY_NULLS, _MISS_SQL))
def q_validate_missing(spark, sf_dir):
    return _v(val.validate_missing(fx.hourly_nulls(spark, sf_dir)))


@register("validate_duplicates", sql(fs.HOURLY_KEYED, """
SELECT 'duplicates' AS "check", 'datetime' AS "column",
       CASE WHEN count(*) - count(DISTINCT datetime) > 0 THEN 'error' ELSE 'passed' END AS status,
       count(*) - count(DISTINCT datetime) AS n_bad FROM hourly_keyed
UNION ALL
SELECT 'duplicates', NULL, CASE WHEN d > 0 THEN 'warning' ELSE 'passed' END, d
FROM (SELECT (SELECT count(*) FROM hourly_keyed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM hourly_keyed)) AS d)"""))
def q_validate_duplicates(spark, sf_dir):
    return _v(val.validate_duplicates(fx.hourly_keyed(spark, sf_dir)))


@register("validate_continuity", sql(fs.HOURLY_KEYED, """
SELECT event_type, 'continuity' AS "check", 'datetime' AS "column",
       CASE WHEN count(*) FILTER (WHERE g > 2) > 0 THEN 'warning' ELSE 'passed' END AS status,
       count(*) FILTER (WHERE g > 2) AS n_bad
FROM (SELECT event_type, date_diff('second', lag(datetime) OVER (PARTITION BY event_type ORDER BY datetime), datetime) / 3600.0 AS g
      FROM hourly_keyed) GROUP BY event_type"""))
def q_validate_continuity(spark, sf_dir):
    return val.validate_continuity(fx.hourly_keyed(spark, sf_dir), keys=["event_type"]).select("event_type", *_VCOLS)


@register("validate_consistency", sql(fs.HOURLY + f""",
vc AS (SELECT datetime, isodow(datetime) >= 6 AS is_weekend, {fs.holiday_sql('datetime')} AS is_holiday,
              CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week FROM hourly)""",
                                       """
SELECT 'consistency:weekend_holiday' AS "check", 'is_holiday' AS "column",
       CASE WHEN count(*) FILTER (WHERE is_weekend AND NOT is_holiday) > 0 THEN 'warning' ELSE 'passed' END AS status,
       count(*) FILTER (WHERE is_weekend AND NOT is_holiday) AS n_bad FROM vc
UNION ALL SELECT 'consistency:hour_matches_time', 'hour', CASE WHEN count(*) FILTER (WHERE hour <> hour(datetime)) > 0
       THEN 'warning' ELSE 'passed' END, count(*) FILTER (WHERE hour <> hour(datetime)) FROM vc
UNION ALL SELECT 'consistency:dow_matches_time', 'day_of_week', CASE WHEN count(*) FILTER (WHERE day_of_week <> isodow(datetime) - 1) > 0
       THEN 'warning' ELSE 'passed' END, count(*) FILTER (WHERE day_of_week <> isodow(datetime) - 1) FROM vc"""))
def q_validate_consistency(spark, sf_dir):
    from ..functions import calendar as cal
    h = fx.hourly(spark, sf_dir)
    t = F.col("datetime")
    h = h.select("datetime", (F.weekday(t) >= 5).alias("is_weekend"), cal.holiday_flag(t).alias("is_holiday"),
                 F.hour(t).alias("hour"), F.weekday(t).alias("day_of_week"))
    return _v(val.validate_consistency(h))


_ALL_CTE = fs.HOURLY_NULLS + """,
vr AS (SELECT * FROM hourly_nulls)"""
_ALL_SQL = " UNION ALL ".join([
    *[f"""SELECT 'columns' AS "check", '{c}' AS "column", 'passed' AS status, 0 AS n_bad""" for c in val.REQUIRED_COLUMNS],
    *[f"SELECT 'columns', '{c}', 'warning', 1" for c in val.OPTIONAL_COLUMNS],
    *[f"SELECT 'dtypes', '{c}', 'passed', 0" for c in val.DTYPE_RULES],
    " UNION ALL ".join(p for p in _RANGE_SQL.split(" UNION ALL ") if "'hour'" not in p and "'day_of_week'" not in p),
    _MISS_SQL,
    """SELECT 'duplicates', 'datetime', CASE WHEN count(*) > count(DISTINCT datetime) THEN 'error' ELSE 'passed' END, count(*) - count(DISTINCT datetime) FROM hourly_nulls""",
    """SELECT 'duplicates', NULL, CASE WHEN d > 0 THEN 'warning' ELSE 'passed' END, d
       FROM (SELECT (SELECT count(*) FROM hourly_nulls) - (SELECT count(*) FROM (SELECT DISTINCT * FROM hourly_nulls)) AS d)""",
    """SELECT 'continuity', 'datetime', CASE WHEN count(*) FILTER (WHERE g > 2) > 0 THEN 'warning' ELSE 'passed' END, count(*) FILTER (WHERE g > 2)
       FROM (SELECT date_diff('second', lag(datetime) OVER (ORDER BY datetime), datetime) / 3600.0 AS g FROM hourly_nulls)"""])


@register("validate_all", sql(_ALL_CTE, _ALL_SQL))
def q_validate_all(spark, sf_dir):
    return _v(val.validate_all(fx.hourly_nulls(spark, sf_dir)))


@register("validation_summary", sql(_ALL_CTE, f"""
SELECT count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'warning') AS warnings,
       count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'error') = 0 AS is_valid
FROM ({_ALL_SQL})"""))
def q_validation_summary(spark, sf_dir):
    return val.validation_summary(val.validate_all(fx.hourly_nulls(spark, sf_dir)))


@register("validate_minimum", sql(fs.HOURLY, """
SELECT 'minimum' AS "check", 'load' AS "column", CASE WHEN count(load) = 0 THEN 'error' ELSE 'passed' END AS status,
       CASE WHEN count(load) = 0 THEN 1 ELSE 0 END AS n_bad FROM hourly
UNION ALL SELECT 'minimum', 'load', CASE WHEN min(load) < 0 THEN 'error' ELSE 'passed' END,
       CASE WHEN min(load) < 0 THEN 1 ELSE 0 END FROM hourly
UNION ALL SELECT 'minimum', NULL, CASE WHEN count(*) < 100 THEN 'error' ELSE 'passed' END,
       CASE WHEN count(*) < 100 THEN 1 ELSE 0 END FROM hourly
UNION ALL SELECT 'minimum', 'temperature', CASE WHEN count(*) FILTER (WHERE temperature < -50 OR temperature > 60) > 0
       THEN 'warning' ELSE 'passed' END, count(*) FILTER (WHERE temperature < -50 OR temperature > 60) FROM hourly
UNION ALL SELECT 'minimum', 'humidity', CASE WHEN count(*) FILTER (WHERE humidity < 0 OR humidity > 100) > 0
       THEN 'warning' ELSE 'passed' END, count(*) FILTER (WHERE humidity < 0 OR humidity > 100) FROM hourly"""))
def q_validate_minimum(spark, sf_dir):
    return _v(val.validate_minimum(fx.hourly(spark, sf_dir)))


@register("needs_fill", sql(fs.HOURLY_NULLS, """
SELECT 'temperature' AS "column", count(*) FILTER (WHERE temperature IS NULL) AS n_missing, false AS absent,
       count(*) FILTER (WHERE temperature IS NULL) > 0 AS needs_fill FROM hourly_nulls
UNION ALL SELECT 'humidity', count(*) FILTER (WHERE humidity IS NULL), false,
       count(*) FILTER (WHERE humidity IS NULL) > 0 FROM hourly_nulls"""))
def q_needs_fill(spark, sf_dir):
    return val.needs_fill(fx.hourly_nulls(spark, sf_dir))


_HM = fs.HOURLY_NULLS + """,
hm AS (SELECT hour(datetime) AS h, avg(temperature) AS ht, avg(humidity) AS hh FROM hourly_nulls GROUP BY 1),
mm AS (SELECT month(datetime) AS m, avg(temperature) AS mt, avg(humidity) AS mh FROM hourly_nulls GROUP BY 1),
filled AS (
  SELECT n.datetime, n.load,
         coalesce(n.temperature, coalesce(mm.mt, 20.0) * 0.6 + coalesce(hm.ht, 20.0) * 0.4) AS temperature,
         coalesce(n.humidity, coalesce(mm.mh, 50.0) * 0.6 + coalesce(hm.hh, 50.0) * 0.4) AS humidity
  FROM hourly_nulls n LEFT JOIN hm ON hour(n.datetime) = hm.h LEFT JOIN mm ON month(n.datetime) = mm.m)"""


@register("hour_month_mean_fill", sql(_HM, "SELECT * FROM filled", ["load", "temperature", "humidity"]))
def q_hour_month_fill(spark, sf_dir):
    return round6(jn.hour_month_mean_fill(fx.hourly_nulls(spark, sf_dir)).select(
        "datetime", "load", "temperature", "humidity"))


@register("weather_fill", sql(_HM, "SELECT * FROM filled", ["load", "temperature", "humidity"]))
def q_weather_fill(spark, sf_dir):
    return round6(jn.weather_fill(fx.hourly_nulls(spark, sf_dir), "auto").select(
        "datetime", "load", "temperature", "humidity"))


@register("weather_join", sql(fs.HOURLY_NULLS + """,
wx AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h,
              avg(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.5 - 5) AS t,
              avg(CASE WHEN event_type = 'error' THEN 100.0 ELSE 0.0 END) AS u FROM events GROUP BY 1)""", """
SELECT n.datetime, n.load, coalesce(n.temperature, wx.t) AS temperature, coalesce(n.humidity, wx.u) AS humidity
FROM hourly_nulls n LEFT JOIN wx ON n.datetime = wx.h""", ["load", "temperature", "humidity"]))
def q_weather_join(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    weather = ev.select(F.col("ts").alias("datetime"),
                        (F.get_json_object("props", "$.k").cast("double") * 0.5 - 5).alias("temperature"),
                        F.when(F.col("event_type") == "error", 100.0).otherwise(0.0).alias("humidity"))
    return round6(jn.weather_join(fx.hourly_nulls(spark, sf_dir), weather).select(
        "datetime", "load", "temperature", "humidity"))


_HIST = fs.REQUESTS + """,
hl AS (
  SELECT r.datetime, h1.load AS load_lag_1h, h2.load AS load_lag_2h, h24.load AS load_lag_24h, h168.load AS load_lag_168h
  FROM requests r
  LEFT JOIN hourly h1 ON h1.datetime = r.datetime - INTERVAL 1 HOUR
  LEFT JOIN hourly h2 ON h2.datetime = r.datetime - INTERVAL 2 HOUR
  LEFT JOIN hourly h24 ON h24.datetime = r.datetime - INTERVAL 24 HOUR
  LEFT JOIN hourly h168 ON h168.datetime = r.datetime - INTERVAL 168 HOUR)"""


def _hist_req(spark, sf_dir):
    req = fx.requests(spark, sf_dir).select("datetime")
    return jn.history_lag_lookup(req, fx.hourly(spark, sf_dir))


@register("history_lag_lookup", sql(_HIST, "SELECT *, load_lag_168h AS load_same_hour_last_week FROM hl",
                                    ["load_lag_1h", "load_lag_2h", "load_lag_24h", "load_lag_168h",
                                     "load_same_hour_last_week"]))
def q_history_lag(spark, sf_dir):
    return round6(_hist_req(spark, sf_dir))


@register("history_change", sql(_HIST, """
SELECT datetime, (load_lag_1h - load_lag_2h) / nullif(load_lag_2h, 0) AS load_change_1h,
       (load_lag_1h - load_lag_24h) / nullif(load_lag_24h, 0) AS load_change_24h FROM hl""",
                                ["load_change_1h", "load_change_24h"]))
def q_history_change(spark, sf_dir):
    return round6(jn.history_change(_hist_req(spark, sf_dir)).select("datetime", "load_change_1h", "load_change_24h"))


@register("history_range_mean", sql(_HIST + """,
rm AS (SELECT r.datetime,
              avg(h.load) FILTER (WHERE h.datetime >= r.datetime - INTERVAL 3 HOUR) AS m3,
              avg(h.load) AS m24
       FROM requests r LEFT JOIN hourly h ON h.datetime >= r.datetime - INTERVAL 24 HOUR AND h.datetime < r.datetime
       GROUP BY r.datetime)""", """
SELECT rm.datetime, coalesce(m3, hl.load_lag_1h, 1500.0) AS load_ma_3h, coalesce(m24, hl.load_lag_24h, 1500.0) AS load_ma_24h
FROM rm JOIN hl USING (datetime)""", ["load_ma_3h", "load_ma_24h"]))
def q_history_range_mean(spark, sf_dir):
    r = _hist_req(spark, sf_dir)
    return round6(jn.history_range_mean(r, fx.hourly(spark, sf_dir)).select("datetime", "load_ma_3h", "load_ma_24h"))


_IMP_PART = fs.IMPORTANCES + """,
imp AS (SELECT * FROM importances WHERE NOT (method = 'LIME' AND feature IN ('hour', 'humidity'))),
feats AS (SELECT DISTINCT feature FROM imp), meths AS (SELECT DISTINCT method FROM imp),
rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rank FROM imp),
iu AS (SELECT m.method, f.feature, coalesce(rk.score, 0.0) AS score,
              CAST(coalesce(rk.rank, (SELECT count(*) FROM feats)) AS INTEGER) AS rank
       FROM meths m CROSS JOIN feats f LEFT JOIN rk ON rk.method = m.method AND rk.feature = f.feature)"""


def _imp_part(spark, sf_dir):
    i = fx.importances(spark, sf_dir)
    return i.filter(~((F.col("method") == "LIME") & F.col("feature").isin("hour", "humidity")))


@register("importance_union", sql(_IMP_PART, "SELECT * FROM iu", ["score"]))
def q_importance_union(spark, sf_dir):
    return round6(jn.importance_union(_imp_part(spark, sf_dir)))


@register("feature_pairs", sql(_IMP_PART, """
SELECT a.feature AS feature1, b.feature AS feature2, avg(abs(a.rank - b.rank)) AS mean_rank_diff,
       CAST(row_number() OVER (ORDER BY avg(abs(a.rank - b.rank)) DESC, a.feature, b.feature) AS INTEGER) AS pair_rank
FROM iu a JOIN iu b ON a.method = b.method AND a.feature < b.feature
GROUP BY a.feature, b.feature QUALIFY pair_rank <= 5""", ["mean_rank_diff"]))
def q_feature_pairs(spark, sf_dir):
    return round6(jn.feature_pairs(jn.importance_union(_imp_part(spark, sf_dir))).drop("rank_diffs"))


@register("kendall_w", sql(_IMP_PART + """,
per AS (SELECT feature, sum(rank) AS rs, avg(rank) AS rm FROM iu GROUP BY 1),
dims AS (SELECT count(DISTINCT method) AS k, count(DISTINCT feature) AS n FROM iu),
kw AS (SELECT k, n, 12 * sum((rs - k * (n + 1) / 2.0) ^ 2) / (k * k * (n ^ 3 - n)) AS kendall_w,
              12 * sum((rm - (n + 1) / 2.0) ^ 2) / (k * k * (n ^ 3 - n)) AS kendall_w_ref
       FROM per, dims GROUP BY k, n)""", """
SELECT *, CASE WHEN kendall_w >= 0.9 THEN 'very high agreement' WHEN kendall_w >= 0.7 THEN 'high agreement'
               WHEN kendall_w >= 0.5 THEN 'moderate agreement' WHEN kendall_w >= 0.3 THEN 'low agreement'
               ELSE 'very low agreement' END AS interpretation FROM kw""", ["kendall_w", "kendall_w_ref"]))
def q_kendall(spark, sf_dir):
    return round6(met.kendall_w(jn.importance_union(_imp_part(spark, sf_dir))))


@register("consensus_rank", sql(_IMP_PART, """
SELECT feature, CAST(sum(rank) AS BIGINT) AS rank_sum, CAST(row_number() OVER (ORDER BY sum(rank), feature) AS INTEGER) AS consensus_rank
FROM iu GROUP BY feature"""))
def q_consensus(spark, sf_dir):
    r = met.consensus_rank(jn.importance_union(_imp_part(spark, sf_dir)))
    return r.withColumn("rank_sum", F.col("rank_sum").cast("bigint"))


@register("dense_rank_desc", sql(fs.IMPORTANCES, """
SELECT method, feature, score, CAST(row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS INTEGER) AS rank
FROM importances""", ["score"]))
def q_dense_rank(spark, sf_dir):
    return round6(rk.dense_rank_desc(fx.importances(spark, sf_dir)))


@register("xai_rank_compare", sql(fs.IMPORTANCES + """,
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS INTEGER) AS rank FROM importances)""",
                                  "SELECT feature, " + ", ".join(
                                      f"any_value(rank) FILTER (WHERE method = '{m}') AS {m}_rank, "
                                      f"any_value(score) FILTER (WHERE method = '{m}') AS {m}_score"
                                      for m in ("SHAP", "LIME", "Gain", "Permutation")) + " FROM r GROUP BY feature",
                                  [f"{m}_score" for m in ("SHAP", "LIME", "Gain", "Permutation")]))
def q_xai_rank_compare(spark, sf_dir):
    return round6(met.xai_rank_compare(rk.dense_rank_desc(fx.importances(spark, sf_dir))))


@register("shap_for_timestamp", sql(fs.CONTRIB + """,
an AS (SELECT DISTINCT datetime FROM hourly_idx WHERE load_lag_24h IS NOT NULL
       AND abs(load - load_lag_24h) / load_lag_24h > 0.15)""", """
SELECT c.datetime, c.row_id, c.feature, c.shap_value, c.feature_value, c.direction, c.abs_contribution,
       CAST(row_number() OVER (PARTITION BY c.datetime ORDER BY abs(c.shap_value) DESC, c.feature) AS INTEGER) AS rank
FROM an JOIN contributions c USING (datetime) WHERE c.shap_value IS NOT NULL QUALIFY rank <= 10""",
                                    ["shap_value", "feature_value", "abs_contribution"]))
def q_shap_for_ts(spark, sf_dir):
    h = fx.hourly_indexed(spark, sf_dir)
    a = insight.anomaly_insights(fx.predictions_naive(spark, sf_dir, indexed=h))
    return round6(jn.shap_for_timestamp(a, fx.contributions_linear(spark, sf_dir, indexed=h)))


@register("grid_cross_join", sql(fs.HOURLY + """,
g AS (SELECT min(temperature) + (max(temperature) - min(temperature)) * i / 4 AS grid_value
      FROM hourly, range(5) r(i) GROUP BY i)""", """
SELECT datetime, grid_value, load FROM hourly CROSS JOIN g""", ["grid_value", "load"]))
def q_grid_cross(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    rng = h.agg(F.min("temperature").alias("lo"), F.max("temperature").alias("hi"))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "lo", "hi").select(
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 4).alias("grid_value"))
    return round6(jn.grid_cross_join(h.select("datetime", "load"), grid).select("datetime", "grid_value", "load"))


# ------------------------------------------------------------ §2.7 sort / rank
@register("time_sort", sql(fs.HOURLY_KEYED, "SELECT event_type, datetime, load FROM hourly_keyed", ["load"]))
def q_time_sort(spark, sf_dir):
    return round6(fx.hourly_keyed(spark, sf_dir).select("event_type", "datetime", "load")
                  .orderBy("event_type", "datetime"))


_DEV = fs.PRED + """,
dev AS (SELECT datetime, actual_load, predicted_load, abs(actual_load - predicted_load) / predicted_load * 100 AS deviation_pct,
               CASE WHEN abs(actual_load - predicted_load) / predicted_load * 100 > 50 THEN 'critical'
                    WHEN abs(actual_load - predicted_load) / predicted_load * 100 > 30 THEN 'high' ELSE 'medium' END AS severity
        FROM pred WHERE predicted_load IS NOT NULL AND predicted_load <> 0 AND actual_load IS NOT NULL
          AND abs(actual_load - predicted_load) / predicted_load * 100 > 15)"""


@register("severity_topn", sql(_DEV, """
SELECT datetime, actual_load, predicted_load, deviation_pct, severity FROM dev
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, datetime LIMIT 20""",
                               ["actual_load", "predicted_load", "deviation_pct"]))
def q_severity_topn(spark, sf_dir):
    from ..operators import anomaly
    d = anomaly.deviation_scan(fx.predictions_naive(spark, sf_dir), top=None)
    return round6(rk.severity_topn(d, 20).select("datetime", "actual_load", "predicted_load", "deviation_pct",
                                                  "severity"))


@register("abs_topk", sql(fs.CONTRIB, """
SELECT row_id, feature, shap_value, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature) AS INTEGER) AS rank
FROM contributions QUALIFY rank <= 3""", ["shap_value"]))
def q_abs_topk(spark, sf_dir):
    c = fx.contributions_linear(spark, sf_dir)
    return round6(rk.abs_topk(c, 3).select("row_id", "feature", "shap_value", "rank"))


_MET = fs.MODEL_PRED + """,
mp_src AS (SELECT * FROM model_pred WHERE __SRC__),
mu AS (SELECT model, avg(y) AS m FROM mp_src GROUP BY 1),
sc AS (SELECT a.model, avg(abs(a.y - b.y)) AS scale FROM model_pred a JOIN model_pred b
       ON a.model = b.model AND a.row_id = b.row_id + 24 GROUP BY 1),
met AS (
  SELECT p.model, count(*) AS n, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ^ 2)) AS rmse,
         avg(abs((y - yhat) / y)) FILTER (WHERE y <> 0) * 100 AS mape,
         CASE WHEN sum((y - mu.m) ^ 2) <> 0 THEN 1 - sum((y - yhat) ^ 2) / sum((y - mu.m) ^ 2) END AS r2,
         avg(abs(yhat - y) / ((abs(y) + abs(yhat)) / 2)) FILTER (WHERE (abs(y) + abs(yhat)) / 2 <> 0) * 100 AS smape,
         avg(abs(y - yhat)) / nullif(any_value(sc.scale), 0) AS mase
  FROM mp_src p JOIN mu USING (model) JOIN sc USING (model) GROUP BY p.model)"""
_MET_COLS = ["mae", "rmse", "mape", "r2", "smape", "mase"]


def _metrics(spark, sf_dir):
    mp = fx.model_predictions(spark, sf_dir)
    return met.regression_metrics(mp, ["model"], scale=met.seasonal_scale(mp))


@register("regression_metrics", sql(_MET.replace("__SRC__", "true"), "SELECT * FROM met", _MET_COLS))
def q_regression_metrics(spark, sf_dir):
    return round6(_metrics(spark, sf_dir))


@register("compare_models", sql(_MET.replace("__SRC__", "model <> 'mean_24' OR row_id >= 48"),
                                "SELECT * FROM met", _MET_COLS))
def q_compare_models(spark, sf_dir):
    mp = fx.model_predictions(spark, sf_dir)
    return round6(met.compare_models(mp, ["model"], sequence_models=["mean_24"], scale=met.seasonal_scale(mp)))


@register("model_ranking", sql(_MET.replace("__SRC__", "true"), """
SELECT model, mae, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank FROM met""", ["mae"]))
def q_model_ranking(spark, sf_dir):
    return round6(rk.model_ranking(_metrics(spark, sf_dir)).select("model", "mae", "rank"))


@register("comparison_table", sql(_MET.replace("__SRC__", "true"), """
SELECT model, mae, r2, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank_mae,
       CAST(row_number() OVER (ORDER BY r2 DESC, model) AS INTEGER) AS rank_r2 FROM met""", ["mae", "r2"]))
def q_comparison_table(spark, sf_dir):
    return round6(met.comparison_table(_metrics(spark, sf_dir)).select("model", "mae", "r2", "rank_mae", "rank_r2"))


@register("select_best", sql(_MET.replace("__SRC__", "true"), "SELECT arg_min(model, mae) AS best_model, min(mae) AS mae FROM met", ["mae"]))
def q_select_best(spark, sf_dir):
    return round6(rk.select_best(_metrics(spark, sf_dir)))


@register("metric_unpivot", sql(_MET.replace("__SRC__", "true"), """
SELECT model, 'mae' AS metric, mae AS value FROM met UNION ALL SELECT model, 'rmse', rmse FROM met
UNION ALL SELECT model, 'r2', r2 FROM met""", ["value"]))
def q_metric_unpivot(spark, sf_dir):
    from ..operators import profile
    m = _metrics(spark, sf_dir).select("model", "mae", "rmse", "r2")
    return round6(profile.metric_unpivot(m, "model", ["mae", "rmse", "r2"]))


_EVAL = fs.PRED + """,
ev AS (SELECT actual_load AS y, predicted_load AS yhat, least(predicted_load, load_lag_1h) AS lower_bound,
              greatest(predicted_load, load_lag_1h) AS upper_bound FROM pred),
p95 AS (SELECT quantile_cont(abs(y - yhat), 0.95) AS q FROM ev)"""


@register("evaluate_model", sql(_EVAL, """
SELECT avg(y) AS actual_mean, stddev_pop(y) AS actual_std, avg(yhat) AS predicted_mean, stddev_pop(yhat) AS predicted_std,
       max(y - yhat) AS max_error, min(y - yhat) AS min_error,
       count(*) FILTER (WHERE abs(y - yhat) > (SELECT q FROM p95)) AS n_large_errors,
       round(avg(CASE WHEN y BETWEEN lower_bound AND upper_bound THEN 1.0 ELSE 0.0 END) * 100, 2) AS coverage_pct
FROM ev""", ["actual_mean", "actual_std", "predicted_mean", "predicted_std", "max_error", "min_error", "coverage_pct"]))
def q_evaluate_model(spark, sf_dir):
    p = fx.predictions_naive(spark, sf_dir)
    e = p.select(F.col("actual_load").alias("y"), F.col("predicted_load").alias("yhat"),
                 F.least("predicted_load", "load_lag_1h").alias("lower_bound"),
                 F.greatest("predicted_load", "load_lag_1h").alias("upper_bound"))
    r = met.evaluate_model(e, keys=[])
    return round6(r.select("actual_mean", "actual_std", "predicted_mean", "predicted_std", "max_error",
                           "min_error", "n_large_errors", "coverage_pct"))


@register("ensemble_weights_auto", sql(fs.MODEL_PRED + """,
err AS (SELECT model, avg(abs(y - yhat)) AS error FROM model_pred WHERE row_id >= 48 GROUP BY 1),
ex AS (SELECT model, error, exp(-10 * (error - (SELECT min(error) FROM err))) AS x FROM err)""", """
SELECT model, error, x / (SELECT sum(x) FROM ex) AS weight FROM ex""", ["error", "weight"]))
def q_ensemble_weights_auto(spark, sf_dir):
    return round6(met.ensemble_weights_auto(fx.model_predictions(spark, sf_dir)))


_WM = fs.MODEL_PRED + """,
err AS (SELECT model, avg(abs(y - yhat)) AS e FROM model_pred GROUP BY 1),
wm AS (SELECT model, (1.0 / e) / sum(1.0 / e) OVER () AS weight FROM err)"""


def _inverse_error_weights(spark, sf_dir):
    mp = fx.model_predictions(spark, sf_dir)
    e = mp.groupBy("model").agg((1.0 / F.avg(F.abs(F.col("y") - F.col("yhat")))).alias("weight"))
    return met.ensemble_weights_manual(e)


@register("ensemble_weights_manual", sql(_WM, "SELECT * FROM wm", ["weight"]))
def q_ensemble_weights_manual(spark, sf_dir):
    return round6(_inverse_error_weights(spark, sf_dir))


@register("ensemble_predict", sql(_WM, """
SELECT p.row_id, any_value(p.y) AS y, sum(coalesce(w.weight, 0.0) * p.yhat) AS ensemble
FROM model_pred p LEFT JOIN wm w USING (model) GROUP BY p.row_id""", ["y", "ensemble"]))
def q_ensemble_predict(spark, sf_dir):
    mp = fx.model_predictions(spark, sf_dir)
    return round6(met.ensemble_predict(mp, _inverse_error_weights(spark, sf_dir)).drop("individual"))


@register("ensemble_interval")
def q_ensemble_interval(spark, sf_dir):
    mp = fx.model_predictions(spark, sf_dir)
    return round6(met.ensemble_interval(mp, _inverse_error_weights(spark, sf_dir)))


@register("sample_n")
def q_sample_n(spark, sf_dir):
    return rk.sample_n(fx.hourly(spark, sf_dir), 100, ["datetime"], seed=42)


@register("bootstrap_resample")
def q_bootstrap(spark, sf_dir):
    b = rk.bootstrap_weights(fx.hourly(spark, sf_dir), "datetime", 10)
    return b.groupBy("replicate").agg(F.sum("weight").alias("n_drawn"),
                                      (F.sum(F.col("weight") * F.col("load")) / F.sum("weight")).alias("mean_load"))


@register("feature_set_union", sql(fs.CONTRIB, "SELECT DISTINCT feature FROM contributions"))
def q_feature_set_union(spark, sf_dir):
    c = fx.contributions_linear(spark, sf_dir)
    # union of the features that push up and those that push down
    return rk.feature_set_union(c.filter(F.col("shap_value") > 0), c.filter(F.col("shap_value") <= 0))


@register("cv_average", sql(fs.HOURLY + """,
r AS (SELECT CAST(row_number() OVER (ORDER BY datetime) - 1 AS BIGINT) AS row_id, load,
             lag(load, 24) OVER (ORDER BY datetime) AS yhat, count(*) OVER () AS n FROM hourly),
f AS (SELECT fold, r.* FROM r CROSS JOIN range(5) t(fold)
      WHERE row_id >= n - (5 - fold) * (n // 6) AND row_id < n - (5 - fold) * (n // 6) + (n // 6)),
fm AS (SELECT fold, avg(abs(load - yhat)) AS mae, sqrt(avg((load - yhat) ^ 2)) AS rmse FROM f GROUP BY fold),
cv AS (SELECT 'seasonal_naive' AS model, 'mae' AS metric, mae AS value FROM fm
       UNION ALL SELECT 'seasonal_naive', 'rmse', rmse FROM fm)""", """
SELECT model, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n_folds FROM cv GROUP BY 1, 2""",
                          ["mean", "std"]))
def q_cv_average(spark, sf_dir):
    from ..operators import features as feat
    h = fx.hourly(spark, sf_dir)
    lagged = fx.hourly_indexed(spark, sf_dir).select("datetime", "load_lag_24h")
    folds = feat.timeseries_cv_folds(h.select("datetime", "load")).filter(F.col("role") == "test")
    f = folds.join(lagged, "datetime")
    fm = f.groupBy("fold").agg(F.avg(F.abs(F.col("load") - F.col("load_lag_24h"))).alias("mae"),
                               F.sqrt(F.avg(F.pow(F.col("load") - F.col("load_lag_24h"), 2))).alias("rmse"))
    cv = fm.select(F.lit("seasonal_naive").alias("model"), "fold",
                   F.expr("stack(2, 'mae', mae, 'rmse', rmse)").alias("metric", "value"))
    return round6(met.cv_average(cv))
