"""Queries: aggregations (§2.6), period comparisons and pair joins (§2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions.stats import safe_corr

from ..operators import compare as cmp
from ..operators import insight
from ..operators import profile as prof
from ..sources import fixtures as fx
from . import fixture_sql as fs
from .registry import register, round6, sql

P1 = ("2024-01-01", "2024-01-14")
P2 = ("2024-01-15", "2024-01-28")
Y1 = ("1996-01-01", "1996-12-31")
Y2 = ("1997-01-01", "1997-12-31")
P_SQL = ("CASE WHEN datetime BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-14' THEN 'p1' "
         "WHEN datetime BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-28' THEN 'p2' END")


@register("basic_info", sql(fs.HOURLY, """
SELECT count(*) AS n_rows, 4 AS n_columns, min(datetime) AS start, max(datetime) AS "end",
       CAST(floor(date_diff('second', min(datetime), max(datetime)) / 86400) AS BIGINT) AS date_range_days
FROM hourly"""))
def q_basic_info(spark, sf_dir):
    return prof.basic_info(fx.hourly(spark, sf_dir)).withColumn("n_columns", F.col("n_columns").cast("int"))


_MISS = fs.HOURLY_NULLS + """,
miss AS (
  SELECT 'datetime' AS "column", count(*) FILTER (WHERE datetime IS NULL) AS missing_count, count(*) AS n FROM hourly_nulls
  UNION ALL SELECT 'load', count(*) FILTER (WHERE load IS NULL), count(*) FROM hourly_nulls
  UNION ALL SELECT 'temperature', count(*) FILTER (WHERE temperature IS NULL), count(*) FROM hourly_nulls
  UNION ALL SELECT 'humidity', count(*) FILTER (WHERE humidity IS NULL), count(*) FROM hourly_nulls)"""


@register("missing_stats", sql(_MISS, """
SELECT "column", missing_count, round(missing_count / n * 100, 2) AS missing_pct FROM miss""", ["missing_pct"]))
def q_missing_stats(spark, sf_dir):
    return round6(prof.missing_stats(fx.hourly_nulls(spark, sf_dir)))


@register("quality_metrics", sql(_MISS, """
SELECT (SELECT count(*) FROM hourly_nulls) AS n_rows,
       (SELECT CAST(floor(date_diff('second', min(datetime), max(datetime)) / 86400) AS BIGINT) FROM hourly_nulls) AS n_days,
       round(sum(missing_count) / (any_value(n) * 4) * 100, 2) AS missing_pct,
       string_agg("column", ',' ORDER BY CASE "column" WHEN 'datetime' THEN 0 WHEN 'load' THEN 1
                  WHEN 'temperature' THEN 2 ELSE 3 END) FILTER (WHERE missing_count > 0) AS missing_columns
FROM miss""", ["missing_pct"]))
def q_quality_metrics(spark, sf_dir):
    return round6(prof.quality_metrics(fx.hourly_nulls(spark, sf_dir)))


@register("duplicate_stats", sql(fs.HOURLY_KEYED, """
SELECT CAST((SELECT count(*) FROM hourly_keyed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM hourly_keyed)) AS BIGINT) AS duplicate_rows,
       CAST((SELECT count(*) FROM hourly_keyed) - (SELECT count(DISTINCT datetime) FROM hourly_keyed) AS BIGINT) AS duplicate_datetimes,
       (SELECT count(*) FROM hourly_keyed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM hourly_keyed)) > 0 AS has_duplicates"""))
def q_duplicate_stats(spark, sf_dir):
    return prof.duplicate_stats(fx.hourly_keyed(spark, sf_dir))


_LONG = fs.HOURLY + """,
lv AS (SELECT 'load' AS "column", load AS value FROM hourly
       UNION ALL SELECT 'temperature', temperature FROM hourly
       UNION ALL SELECT 'humidity', humidity FROM hourly)"""


@register("outliers_iqr", sql(_LONG + """,
b AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n
      FROM lv GROUP BY 1),
o AS (SELECT l."column", l.value, b.n FROM lv l JOIN b USING ("column")
      WHERE l.value < b.q1 - 1.5 * (b.q3 - b.q1) OR l.value > b.q3 + 1.5 * (b.q3 - b.q1))""", """
SELECT "column", count(*) AS count, round(count(*) / any_value(n) * 100, 2) AS percentage,
       min(value) AS min_outlier, max(value) AS max_outlier, 'iqr' AS method FROM o GROUP BY 1""",
                              ["percentage", "min_outlier", "max_outlier"]))
def q_outliers_iqr(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    return round6(prof.outliers(h, ["load", "temperature", "humidity"], "iqr", 1.5))


@register("outliers_zscore", sql(_LONG + """,
b AS (SELECT "column", avg(value) AS mu, stddev_samp(value) AS sd, count(*) AS n FROM lv GROUP BY 1),
o AS (SELECT l."column", l.value, b.n FROM lv l JOIN b USING ("column") WHERE abs((l.value - b.mu) / b.sd) > 3.0)""",
                                 """
SELECT "column", count(*) AS count, round(count(*) / any_value(n) * 100, 2) AS percentage,
       min(value) AS min_outlier, max(value) AS max_outlier, 'zscore' AS method FROM o GROUP BY 1""",
                                 ["percentage", "min_outlier", "max_outlier"]))
def q_outliers_zscore(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    return round6(prof.outliers(h, ["load", "temperature", "humidity"], "zscore", 3.0))


@register("distribution_summary", sql(_LONG, """
SELECT "column", count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25,
       round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75,
       round(max(value), 4) AS max, round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurtosis
FROM lv GROUP BY 1""", ["mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis"]))
def q_distribution_summary(spark, sf_dir):
    return round6(prof.distribution_summary(fx.hourly(spark, sf_dir), ["load", "temperature", "humidity"]))


def _pattern_sql(key_expr, name, src=fs.HOURLY, table="hourly"):
    return sql(src, f"""SELECT CAST({key_expr} AS INTEGER) AS {name}, avg(load) AS mean, stddev_samp(load) AS std,
       count(load) AS count FROM {table} GROUP BY 1""", ["mean", "std"])


@register("hourly_pattern", _pattern_sql("hour(datetime)", "hour"))
def q_hourly_pattern(spark, sf_dir):
    return round6(prof.temporal_pattern(fx.hourly(spark, sf_dir), "hour"))


@register("weekly_pattern", _pattern_sql("isodow(datetime) - 1", "day_of_week"))
def q_weekly_pattern(spark, sf_dir):
    return round6(prof.temporal_pattern(fx.hourly(spark, sf_dir), "day_of_week"))


@register("monthly_pattern", _pattern_sql("month(datetime)", "month", fs.DAILY_ORDERS, "daily_orders"))
def q_monthly_pattern(spark, sf_dir):
    return round6(prof.temporal_pattern(fx.daily_orders(spark, sf_dir), "month"))


@register("patterns_grouping_sets", sql(fs.HOURLY, """
SELECT CASE WHEN grouping(h) = 0 THEN 'hour' WHEN grouping(d) = 0 THEN 'day_of_week' ELSE 'month' END AS pattern,
       CAST(coalesce(h, d, m) AS INTEGER) AS key, avg(load) AS mean, stddev_samp(load) AS std, count(load) AS count
FROM (SELECT hour(datetime) AS h, isodow(datetime) - 1 AS d, month(datetime) AS m, load FROM hourly)
GROUP BY GROUPING SETS ((h), (d), (m))""", ["mean", "std"]))
def q_patterns_gs(spark, sf_dir):
    return round6(prof.patterns_grouping_sets(fx.hourly(spark, sf_dir)))


@register("hour_dow_matrix", sql(fs.HOURLY, "SELECT CAST(hour(datetime) AS INTEGER) AS hour, " + ", ".join(
    f"avg(load) FILTER (WHERE isodow(datetime) - 1 = {d}) AS d{d}" for d in range(7)) + " FROM hourly GROUP BY 1",
                                 [f"d{d}" for d in range(7)]))
def q_hour_dow(spark, sf_dir):
    return round6(prof.hour_dow_matrix(fx.hourly(spark, sf_dir)))


@register("resample_mean", sql(fs.HOURLY_KEYED, """
SELECT event_type, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime, avg(load) AS load,
       avg(temperature) AS temperature, avg(humidity) AS humidity FROM hourly_keyed GROUP BY 1, 2""",
                               ["load", "temperature", "humidity"]))
def q_resample_mean(spark, sf_dir):
    return round6(prof.resample_mean(fx.hourly_keyed(spark, sf_dir), "day", keys=["event_type"]))


@register("resample_mean_spine", sql(fs.HOURLY_KEYED + """,
s AS (SELECT event_type, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM hourly_keyed GROUP BY 1)""", """
SELECT s.event_type, s.datetime, k.load, k.temperature, k.humidity FROM s LEFT JOIN hourly_keyed k USING (event_type, datetime)""",
                                     ["load", "temperature", "humidity"]))
def q_resample_spine(spark, sf_dir):
    """Hours in which a series has no event appear with null means."""
    return round6(prof.resample_mean(fx.hourly_keyed(spark, sf_dir), "hour", keys=["event_type"]))


@register("correlation_pair", sql(fs.HOURLY, "SELECT corr(temperature, load) AS correlation FROM hourly",
                                  ["correlation"]))
def q_corr_pair(spark, sf_dir):
    return round6(fx.hourly(spark, sf_dir).agg(safe_corr("temperature", "load").alias("correlation")))


_CM = ["load", "temperature", "humidity"]


@register("correlation_matrix", sql(fs.HOURLY, " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM hourly"
    for a in _CM for b in _CM), ["correlation"]))
def q_corr_matrix(spark, sf_dir):
    return round6(prof.correlation_matrix(fx.hourly(spark, sf_dir)))


@register("lagged_correlation", sql(fs.HOURLY + ",\nlg AS (SELECT load, " + ", ".join(
    f"lag(temperature, {k}) OVER (ORDER BY datetime) AS l{k}" for k in range(25)) + " FROM hourly),\ncs AS (" +
    " UNION ALL ".join(f"SELECT {k} AS lag, corr(load, l{k}) AS correlation FROM lg" for k in range(25)) + ")",
    """SELECT 'load' AS feature1, 'temperature' AS feature2, CAST(lag AS INTEGER) AS lag, correlation,
       CAST(row_number() OVER (ORDER BY abs(correlation) DESC, lag) AS INTEGER) AS rank
FROM cs WHERE abs(correlation) > 0.01 QUALIFY rank <= 5""", ["correlation"]))
def q_lagged_corr(spark, sf_dir):
    return round6(insight.lagged_correlation(fx.hourly(spark, sf_dir), "load", "temperature", min_abs=0.01))


_TD = ["temperature", "humidity", "load_lag_1h", "load_lag_24h", "load_lag_168h"]


@register("top_drivers", sql(fs.HOURLY_IDX + ",\ncs AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, load) AS correlation FROM hourly_idx" for c in _TD) + ")",
    """SELECT feature, correlation, CAST(row_number() OVER (ORDER BY abs(correlation) DESC, feature) AS INTEGER) AS rank
FROM cs WHERE abs(correlation) > 0.01 QUALIFY rank <= 10""", ["correlation"]))
def q_top_drivers(spark, sf_dir):
    h = fx.hourly_indexed(spark, sf_dir).drop("row_id")
    return round6(prof.top_drivers(h, min_abs=0.01))


_STATS_COLS = ["total", "mean", "std", "min", "max", "median", "q25", "q75", "daily_mean_max", "daily_mean_min",
               "workday_mean", "weekend_mean", "temperature_mean", "temperature_max", "temperature_min"]


@register("series_statistics", sql(fs.HOURLY + """,
dm AS (SELECT avg(load) AS m FROM hourly GROUP BY CAST(datetime AS DATE))""", """
SELECT sum(load) AS total, avg(load) AS mean, stddev_samp(load) AS std, min(load) AS min, max(load) AS max,
       quantile_cont(load, 0.5) AS median, quantile_cont(load, 0.25) AS q25, quantile_cont(load, 0.75) AS q75,
       (SELECT max(m) FROM dm) AS daily_mean_max, (SELECT min(m) FROM dm) AS daily_mean_min,
       avg(load) FILTER (WHERE isodow(datetime) < 6) AS workday_mean,
       avg(load) FILTER (WHERE isodow(datetime) >= 6) AS weekend_mean,
       avg(temperature) AS temperature_mean, max(temperature) AS temperature_max, min(temperature) AS temperature_min
FROM hourly""", _STATS_COLS))
def q_series_statistics(spark, sf_dir):
    return round6(prof.series_statistics(fx.hourly(spark, sf_dir)))


@register("daily_aggregates", sql(fs.HOURLY, """
SELECT CAST(datetime AS DATE) AS date, avg(load) AS mean, max(load) AS max, min(load) AS min FROM hourly GROUP BY 1""",
                                  ["mean", "max", "min"]))
def q_daily_aggregates(spark, sf_dir):
    return round6(prof.daily_aggregates(fx.hourly(spark, sf_dir)))


@register("accuracy_stats", sql(fs.PRED, """
SELECT avg(abs(actual_load - predicted_load)) AS mae,
       sqrt(avg((actual_load - predicted_load) ^ 2)) AS rmse,
       avg(abs(actual_load - predicted_load) / abs(CASE WHEN actual_load = 0 THEN 1 ELSE actual_load END) * 100) AS mape,
       max(abs(actual_load - predicted_load) / abs(CASE WHEN actual_load = 0 THEN 1 ELSE actual_load END) * 100) AS max_error_pct,
       CASE WHEN sum((actual_load - (SELECT avg(actual_load) FROM pred)) ^ 2) = 0 THEN 0.0
            ELSE 1 - sum((actual_load - predicted_load) ^ 2) / sum((actual_load - (SELECT avg(actual_load) FROM pred)) ^ 2) END AS r2
FROM pred""", ["mae", "rmse", "mape", "max_error_pct", "r2"]))
def q_accuracy_stats(spark, sf_dir):
    return round6(prof.accuracy_stats(fx.predictions_naive(spark, sf_dir)))


_PS = fs.HOURLY + f""",
tagged AS (SELECT *, {P_SQL} AS period FROM hourly),
ps AS (SELECT period, count(*) AS count, avg(load) AS mean, stddev_samp(load) AS std, min(load) AS min,
              max(load) AS max, quantile_cont(load, 0.5) AS median, sum(load) AS sum
       FROM tagged WHERE period IS NOT NULL GROUP BY 1)"""


@register("period_stats", sql(_PS, "SELECT * FROM ps", ["mean", "std", "min", "max", "median", "sum"]))
def q_period_stats(spark, sf_dir):
    return round6(cmp.period_stats(fx.hourly(spark, sf_dir), [("p1", *P1), ("p2", *P2)]))


@register("period_diff", sql(_PS + """,
a AS (SELECT * FROM ps WHERE period = 'p1'), b AS (SELECT * FROM ps WHERE period = 'p2')""", """
SELECT round(b.mean - a.mean, 2) AS mean_diff,
       CASE WHEN a.mean <> 0 THEN round((b.mean - a.mean) / a.mean * 100, 2) ELSE 0.0 END AS mean_diff_pct,
       round(b.max - a.max, 2) AS max_diff, round(b.min - a.min, 2) AS min_diff, round(b.sum - a.sum, 2) AS sum_diff
FROM a, b""", ["mean_diff", "mean_diff_pct", "max_diff", "min_diff", "sum_diff"]))
def q_period_diff(spark, sf_dir):
    s = cmp.period_stats(fx.hourly(spark, sf_dir), [("p1", *P1), ("p2", *P2)])
    return round6(cmp.period_diff(s, "p1", "p2"))


_GR = fs.DAILY_ORDERS + """,
gt AS (SELECT *, CASE WHEN datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' THEN 'y1'
                      WHEN datetime BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' THEN 'y2' END AS period
       FROM daily_orders)"""


@register("granular_means", sql(_GR, """
SELECT period, strftime(datetime, '%Y-%m') AS bucket, avg(load) AS mean, count(*) AS count
FROM gt WHERE period IS NOT NULL GROUP BY 1, 2""", ["mean"]))
def q_granular_means(spark, sf_dir):
    return round6(cmp.granular_means(fx.daily_orders(spark, sf_dir), [("y1", *Y1), ("y2", *Y2)], "monthly"))


@register("granular_means_weekly", sql(_GR, """
SELECT period, strftime(date_trunc('week', datetime), '%Y-%m-%d') || '/' ||
       strftime(CAST(date_trunc('week', datetime) AS DATE) + 6, '%Y-%m-%d') AS bucket, avg(load) AS mean, count(*) AS count
FROM gt WHERE period IS NOT NULL GROUP BY 1, 2""", ["mean"]))
def q_granular_weekly(spark, sf_dir):
    return round6(cmp.granular_means(fx.daily_orders(spark, sf_dir), [("y1", *Y1), ("y2", *Y2)], "weekly"))


@register("hourly_diff", sql(fs.HOURLY + f""",
hd AS (SELECT CAST(hour(datetime) AS INTEGER) AS hour,
              avg(load) FILTER (WHERE {P_SQL} = 'p1') AS p1_avg, avg(load) FILTER (WHERE {P_SQL} = 'p2') AS p2_avg
       FROM hourly GROUP BY 1 HAVING p1_avg IS NOT NULL AND p2_avg IS NOT NULL),
hd2 AS (SELECT *, p2_avg - p1_avg AS diff, CASE WHEN p1_avg <> 0 THEN (p2_avg - p1_avg) / p1_avg * 100 ELSE 0.0 END AS diff_pct FROM hd)""",
                             """
SELECT *, row_number() OVER (ORDER BY abs(diff) DESC, hour) = 1 AS is_max_diff,
       row_number() OVER (ORDER BY abs(diff) ASC, hour) = 1 AS is_min_diff FROM hd2""",
                             ["p1_avg", "p2_avg", "diff", "diff_pct"]))
def q_hourly_diff(spark, sf_dir):
    return round6(cmp.hourly_diff(fx.hourly(spark, sf_dir), P1, P2))


@register("workday_diff", sql(fs.HOURLY + f""",
wd AS (SELECT CASE WHEN NOT (isodow(datetime) >= 6) AND NOT {fs.holiday_sql('datetime')} THEN 'workday' ELSE 'weekend' END AS day_type,
              avg(load) FILTER (WHERE {P_SQL} = 'p1') AS p1_avg, avg(load) FILTER (WHERE {P_SQL} = 'p2') AS p2_avg
       FROM hourly GROUP BY 1 HAVING p1_avg IS NOT NULL AND p2_avg IS NOT NULL)""", """
SELECT *, p2_avg - p1_avg AS diff, CASE WHEN p1_avg <> 0 THEN (p2_avg - p1_avg) / p1_avg * 100 ELSE 0.0 END AS diff_pct
FROM wd""", ["p1_avg", "p2_avg", "diff", "diff_pct"]))
def q_workday_diff(spark, sf_dir):
    return round6(cmp.workday_diff(fx.hourly(spark, sf_dir), P1, P2))


@register("conversation_stats", sql(fs.HOURLY, "SELECT avg(load) AS mean, max(load) AS max, min(load) AS min FROM hourly",
                                    ["mean", "max", "min"]))
def q_conversation_stats(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    return round6(h.agg(F.avg("load").alias("mean"), F.max("load").alias("max"), F.min("load").alias("min")))


_QT = fs.HOURLY + """,
c AS (SELECT temperature - (SELECT avg(temperature) FROM hourly) AS u, load AS v FROM hourly),
s AS (SELECT count(u) AS n, sum(u) AS s1, sum(u^2) AS s2, sum(u^3) AS s3, sum(u^4) AS s4, sum(v) AS t0,
             sum(u * v) AS t1, sum(u * u * v) AS t2, min(u) AS umin, max(u) AS umax,
             (SELECT avg(temperature) FROM hourly) AS mx FROM c),
d AS (SELECT *,
  n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS dd,
  t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2) AS da,
  n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) AS db,
  n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) AS dc FROM s),
g AS (SELECT *, umin + (umax - umin) * i / 99 AS u FROM d, range(100) r(i))"""


@register("quadratic_trend", sql(_QT, """
SELECT CAST(i AS INTEGER) AS i, u + mx AS temperature, da / dd + db / dd * u + dc / dd * u * u AS fitted FROM g""",
                                 ["temperature", "fitted"]))
def q_quadratic(spark, sf_dir):
    return round6(prof.quadratic_trend(fx.hourly(spark, sf_dir)))


@register("importance_normalised", sql(fs.IMPORTANCES, """
SELECT method, feature, score, CAST(row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS INTEGER) AS rank,
       score / nullif(max(score) OVER (PARTITION BY method), 0) AS normalised FROM importances""",
                                       ["score", "normalised"]))
def q_importance_norm(spark, sf_dir):
    return round6(prof.importance_normalised(fx.importances(spark, sf_dir), keys=["method"]))


_FC = fs.CONTRIB + """,
pairs AS (SELECT b.row_id AS pair_id, a.row_id AS row1, b.row_id AS row2
          FROM (SELECT DISTINCT row_id, datetime FROM contributions) a
          JOIN (SELECT DISTINCT row_id, datetime FROM contributions) b ON a.datetime = b.datetime - INTERVAL 24 HOUR),
s1 AS (SELECT p.pair_id, c.feature, c.feature_value AS value1, c.shap_value AS shap1 FROM pairs p JOIN contributions c ON c.row_id = p.row1),
s2 AS (SELECT p.pair_id, c.feature, c.feature_value AS value2, c.shap_value AS shap2 FROM pairs p JOIN contributions c ON c.row_id = p.row2),
fc AS (SELECT coalesce(s1.pair_id, s2.pair_id) AS pair_id, coalesce(s1.feature, s2.feature) AS feature,
              coalesce(value1, 0.0) AS value1, coalesce(value2, 0.0) AS value2, coalesce(shap1, 0.0) AS shap1,
              coalesce(shap2, 0.0) AS shap2
       FROM s1 FULL OUTER JOIN s2 ON s1.pair_id = s2.pair_id AND s1.feature = s2.feature)"""


@register("feature_change", sql(_FC, """
SELECT pair_id, feature, value1, value2, shap1, shap2, value2 - value1 AS value_change, shap2 - shap1 AS shap_change,
       CASE WHEN shap2 - shap1 > 20 THEN 'driver' WHEN shap2 - shap1 < -20 THEN 'reducer' ELSE 'neutral' END AS impact_type,
       CAST(row_number() OVER (PARTITION BY pair_id ORDER BY abs(shap2 - shap1) DESC, feature) AS INTEGER) AS rank
FROM fc""", ["value1", "value2", "shap1", "shap2", "value_change", "shap_change"]))
def q_feature_change(spark, sf_dir):
    c = fx.contributions_linear(spark, sf_dir)
    pairs = cmp.offset_pairs(c, 24)
    return round6(cmp.feature_change(c, pairs))


@register("report_diff", sql(fs.CONTRIB + """,
topc AS (SELECT * FROM contributions QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature) <= 5),
pairs AS (SELECT b.row_id AS pair_id, a.row_id AS row1, b.row_id AS row2
          FROM (SELECT DISTINCT row_id, datetime FROM contributions) a
          JOIN (SELECT DISTINCT row_id, datetime FROM contributions) b ON a.datetime = b.datetime - INTERVAL 24 HOUR),
s1 AS (SELECT p.pair_id, c.feature, c.shap_value AS shap1 FROM pairs p JOIN topc c ON c.row_id = p.row1),
s2 AS (SELECT p.pair_id, c.feature, c.shap_value AS shap2 FROM pairs p JOIN topc c ON c.row_id = p.row2),
fc AS (SELECT coalesce(s1.pair_id, s2.pair_id) AS pair_id, coalesce(s1.feature, s2.feature) AS feature,
              coalesce(shap1, 0.0) AS shap1, coalesce(shap2, 0.0) AS shap2
       FROM s1 FULL OUTER JOIN s2 ON s1.pair_id = s2.pair_id AND s1.feature = s2.feature)""", """
SELECT pair_id, feature, shap1, shap2, shap2 - shap1 AS change,
       CASE WHEN shap2 - shap1 > 0 THEN 'increase' ELSE 'decrease' END AS change_direction
FROM fc WHERE abs(shap2 - shap1) > 10""", ["shap1", "shap2", "change"]))
def q_report_diff(spark, sf_dir):
    c = fx.contributions_linear(spark, sf_dir)
    return round6(cmp.report_diff(c, cmp.offset_pairs(c, 24)))
