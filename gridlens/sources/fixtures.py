"""Series derived from the shared test tables (see FIXTURES.md §2).

Each builder reads whole tables; every derived row comes from data, so the
work grows with the tables.  The DuckDB twins live in
``gridlens.catalog.fixture_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.stats import safe_corr

from ..functions import calendar as cal
from ..operators import windows as win
from ..plans import ordered as o
from .series import event_weather_aggs, hour_bucket, parquet_series_scan
from .tables import read_table

# ---- fixed values: contribution weights of the linear fixture --------------
LINEAR_WEIGHTS = {"temperature": 12.0, "humidity": -3.0, "hour": 8.0,
                  "day_of_week": -15.0, "load_lag_1h": 0.6, "load_lag_24h": 0.3}
# ---------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events", ["ts", "event_type", "value", "props"])


def hourly(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``(datetime, load, temperature, humidity)`` — one row per hour
    (optionally only the hours ``start .. end``, pushed to the scan)."""
    return parquet_series_scan(events(spark, sf_dir), "ts", "value", extra=event_weather_aggs(),
                               start=start, end=end)


def hourly_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same per ``event_type`` (5 series with gaps)."""
    return parquet_series_scan(events(spark, sf_dir), "ts", "value", keys=["event_type"],
                               extra=event_weather_aggs())


def hourly_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    hr, day = F.hour("datetime"), F.dayofmonth("datetime")
    return h.withColumns({
        "temperature": F.when((hr * 7 + day) % 11 == 3, F.lit(None).cast("double"))
                        .otherwise(F.col("temperature")),
        "humidity": F.when((hr + day) % 13 == 5, F.lit(None).cast("double"))
                     .otherwise(F.col("humidity")),
    })


def hourly_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign-style input: alias names, load as text, some 'n/a' values."""
    h = hourly(spark, sf_dir)
    pos = (F.dayofmonth("datetime") - 1) * 24 + F.hour("datetime")
    return h.select(
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("Datetime"),
        F.when(pos % 50 == 49, F.lit("n/a")).otherwise(F.col("load").cast("string")).alias("load_MW"),
        F.col("temperature").alias("db_temp"),
        F.col("humidity").alias("rh"))


def hourly_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` + ``row_id`` (0-based time position) + row lags 1/24/168."""
    h = hourly(spark, sf_dir)
    lags = win.add_lags(h, "load", {"load_lag_1h": 1, "load_lag_24h": 24, "load_lag_168h": 168},
                        keep_index=True)
    return lags.withColumnRenamed(o.IDX, "row_id")


def predictions_naive(spark: SparkSession, sf_dir: str, indexed: DataFrame | None = None) -> DataFrame:
    """Seasonal-naive forecast: ``predicted_load = load 24 rows earlier``."""
    h = indexed if indexed is not None else hourly_indexed(spark, sf_dir)
    t = F.col("datetime")
    return h.filter(F.col("load_lag_24h").isNotNull()).select(
        "datetime", F.col("load").alias("actual_load"),
        F.col("load_lag_24h").alias("predicted_load"),
        "temperature", "humidity", "load_lag_1h",
        F.hour(t).alias("hour"), F.month(t).alias("month"),
        (F.weekday(t) >= 5).alias("is_weekend"), cal.holiday_flag(t).alias("is_holiday"),
        cal.workday_flag(F.weekday(t) >= 5, cal.holiday_flag(t)).alias("is_workday"))


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ``(model, row_id, y, yhat)``: lag-1, lag-24 and 24-row mean
    forecasts for rows 24 onward."""
    h = hourly(spark, sf_dir)
    lo = o.layout(h, "datetime", halo=24)
    w = lo.window
    wide = lo.finish(lo.df.withColumns({
        "lag_1": F.lag("load", 1).over(w),
        "lag_24": F.lag("load", 24).over(w),
        "mean_24": F.avg("load").over(w.rowsBetween(-24, -1)),
    }), keep_index=True).filter(F.col(o.IDX) >= 24)
    return wide.select(F.col(o.IDX).alias("row_id"), F.col("load").alias("y"),
                       F.expr("stack(3, 'lag_1', lag_1, 'lag_24', lag_24, 'mean_24', mean_24)")
                       .alias("model", "yhat"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    return od.groupBy(hour_bucket("o_orderdate", "day").alias("datetime")).agg(
        F.sum("o_totalprice").alias("load"))


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice"])
    return li.groupBy("l_suppkey", hour_bucket("l_shipdate", "day").alias("datetime")).agg(
        F.sum("l_extendedprice").alias("load"))


def hourly_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` load with two long null gaps: two days, and eight days."""
    day = F.dayofmonth("datetime")
    return hourly(spark, sf_dir).select("datetime", F.when(~(day.isin(5, 6) | day.between(12, 19)), F.col("load")).alias("load"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests: every hour, with lags as columns."""
    h = hourly_indexed(spark, sf_dir)
    t = F.col("datetime")
    return h.select(
        "datetime", F.hour(t).alias("hour"), F.weekday(t).alias("day_of_week"),
        "temperature", "humidity", cal.holiday_flag(t).alias("is_holiday"),
        cal.season(t).alias("season"), "load_lag_1h", "load_lag_24h", "load_lag_168h",
        F.col("load").alias("actual_load"))


def contributions_linear(spark: SparkSession, sf_dir: str, indexed: DataFrame | None = None) -> DataFrame:
    """Long contributions of a linear model on every hour:
    ``shap_value = w_f * (x_f - mean(x_f))``."""
    h = indexed if indexed is not None else hourly_indexed(spark, sf_dir)
    t = F.col("datetime")
    last = h.withColumns({"hour": F.hour(t).cast("double"), "day_of_week": F.weekday(t).cast("double")})
    feats = list(LINEAR_WEIGHTS)
    stacked = last.select(
        "row_id", "datetime",
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                     F.col(f).cast("double").alias("feature_value"))
                            for f in feats])).alias("kv")).select("row_id", "datetime", "kv.*")
    means = stacked.groupBy("feature").agg(F.avg("feature_value").alias("_mean"))
    weights = F.broadcast(spark.createDataFrame(list(LINEAR_WEIGHTS.items()), "feature string, w double"))
    out = (stacked.join(F.broadcast(means), "feature").join(weights, "feature")
           .withColumn("shap_value", F.col("w") * (F.col("feature_value") - F.col("_mean"))))
    return out.select("row_id", "datetime", "feature", "shap_value", "feature_value",
                      F.when(F.col("shap_value") > 0, "positive").otherwise("negative").alias("direction"),
                      F.abs("shap_value").alias("abs_contribution"))


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ``(method, feature, score)`` for four methods, derived from the
    linear contributions: SHAP = mean |phi|, LIME = |w| * std, Gain = |corr(x, load)|,
    Permutation = w^2 * var."""
    h = hourly_indexed(spark, sf_dir)
    c = contributions_linear(spark, sf_dir, indexed=h)
    weights = F.broadcast(spark.createDataFrame(list(LINEAR_WEIGHTS.items()), "feature string, w double"))
    stats = (c.groupBy("feature").agg(F.avg("abs_contribution").alias("shap"),
                                      F.stddev_pop("feature_value").alias("sd"))
             .join(weights, "feature"))
    t = F.col("datetime")
    hh = h.withColumns({"hour": F.hour(t).cast("double"), "day_of_week": F.weekday(t).cast("double")})
    corr = hh.agg(*[F.abs(safe_corr(f, "load")).alias(f) for f in LINEAR_WEIGHTS])
    corr_long = corr.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                         F.col(f).alias("gain"))
                                                for f in LINEAR_WEIGHTS])).alias("kv")).select("kv.*")
    wide = stats.join(F.broadcast(corr_long), "feature")
    return wide.select("feature", F.expr(
        "stack(4, 'SHAP', shap, 'LIME', abs(w) * sd, 'Gain', gain, 'Permutation', w * w * sd * sd)")
        .alias("method", "score")).select("method", "feature", "score")


#: Text of a turn with what the parsers look for, from its numbers; the same SQL in both engines.
QUESTION_TEXT = """CASE (conv_id + turn) % 5
  WHEN 0 THEN concat(text, ' ', CAST(conv_id % 12 + 1 AS STRING), '月', CAST(turn % 12 + 1 AS STRING), '月')
  WHEN 1 THEN concat('2024-01-', lpad(CAST(turn % 28 + 1 AS STRING), 2, '0'), ' ', text, ' 2024/02/', lpad(CAST(conv_id % 28 + 1 AS STRING), 2, '0'))
  WHEN 2 THEN concat(text, ' ', CAST(conv_id % 45 AS STRING), '.5°C 湿度 ', CAST(turn * 7 % 100 AS STRING), CASE turn % 3 WHEN 0 THEN '工作日' WHEN 1 THEN '周末' ELSE '节假日' END)
  WHEN 3 THEN concat('```json', chr(10), text, chr(10), '```')
  ELSE concat(text, ' 2024-01-03 ', CAST(turn AS STRING), ' C') END"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` with months, dates, scenarios or a code fence in its text."""
    return conversations(spark, sf_dir).withColumn("text", F.expr(QUESTION_TEXT))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
