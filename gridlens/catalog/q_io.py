"""Queries: sources, sinks and remaining projections (§2.1, §2.2)."""

from __future__ import annotations

import os
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import insight
from ..operators import report as rep
from ..operators import standardize as std
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import series as src
from . import fixture_sql as fs
from .q_features import _CF_SQL, _STD, _pin6
from .registry import register, round6, sql


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex}")


def _csv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "hourly-csv")
    src.csv_sink(fx.hourly_text(spark, sf_dir), path)
    return src.csv_scan(spark, path, "Datetime string, load_MW string, db_temp double, rh double",
                        time_col="Datetime")


@register("csv_sink", sql(fs.HOURLY, "SELECT * FROM hourly", ["load", "temperature", "humidity"]))
def q_csv_sink(spark, sf_dir):
    path = _scratch(spark, "hourly")
    src.csv_sink(fx.hourly(spark, sf_dir), path)
    back = spark.read.option("header", True).schema(
        "datetime timestamp_ntz, load double, temperature double, humidity double").csv(path)
    return round6(back)


@register("csv_scan", sql(_STD, """
SELECT CAST(Datetime AS TIMESTAMP) AS Datetime, load_MW, db_temp, rh FROM hourly_text""", ["db_temp", "rh"]))
def q_csv_scan(spark, sf_dir):
    return round6(_csv_roundtrip(spark, sf_dir))


@register("load_series", sql(_STD, "SELECT * FROM std WHERE load IS NOT NULL", ["load", "temperature", "humidity"]))
def q_load_series(spark, sf_dir):
    return round6(src.load_series(_csv_roundtrip(spark, sf_dir)).select(*std.CONTRACT))


@register("report_text_sink")
def q_report_text_sink(spark, sf_dir):
    from .q_models import q_series_report
    lines = q_series_report(spark, sf_dir)
    path = _scratch(spark, "report")
    rep.write_report_text(lines, path)
    return spark.read.text(path)


@register("calendar_spine", sql(fs.HOURLY_KEYED + f""",
sp AS (SELECT event_type, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM hourly_keyed GROUP BY 1),
cal AS (SELECT event_type, datetime, CAST(datetime AS DATE) AS date, CAST(hour(datetime) AS INTEGER) AS hour,
               CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week, isodow(datetime) >= 6 AS is_weekend,
               {fs.holiday_sql('datetime')} AS is_holiday, {fs.season_sql('datetime')} AS season FROM sp)""", """
SELECT c.*, k.load FROM cal c LEFT JOIN hourly_keyed k USING (event_type, datetime)""",
                                ["load"]))
def q_calendar_spine(spark, sf_dir):
    hk = fx.hourly_keyed(spark, sf_dir)
    spine = src.add_generator_calendar(src.spine_from(hk, keys=["event_type"]))
    return round6(spine.join(hk.select("event_type", "datetime", "load"), ["event_type", "datetime"], "left"))


_NUMERIC = [c for c in feat.FEATURES]


@register("select_numeric_features", sql(_CF_SQL + ",\npp AS (" + __import__(
    "gridlens.catalog.q_features", fromlist=["_CF_BODY"])._CF_BODY + ")", "SELECT datetime, " + ", ".join(_NUMERIC) +
                                         " FROM pp",
                                         [c for c in _NUMERIC if c not in ("hour", "day_of_week", "month",
                                                                           "day_of_month", "is_workday")]))
def q_select_numeric(spark, sf_dir):
    base = std.standardize_columns(_pin6(fx.hourly(spark, sf_dir)))
    fe = feat.create_features(base)
    cols = std.select_numeric_features(fe)
    return round6(fe.select("datetime", *cols))


@register("fill_absent_features", sql(fs.REQUESTS, """
SELECT datetime, temperature, humidity, 0.0 AS apparent_temperature, 0.0 AS load_ma_3h, 0.0 AS month_sin
FROM requests""", ["temperature", "humidity", "apparent_temperature", "load_ma_3h", "month_sin"]))
def q_fill_absent(spark, sf_dir):
    r = fx.requests(spark, sf_dir).select("datetime", "temperature", "humidity")
    return round6(std.fill_absent_features(r, ["temperature", "humidity", "apparent_temperature", "load_ma_3h",
                                               "month_sin"]))


@register("feature_vector")
def q_feature_vector(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    fe = feat.create_features(std.standardize_columns(_pin6(fx.hourly(spark, sf_dir))))
    va = VectorAssembler(inputCols=feat.FEATURES, outputCol="vec", handleInvalid="error")
    v = va.transform(fe).select("datetime", vector_to_array("vec").alias("a"))
    return round6(v.select("datetime", F.size("a").alias("n_features"),
                           F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x).alias("vector_sum")))


_SCALED = ["temperature", "humidity", "load_lag_1h", "load_lag_24h", "load_lag_168h", "load_ma_3h", "load_ma_24h",
           "apparent_temperature"]


@register("preprocess", sql(_CF_SQL + f""",
pp AS ({__import__('gridlens.catalog.q_features', fromlist=['_CF_BODY'])._CF_BODY})""",
                            " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS scale FROM pp"
                                               for c in _SCALED), ["mean", "scale"]))
def q_preprocess(spark, sf_dir):
    base = std.standardize_columns(_pin6(fx.hourly(spark, sf_dir)))
    fe = feat.create_features(base)
    path = _scratch(spark, "processed")
    src.csv_sink(fe, path)
    return round6(std.standard_scaler(fe))


@register("data_profile")
def q_data_profile(spark, sf_dir):
    return round6(rep.data_profile(fx.hourly_nulls(spark, sf_dir)))


_AB = fs.CONTRIB + """,
rt(feature, lo, hi) AS (VALUES ('temperature', 5.0, 40.0), ('humidity', 20.0, 95.0), ('hour', 0.0, 23.0),
   ('load_lag_1h', 500.0, 4000.0), ('load_lag_24h', 500.0, 4000.0), ('load_lag_168h', 500.0, 4000.0))"""


@register("abnormal_features", sql(_AB, """
SELECT c.row_id, c.datetime, c.feature, c.feature_value AS value, CAST(NULL AS DOUBLE) AS shap_value,
       CASE WHEN c.feature_value < rt.lo THEN 'low' ELSE 'high' END AS deviation,
       CASE WHEN c.feature_value < rt.lo THEN abs(c.feature_value - rt.lo) ELSE abs(c.feature_value - rt.hi) END AS deviation_amount
FROM contributions c JOIN rt USING (feature) WHERE c.feature_value < rt.lo OR c.feature_value > rt.hi
UNION ALL
SELECT row_id, datetime, feature, feature_value, shap_value, 'extreme_contribution', abs_contribution
FROM contributions WHERE abs_contribution > 200""", ["value", "shap_value", "deviation_amount"]))
def q_abnormal(spark, sf_dir):
    return round6(rep.abnormal_features(fx.contributions_linear(spark, sf_dir)))


@register("anomaly_causes", sql(fs.PRED, """
SELECT datetime, coalesce(nullif(concat_ws('; ',
         CASE WHEN temperature > 35 THEN '{hot}' WHEN temperature < 5 THEN '{cold}' END,
         CASE WHEN load_lag_1h IS NULL THEN '{lag_missing}' END,
         CASE WHEN coalesce(is_holiday, false) THEN '{holiday}' WHEN coalesce(is_weekend, false) THEN '{weekend}' END,
         CASE WHEN month IN (6, 7, 8) AND actual_load - predicted_load > 0 THEN '{summer}'
              WHEN month IN (12, 1, 2) AND actual_load - predicted_load > 0 THEN '{winter}' END), ''),
         '{unknown}') AS causes
FROM pred""".format(**insight.CAUSE_TEXT)))
def q_anomaly_causes(spark, sf_dir):
    p = fx.predictions_naive(spark, sf_dir)
    err = F.col("actual_load") - F.col("predicted_load")
    return p.select("datetime", F.concat_ws("; ", insight.anomaly_causes(p, err)).alias("causes"))


@register("pair_text")
def q_pair_text(spark, sf_dir):
    from .q_models import q_period_pair
    return q_period_pair(spark, sf_dir).select("pair_id", "explanation")
