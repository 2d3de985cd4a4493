"""Feature engineering: calendar + lag + weather features in one plan,
time-ordered splits, folds and sequence windows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import weather as wx
from ..plans import ordered as o
from . import windows as win

# ---- fixed values: the 30 model features, in order -------------------------
FEATURES = [
    "hour", "day_of_week", "temperature", "humidity", "hour_sin", "hour_cos",
    "day_of_week_sin", "day_of_week_cos", "month", "month_sin", "month_cos",
    "day_of_month", "day_of_month_sin", "day_of_month_cos", "is_workday",
    "load_lag_1h", "load_lag_24h", "load_lag_168h", "load_same_hour_last_week",
    "load_change_1h", "load_change_24h", "load_ma_3h", "load_ma_24h",
    "apparent_temperature", "thermal_comfort_index", "heating_cooling_index",
    "temperature_squared", "temp_workday_interaction", "temp_humidity_interaction",
    "heat_humidity_index",
]
SEQ_LEN = 24
# ---------------------------------------------------------------------------


def calendar_features(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Date parts, cyclic encodings and the workday flag (pure projection)."""
    t = F.col(time_col)
    adds = {}
    if "hour" not in df.columns:
        adds["hour"] = F.hour(t)
    if "day_of_week" not in df.columns:
        adds["day_of_week"] = F.weekday(t)
    if "is_weekend" not in df.columns:
        adds["is_weekend"] = F.weekday(t) >= 5
    if "is_holiday" not in df.columns:
        adds["is_holiday"] = cal.holiday_flag(t)
    df = df.withColumns(adds) if adds else df
    hs, hc = cal.cyclic("hour", 24)
    ds, dc = cal.cyclic("day_of_week", 7)
    df = df.withColumns({"hour_sin": hs, "hour_cos": hc, "day_of_week_sin": ds,
                         "day_of_week_cos": dc, "month": F.month(t), "day_of_month": F.dayofmonth(t)})
    ms, mc = cal.cyclic("month", 12)
    dms, dmc = cal.cyclic("day_of_month", 31)
    return df.withColumns({"month_sin": ms, "month_cos": mc, "day_of_month_sin": dms,
                           "day_of_month_cos": dmc,
                           "is_workday": cal.workday_flag("is_weekend", "is_holiday")})


def weather_features(df: DataFrame) -> DataFrame:
    t, h = F.col("temperature"), F.col("humidity")
    return df.withColumns({
        "apparent_temperature": wx.apparent_temperature(t, h),
        "thermal_comfort_index": wx.thermal_comfort_index(t),
        "heating_cooling_index": wx.heating_cooling_index(t),
        "temperature_squared": t * t,
        "temperature_category": wx.temperature_category(t),
        "humidity_category": wx.humidity_category(h),
        "temp_workday_interaction": t * F.col("is_workday"),
        "temp_humidity_interaction": t * h / 100,
        "heat_humidity_index": wx.heat_humidity_index(t, h),
        "time_period": cal.time_period("hour"),
    })


def create_features(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
                    leak_free: bool = False, chunk: int | None = None,
                    fill_and_drop: bool = True) -> DataFrame:
    """The full feature table: calendar + cyclic + lags / changes / rolling
    means + weather + categories; then forward-fill every column and drop
    rows still holding a null (on complete input: the first 168 rows).

    One row-index pass serves the lag windows and the fill."""
    keys = list(keys)
    lagged = win.lag_features(df, "load", time_col, keys, chunk=chunk, leak_free=leak_free,
                              keep_index=True)
    feats = weather_features(calendar_features(lagged, time_col))
    if not fill_and_drop:
        return feats.drop(o.IDX)
    chunk_rows = chunk or o.DEFAULTS.chunk_rows
    core = feats.withColumn(o.CHUNK, F.floor(F.col(o.IDX) / chunk_rows))
    cols = [c for c in feats.columns if c not in (time_col, *keys, o.IDX)]
    filled = o.fill_forward(core, cols, keys).drop(o.CHUNK, o.IDX)
    return filled.dropna()


def train_test_split(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
                     train_ratio: float = 0.8, test_days: int | None = None) -> DataFrame:
    """Label each row ``split = 'train' | 'test'`` by time order: the last
    ``test_days * 24`` rows are test, else the first ``int(n * ratio)`` rows
    train.  ``n`` per series is an aggregate joined back (no single task)."""
    keys = list(keys)
    idx = o.with_row_index(df, [time_col], keys)
    n = idx.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = idx.join(n, keys, "left") if keys else idx.crossJoin(F.broadcast(n))
    if test_days:
        cut = F.greatest(F.col("_n") - test_days * 24, F.lit(0))
    else:
        cut = F.floor(F.col("_n") * F.lit(train_ratio))
    return j.withColumn("split", F.when(F.col(o.IDX) < cut, "train").otherwise("test")) \
            .withColumnRenamed(o.IDX, "row_id").drop("_n")


def timeseries_cv_folds(df: DataFrame, n_splits: int = 5, time_col: str = "datetime",
                        keys: Sequence[str] = ()) -> DataFrame:
    """Expanding-window folds: ``ts = n // (k+1)``; fold i tests rows
    ``[n - (k-i)*ts, n - (k-i-1)*ts)`` and trains on every earlier row.

    Returns ``(fold, row_id, role, ...)``; each row joins the k-row fold
    table (broadcast, bounded by ``n_splits``) with a range predicate."""
    keys = list(keys)
    spark = df.sparkSession
    idx = o.with_row_index(df, [time_col], keys).withColumnRenamed(o.IDX, "row_id")
    n = idx.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    folds = spark.range(n_splits).select(F.col("id").cast("int").alias("fold"))
    # the row counts are one row a series, so only the single row without keys is broadcast
    sized = idx.join(n, keys, "inner") if keys else idx.crossJoin(F.broadcast(n))
    j = sized.crossJoin(F.broadcast(folds)).withColumn("_ts", F.floor(F.col("_n") / (n_splits + 1))).withColumn(
        "_test_lo", F.col("_n") - (F.lit(n_splits) - F.col("fold")) * F.col("_ts")).drop("_n")
    rid = F.col("row_id")
    role = (F.when(rid < F.col("_test_lo"), "train")
             .when(rid < F.col("_test_lo") + F.col("_ts"), "test"))
    return j.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_test_lo", "_ts")


def sequence_windows(df: DataFrame, features: Sequence[str], target: str = "load",
                     length: int = SEQ_LEN, time_col: str = "datetime",
                     keys: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """For each row i >= length: the previous ``length`` rows' feature
    vectors (``array<array<double>>``) and the target of row i."""
    lo = o.layout(df, time_col, keys, halo=length, chunk=chunk)
    w = lo.window.rowsBetween(-length, -1)
    vec = F.array(*[F.col(c).cast("double") for c in features])
    out = lo.df.withColumn("sequence", F.collect_list(vec).over(w))
    out = lo.finish(out, keep_index=True).filter(F.size("sequence") == length)
    return out.select(*keys, time_col, F.col(o.IDX).alias("row_id"), "sequence",
                      F.col(target).alias("target"))


def seasonal_abs_diff(df: DataFrame, col: str = "load", season: int = 24,
                      time_col: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    """MASE scale: ``mean |y_t - y_{t-season}|`` (lag 1 when n <= season)."""
    keys = list(keys)
    lo = o.layout(df, time_col, keys, halo=season)
    w = lo.window
    d = lo.finish(lo.df.withColumns({"_ds": F.abs(F.col(col) - F.lag(col, season).over(w)),
                                     "_d1": F.abs(F.col(col) - F.lag(col, 1).over(w))}))
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_ds").alias("_s"),
                               F.avg("_d1").alias("_s1"))
    return agg.select(*keys, "n", F.when(F.col("n") > season, F.col("_s")).otherwise(F.col("_s1"))
                      .alias("scale"))
