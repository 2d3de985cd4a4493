"""Joins the analytics perform: history look-ups at exact time offsets,
hour / month mean fills, weather attachment, importance unions, feature
pairs and grid expansion."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT_LAG_LOAD
from . import windows as win

# ---- fixed values ---------------------------------------------------------
HISTORY_OFFSETS = {"load_lag_1h": 1, "load_lag_2h": 2, "load_lag_24h": 24, "load_lag_168h": 168}
FILL_DEFAULTS = {"temperature": 20.0, "humidity": 50.0}
MONTH_WEIGHT, HOUR_WEIGHT = 0.6, 0.4
# ---------------------------------------------------------------------------


def _offsets_table(spark, offsets: dict[str, int]):
    return spark.createDataFrame(list(offsets.items()), "_name string, _off int")


def history_lag_lookup(req: DataFrame, hist: DataFrame, time_col: str = "datetime",
                       value_col: str = "load", offsets: dict[str, int] | None = None,
                       keys: Sequence[str] = ()) -> DataFrame:
    """For each request time ``t``: the history value at exactly ``t - k``
    hours for every offset; absent -> the request's own column (or null).

    Distinct request keys x offsets (a fixed-size table, broadcast) -> one
    equi join on ``(keys, time)`` with the history -> pivot -> joined back
    on the request's own ``(keys, time)``.  A time-offset look-up, unlike
    the row-offset ``lag_features``."""
    keys = list(keys)
    offsets = offsets or HISTORY_OFFSETS
    spark = req.sparkSession
    probes = req.select(*keys, F.col(time_col).alias("_t")).distinct().crossJoin(
        F.broadcast(_offsets_table(spark, offsets)))
    probes = probes.withColumn("_ht", F.col("_t") - F.make_dt_interval(hours=F.col("_off")))
    h = hist.select(*keys, F.col(time_col).alias("_ht"), F.col(value_col).alias("_v"))
    found = probes.join(h, keys + ["_ht"], "inner")
    wide = found.groupBy(*keys, "_t").pivot("_name", list(offsets)).agg(F.first("_v"))
    wide = wide.select(*keys, F.col("_t").alias(time_col), *[F.col(n).alias("_h_" + n) for n in offsets])
    out = req.join(wide, keys + [time_col], "left")
    for n in offsets:
        own = F.col(n) if n in req.columns else F.lit(None).cast("double")
        out = out.withColumn(n, F.coalesce(F.col("_h_" + n), own)).drop("_h_" + n)
    if "load_lag_168h" in offsets:
        out = out.withColumn("load_same_hour_last_week", F.col("load_lag_168h"))
    return out


def history_change(df: DataFrame) -> DataFrame:
    """``change_1h = (lag1 - lag2h)/lag2h``, ``change_24h = (lag1 - lag24)/lag24``
    where both are present (zero denominators -> null)."""
    return df.withColumns({
        "load_change_1h": F.try_divide(F.col("load_lag_1h") - F.col("load_lag_2h"), F.col("load_lag_2h")),
        "load_change_24h": F.try_divide(F.col("load_lag_1h") - F.col("load_lag_24h"), F.col("load_lag_24h")),
    })


def history_range_mean(req: DataFrame, hist: DataFrame, time_col: str = "datetime",
                       value_col: str = "load", default: float = DEFAULT_LAG_LOAD,
                       windows: dict[str, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean history value over ``[t - n h, t)`` for n = 3 and 24; when no
    history falls inside, the lag 1 h / lag 24 h column, else ``default``.

    Each distinct request time probes the n whole hours before it (a fixed
    fan-out) with an equi join — no range join, no sort of the history.
    Assumes an hourly history (one value per whole hour)."""
    keys = list(keys)
    windows = windows or {"load_ma_3h": 3, "load_ma_24h": 24}
    spark = req.sparkSession
    span = max(windows.values())
    steps = spark.range(1, span + 1).select(F.col("id").cast("int").alias("_off"))
    probes = req.select(*keys, F.col(time_col).alias("_t")).distinct().crossJoin(F.broadcast(steps))
    probes = probes.withColumn("_ht", F.col("_t") - F.make_dt_interval(hours=F.col("_off")))
    h = hist.select(*keys, F.col(time_col).alias("_ht"), F.col(value_col).alias("_v"))
    found = probes.join(h, keys + ["_ht"], "inner")
    agg = found.groupBy(*keys, F.col("_t").alias(time_col)).agg(
        *[F.avg(F.when(F.col("_off") <= n, F.col("_v"))).alias("_m_" + name) for name, n in windows.items()])
    out = req.join(agg, keys + [time_col], "left")
    fallback = {"load_ma_3h": "load_lag_1h", "load_ma_24h": "load_lag_24h"}
    for name in windows:
        fb = F.col(fallback[name]) if fallback.get(name) in req.columns else F.lit(None).cast("double")
        out = out.withColumn(name, F.coalesce(F.col("_m_" + name), fb, F.lit(default))).drop("_m_" + name)
    return out


def hour_month_mean_fill(df: DataFrame, columns: Sequence[str] = ("temperature", "humidity"),
                         time_col: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with ``0.6 * mean(same month) + 0.4 * mean(same hour)``;
    means over non-null rows; a month / hour without data takes the
    column default (20 for temperature, 50 for humidity).

    The two mean tables have at most 12 and 24 rows per series."""
    keys = list(keys)
    t = F.col(time_col)
    base = df.withColumns({"_hr": F.hour(t), "_mo": F.month(t)})
    hm = base.groupBy(*keys, "_hr").agg(*[F.avg(c).alias("_h_" + c) for c in columns])
    mm = base.groupBy(*keys, "_mo").agg(*[F.avg(c).alias("_m_" + c) for c in columns])
    if keys:
        j = base.join(hm, keys + ["_hr"], "left").join(mm, keys + ["_mo"], "left")
    else:
        j = base.join(F.broadcast(hm), "_hr", "left").join(F.broadcast(mm), "_mo", "left")
    for c in columns:
        d = F.lit(FILL_DEFAULTS.get(c, 0.0))
        fill = F.coalesce(F.col("_m_" + c), d) * MONTH_WEIGHT + F.coalesce(F.col("_h_" + c), d) * HOUR_WEIGHT
        j = j.withColumn(c, F.coalesce(F.col(c), fill))
    return j.drop("_hr", "_mo", *["_h_" + c for c in columns], *["_m_" + c for c in columns])


def weather_join(df: DataFrame, weather: DataFrame, time_col: str = "datetime",
                 weather_time: str = "datetime", columns: Sequence[str] = ("temperature", "humidity"),
                 keys: Sequence[str] = ()) -> DataFrame:
    """Attach an hourly weather table: left equi join on the hour bucket
    (+ location keys); existing non-null values win.  Shuffle join on the
    hour key — both sides grow with time, neither is broadcast blindly
    (AQE may still choose a broadcast at run time from real sizes)."""
    keys = list(keys)
    w = weather.groupBy(*keys, F.date_trunc("hour", F.col(weather_time)).cast("timestamp_ntz").alias("_wh")) \
               .agg(*[F.avg(c).alias("_w_" + c) for c in columns])
    base = df.withColumn("_wh", F.date_trunc("hour", F.col(time_col)).cast("timestamp_ntz"))
    j = base.join(w, keys + ["_wh"], "left")
    for c in columns:
        own = F.col(c) if c in df.columns else F.lit(None).cast("double")
        j = j.withColumn(c, F.coalesce(own, F.col("_w_" + c)))
    return j.drop("_wh", *["_w_" + c for c in columns])


def weather_fill(df: DataFrame, method: str = "auto", time_col: str = "datetime",
                 weather: DataFrame | None = None, columns: Sequence[str] = ("temperature", "humidity"),
                 keys: Sequence[str] = ()) -> DataFrame:
    """auto: hour/month means, then interpolation for what is left;
    historical: means only; interpolation: linear only; api: join a weather
    table, then fall back to auto.  Absent columns are added first."""
    cols = list(columns)
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    if method == "api":
        if weather is not None:
            df = weather_join(df, weather, time_col, columns=cols, keys=keys)
        method = "auto"
    if method in ("auto", "historical"):
        df = hour_month_mean_fill(df, cols, time_col, keys)
    if method in ("auto", "interpolation"):
        df = win.linear_interpolate(df, cols, time_col, keys)
    if method not in ("auto", "historical", "interpolation"):
        raise ValueError(f"unknown method {method}")
    return df


def importance_union(imp: DataFrame, method_col: str = "method", feature_col: str = "feature",
                     score_col: str = "score") -> DataFrame:
    """Every (method, feature) over the union of features: rank by score
    desc (ties by feature name) within the method; a feature the method did
    not score gets score 0 and rank = number of features.  ``imp`` is read
    three times: materialise it first when it is expensive to compute."""
    feats = imp.select(feature_col).distinct()
    methods = imp.select(method_col).distinct()
    n = feats.agg(F.count(F.lit(1)).alias("_nf"))
    w = Window.partitionBy(method_col).orderBy(F.col(score_col).desc(), F.col(feature_col))
    ranked = imp.withColumn("rank", F.row_number().over(w))
    grid = methods.crossJoin(feats)   # methods x features: both bounded by the explainers run
    j = grid.join(ranked, [method_col, feature_col], "left").crossJoin(F.broadcast(n))
    return j.select(method_col, feature_col, F.coalesce(F.col(score_col), F.lit(0.0)).alias(score_col),
                    F.coalesce(F.col("rank"), F.col("_nf").cast("int")).alias("rank"))


def feature_pairs(ranks: DataFrame, top: int = 5, method_col: str = "method",
                  feature_col: str = "feature", rank_col: str = "rank") -> DataFrame:
    """Pairs of features (i < j) ranked by the mean over methods of
    ``|rank_i - rank_j|``: the features whose positions the explainers
    disagree on most.  Self join on method with ``a < b``."""
    a = ranks.select(F.col(method_col), F.col(feature_col).alias("feature1"), F.col(rank_col).alias("r1"))
    b = ranks.select(F.col(method_col), F.col(feature_col).alias("feature2"), F.col(rank_col).alias("r2"))
    j = a.join(b, [method_col]).filter(F.col("feature1") < F.col("feature2"))
    g = j.groupBy("feature1", "feature2").agg(F.avg(F.abs(F.col("r1") - F.col("r2"))).alias("mean_rank_diff"),
                                              F.map_from_entries(F.collect_list(F.struct(
                                                  F.col(method_col), (F.col("r1") - F.col("r2")))))
                                              .alias("rank_diffs"))
    w = Window.orderBy(F.col("mean_rank_diff").desc(), "feature1", "feature2")
    # one row per feature pair: bounded by the square of the feature count
    return g.withColumn("pair_rank", F.row_number().over(w)).filter(F.col("pair_rank") <= top)


def grid_cross_join(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """rows x grid values; the grid's size is a parameter, so broadcast."""
    return rows.crossJoin(F.broadcast(grid))


def shap_for_timestamp(anomalies: DataFrame, contrib: DataFrame, time_col: str = "datetime",
                       top: int = 10) -> DataFrame:
    """Contributions of each anomaly's time stamp, non-null, top ``top`` by
    |value| (equi join on time, then a per-time top-k)."""
    c = contrib.filter(F.col("shap_value").isNotNull())
    j = anomalies.select(time_col).distinct().join(c, time_col)
    w = Window.partitionBy(time_col).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
