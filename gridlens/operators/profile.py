"""Profiling aggregates: info, missing values, duplicates, outliers,
distributions, patterns, continuity, correlations, statistics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.stats import safe_corr
from pyspark.sql import types as T

from ..plans import ordered as o
from ..plans.quantiles import quantile_columns


def _numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def time_gaps(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
              expected_hours: float = 1.0, max_gap: float | None = None) -> DataFrame:
    """Consecutive time differences above ``max_gap`` (default twice the
    expected step) -> ``(keys, gap_start, gap_end, hours_gap)``."""
    keys = list(keys)
    lo = o.layout(df.select(*keys, time_col), time_col, keys, halo=1)
    prev = F.lag(time_col, 1).over(lo.window)
    d = lo.finish(lo.df.withColumn("gap_start", prev).withColumn(
        "hours_gap", (F.unix_timestamp(F.col(time_col)) - F.unix_timestamp("gap_start")) / 3600.0))
    limit = max_gap or expected_hours * 2
    return d.filter(F.col("hours_gap") > limit).select(
        *keys, "gap_start", F.col(time_col).alias("gap_end"), "hours_gap")


def time_continuity_summary(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
                            expected_hours: float = 1.0, max_gap: float | None = None) -> DataFrame:
    keys = list(keys)
    lo = o.layout(df.select(*keys, time_col), time_col, keys, halo=1)
    prev = F.lag(time_col, 1).over(lo.window)
    d = lo.finish(lo.df.withColumn(
        "_h", (F.unix_timestamp(F.col(time_col)) - F.unix_timestamp(prev)) / 3600.0))
    limit = max_gap or expected_hours * 2
    n_gaps = F.count(F.when(F.col("_h") > limit, 1))
    return d.groupBy(*keys).agg(
        (n_gaps == 0).alias("is_continuous"), n_gaps.alias("n_gaps"),
        (F.sum("_h") - F.count("_h")).alias("total_missing_hours"))


def basic_info(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Rows, columns, first / last time stamp and whole-day span."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.min(time_col).alias("start"), F.max(time_col).alias("end")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "start", "end",
        F.floor((F.unix_timestamp("end") - F.unix_timestamp("start")) / 86400).cast("bigint")
        .alias("date_range_days"))


def missing_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long ``(column, missing_count, missing_pct)`` for every column, from
    one aggregate pass (``pct`` rounded to 2 decimals)."""
    cols = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in cols]))
        .alias("kv")).select("_n", "kv.*")
    return long.select("column", "missing_count",
                       F.round(F.col("missing_count") / F.col("_n") * 100, 2).alias("missing_pct"))


def missing_summary(df: DataFrame) -> DataFrame:
    m = missing_stats(df)
    return m.agg(F.sum("missing_count").alias("total_missing"),
                 (F.sum("missing_count") == 0).alias("is_complete"))


def quality_metrics(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """One row: n rows, day span, overall missing percentage, and the list of
    columns with missing values."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi"),
                 *[F.count_if(F.col(c).isNull()).alias("_m_" + c) for c in cols])
    total = sum((F.col("_m_" + c) for c in cols), F.lit(0))
    missing_cols = F.filter(F.array(*[F.when(F.col("_m_" + c) > 0, F.lit(c)) for c in cols]),
                            lambda x: x.isNotNull())
    return agg.select(
        "n_rows",
        F.floor((F.unix_timestamp("_hi") - F.unix_timestamp("_lo")) / 86400).cast("bigint").alias("n_days"),
        F.round(total / (F.col("n_rows") * len(cols)) * 100, 2).alias("missing_pct"),
        F.concat_ws(",", missing_cols).alias("missing_columns"))


def duplicate_stats(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Rows beyond the first copy of a full row, and repeated time stamps
    (nulls compare equal, as grouping does).  Two aggregations, each with a
    map-side partial count — a hot duplicate group is pre-aggregated."""
    full = df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1).alias("duplicate_rows"))
    times = df.groupBy(time_col).count().agg(F.sum(F.col("count") - 1).alias("duplicate_datetimes"))
    return full.crossJoin(times).select(
        F.coalesce("duplicate_rows", F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce("duplicate_datetimes", F.lit(0)).cast("bigint").alias("duplicate_datetimes"),
        (F.coalesce("duplicate_rows", F.lit(0)) > 0).alias("has_duplicates"))


def _unpivot_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("kv")).select("kv.*").filter(F.col("value").isNotNull())


def outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr",
             threshold: float = 1.5, approx: bool = False) -> DataFrame:
    """Per numeric column: values outside ``[Q1 - t*IQR, Q3 + t*IQR]`` (iqr)
    or with ``|z| > t`` (zscore, sample std).  Bounds come from one grouped
    aggregate (one row per column), broadcast back; only columns with at
    least one outlier are returned."""
    cols = list(columns or _numeric_cols(df))
    long = _unpivot_numeric(df, cols)
    if method == "iqr":
        q = quantile_columns(long, "value", {"_q1": 0.25, "_q3": 0.75}, ["column"], approx)
        n = long.groupBy("column").agg(F.count(F.lit(1)).alias("_n"))
        iqr = F.col("_q3") - F.col("_q1")
        b = q.join(n, "column").select("column", "_n", (F.col("_q1") - threshold * iqr).alias("_lo"),
                                       (F.col("_q3") + threshold * iqr).alias("_hi"))
        is_out = (F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))
    elif method == "zscore":
        b = long.groupBy("column").agg(F.avg("value").alias("_mu"), F.stddev_samp("value").alias("_sd"),
                                       F.count(F.lit(1)).alias("_n"))
        is_out = F.abs(F.try_divide(F.col("value") - F.col("_mu"), F.col("_sd"))) > threshold
    else:
        raise ValueError(f"unknown method {method}")
    j = long.join(F.broadcast(b), "column")
    agg = j.groupBy("column").agg(F.count_if(is_out).alias("count"), F.first("_n").alias("_n"),
                                  F.min(F.when(is_out, F.col("value"))).alias("min_outlier"),
                                  F.max(F.when(is_out, F.col("value"))).alias("max_outlier"))
    return agg.filter(F.col("count") > 0).select(
        "column", "count", F.round(F.col("count") / F.col("_n") * 100, 2).alias("percentage"),
        "min_outlier", "max_outlier", F.lit(method).alias("method"))


def adjusted_skew_kurt(x: str) -> tuple[Column, Column]:
    """Bias-corrected (sample) skewness and excess kurtosis from Spark's
    population moments: ``G1 = g1*sqrt(n(n-1))/(n-2)``,
    ``G2 = (n-1)/((n-2)(n-3)) * ((n+1)*g2 + 6)``."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


def distribution_summary(df: DataFrame, columns: Sequence[str] | None = None,
                         approx: bool = False, digits: int = 4) -> DataFrame:
    """count, mean, std, min, q25, median, q75, max, skew, kurtosis per
    column (nulls dropped; skew / kurtosis bias-corrected; rounded)."""
    cols = list(columns or _numeric_cols(df))
    long = _unpivot_numeric(df, cols)
    q = quantile_columns(long, "value", {"_q25": 0.25, "_q50": 0.5, "_q75": 0.75}, ["column"], approx)
    skew, kurt = adjusted_skew_kurt("value")
    agg = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        skew.alias("skew"), kurt.alias("kurtosis")).join(q, "column", "left")
    r = lambda c: F.round(c, digits)
    return agg.select("column", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
                      r(F.col("min")).alias("min"), r(F.col("_q25")).alias("q25"),
                      r(F.col("_q50")).alias("median"), r(F.col("_q75")).alias("q75"),
                      r(F.col("max")).alias("max"), r(F.col("skew")).alias("skew"),
                      r(F.col("kurtosis")).alias("kurtosis"))


def temporal_pattern(df: DataFrame, by: str, target: str = "load", time_col: str = "datetime") -> DataFrame:
    """Mean, sample std and count of ``target`` per ``hour`` / ``day_of_week``
    / ``month`` (derived from the time stamp)."""
    t = F.col(time_col)
    key = {"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t)}[by]
    return df.groupBy(key.alias(by)).agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
                                         F.count(target).alias("count"))


def patterns_grouping_sets(df: DataFrame, target: str = "load", time_col: str = "datetime") -> DataFrame:
    """Hour, weekday and month patterns in one shuffle (GROUPING SETS)."""
    t = F.col(time_col)
    b = df.select(F.hour(t).alias("hour"), F.weekday(t).alias("day_of_week"), F.month(t).alias("month"),
                  F.col(target).alias("_y"))
    b.createOrReplaceTempView("_gl_patterns")
    return df.sparkSession.sql("""
        SELECT CASE WHEN grouping(hour) = 0 THEN 'hour' WHEN grouping(day_of_week) = 0 THEN 'day_of_week'
                    ELSE 'month' END AS pattern,
               coalesce(hour, day_of_week, month) AS key,
               avg(_y) AS mean, stddev_samp(_y) AS std, count(_y) AS count
        FROM _gl_patterns GROUP BY GROUPING SETS ((hour), (day_of_week), (month))""")


def hour_dow_matrix(df: DataFrame, target: str = "load", time_col: str = "datetime") -> DataFrame:
    """Mean by hour x weekday; weekday columns ``d0`` (Mon) .. ``d6``.
    The pivot values are fixed, so no extra pass discovers them."""
    t = F.col(time_col)
    return (df.withColumn("_dow", F.weekday(t)).groupBy(F.hour(t).alias("hour"))
              .pivot("_dow", list(range(7))).agg(F.avg(target))
              .select("hour", *[F.col(str(d)).alias(f"d{d}") for d in range(7)]))


def resample_mean(df: DataFrame, unit: str = "day", time_col: str = "datetime",
                  columns: Sequence[str] | None = None, keys: Sequence[str] = (),
                  fill_empty: bool = True) -> DataFrame:
    """Mean of every numeric column per time bucket; with ``fill_empty`` the
    empty buckets between first and last appear with null means (a spine
    built per series with ``sequence`` and left-joined)."""
    keys = list(keys)
    cols = list(columns or _numeric_cols(df, exclude=keys))
    b = F.date_trunc(unit, F.col(time_col)).cast("timestamp_ntz")
    agg = df.groupBy(*keys, b.alias(time_col)).agg(*[F.avg(c).alias(c) for c in cols])
    if not fill_empty:
        return agg
    rng = agg.groupBy(*keys).agg(F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi"))
    spine = rng.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL 1 {unit.upper()}")))
                       .alias(time_col))
    return spine.join(agg, keys + [time_col], "left")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None,
                       exclude: Sequence[str] = ("predicted_load", "lower_bound", "upper_bound"),
                       max_cols: int | None = None) -> DataFrame:
    """Pearson correlation (pairwise-complete) of all numeric columns (the first
    ``max_cols``, if given): one aggregate with every pair, unpivoted."""
    cols = list(columns or [c for c in _numeric_cols(df) if c not in set(exclude)][:max_cols])
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[safe_corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), F.col(f"{a}__{b}").alias("correlation"))
        for a, b in pairs])).alias("kv")).select("kv.*")


def top_drivers(df: DataFrame, target: str = "load",
                exclude: Sequence[str] = ("load", "actual_load", "predicted_load"),
                min_abs: float = 0.3, top: int = 10) -> DataFrame:
    """Numeric columns whose |corr(col, target)| > min_abs, strongest first."""
    cols = [c for c in _numeric_cols(df) if c not in set(exclude) and c != target]
    wide = df.agg(*[safe_corr(c, target).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in cols])).alias("kv")
    ).select("kv.*").filter(F.abs("correlation") > min_abs)
    w = Window.orderBy(F.abs("correlation").desc(), F.col("feature"))
    # the long table has one row per column: bounded by the schema width
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def series_statistics(df: DataFrame, target: str = "load", time_col: str = "datetime",
                      keys: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """total, mean, std, min, max, median, q25, q75, max / min of daily
    means, workday / weekend mean, temperature mean / max / min."""
    keys = list(keys)
    t = F.col(time_col)
    weekend = F.weekday(t) >= 5
    q = quantile_columns(df, target, {"_q50": 0.5, "_q25": 0.25, "_q75": 0.75}, keys, approx)
    temp = [F.avg("temperature").alias("temperature_mean"), F.max("temperature").alias("temperature_max"),
            F.min("temperature").alias("temperature_min")] if "temperature" in df.columns else []
    main = df.groupBy(*keys).agg(
        F.sum(target).alias("total"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"), F.max(target).alias("max"),
        F.avg(F.when(~weekend, F.col(target))).alias("workday_mean"),
        F.avg(F.when(weekend, F.col(target))).alias("weekend_mean"), *temp)
    daily = (df.groupBy(*keys, F.to_date(t).alias("_d")).agg(F.avg(target).alias("_dm"))
               .groupBy(*keys).agg(F.max("_dm").alias("daily_mean_max"), F.min("_dm").alias("daily_mean_min")))
    j = main.join(daily, keys, "left").join(q, keys, "left") if keys else main.crossJoin(daily).crossJoin(q)
    return j.select(*keys, "total", "mean", "std", "min", "max", F.col("_q50").alias("median"),
                    F.col("_q25").alias("q25"), F.col("_q75").alias("q75"), "daily_mean_max",
                    "daily_mean_min", "workday_mean", "weekend_mean",
                    *[c.alias(n) for c, n in [(F.col(x), x) for x in
                      (["temperature_mean", "temperature_max", "temperature_min"] if temp else [])]])


def daily_aggregates(df: DataFrame, target: str = "load", time_col: str = "datetime",
                     keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date(time_col).alias("date")).agg(
        F.avg(target).alias("mean"), F.max(target).alias("max"), F.min(target).alias("min"))


def accuracy_stats(df: DataFrame, actual: str = "actual_load", predicted: str = "predicted_load",
                   keys: Sequence[str] = ()) -> DataFrame:
    """mae, rmse, mape (actual 0 -> 1), max pct error, r2 (0 when ss_tot = 0).

    Two aggregate passes (mean first for ss_tot), both partial."""
    keys = list(keys)
    a, p = F.col(actual), F.col(predicted)
    denom = F.when(a == 0, F.lit(1.0)).otherwise(a)
    pct = F.abs(a - p) / F.abs(denom) * 100
    means = df.groupBy(*keys).agg(F.avg(actual).alias("_mu"))
    j = df.join(means, keys, "left") if keys else df.crossJoin(F.broadcast(means))
    agg = j.groupBy(*keys).agg(
        F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(pct).alias("mape"), F.max(pct).alias("max_error_pct"),
        F.sum((a - p) * (a - p)).alias("_ss_res"), F.sum((a - F.col("_mu")) * (a - F.col("_mu"))).alias("_ss_tot"))
    return agg.select(*keys, "mae", "rmse", "mape", "max_error_pct",
                      F.when(F.col("_ss_tot") == 0, F.lit(0.0))
                       .otherwise(1 - F.col("_ss_res") / F.col("_ss_tot")).alias("r2"))


def quadratic_trend(df: DataFrame, x: str = "temperature", y: str = "load", points: int = 100) -> DataFrame:
    """Least-squares ``y = a + b*x + c*x^2`` evaluated on ``points`` evenly
    spaced x values.  Power sums of the centred x come from one aggregate;
    the 3x3 normal equations are solved with column expressions."""
    mu = df.agg(F.avg(x).alias("_mx"))
    c = df.crossJoin(F.broadcast(mu)).select((F.col(x) - F.col("_mx")).alias("u"), F.col(y).alias("v"), "_mx")
    s = c.agg(F.count("u").alias("n"), F.sum("u").alias("s1"), F.sum(F.pow("u", 2)).alias("s2"),
              F.sum(F.pow("u", 3)).alias("s3"), F.sum(F.pow("u", 4)).alias("s4"),
              F.sum("v").alias("t0"), F.sum(F.col("u") * F.col("v")).alias("t1"),
              F.sum(F.col("u") * F.col("u") * F.col("v")).alias("t2"),
              F.min("u").alias("umin"), F.max("u").alias("umax"), F.first("_mx").alias("mx"))
    # Cramer's rule on [[n,s1,s2],[s1,s2,s3],[s2,s3,s4]] [a,b,c] = [t0,t1,t2]
    n, s1, s2, s3, s4 = (F.col(k) for k in ("n", "s1", "s2", "s3", "s4"))
    t0, t1, t2 = F.col("t0"), F.col("t1"), F.col("t2")

    def det3(a11, a12, a13, a21, a22, a23, a31, a32, a33):
        return a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31)

    d = det3(n, s1, s2, s1, s2, s3, s2, s3, s4)
    da = det3(t0, s1, s2, t1, s2, s3, t2, s3, s4)
    db = det3(n, t0, s2, s1, t1, s3, s2, t2, s4)
    dc = det3(n, s1, t0, s1, s2, t1, s2, s3, t2)
    coef = s.select((da / d).alias("a"), (db / d).alias("b"), (dc / d).alias("c"), "umin", "umax", "mx")
    grid = coef.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    u = F.col("umin") + (F.col("umax") - F.col("umin")) * F.col("i") / (points - 1)
    return grid.select("i", (u + F.col("mx")).alias(x),
                       (F.col("a") + F.col("b") * u + F.col("c") * u * u).alias("fitted"))


def metric_unpivot(df: DataFrame, id_col: str = "model", metrics: Sequence[str] | None = None) -> DataFrame:
    metrics = list(metrics or [c for c in _numeric_cols(df) if c != id_col])
    return df.unpivot([id_col], metrics, "metric", "value")


def importance_normalised(df: DataFrame, score: str = "score", feature: str = "feature",
                          top: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Top ``top`` features by score, each divided by the largest score."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(feature))
    t = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return t.withColumn("normalised", F.try_divide(F.col(score), F.max(score).over(Window.partitionBy(*keys))))
