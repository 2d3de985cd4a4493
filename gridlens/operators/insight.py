"""Insight operators: anomalies, causes, trend runs, lagged correlations."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.stats import safe_corr

from ..plans import ordered as o

# ---- fixed values ---------------------------------------------------------
ANOMALY_THRESHOLD = 0.15
SEVERITY_BANDS = [(0.3, "high"), (0.2, "medium")]   # above -> label, else low
SEVERITY_ORDER = ["high", "medium", "low"]
CAUSE_HOT_T, CAUSE_COLD_T = 35.0, 5.0
SUMMER_MONTHS, WINTER_MONTHS = (6, 7, 8), (12, 1, 2)
CAUSE_TEXT = {
    "hot": "extreme heat may push cooling load above the forecast",
    "cold": "extreme cold may push heating load above the forecast",
    "lag_missing": "recent load history is missing, which hurts forecast accuracy",
    "holiday": "holiday activity differs from a regular workday",
    "weekend": "weekend load differs from the workday pattern",
    "summer": "summer cooling demand keeps rising",
    "winter": "winter heating demand keeps rising",
    "unknown": "unknown cause, check data quality",
}
TREND_THRESHOLD = 0.02
TREND_MIN_DURATION = 6
CORR_MIN_ABS = 0.5
CORR_TOP = 5
# ---------------------------------------------------------------------------


def _opt(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def anomaly_causes(df: DataFrame, error: Column) -> Column:
    """Array of rule-based causes for one deviation row; columns that are
    absent from ``df`` are skipped."""
    parts = []
    t = _opt(df, "temperature")
    if t is not None:
        parts.append(F.when(t > CAUSE_HOT_T, CAUSE_TEXT["hot"])
                      .when(t < CAUSE_COLD_T, CAUSE_TEXT["cold"]))
    lag1 = _opt(df, "load_lag_1h")
    if lag1 is not None:
        parts.append(F.when(lag1.isNull(), CAUSE_TEXT["lag_missing"]))
    hol, wk = _opt(df, "is_holiday"), _opt(df, "is_weekend")
    if hol is not None or wk is not None:
        expr = None
        if hol is not None:
            expr = F.when(F.coalesce(hol, F.lit(False)), CAUSE_TEXT["holiday"])
        if wk is not None:
            cond = F.coalesce(wk, F.lit(False))
            expr = F.when(cond, CAUSE_TEXT["weekend"]) if expr is None else expr.when(cond, CAUSE_TEXT["weekend"])
        parts.append(expr)
    m = _opt(df, "month")
    if m is not None:
        parts.append(F.when(m.isin(*SUMMER_MONTHS) & (error > 0), CAUSE_TEXT["summer"])
                      .when(m.isin(*WINTER_MONTHS) & (error > 0), CAUSE_TEXT["winter"]))
    if not parts:
        return F.array(F.lit(CAUSE_TEXT["unknown"]))
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(arr) == 0, F.array(F.lit(CAUSE_TEXT["unknown"]))).otherwise(arr)


def severity_rank(sev: Column, order: Sequence[str] = SEVERITY_ORDER) -> Column:
    expr = None
    for i, s in enumerate(order):
        expr = F.when(sev == s, i) if expr is None else expr.when(sev == s, i)
    return expr.otherwise(len(order))


def anomaly_insights(df: DataFrame, actual_col: str = "actual_load",
                     predicted_col: str = "predicted_load", time_col: str = "datetime",
                     threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Rows whose relative error ``|a - p| / p`` exceeds ``threshold``.

    Stateless projection + filter: runs unchanged on a streaming DataFrame.
    Rows with ``p = 0`` are skipped.  Adds ``error, error_percentage,
    severity, severity_rank, anomaly_type, possible_causes``; order with
    ``severity_rank, datetime`` at the sink."""
    a, p = F.col(actual_col), F.col(predicted_col)
    err = a - p
    pct = F.abs(err) / p
    sev = F.when(pct > SEVERITY_BANDS[0][0], SEVERITY_BANDS[0][1])
    for edge, name in SEVERITY_BANDS[1:]:
        sev = sev.when(pct > edge, name)
    sev = sev.otherwise("low")
    flagged = df.filter((p != 0) & (pct > threshold))
    return flagged.select(
        F.col(time_col).alias("datetime"),
        a.alias("actual_value"), p.alias("predicted_value"),
        err.alias("error"), (pct * 100).alias("error_percentage"),
        sev.alias("severity"), severity_rank(sev).alias("severity_rank"),
        F.when(err > 0, "high_error").otherwise("low_error").alias("anomaly_type"),
        anomaly_causes(df, err).alias("possible_causes"))


def trend_runs(df: DataFrame, value_col: str = "load", time_col: str = "datetime",
               keys: Sequence[str] = (), threshold: float = TREND_THRESHOLD,
               min_duration: int = TREND_MIN_DURATION, direction: str | None = None,
               chunk: int | None = None) -> DataFrame:
    """Maximal runs of equal direction of the step-wise percentage change.

    Direction per row: change > thr increasing, < -thr decreasing, else
    stable.  Changes compare padded values: a null takes the last value,
    however old, so a null row has change 0, counts as stable and ends a
    rising or falling run; rows before the first value have no change and
    are skipped.  Runs of at least ``min_duration`` rows are returned with their first and last
    row's value.  Gaps-and-islands on the chunked layout: the previous
    non-null direction comes from an exact carried forward-fill, the run id
    is an exact carried running sum — no task ever holds a whole series."""
    keys = list(keys)
    lo = o.padded_layout(df, value_col, "_pad", 1, time_col, keys, chunk)
    v, cur = F.col(value_col), F.col("_pad")
    step = lo.df.withColumn("_prev", F.lag("_pad", 1).over(lo.window))
    prev_v, inf = F.col("_prev"), F.lit(float("inf"))
    rate = (F.when((prev_v == 0) & (cur > 0), inf).when((prev_v == 0) & (cur < 0), -inf)
             .otherwise(F.try_divide(cur, prev_v) - 1))
    step = lo.finish(step.withColumn("_rate", rate), keep_index=True)
    dir_ = (F.when(F.col("_rate") > threshold, "increasing")
             .when(F.col("_rate") < -threshold, "decreasing")
             .when(F.col("_rate").isNotNull(), "stable"))
    core = step.withColumn("_dir", dir_).filter(F.col("_dir").isNotNull())
    core = core.withColumn(o.CHUNK, F.floor(F.col(o.IDX) / lo.chunk))
    # previous direction: the previous kept row in this chunk, or for the
    # first kept row of a chunk the last direction of the earlier chunks
    core = o.carry_join(core, _carry_last(core, "_dir", keys), keys)
    w2 = Window.partitionBy(*keys, o.CHUNK).orderBy(o.IDX)
    prev_dir = F.coalesce(F.lag("_dir", 1).over(w2), F.col("_carry_dir"))
    flagged = core.withColumn("_new", F.when(prev_dir.isNull() | (prev_dir != F.col("_dir")), 1)
                              .otherwise(0))
    runs = o.running_sum(flagged, "_new", "_run", keys)
    agg = runs.groupBy(*keys, "_run").agg(
        F.first("_dir").alias("trend_type"),
        F.count(F.lit(1)).alias("duration"),
        F.min_by(v, F.col(o.IDX)).alias("start_value"),
        F.max_by(v, F.col(o.IDX)).alias("end_value"),
        F.min_by(F.col(time_col), F.col(o.IDX)).alias("start_time"),
        F.max_by(F.col(time_col), F.col(o.IDX)).alias("end_time"))
    out = agg.filter(F.col("duration") >= min_duration).select(
        *keys, "start_time", "end_time", "trend_type", "duration", "start_value", "end_value",
        (F.col("end_value") - F.col("start_value")).alias("change_absolute"),
        F.when(F.col("start_value") != 0,
               (F.col("end_value") - F.col("start_value")) / F.col("start_value"))
         .otherwise(F.lit(0.0)).alias("change_rate"))
    out = out.withColumn("confidence", F.least(
        F.lit(1.0), F.col("duration") / 24 * 0.5 + F.abs(F.col("change_rate")) * 5))
    if direction:
        out = out.filter(F.col("trend_type") == direction)
    return out


def _carry_last(core: DataFrame, col: str, keys: list) -> DataFrame:
    """Per chunk: last ``col`` value of all earlier chunks (one row per chunk)."""
    ends = core.groupBy(*keys, o.CHUNK).agg(F.max_by(col, o.IDX).alias("_end"))
    cw = Window.partitionBy(*keys).orderBy(o.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, o.CHUNK, F.last("_end", ignorenulls=True).over(cw).alias("_carry_dir"))


def lagged_correlation(df: DataFrame, f1: str, f2: str, max_lag: int = 24,
                       time_col: str = "datetime", keys: Sequence[str] = (),
                       min_abs: float = CORR_MIN_ABS, top: int = CORR_TOP,
                       chunk: int | None = None) -> DataFrame:
    """``corr(f1, f2 shifted by lag rows)`` for lag 0..max_lag; keep
    ``|r| > min_abs``, strongest ``top`` first.  One pass: all lag columns
    on the chunked layout, then a single aggregate of all correlations."""
    keys = list(keys)
    lo = o.layout(df, time_col, keys, halo=max_lag, chunk=chunk)
    w = lo.window
    lagged = lo.finish(lo.df.withColumns(
        {f"_l{k}": F.lag(f2, k).over(w) for k in range(max_lag + 1)}))
    wide = lagged.groupBy(*keys).agg(*[safe_corr(F.col(f1), F.col(f"_l{k}")).alias(f"c{k}")
                                       for k in range(max_lag + 1)])
    long = wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("correlation"))
        for k in range(max_lag + 1)])).alias("kv")).select(*keys, "kv.*")
    long = long.filter(F.abs("correlation") > min_abs)
    rw = Window.partitionBy(*keys).orderBy(F.abs("correlation").desc(), F.col("lag"))
    return (long.withColumn("rank", F.row_number().over(rw)).filter(F.col("rank") <= top)
                .select(*keys, F.lit(f1).alias("feature1"), F.lit(f2).alias("feature2"),
                        "lag", "correlation", "rank"))
