"""Time-ordered window operators (lags, changes, rolling means, fills, runs).

All windows run on the chunk-with-halo layout of ``plans.ordered``: for a
keyed table the window is ``PARTITION BY (keys, _chunk)``, for a single
series ``PARTITION BY _chunk`` — never one task per series."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ordered as o


def _lead_lag_frame(df, time_col, keys, halo, chunk, indexed):
    return o.layout(df, time_col, keys, halo=halo, chunk=chunk, indexed=indexed)


def add_lags(df: DataFrame, col: str, lags: dict[str, int], time_col: str = "datetime",
             keys: Sequence[str] = (), chunk: int | None = None,
             keep_index: bool = False, indexed: bool = False) -> DataFrame:
    """``{name: k}`` -> ``name = col shifted k rows`` in time order."""
    halo = max(lags.values()) if lags else 0
    lo = _lead_lag_frame(df, time_col, keys, halo, chunk, indexed)
    w = lo.window
    out = lo.df.withColumns({name: F.lag(col, k).over(w) for name, k in lags.items()})
    return lo.finish(out, keep_index)


def pct_change_expr(cur: Column, prev: Column) -> Column:
    """``cur/prev - 1``; ±inf (prev 0, cur non-zero) -> 0; 0/0 -> null."""
    return (F.when((prev == 0) & (cur != 0), F.lit(0.0))
             .otherwise(F.try_divide(cur, prev) - 1))


def lag_features(df: DataFrame, value_col: str = "load", time_col: str = "datetime",
                 keys: Sequence[str] = (), chunk: int | None = None, leak_free: bool = False,
                 keep_index: bool = False, indexed: bool = False) -> DataFrame:
    """Row-based lag, change and rolling-mean features of ``value_col``.

    ``load_lag_1h/24h/168h``, ``load_same_hour_last_week`` (= lag 168),
    ``load_change_1h/24h`` (pct change on the forward-filled value),
    ``load_ma_3h/24h`` (trailing mean incl. the current row unless
    ``leak_free``)."""
    # the change rates compare padded values (nulls take the last value, however old)
    lo = o.padded_layout(df, value_col, "_pad", 168, time_col, keys, chunk, indexed)
    w = lo.window
    v = F.col(value_col)
    hi = -1 if leak_free else 0
    out = (lo.df
           .withColumns({
               "load_lag_1h": F.lag(v, 1).over(w),
               "load_lag_24h": F.lag(v, 24).over(w),
               "load_lag_168h": F.lag(v, 168).over(w),
               "load_ma_3h": F.avg(v).over(w.rowsBetween(-2 + hi, hi)),
               "load_ma_24h": F.avg(v).over(w.rowsBetween(-23 + hi, hi)),
           }))
    out = out.withColumns({
        "load_same_hour_last_week": F.col("load_lag_168h"),
        "load_change_1h": pct_change_expr(F.col("_pad"), F.lag("_pad", 1).over(w)),
        "load_change_24h": pct_change_expr(F.col("_pad"), F.lag("_pad", 24).over(w)),
    }).drop("_pad")
    return lo.finish(out, keep_index)


def diff(df: DataFrame, col: str, out: str = "diff", time_col: str = "datetime",
         keys: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    lo = _lead_lag_frame(df, time_col, keys, 1, chunk, False)
    res = lo.df.withColumn(out, F.col(col) - F.lag(col, 1).over(lo.window))
    return lo.finish(res)


def rolling_mean(df: DataFrame, col: str, rows: int, out: str | None = None,
                 time_col: str = "datetime", keys: Sequence[str] = (),
                 leak_free: bool = False, chunk: int | None = None) -> DataFrame:
    hi = -1 if leak_free else 0
    lo = _lead_lag_frame(df, time_col, keys, rows, chunk, False)
    res = lo.df.withColumn(out or f"{col}_ma_{rows}",
                           F.avg(col).over(lo.window.rowsBetween(-(rows - 1) + hi, hi)))
    return lo.finish(res)


def ffill(df: DataFrame, cols: Sequence[str], time_col: str = "datetime",
          keys: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """Forward-fill ``cols`` (unbounded look-back, exact across chunks)."""
    lo = o.layout(df, time_col, keys, halo=0, chunk=chunk)
    out = o.fill_forward(lo.core(), list(cols), keys)
    return out.drop(o.CHUNK, o.HALO, o.IDX)


def ffill_then_dropna(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
                      chunk: int | None = None, indexed: bool = False) -> DataFrame:
    """Forward-fill every column, then drop rows that still hold a null."""
    cols = [c for c in df.columns if c not in (time_col, *keys, o.IDX)]
    lo = o.layout(df, time_col, keys, halo=0, chunk=chunk, indexed=indexed)
    out = o.fill_forward(lo.core(), cols, keys).drop(o.CHUNK, o.HALO)
    if not indexed:
        out = out.drop(o.IDX)
    return out.dropna()


def linear_interpolate(df: DataFrame, cols: Sequence[str], time_col: str = "datetime",
                       keys: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """Fill nulls linearly by row position between the neighbouring
    non-null values; leading nulls take the next value, trailing nulls the
    previous one.  (A final median fill can only reach a series with no
    value at all, whose median is null, so it is not computed.)"""
    keys = list(keys)
    lo = o.layout(df, time_col, keys, halo=0, chunk=chunk)
    core = lo.core()
    pos = {}
    for c in cols:
        core = core.withColumn("_p_" + c, F.when(F.col(c).isNotNull(), F.struct(
            F.col(o.IDX).alias("i"), F.col(c).alias("v"))))
        pos[c] = "_p_" + c
    core = o.fill_forward(core, list(pos.values()), keys, suffix="_prev")
    core = o.fill_forward(core, list(pos.values()), keys, backward=True, suffix="_next")
    for c in cols:
        p, n = F.col(pos[c] + "_prev"), F.col(pos[c] + "_next")
        frac = (F.col(o.IDX) - p["i"]) / (n["i"] - p["i"])
        interp = p["v"] + (n["v"] - p["v"]) * frac
        core = core.withColumn(c, F.coalesce(F.col(c), interp, p["v"], n["v"]))
    drop = [x for c in cols for x in (pos[c], pos[c] + "_prev", pos[c] + "_next")]
    return core.drop(*drop, o.CHUNK, o.HALO, o.IDX)


def tail_n(df: DataFrame, n: int, time_col: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows by time (per series with ``keys``).  Distributed top-k:
    per-partition top-n then merge, never a full sort into one task."""
    if not keys:
        return df.orderBy(F.col(time_col).desc()).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col(time_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
