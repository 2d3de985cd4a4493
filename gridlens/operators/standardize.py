"""Projections and standardisation (column contract, coercion, calendar)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions import weather as wx
from ..params import DEFAULT_LAG_LOAD

# ---- fixed values ---------------------------------------------------------
# alias names per standard column, matched case-sensitively in input order
ALIASES = {
    "datetime": ["datetime", "Datetime", "time", "Time", "timestamp", "date"],
    "load": ["load", "Load", "load_MW", "负荷", "energy", "Demand"],
    "temperature": ["temperature", "temp", "Temperature", "dry_bulb", "db_temp"],
    "humidity": ["humidity", "rh", "humidity_percent", "relative_humidity"],
}
DEFAULT_TEMPERATURE = 20.0
DEFAULT_HUMIDITY = 50.0
TEMPERATURE_FROM_LOAD_SCALE = 100.0
CONTRACT = ["datetime", "load", "temperature", "humidity", "day_of_week", "is_holiday"]
# columns never used as model features
NON_FEATURES = {"datetime", "date", "load", "time_period", "temperature_category",
                "humidity_category"}
# request bounds: hour 0..23, day_of_week 0..6, humidity 0..100
REQUEST_BOUNDS = {"hour": (0, 23), "day_of_week": (0, 6), "humidity": (0, 100)}
REQUEST_REQUIRED = ["datetime", "hour", "day_of_week", "temperature", "humidity"]
SCALER_FEATURES = ["temperature", "humidity", "load_lag_1h", "load_lag_24h", "load_lag_168h",
                   "load_ma_3h", "load_ma_24h", "apparent_temperature"]
# ---------------------------------------------------------------------------


def resolve_aliases(columns: Sequence[str]) -> dict[str, str]:
    """Standard name -> input column: scan input columns in order, each
    column is claimed by the first standard name (in contract order) that
    lists it and is not yet taken."""
    mapping: dict[str, str] = {}
    for c in columns:
        for std, cands in ALIASES.items():
            if std not in mapping and c in cands:
                mapping[std] = c
                break
    return mapping


def coerce_numeric(c: Column | str) -> Column:
    """Non-numeric text -> null (no ANSI error); NaN -> null."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.cast("string").try_cast(T.DoubleType())
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Map alias names onto ``datetime, load, temperature, humidity,
    day_of_week, is_holiday``; impute / default what is absent; coerce."""
    m = resolve_aliases(df.columns)
    cols: dict[str, Column] = {}
    if "datetime" in m:
        src = F.col(m["datetime"])
        ts = src if dict(df.dtypes)[m["datetime"]].startswith("timestamp") else \
            F.to_timestamp_ntz(src.cast("string"))
        cols["datetime"] = ts.cast("timestamp_ntz")
    else:
        cols["datetime"] = F.lit(None).cast("timestamp_ntz")
    cols["load"] = coerce_numeric(m["load"]) if "load" in m else F.lit(0.0)
    if "temperature" in m:
        cols["temperature"] = coerce_numeric(m["temperature"])
    elif "load" not in m:
        cols["temperature"] = F.lit(DEFAULT_TEMPERATURE)
    cols["humidity"] = coerce_numeric(m["humidity"]) if "humidity" in m else F.lit(DEFAULT_HUMIDITY)
    out = df.select(*[v.alias(k) for k, v in cols.items()],
                    *[F.col(c) for c in ("day_of_week", "is_holiday") if c in df.columns])
    # no temperature but a load: 20 + (load - mean) / 100 via one aggregate
    out = impute_temperature_from_load(out)
    out = default_missing_columns(out)
    return out.select(*CONTRACT)


def impute_temperature_from_load(df: DataFrame, load_col: str = "load",
                                 keys: Sequence[str] = ()) -> DataFrame:
    """``temperature = 20 + (load - mean(load)) / 100`` when absent.

    The mean is one aggregate joined back (per series with ``keys``)."""
    if "temperature" in df.columns:
        return df
    if load_col not in df.columns:
        return df.withColumn("temperature", F.lit(DEFAULT_TEMPERATURE))
    keys = list(keys)
    means = df.groupBy(*keys).agg(F.avg(load_col).alias("_mean"))
    joined = df.join(means, keys, "left") if keys else df.crossJoin(F.broadcast(means))
    return joined.withColumn("temperature", F.lit(DEFAULT_TEMPERATURE) + (
        F.col(load_col) - F.col("_mean")) / TEMPERATURE_FROM_LOAD_SCALE).drop("_mean")


def default_missing_columns(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    adds = {}
    if "humidity" not in df.columns:
        adds["humidity"] = F.lit(DEFAULT_HUMIDITY)
    for c in ("load", "temperature"):
        if c not in df.columns:
            adds[c] = F.lit(0.0)
    if "day_of_week" not in df.columns:
        adds["day_of_week"] = F.weekday(time_col)
    if "is_holiday" not in df.columns:
        adds["is_holiday"] = F.weekday(time_col) >= 5
    return df.withColumns(adds) if adds else df


def convert_timezone(df: DataFrame, target_tz: str = "America/New_York",
                     time_col: str = "datetime") -> DataFrame:
    """Zone-less stamps are read as UTC and expressed as local wall time."""
    return df.withColumn(time_col, F.convert_timezone(F.lit("UTC"), F.lit(target_tz),
                                                      F.col(time_col)))


def base_calendar_columns(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    t = F.col(time_col)
    return df.withColumns({"hour": F.hour(t), "is_weekend": F.weekday(t) >= 5,
                           "season": cal.season(t), "date": F.to_date(t)})


def drop_null_target(df: DataFrame, target: str = "load") -> DataFrame:
    return df.dropna(subset=[target])


def select_numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Integer / floating columns except the non-feature names (booleans are
    not numeric, so they drop out)."""
    skip = NON_FEATURES | set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                                       T.FloatType, T.DoubleType, T.DecimalType))
            and f.name not in skip]


def fill_absent_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    missing = {c: F.lit(0.0) for c in features if c not in df.columns}
    return df.withColumns(missing) if missing else df


def range_filter(df: DataFrame, start: str, end: str, time_col: str = "datetime",
                 end_inclusive_day: bool = False) -> DataFrame:
    """``start <= t <= end`` (an end date means its midnight only, unless
    ``end_inclusive_day``).  Pushed down to the parquet scan."""
    lo = F.to_timestamp_ntz(F.lit(start))
    if end_inclusive_day:
        return df.filter((F.col(time_col) >= lo) &
                         (F.col(time_col) < F.to_timestamp_ntz(F.lit(end)) + F.expr("INTERVAL 1 DAY")))
    return df.filter((F.col(time_col) >= lo) & (F.col(time_col) <= F.to_timestamp_ntz(F.lit(end))))


def latest_features(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
                    exclude: Sequence[str] = ("load", "actual_load", "predicted_load")) -> DataFrame:
    """Last row per series (by time) without target / prediction columns.

    ``max_by(struct, time)`` is a partial aggregate: no sort, no single task."""
    keep = [c for c in df.columns if c not in set(exclude) | {time_col, *keys}]
    row = F.max_by(F.struct(*[F.col(c) for c in keep]), F.col(time_col))
    return (df.groupBy(*keys).agg(F.max(time_col).alias(time_col), row.alias("_last"))
              .select(*keys, time_col, "_last.*"))


def prediction_features(req: DataFrame, default_lag: float = DEFAULT_LAG_LOAD) -> DataFrame:
    """Feature rows for prediction requests (one ``select``).

    Lags default to ``default_lag``; ``ma_3h = (lag1 + 2*d)/3``,
    ``ma_24h = (lag24 + 23*d)/24``; change features 0."""
    t = F.to_timestamp_ntz(F.col("datetime").cast("string")) if dict(req.dtypes)["datetime"] == "string" \
        else F.col("datetime")
    d = F.lit(default_lag)
    lag1 = F.coalesce(F.col("load_lag_1h").cast("double"), d) if "load_lag_1h" in req.columns else d
    lag24 = F.coalesce(F.col("load_lag_24h").cast("double"), d) if "load_lag_24h" in req.columns else d
    lag168 = F.coalesce(F.col("load_lag_168h").cast("double"), d) if "load_lag_168h" in req.columns else d
    hour, dow = F.col("hour"), F.col("day_of_week")
    month, dom = F.month(t), F.dayofmonth(t)
    temp, hum = F.col("temperature").cast("double"), F.col("humidity").cast("double")
    is_weekend = dow >= 5
    is_holiday = F.coalesce(F.col("is_holiday"), F.lit(False)) if "is_holiday" in req.columns \
        else F.lit(False)
    workday = cal.workday_flag(is_weekend, is_holiday)
    hs, hc = cal.cyclic(hour, 24)
    ds, dc = cal.cyclic(dow, 7)
    ms, mc = cal.cyclic(month, 12)
    dms, dmc = cal.cyclic(dom, 31)
    keep = [c for c in ("request_id", "datetime") if c in req.columns]
    return req.select(
        *keep,
        hour.alias("hour"), dow.alias("day_of_week"), temp.alias("temperature"), hum.alias("humidity"),
        hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("day_of_week_sin"), dc.alias("day_of_week_cos"),
        month.alias("month"), ms.alias("month_sin"), mc.alias("month_cos"),
        dom.alias("day_of_month"), dms.alias("day_of_month_sin"), dmc.alias("day_of_month_cos"),
        workday.alias("is_workday"),
        lag1.alias("load_lag_1h"), lag24.alias("load_lag_24h"), lag168.alias("load_lag_168h"),
        lag168.alias("load_same_hour_last_week"),
        F.lit(0.0).alias("load_change_1h"), F.lit(0.0).alias("load_change_24h"),
        ((lag1 + d * 2) / 3).alias("load_ma_3h"), ((lag24 + d * 23) / 24).alias("load_ma_24h"),
        wx.apparent_temperature(temp, hum).alias("apparent_temperature"),
        wx.thermal_comfort_index(temp).alias("thermal_comfort_index"),
        wx.heating_cooling_index(temp).alias("heating_cooling_index"),
        (temp * temp).alias("temperature_squared"),
        (temp * workday).alias("temp_workday_interaction"),
        (temp * hum / 100).alias("temp_humidity_interaction"),
        wx.heat_humidity_index(temp, hum).alias("heat_humidity_index"))


def request_validation(req: DataFrame) -> DataFrame:
    """Split requests: ``valid`` flag plus an array of rejection reasons."""
    reasons = []
    for c in REQUEST_REQUIRED:
        if c in req.columns:
            reasons.append(F.when(F.col(c).isNull(), F.lit(f"{c} is required")))
        else:
            reasons.append(F.lit(f"{c} is required"))
    for c, (lo, hi) in REQUEST_BOUNDS.items():
        if c in req.columns:
            reasons.append(F.when(~F.col(c).between(lo, hi), F.lit(f"{c} outside [{lo}, {hi}]")))
    arr = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return req.withColumn("reasons", arr).withColumn("valid", F.size("reasons") == 0)


def standard_scaler(df: DataFrame, cols: Sequence[str] = SCALER_FEATURES,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Per column mean and population std (``ddof=0``) — the fitted scaler
    as a long table ``(keys, feature, mean, scale)``."""
    present = [c for c in cols if c in df.columns]
    aggs = []
    for c in present:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                 F.col(f"s_{c}").alias("scale")) for c in present])).alias("kv")).select(*keys, "kv.*")


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(x - mean) / scale`` using a scaler table of one row per feature
    (bounded by the feature count: broadcast)."""
    wide = scaler.groupBy().pivot("feature", list(cols)).agg(
        F.first(F.struct("mean", "scale")))
    joined = df.crossJoin(F.broadcast(wide.select(*[F.col(c).alias("_sc_" + c) for c in cols])))
    return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_sc_{c}.mean"),
                                               F.col(f"_sc_{c}.scale")) for c in cols}) \
                 .drop(*["_sc_" + c for c in cols])
