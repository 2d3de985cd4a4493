"""Build measurement series from raw tables; CSV scan; calendar spine."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal


def hour_bucket(ts: Column | str, unit: str = "hour") -> Column:
    """Truncate a time stamp and keep it zone-less (``timestamp_ntz``)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def parquet_series_scan(df: DataFrame, ts_col: str, value_col: str,
                        keys: Sequence[str] = (), unit: str = "hour",
                        extra: dict[str, Column] | None = None,
                        start: str | None = None, end: str | None = None) -> DataFrame:
    """Aggregate an event table into a regular series ``(keys, datetime, load, ...)``.

    One hash shuffle on ``(keys, bucket)`` with map-side partial aggregation,
    so a hot key is pre-aggregated before it is shuffled.  ``start`` / ``end``
    (bucket stamps, inclusive) become plain predicates on the raw time
    column, so the parquet reader skips row groups outside the range."""
    if start is not None:
        df = df.filter(F.col(ts_col) >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        df = df.filter(F.col(ts_col) < F.to_timestamp_ntz(F.lit(end)) + F.expr(f"INTERVAL 1 {unit.upper()}"))
    aggs = [F.sum(value_col).alias("load")]
    aggs += [v.alias(k) for k, v in (extra or {}).items()]
    return (df.groupBy(*keys, hour_bucket(ts_col, unit).alias("datetime"))
              .agg(*aggs))


def event_weather_aggs(props_col: str = "props", type_col: str = "event_type") -> dict[str, Column]:
    """Weather stand-ins derived from the event table (see FIXTURES):
    temperature = avg(props.k) * 0.5 - 5, humidity = share of error events."""
    k = F.get_json_object(F.col(props_col), "$.k").cast("double")
    return {
        "temperature": F.avg(k) * 0.5 - 5,
        "humidity": F.lit(100.0) * F.sum(F.when(F.col(type_col) == "error", 1).otherwise(0))
        / F.count(F.lit(1)),
    }


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             time_col: str = "datetime", time_format: str | None = None) -> DataFrame:
    """Read a headered CSV; parse ``time_col`` into ``timestamp_ntz`` when present."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", False)
    df = reader.csv(path)
    if time_col in df.columns:
        col = F.col(time_col).cast("string")
        parsed = (F.to_timestamp_ntz(col, F.lit(time_format)) if time_format
                  else F.to_timestamp_ntz(col))
        df = df.withColumn(time_col, parsed)
    return df


def calendar_spine(spark: SparkSession, start: Column, end: Column,
                   step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Every step from ``start`` to ``end`` inclusive plus calendar columns.

    ``start`` / ``end`` may come from an aggregate over data; generation is
    one ``explode(sequence)`` per input row, so a year range fans out
    inside a task, not on the driver."""
    base = spark.range(1).select(F.explode(F.sequence(start.cast("timestamp_ntz"),
                                                      end.cast("timestamp_ntz"),
                                                      F.expr(step))).alias("datetime"))
    return add_generator_calendar(base)


def spine_from(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
               step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Spine per series spanning that series' min..max time stamp."""
    rng = df.groupBy(*keys).agg(F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi"))
    return rng.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias(time_col))


def add_generator_calendar(df: DataFrame, ts: str = "datetime") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "date": F.to_date(t), "hour": F.hour(t), "day_of_week": F.weekday(t),
        "is_weekend": F.weekday(t) >= 5, "is_holiday": cal.holiday_flag(t),
        "season": cal.season(t)})


def load_series(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Composite loader: standardise alias names and types, drop rows
    without a target, interpolate weather gaps by position, ordered by time
    at the sink only (no global sort here)."""
    from ..operators import standardize as std
    from ..operators import windows as win
    s = std.drop_null_target(std.standardize_columns(df))
    return win.linear_interpolate(s, ["temperature", "humidity"], time_col)


def csv_sink(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Headered CSV, one folder; optionally partitioned (e.g. by month)."""
    w = df.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
