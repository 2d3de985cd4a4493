"""Streaming forms of the series operators.

The modelled application has no streams; what carries over is (1) the
event -> hourly aggregation, expressed as an event-time tumbling window with
a watermark (late rows inside the watermark still update their hour, rows
behind it are dropped), and (2) every stateless operator (scalar features,
anomaly flags, range validation, prediction with a fitted model), which are
``DataFrame -> DataFrame`` functions without actions and therefore run
unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import insight
from ..operators import validation as val

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 file_glob: str | None = None) -> DataFrame:
    """Parquet files arriving in the folder ``path`` (optionally only those
    matching ``file_glob``) as an unbounded event table."""
    r = spark.readStream.schema(EVENT_SCHEMA).format("parquet")
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def hourly_stream(events: DataFrame, watermark: str = "2 hours", keys: tuple = ()) -> DataFrame:
    """Hourly load / temperature / humidity per event-time hour (append mode:
    an hour is emitted once the watermark passes its end)."""
    k = F.get_json_object("props", "$.k").cast("double")
    ev = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", watermark)
    g = ev.groupBy(*keys, F.window("_t", "1 hour").alias("w")).agg(
        F.sum("value").alias("load"), (F.avg(k) * 0.5 - 5).alias("temperature"),
        (F.lit(100.0) * F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)) / F.count(F.lit(1)))
        .alias("humidity"))
    return g.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("datetime"), "load", "temperature",
                    "humidity")


def stream_anomalies(pred: DataFrame, **kw) -> DataFrame:
    """Anomaly flags on a stream of (actual, predicted) rows."""
    return insight.anomaly_insights(pred, **kw)


def stream_validation(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Per-row range flags on a stream (the aggregate report is a batch op)."""
    rules = rules or val.RANGE_RULES
    flags = [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(c)) for c, (lo, hi) in rules.items()
             if c in df.columns]
    return df.withColumn("out_of_range", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a streaming query over everything available into an in-memory
    table (tests / smoke runs) and return that table."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)
