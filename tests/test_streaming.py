"""Stateless operators on a streaming DataFrame; windowed hourly stream."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from gridlens.streaming import event_stream, hourly_stream, run_available, stream_anomalies
from gridlens.sources import fixtures as fx


def test_hourly_stream_matches_batch(spark):
    ev = event_stream(spark, SF001, file_glob="events.parquet")
    hs = hourly_stream(ev, watermark="0 seconds")
    out = run_available(hs, "hourly_stream_t", tempfile.mkdtemp(prefix="gl-ck-"))
    batch = fx.hourly(spark, SF001)
    # with a zero watermark every hour but the last is final after the run
    got = out.count()
    assert 0 < got <= batch.count()
    j = out.join(batch.withColumnRenamed("load", "b"), "datetime")
    assert j.filter(F.abs(F.col("load") - F.col("b")) > 1e-6).count() == 0


def test_anomalies_on_stream(spark):
    d = tempfile.mkdtemp(prefix="gl-pred-")
    fx.predictions_naive(spark, SF001).write.mode("overwrite").parquet(os.path.join(d, "p"))
    schema = spark.read.parquet(os.path.join(d, "p")).schema
    s = spark.readStream.schema(schema).parquet(os.path.join(d, "p") + "/")
    out = run_available(stream_anomalies(s), "anom_stream_t", tempfile.mkdtemp(prefix="gl-ck-"))
    from gridlens.operators import insight
    assert out.count() == insight.anomaly_insights(fx.predictions_naive(spark, SF001)).count()
