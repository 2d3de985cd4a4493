"""Hand-made edge frames (FIXTURES §3)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from gridlens.operators import compare as cmp
from gridlens.operators import insight, metrics as met, profile as prof
from gridlens.operators import ranking as rk, standardize as std, validation as val, windows as win
from gridlens.operators.features import seasonal_abs_diff


def _series(spark, values, start="2024-01-01 00:00:00", step_hours=1, col="load"):
    t0 = dt.datetime.fromisoformat(start)
    rows = [(t0 + dt.timedelta(hours=i * step_hours), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"datetime timestamp_ntz, {col} double")


def test_zeros_pct_change(spark):
    df = _series(spark, [0, 0, 5, 0])
    r = win.lag_features(df).orderBy("datetime").select("load_change_1h").collect()
    assert r[0][0] is None          # no previous row
    assert r[1][0] is None          # 0 / 0
    assert r[2][0] == 0.0           # 5 / 0 = inf -> 0
    assert r[3][0] == -1.0


def test_const_metrics_and_corr(spark):
    df = _series(spark, [7, 7, 7, 7, 7]).withColumn("model", F.lit("m")).withColumn("y", F.col("load")) \
        .withColumn("yhat", F.col("load") + 1)
    m = met.regression_metrics(df).first()
    assert m["r2"] is None and m["mae"] == 1.0
    from gridlens.functions.stats import safe_corr
    c = df.agg(safe_corr("y", "yhat")).first()[0]
    assert c is None
    assert prof.top_drivers(df.select("load", "y"), target="load").count() == 0


def test_runs_null_is_stable_and_breaks(spark):
    up = [100 * (1.1 ** i) for i in range(7)]            # 6 increasing steps
    vals = up + [None] + [up[-1] * 1.1, up[-1] * 1.21]   # null, then 2 more up
    down = [vals[-1] * (0.9 ** (i + 1)) for i in range(5)]
    stable = [down[-1]] * 7
    df = _series(spark, vals + down + stable)
    runs = insight.trend_runs(df, min_duration=6).orderBy("start_time").collect()
    types = [(r["trend_type"], r["duration"]) for r in runs]
    assert types[0] == ("increasing", 6)                  # the null row is a stable step
    assert ("increasing", 8) not in types
    assert types[-1][0] == "stable"
    assert all(d >= 6 for _, d in types)


def test_ties_in_ranking(spark):
    df = spark.createDataFrame([("SHAP", "b", 1.0), ("SHAP", "a", 1.0), ("SHAP", "c", 2.0)],
                               "method string, feature string, score double")
    r = rk.dense_rank_desc(df).orderBy("rank").select("feature").collect()
    assert [x[0] for x in r] == ["c", "a", "b"]


def test_duplicates_nulls_equal(spark):
    rows = [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 2), None),
            (dt.datetime(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, load double")
    d = prof.duplicate_stats(df).first()
    assert d["duplicate_rows"] == 2 and d["duplicate_datetimes"] == 2


def test_gaps_strict_rule(spark):
    t0 = dt.datetime(2024, 1, 1)
    hours = [0, 1, 3, 6, 10]       # gaps of 1, 2, 3, 4 hours
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h), 1.0) for h in hours], "datetime timestamp_ntz, load double")
    g = prof.time_gaps(df).orderBy("gap_end").select("hours_gap").collect()
    assert [x[0] for x in g] == [3.0, 4.0]          # strictly > 2 h
    s = prof.time_continuity_summary(df).first()
    assert s["n_gaps"] == 2 and s["total_missing_hours"] == 10 - 4


def test_short_series_mase_fallback(spark):
    df = _series(spark, list(range(20)))
    s = seasonal_abs_diff(df).first()
    assert s["n"] == 20 and s["scale"] == 1.0       # lag-1 diff when n <= 24


def test_nan_inf_normalised(spark):
    rows = [("2024-01-01 00:00:00", "1.5", 1.0), ("2024-01-01 01:00:00", "NaN", 2.0),
            ("2024-01-01 02:00:00", "abc", 3.0)]
    df = spark.createDataFrame(rows, "datetime string, load string, temperature double")
    out = std.standardize_columns(df).orderBy("datetime").select("load").collect()
    assert out[0][0] == 1.5 and out[1][0] is None and out[2][0] is None


def test_lead_trail_null_interpolation(spark):
    df = _series(spark, [None, 2, None, 4, None], col="temperature").withColumn("load", F.lit(1.0)) \
        .withColumn("humidity", F.lit(None).cast("double"))
    out = win.linear_interpolate(df, ["temperature", "humidity"]).orderBy("datetime").collect()
    assert [r["temperature"] for r in out] == [2.0, 2.0, 3.0, 4.0, 4.0]
    assert all(r["humidity"] is None for r in out)   # all-null column: median of nothing


def test_period_end_date_inclusion(spark):
    df = _series(spark, [1, 2, 3], start="2024-01-14 23:00:00")     # 23:00, 00:00, 01:00
    s = cmp.period_stats(df, [("p", "2024-01-01", "2024-01-15")]).first()
    assert s["count"] == 2      # the end date contributes only its 00:00 row


def test_validation_statuses(spark):
    df = _series(spark, [1, -5, None, 2])
    r = {(x["check"], x["column"]): x["status"] for x in val.validate_all(df).collect()}
    assert r[("ranges", "load")] == "error"
    assert r[("missing", "load")] == "error"        # 25 % > 10 %
    assert r[("columns", "temperature")] == "error"


def test_sampling_independent_of_partitioning(spark):
    from conftest import SF01
    from gridlens.sources import fixtures as fx
    h = fx.hourly(spark, SF01)
    a = {r["datetime"] for r in rk.sample_n(h.repartition(3), 50, ["datetime"]).collect()}
    b = {r["datetime"] for r in rk.sample_n(h.repartition(17, "load"), 50, ["datetime"]).collect()}
    assert a == b and len(a) == 50
    w1 = rk.bootstrap_weights(h.repartition(2), "datetime", 4).groupBy("replicate").agg(F.sum("weight")).collect()
    w2 = rk.bootstrap_weights(h.repartition(11), "datetime", 4).groupBy("replicate").agg(F.sum("weight")).collect()
    assert sorted(map(tuple, w1)) == sorted(map(tuple, w2))
    # Poisson(1) weights: mean close to 1 over 720 rows x 4 replicates
    mean_w = rk.bootstrap_weights(h, "datetime", 4).agg(F.avg("weight")).first()[0]
    assert 0.85 < mean_w < 1.15


def test_all_checks_from_one_scan(spark, monkeypatch):
    """validate_all equals its checks one by one, on rows with nulls, ties and repeats over several chunks, and reads its input once."""
    from gridlens.operators import validation as val
    rows = [(None, 1.0, None, 5.0), (None, 1.0, None, 5.0)] + [(i * 3600 if i % 9 else i * 3600 - 7200, float(i % 7) - 1, None if i % 5 == 0 else 70.0 * (i % 2), 120.0 * (i % 3)) for i in range(120)]
    rows += rows[40:50] + [(90 * 3600, 99.0, 1.0, 1.0)] + [(400 * 3600, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s long, load double, temperature double, humidity double").select(
        F.timestamp_seconds("s").alias("datetime"), "load", "temperature", "humidity")
    df = df.withColumns({"hour": (F.hour("datetime") + F.when(F.col("load") > 4, 1).otherwise(0)), "is_holiday": F.col("load") > 0, "is_weekend": F.col("load") < 3}).repartition(6)
    parts = [val.validate_columns(df), val.validate_dtypes(df), val.validate_ranges(df), val.validate_missing(df), val.validate_duplicates(df),
             val.validate_consistency(df), val.validate_continuity(df)]
    want = sorted(tuple(map(str, r)) for p in parts for r in p.collect())
    assert {r[2] for r in want} == {"passed", "warning", "error"}
    assert sorted(tuple(map(str, r)) for r in val.validate_all(df).collect()) == want
    real = val.o.layout
    monkeypatch.setattr(val.o, "layout", lambda *a, **k: real(*a, **{**k, "chunk": 4}))
    assert sorted(tuple(map(str, r)) for r in val.validate_all(df).collect()) == want
    keyed = val.validate_continuity(df.withColumn("k", F.col("load") > 2), keys=["k"])
    assert keyed.columns[0] == "k" and keyed.count() == 2
    untimed = df.drop("datetime")
    assert {r["check"] for r in val.validate_all(untimed).collect()} >= {"columns", "missing", "duplicates", "ranges"}
    plan = val.validate_columns(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_validate_all_reads_its_table_once(spark):
    from gridlens.operators import validation as val
    from gridlens.sources import fixtures as fx
    plan = val.validate_all(fx.hourly_nulls(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0          # what is read is the stored order: the scan was made once, for it


def test_range_means_are_two_look_ups(spark, monkeypatch):
    """Any range: gaps, bounds outside the series, null and inverted bounds, null values; over small chunks."""
    times = [i for i in range(200) if not 60 <= i < 75 and i != 199]
    vals = {i: None if i % 17 == 0 else (i * 37 % 101) / 4 for i in times}
    t0 = dt.datetime(2024, 3, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=i, minutes=15 * (i % 4)), v) for i, v in vals.items()], "datetime timestamp_ntz, load double").repartition(5)
    bounds = [(0, 10), (5, 5), (58, 80), (61, 70), (-50, 3), (190, 900), (-9, -1), (300, 400), (40, 20), (None, 5), (5, None), (-50, 900)]
    at = lambda h: None if h is None else t0 + dt.timedelta(hours=h)
    ranges = spark.createDataFrame([(i, at(a), at(b)) for i, (a, b) in enumerate(bounds)], "i int, a timestamp_ntz, b timestamp_ntz")
    want = {}
    for i, (a, b) in enumerate(bounds):
        own = [] if a is None or b is None else [v for h, v in vals.items() if a <= h <= b and v is not None]
        want[i] = (len(own), sum(own) / len(own) if own else None)
    real = cmp.o.layout
    for chunk in (100_000, 7):
        monkeypatch.setattr(cmp.o, "layout", lambda *x, chunk=chunk, **k: real(*x, **{**k, "chunk": chunk}))
        got = {r.i: (r.x_n, r.x_mean) for r in cmp.range_means(ranges, cmp.prefix_totals(df), "a", "b", prefix_name="x").collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert got[i][0] == want[i][0] and (got[i][1] is None) == (want[i][1] is None)
            assert want[i][1] is None or abs(got[i][1] - want[i][1]) < 1e-9
    assert [r.x_n for r in cmp.range_means(ranges, cmp.prefix_totals(df.limit(0)), "a", "b", prefix_name="x").collect()] == [0] * len(bounds)
