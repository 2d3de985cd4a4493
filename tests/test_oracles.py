"""Spark queries vs their DuckDB oracles on the smallest tables (the full
sweep at sf0.01 is ``tools/check.py``)."""

import math
import os

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SAMPLE = ["anomaly_insights", "lag_features", "pct_change", "rolling_mean", "create_features", "trend_runs_daily",
          "linear_interpolate", "ffill_then_dropna", "time_gaps", "timeseries_cv_folds", "distribution_summary",
          "outliers_iqr", "series_statistics", "period_diff", "hourly_diff", "feature_change", "kendall_w",
          "importance_union", "regression_metrics", "ensemble_weights_auto", "history_lag_lookup",
          "history_range_mean", "hour_month_mean_fill", "validate_ranges", "intent_classify", "deviation_scan",
          "root_cause_rules", "standardize_columns", "rule_baseline_load", "apparent_temperature",
          "calendar_spine", "abnormal_features", "quadratic_trend", "lagged_correlation"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    s_rows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    d_rows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert s_rows == d_rows


def test_every_query_has_unique_name_and_entry_runs(spark):
    q = entry.queries()
    assert len(q) >= 180
    assert set(entry.oracle_sql()) <= set(q)
    df = entry.entry(spark)
    assert df.count() >= 0 and "severity" in df.columns
