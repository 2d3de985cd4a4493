"""Plan-level properties that matter at scale."""

import re

from conftest import SF01
from gridlens.operators import standardize as std
from gridlens.operators import windows as win
from gridlens.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_range_reaches_parquet(spark):
    h = fx.hourly(spark, SF01, start="2024-01-08 00:00:00", end="2024-01-15 00:00:00")
    p = _plan(std.range_filter(h, "2024-01-08", "2024-01-15"))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", p).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_column_pruning(spark):
    p = _plan(fx.supplier_daily(spark, SF01))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(x.split(":")[0] for x in schema.split(",")) == {"l_suppkey", "l_extendedprice", "l_shipdate"}


def test_series_windows_are_chunked(spark):
    """The only single-partition windows are over the offset table (a row a
    partition) and the carry table (a row a chunk: last values ``_e_``); the
    lag windows are partitioned by chunk."""
    h = fx.hourly(spark, SF01).select("datetime", "load")
    lines = _plan(win.lag_features(h)).splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and "Exchange SinglePartition" in " ".join(lines[i + 1:i + 3]):
            order = line.split("], [")[-1]
            assert "_pid" in order or ("_chunk" in order and "_e_" in line)
    assert any("Window [" in line and "lag(" in line and "_chunk" in line for line in lines)
