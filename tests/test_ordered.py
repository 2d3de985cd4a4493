"""Chunk-with-halo windows must equal plain windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from gridlens.operators import insight, windows as win
from gridlens.plans import ordered as o
from gridlens.sources import fixtures as fx


def _pdf(df, keys=()):
    return df.toPandas().sort_values([*keys, "datetime"]).reset_index(drop=True)


def test_row_index_is_time_position(spark):
    h = fx.hourly(spark, SF01)
    idx = o.with_row_index(h, ["datetime"], partitions=5).toPandas().sort_values("datetime")
    assert list(idx[o.IDX]) == list(range(len(idx)))


def test_row_index_keyed(spark):
    h = fx.hourly_keyed(spark, SF01)
    idx = o.with_row_index(h, ["datetime"], ["event_type"], partitions=7).toPandas()
    for _, g in idx.groupby("event_type"):
        g = g.sort_values("datetime")
        assert list(g[o.IDX]) == list(range(len(g)))


@pytest.mark.parametrize("chunk", [170, 300])
def test_lag_features_chunked_equal(spark, chunk):
    h = fx.hourly(spark, SF01).select("datetime", "load")
    a = _pdf(win.lag_features(h, chunk=chunk))
    b = _pdf(win.lag_features(h))
    pd.testing.assert_frame_equal(a, b)
    # against pandas on the same rows
    p = h.toPandas().sort_values("datetime").reset_index(drop=True)
    assert a["load_lag_168h"].equals(p["load"].shift(168))
    assert (a["load_ma_24h"] - p["load"].rolling(24, min_periods=1).mean()).abs().max() < 1e-9


def test_keyed_lags_chunked_equal(spark):
    h = fx.hourly_keyed(spark, SF01).select("event_type", "datetime", "load")
    a = _pdf(win.lag_features(h, keys=["event_type"], chunk=200), ["event_type"])
    b = _pdf(win.lag_features(h, keys=["event_type"]), ["event_type"])
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("chunk", [7, 50])
def test_ffill_and_interpolate_chunked_equal(spark, chunk):
    h = fx.hourly_nulls(spark, SF01)
    a = _pdf(win.ffill(h, ["temperature", "humidity"], chunk=chunk))
    p = h.toPandas().sort_values("datetime").reset_index(drop=True)
    exp = p[["temperature", "humidity"]].ffill()
    assert (a[["temperature", "humidity"]].fillna(-1) - exp.fillna(-1)).abs().max().max() < 1e-12
    ai = _pdf(win.linear_interpolate(h, ["temperature", "humidity"], chunk=chunk))
    ei = p[["temperature", "humidity"]].interpolate(method="linear").ffill().bfill()
    assert (ai[["temperature", "humidity"]] - ei).abs().max().max() < 1e-9


@pytest.mark.parametrize("chunk", [30, 100])
def test_trend_runs_chunked_equal(spark, chunk):
    d = fx.daily_orders(spark, SF01)
    a = insight.trend_runs(d, min_duration=3, chunk=chunk).toPandas().sort_values("start_time")
    b = insight.trend_runs(d, min_duration=3).toPandas().sort_values("start_time")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_trend_runs_match_loop(spark):
    """Gaps-and-islands equals a direct loop over the ordered rows."""
    d = fx.daily_orders(spark, SF01)
    p = d.toPandas().sort_values("datetime").reset_index(drop=True)
    rate = p["load"].pct_change()
    runs, cur, cur_dir = [], [], None
    for i, r in rate.items():
        if pd.isna(r):
            continue
        di = "increasing" if r > 0.02 else "decreasing" if r < -0.02 else "stable"
        if di == cur_dir:
            cur.append(i)
        else:
            if len(cur) >= 3:
                runs.append((cur_dir, len(cur)))
            cur, cur_dir = [i], di
    if len(cur) >= 3:
        runs.append((cur_dir, len(cur)))
    got = insight.trend_runs(d, min_duration=3).orderBy("start_time").select("trend_type", "duration").collect()
    assert [(r[0], r[1]) for r in got] == runs


def test_running_sum_carry(spark):
    h = fx.hourly(spark, SF01).select("datetime", "load")
    lo = o.layout(h, "datetime", halo=0, chunk=37)
    core = lo.core().withColumn("one", F.lit(1))
    r = o.running_sum(core, "one", "cnt").toPandas().sort_values(o.IDX)
    assert list(r["cnt"]) == list(range(1, len(r) + 1))


def test_exact_quantiles_with_hot_value(spark):
    """Distributed quantiles equal pandas' linear quantiles, also when one
    value holds a third of the rows."""
    import numpy as np
    from gridlens.plans.quantiles import quantiles
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=400), np.full(200, 0.25)])
    keys = np.where(np.arange(600) % 3 == 0, "a", "b")
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(keys, vals)], "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, "v", probs, ["k"]).toPandas()
    p = pd.DataFrame({"k": keys, "v": vals})
    for k, g in p.groupby("k"):
        for q in probs:
            exp = g["v"].quantile(q)
            val = got[(got["k"] == k) & (got["prob"] == q)]["quantile"].iloc[0]
            assert abs(val - exp) < 1e-12


def test_null_gaps_do_not_depend_on_chunks(spark):
    """Padded change rates and trend runs over gaps longer than the halo and across chunk borders."""
    import pandas as pd
    from gridlens.operators import insight
    from gridlens.operators import windows as win
    n = 900
    values = [None if 60 <= i < 90 or 150 <= i < 400 or i == 700 else 100.0 + (i * 37 % 11) + i / 7 for i in range(n)]
    times = pd.date_range("2024-01-01", periods=n, freq="h")
    df = spark.createDataFrame([(t.to_pydatetime(), v) for t, v in zip(times, values)], "datetime timestamp_ntz, load double")
    s = pd.Series(values, dtype="float64").ffill()
    for chunk in (170, 300, None):
        got = win.lag_features(df, chunk=chunk).toPandas().sort_values("datetime")
        for k, name in ((1, "load_change_1h"), (24, "load_change_24h")):
            want = s / s.shift(k) - 1
            diff = (got[name].reset_index(drop=True) - want).abs()
            assert diff.max() < 1e-9 and (got[name].reset_index(drop=True).isna() == want.isna()).all()
    runs = [sorted(map(tuple, insight.trend_runs(df, min_duration=2, chunk=c).collect()), key=str) for c in (40, 170, None)]
    assert runs[0] == runs[1] == runs[2]
    gap = [r for r in insight.trend_runs(df, min_duration=2).collect() if r["duration"] >= 250]
    assert [r["trend_type"] for r in gap] == ["stable"]


def test_a_cluster_needs_a_checkpoint_folder():
    import pytest
    from gridlens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_selection_narrows_ranges(spark, monkeypatch):
    """Rounds of cuts give the quantiles of a sort: ties, one hot value, infinities, null keys, a range of one value."""
    from gridlens.plans import quantiles as q
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.lognormal(0, 6, 3000) * rng.choice([-1, 1], 3000), np.full(4000, 3.25), rng.integers(0, 9, 2000).astype(float), [np.inf, -np.inf, -0.0]])
    rows = [("a", float(v)) for v in vals] + [("b", 7.0)] * 900 + [(None, float(v)) for v in rng.normal(size=700)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.013, 0.25, 0.5, 0.77, 0.95, 1.0]
    for range_rows, cuts in ((200_000, 256), (50, 16), (6, 8)):
        monkeypatch.setattr(q, "RANGE_ROWS", range_rows)
        monkeypatch.setattr(q, "CUTS", cuts)
        got = {(r.k, r.prob): r.quantile for r in q.quantiles(df, "v", probs, ["k"]).collect()}
        assert len(got) == 4 * len(probs)
        for key in ("a", "b", None, "c"):
            own = np.sort(np.array([v for k, v in rows if k == key]))
            for p in probs:
                h = (len(own) - 1) * p
                lo, hi = own[int(np.floor(h))], own[int(np.ceil(h))]
                want = lo if lo == hi else lo + (h - np.floor(h)) * (hi - lo)
                assert got[key, p] == want or abs(got[key, p] - want) < 1e-9 * max(1, abs(want))
        whole = {r.prob: r.quantile for r in q.quantiles(df.filter("k = 'a'"), "v", probs).collect()}
        assert all(whole[p] == got["a", p] for p in probs)
    monkeypatch.setattr(q, "BROADCAST_ROWS", 0)
    assert {(r.k, r.prob): r.quantile for r in q.quantiles(df, "v", probs, ["k"]).collect()} == got
    assert q.quantiles(df.filter("k = 'd'"), "v", probs).collect() == []


def test_selection_sorts_no_rows(spark):
    from gridlens.plans.quantiles import quantile_columns
    df = spark.range(1000).selectExpr("id % 3 AS k", "cast(id AS double) AS v")
    plan = quantile_columns(df, "v", {"m": 0.5}, ["k"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "RoundRobin" not in plan
