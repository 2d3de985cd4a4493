"""Model / explanation invariants: SHAP additivity and exact
Shapley values, PDP = mean of ICE, ensemble weights, folds."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from gridlens.operators import explain as X
from gridlens.operators import features as feat
from gridlens.operators import metrics as met
from gridlens.operators import models as M
from gridlens.operators import standardize as std
from gridlens.sources import fixtures as fx

FEATS = ["temperature", "humidity", "hour", "load_lag_1h"]


@pytest.fixture(scope="module")
def fitted(spark):
    base = std.standardize_columns(fx.hourly(spark, SF01))
    fe = feat.create_features(base).withColumn("row_id", F.monotonically_increasing_id()).cache()
    pm = M.train_gbt(fe, FEATS, maxIter=4, maxDepth=3)
    return fe, pm, X.tree_tables(pm, spark)


def _cond_expectation(tree, x, subset):
    """E[f(x) | x_S] with cover-weighted averaging over the other features."""
    def rec(node):
        if tree.left[node] < 0:
            return tree.value[node]
        d = tree.feature[node]
        lc, rc = tree.left[node], tree.right[node]
        if d in subset:
            return rec(lc if x[d] <= tree.threshold[node] else rc)
        return (tree.cover[lc] * rec(lc) + tree.cover[rc] * rec(rc)) / tree.cover[node]
    return rec(0)


def test_tree_shap_equals_brute_force_shapley(fitted):
    fe, pm, trees = fitted
    Xm = fe.select(*FEATS).limit(5).toPandas().to_numpy(dtype=float)
    phi = X.tree_shap(Xm, trees)
    m = len(FEATS)
    for r in range(Xm.shape[0]):
        x = Xm[r]
        exact = np.zeros(m)
        for i in range(m):
            others = [j for j in range(m) if j != i]
            for k in range(len(others) + 1):
                for S in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                    gain = sum(t.weight * (_cond_expectation(t, x, set(S) | {i}) - _cond_expectation(t, x, set(S)))
                               for t in trees)
                    exact[i] += w * gain
        assert np.abs(exact - phi[r]).max() < 1e-8


def test_shap_additivity_in_spark(spark, fitted):
    fe, pm, trees = fitted
    ev = X.expected_value(trees)
    long = X.tree_shap_table(pm, fe, FEATS, trees=trees)
    s = long.groupBy("row_id").agg(F.sum("shap_value").alias("s"))
    err = (s.join(pm.transform(fe).select("row_id", "prediction"), "row_id")
            .select(F.max(F.abs(F.col("s") + ev - F.col("prediction")))).first()[0])
    assert err < 1e-8


def test_interactions_sum_to_shap(fitted):
    fe, pm, trees = fitted
    Xm = fe.select(*FEATS).limit(6).toPandas().to_numpy(dtype=float)
    M3 = X.shap_interaction_matrix(Xm, trees)
    assert np.abs(M3.sum(axis=2) - X.tree_shap(Xm, trees)).max() < 1e-8
    assert np.abs(M3 - M3.transpose(0, 2, 1)).max() < 1e-8


def test_pdp_is_mean_of_ice(spark, fitted):
    fe, pm, _ = fitted
    pdp = X.pdp_1d(pm, fe, "temperature", n_grid=7).toPandas().sort_values("grid_index")
    curves = X.ice(pm, fe, "temperature", n_grid=7, sample=None)
    summ = X.ice_summary(curves).toPandas().sort_values("grid_index")
    assert np.allclose(pdp["avg_prediction"].to_numpy(), summ["mean"].to_numpy())
    cen = X.ice_centered(curves).filter(F.col("grid_index") == 0).agg(F.max(F.abs("centered"))).first()[0]
    assert cen == 0


def test_lime_recovers_local_slope(spark, fitted):
    fe, pm, _ = fitted
    rows = fe.limit(2)
    res = X.lime_explain(pm, fe, FEATS, rows, n_samples=150, top=4)
    assert res.count() == 8
    assert res.filter(F.col("weight").isNull()).count() == 0


def test_ensemble_weights_sum_to_one(spark):
    mp = fx.model_predictions(spark, SF01)
    w = met.ensemble_weights_auto(mp).toPandas()
    assert abs(w["weight"].sum() - 1) < 1e-12
    # the stable form never underflows to 0/0 at large errors
    assert w["weight"].notna().all()


def test_cv_folds_disjoint_and_expanding(spark):
    h = fx.hourly(spark, SF01).select("datetime")
    f = feat.timeseries_cv_folds(h, 5).toPandas()
    n = 720
    ts = n // 6
    for k in range(5):
        g = f[f["fold"] == k]
        test = set(g[g["role"] == "test"]["row_id"])
        train = set(g[g["role"] == "train"]["row_id"])
        assert not (test & train)
        assert len(test) == ts
        assert max(train) < min(test)
        assert len(train) == n - (5 - k) * ts


def test_predict_batch_bounds(spark, fitted):
    fe, _, _ = fitted
    tm = M.train_model(fe, FEATS, interval_trees=5, interval_depth=3, maxIter=3, maxDepth=3)
    p = M.predict_batch(tm, fe).toPandas()
    assert (p["lower_bound"] <= p["predicted_load"] + 1e-9).all()
    assert (p["predicted_load"] <= p["upper_bound"] + 1e-9).all()
    assert (p["lower_bound"] >= 0).all()


def test_leaf_tables_made_ahead_by_batch_or_by_leaf_agree(fitted, monkeypatch):
    """The three ways to tabulate a model give the same values, main effects and interactions."""
    fe, pm, trees = fitted
    x = fe.select(*FEATS).limit(40).toPandas().to_numpy(dtype=float)
    columns = [(0,), (3,), (0, 0), (0, 2), (1, 3)]
    ahead = X.leaf_model(trees, columns)
    assert ahead.made is not None
    want = ahead.values(x)
    full = X.shap_interaction_matrix(x, trees)
    assert np.abs(want[:, 2:] - np.stack([full[:, 0, 0], full[:, 0, 2], full[:, 1, 3]], 1)).max() < 1e-10
    assert np.abs(want[:, :2] - X.tree_shap(x, trees)[:, [0, 3]]).max() < 1e-10
    monkeypatch.setattr(X, "TABLE_BYTES", 0)
    by_batch = X.leaf_model(trees, columns)
    assert by_batch.made is None and np.abs(by_batch.values(x) - want).max() < 1e-10
    monkeypatch.setattr(X.leaf, "MAX_FEATURES", 0)
    assert np.abs(X.leaf_model(trees, columns).values(x) - want).max() < 1e-10


def test_grid_predictions_are_dealt_over_all_cores(spark, fitted):
    fe, pm, _ = fitted
    one = fe.coalesce(1)
    n = 2 * spark.sparkContext.defaultParallelism
    assert X.ice(pm, one, "temperature", n_grid=3).select(F.spark_partition_id()).distinct().count() == n
    assert X.pdp_2d(pm, one, "temperature", "hour", n_grid=2).count() == 4
    got = {(r.row_id, r.grid_index): r.prediction for r in X.ice(pm, one, "temperature", n_grid=3).collect()}
    assert len(got) == 3 * fe.count()
