"""Model sizes, early stopping and candidates of the model queries."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from gridlens.catalog import q_models as Q
from gridlens.operators import models as M


@pytest.fixture
def small(monkeypatch):
    """Few trees, and nothing kept from or for other tests."""
    monkeypatch.setattr(M.P, "GBT_TREES", 4)
    monkeypatch.setattr(Q, "_CACHE", {})


def test_trained_model_is_the_full_boosting_on_all_training_rows(spark, small):
    train = Q.feature_table(spark, SF001).filter(F.col("split") == "train")
    tm = Q.trained(spark, SF001)
    assert tm.point.stages[-1].getNumTrees == 4
    full = M.train_gbt(train, Q.FEATURES)
    got, want = [[r.prediction for r in m.transform(train).orderBy("row_id").select("prediction").collect()] for m in (tm.point, full)]
    assert np.allclose(got, want)


def test_early_stop_waits_out_its_patience():
    assert M.best_iteration([5, 4, 4.2, 3.99, 3.98, 4.5, 1], patience=50) == 7
    assert M.best_iteration([5, 4, 4.2, 4.3, 1], patience=2) == 2
    assert M.best_iteration([1, 2, 3], patience=50) == 1
    assert M.best_iteration([float("nan")] * 3, patience=50) == 3


def test_early_stopped_model_has_the_least_validation_error(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(np.sin(a) + rng.normal(0, 2)), i % 3 == 0) for i, (a, b) in enumerate(rng.uniform(0, 6, (240, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, load double, is_validation boolean").coalesce(1).cache()
    valid = df.filter("is_validation")
    pm = M.train_gbt_early_stop(df, ["a", "b"], maxIter=25, maxDepth=3)
    full = M.train_gbt(df.filter("not is_validation"), ["a", "b"], maxIter=25, maxDepth=3)
    errors = full.stages[-1].evaluateEachIteration(full.stages[0].transform(valid), "squared")
    best = int(np.argmin(errors))
    kept = pm.stages[-1]
    assert kept.getNumTrees == best + 1 < 25 and len(kept.treeWeights) == best + 1
    got = pm.transform(valid).agg(F.avg((F.col("load") - F.col("prediction")) ** 2)).first()[0]
    assert abs(got - errors[best]) < 1e-9
    assert kept.numFeatures == 2 and len(M.feature_importance(pm, ["a", "b"]).collect()) == 2


def test_all_three_candidates_are_compared(spark, small):
    rows = Q.q_train_all(spark, SF001).groupBy("model").count().collect()
    assert {r.model for r in rows} == {"gbt", "gbt_early_stop", "forest"}
    assert len({r["count"] for r in rows}) == 1
    assert {r.model for r in Q.q_ensemble_importance(spark, SF001).select("model").distinct().collect()} == {"gbt", "gbt_early_stop", "forest"}


def test_concurrent_folds_equal_one_by_one_fits(spark):
    df = spark.range(420).select(
        F.timestamp_seconds(F.col("id") * 3600).alias("datetime"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).cast("double").alias("b"))
    df = df.withColumn("load", F.col("a") * 3 + F.col("b") * F.col("b") / 10 + 100).repartition(5)
    small = {"maxIter": 3, "maxDepth": 3}
    together = M.cross_validate(df, ["a", "b"], n_splits=4, model_type=["gbt", "gbt_early_stop"], **small).collect()
    alone = [r for k in ("gbt", "gbt_early_stop") for r in M.cross_validate(df, ["a", "b"], n_splits=4, model_type=k, threads=1, **small).collect()]
    as_rows = lambda rows: {(r.model, r.fold, r.train_size, r.test_size, r.metric): r.value for r in rows}
    one, two = as_rows(together), as_rows(alone)
    assert one.keys() == two.keys() and len(one) == 2 * 4 * 4
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert {(k[1], k[2], k[3]) for k in one} == {(0, 84, 84), (1, 168, 84), (2, 252, 84), (3, 336, 84)}
    with pytest.raises(ValueError):
        M.cross_validate(df.limit(3), ["a", "b"], n_splits=4)
    with pytest.raises(ValueError):
        M.train_all_models(df, ["a"], models=["nothing"])


def test_training_computes_its_rows_once_in_tasks_of_many_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x % 7)

    df = spark.range(0, 160, 1, 8).select(counted("id").alias("a"), (F.col("id") % 11).cast("double").alias("load"))
    tm = M.train_model(df, ["a"], maxIter=2, maxDepth=2, interval_trees=2, interval_depth=2)
    assert tm.metrics["n"] == 160 and seen.value == 160
    rows = M.fit_rows(df, ["a", "load"])
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 160
    assert M.fit_rows(df, ["a"], 2 * M.FIT_ROWS + 1).rdd.getNumPartitions() == 3


def test_candidates_and_their_folds_are_fitted_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def waits(sql):
        def run(spark, sf_dir):
            both.wait()
            return spark.sql(sql)
        return run

    monkeypatch.setattr(Q, "feature_table", lambda spark, sf_dir: None)
    monkeypatch.setattr(Q, "_candidate_metrics", waits("SELECT 'gbt' model, 1D mae, 2D rmse, 0.5D r2"))
    monkeypatch.setattr(Q, "_cv_avg", waits("SELECT 'gbt' model, 'mae' metric, 3D mean, 0D std"))
    assert {(r.source, r.metric, r.value) for r in Q.q_candidate_pool(spark, "").collect()} == {
        ("test", "mae", 1.0), ("test", "rmse", 2.0), ("cv", "mae", 3.0)}
    assert [r.cv_mae_mean for r in Q.q_selection_summary(spark, "").collect()] == [3.0]


def test_a_fit_of_rows_in_one_partition_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(M, "FIT_ROWS", 100)
    df = spark.range(0, 400, 1, 1).select(F.col("id").cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("load"))
    one, two = [M.fit_rows(df, ["a", "load"]).rdd.glom().collect() for _ in range(2)]
    assert [len(p) for p in one] == [100] * 4 and one == two
    assert sorted(r.a for p in one for r in p) == [float(i) for i in range(400)]


def test_insights_bundle_computes_the_hourly_series_once(spark, small, monkeypatch, tmp_path):
    hours = F.col("id") % 480
    spark.range(960).select(
        F.timestamp_seconds(hours * 3600 + 1704067200).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"),
        (10 + hours % 24 + F.col("id") % 7).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), (F.col("id") % 90).cast("string"), F.lit("}")).alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    seen, hourly = spark.sparkContext.accumulator(0), Q.fx.hourly

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(Q.fx, "hourly", lambda spark, sf_dir: hourly(spark, sf_dir).withColumn("load", counted("load")))
    got = Q.q_insights_bundle(spark, str(tmp_path)).collect()
    assert {"trend", "correlation"} <= {r.section for r in got}
    assert seen.value == 480


def test_insights_bundle_has_its_summary_causes_and_processed_hours(spark, small, tmp_path):
    hours = F.col("id") % 600        # the last of them from a Sunday evening on, with spikes that no model foresees
    spike = (hours > 500) & (hours % 17 == 0)
    spark.range(1200).select(
        F.timestamp_seconds(hours * 3600 + 1708851600).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"),
        F.when(hours != 590, F.when(spike, 900.0).otherwise((10 + hours % 24 + F.col("id") % 7).cast("double"))).alias("value"),
        F.concat(F.lit('{"k": '), (F.col("id") % 90).cast("string"), F.lit("}")).alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    got = Q.q_insights_bundle(spark, str(tmp_path))
    assert got.columns[:5] == ["section", "rank", "label", "value", "datetime"]
    rows = got.collect()
    summary = {r.label: r for r in rows if r.section == "summary"}
    assert list(summary) == ["n_trends", "n_anomalies", "n_high_anomalies", "n_medium_anomalies", "n_correlations"]

    fe = Q.feature_table(spark, str(tmp_path))
    pred = M.predict_batch(Q.trained(spark, str(tmp_path)), fe.filter("split = 'test'")).select("datetime", "load", "predicted_load", "is_weekend").collect()
    off = {r.datetime: (abs(r.load - r.predicted_load) / r.predicted_load, r) for r in pred if r.predicted_load}
    bad = {t: (x, r) for t, (x, r) in off.items() if x > 0.15}
    assert summary["n_anomalies"].value == len(bad) > 10               # of all, not of the ten that are listed
    assert summary["n_high_anomalies"].value == sum(x > 0.3 for x, _ in bad.values())
    assert summary["n_medium_anomalies"].value == sum(0.2 < x <= 0.3 for x, _ in bad.values())
    assert len(summary["n_anomalies"].text.split("\n")) == 3

    listed = [r for r in rows if r.section == "anomaly"]
    assert len(listed) == 10 and {bool(bad[r.datetime][1].is_weekend) for r in listed} == {True, False}
    for r in listed:
        error = bad[r.datetime][1]
        assert ("holiday activity differs" in r.text) == error.is_weekend       # a weekend counts as a holiday here
        assert r.anomaly_type == ("high_error" if error.load > error.predicted_load else "low_error")
    assert summary["n_trends"].value >= len(found := [r for r in rows if r.section == "trend"]) > 0
    assert all(r.duration >= 3 and 0 < r.confidence <= 1 for r in found)

    corr = {r.lag: r for r in rows if r.section == "correlation"}
    assert summary["n_correlations"].value == len(corr) == 5
    load, temp = zip(*[(r.load, r.temperature) for r in fe.orderBy("datetime").collect()])
    for lag, r in corr.items():                                        # over the processed hours, as the reference
        assert abs(r.value - np.corrcoef(load[lag:], temp[:len(temp) - lag])[0, 1]) < 1e-5 and (r.feature1, r.feature2) == ("load", "temperature")


def _boosting_input(spark, rows, partitions=1):
    rng = np.random.default_rng(rows)
    x = np.round(rng.normal(size=(rows, 6)), 1)
    x[:, 3], x[:, 5] = rng.integers(0, 3, rows), 4.0
    y = x[:, 0] * 3 + x[:, 1] ** 2 + rng.normal(size=rows) + 50
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([[*map(float, a), float(b)] for a, b in zip(x, y)], [*names, "load"]).repartition(partitions)
    return M.cut_lineage(df), names


def _stored_nodes(spark, model, path):
    model.save(path)
    return spark.read.parquet(f"{path}/data").orderBy("treeID", "nodeData.id").collect()


def test_a_boosted_fit_of_one_task_is_mllibs_node_for_node(spark, tmp_path):
    for rows, over in ((250, {"maxIter": 4}), (14, {"maxIter": 3}), (10_400, {"maxIter": 2, "maxDepth": 3, "featureSubsetStrategy": "2"}),
                       (60, {"maxIter": 2, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 1})):
        df, names = _boosting_input(spark, rows)
        est = M.Boosting(featuresCol=M.VEC, labelCol="load", predictionCol="prediction", **M.gbt_params(**over))
        own, full = M.boosted(df, names, est, M.FIT_ROWS), M._pipeline(names, est).fit(df).stages[-1]
        assert _stored_nodes(spark, own, f"{tmp_path}/own{rows}") == _stored_nodes(spark, full, f"{tmp_path}/full{rows}")
        assert own.treeWeights == full.treeWeights and own.numFeatures == full.numFeatures == 6
        assert {p.name: v for p, v in own.extractParamMap().items()} == {p.name: v for p, v in full.extractParamMap().items()}
        assert len(own.trees) == over["maxIter"]


def test_a_boosted_fit_of_few_rows_takes_few_jobs(spark):
    df, names = _boosting_input(spark, 200)
    spark.sparkContext.setJobGroup("few", "")
    try:
        M.train_gbt(df, names, maxIter=8)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 16      # MLlib: more than 40


def test_other_fits_are_left_to_mllib(spark):
    df, names = _boosting_input(spark, 200)
    est = M.Boosting(featuresCol=M.VEC, labelCol="load", **M.gbt_params(maxIter=2))
    assert M.boosted(df, names, est, 199) is None
    assert M.boosted(df.repartition(2), names, est, 200) is None
    assert M.boosted(df.limit(0).coalesce(1), names, est, 200) is None
    assert M.boosted(df, names, est.copy().setMaxBins(8), 200) is None
    assert M.train_gbt(df.repartition(2), names, maxIter=2).stages[-1].getNumTrees == 2
    with pytest.raises(Exception, match="null"):
        M.train_gbt(df.withColumn("c0", F.lit(None).cast("double")), names, maxIter=2)
