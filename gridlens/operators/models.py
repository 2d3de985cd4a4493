"""Forecast models on MLlib: boosted trees, an interval forest on absolute
residuals, a sequence regressor, batch / request prediction, cross
validation and model storage.

Training is distributed MLlib, but for boosted fits of one task's rows (``boosting``, the same models);
prediction is ``model.transform`` (JVM, no Python in the hot path).  Only model-sized values (parameters, node
arrays, importances) ever reach the driver."""

from __future__ import annotations

import json
import math
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Sequence

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..plans.ordered import with_row_index
from ..session import cut_lineage, ensure_checkpoint_dir
from . import metrics as met
from .boosting import BoostedModel, Boosting, Forest, boosted
from .features import sequence_windows

VEC = "features_vec"
MODEL_TYPES = ("gbt", "gbt_early_stop", "forest")
#: Fits at a time.  Each holds its rows' binned copy in executor memory (or on disk) while it runs.
FIT_THREADS = 16
#: Rows that one task of a fit takes.  A boosted model of 200 trees is some 1,200 jobs one after the other; counting
#: as many rows costs about as much as starting the task, so smaller tasks only lengthen every job.  A boosted fit
#: of no more rows, in one partition, is one task as a whole (``boosting``).
FIT_ROWS = 20_000


def gbt_params(**over) -> dict:
    """Boosting defaults (row subsample 0.8, per-node column subsample 0.8,
    at least 3 rows per leaf, seed 42)."""
    base = dict(maxIter=P.GBT_TREES, maxDepth=P.GBT_DEPTH, stepSize=P.GBT_STEP,
                subsamplingRate=P.GBT_SUBSAMPLE, featureSubsetStrategy=str(P.GBT_COLSAMPLE),
                minInstancesPerNode=P.GBT_MIN_CHILD, seed=P.SEED)
    base.update(over)
    return base


def fit_rows(df: DataFrame, columns: Sequence[str], total: int | None = None) -> DataFrame:
    """The rows of a fit, computed and stored once (a fit and its metrics read them many times), in one partition
    per ``FIT_ROWS`` rows.  Rows that came in fewer partitions are dealt evenly, then sorted and stored again: boosting
    draws them by their place, so a partition that is computed anew must have them in the same order."""
    rows = cut_lineage(df.select(*columns))
    tasks = max(1, math.ceil((rows.count() if total is None else total) / FIT_ROWS))
    if rows.rdd.getNumPartitions() >= tasks:
        return rows.coalesce(tasks)
    return cut_lineage(rows.repartition(tasks).sortWithinPartitions(*columns))


def _pipeline(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol=VEC, handleInvalid="error"),
                            estimator])


def _fit_boosted(df: DataFrame, features: Sequence[str], est: GBTRegressor) -> PipelineModel:
    """``est`` fitted on ``df``; where its rows are one task's, in one task instead of a job a level (the same model)."""
    model = boosted(df, features, est, FIT_ROWS)
    pipeline = _pipeline(features, est)
    return pipeline.fit(df) if model is None else PipelineModel([*pipeline.getStages()[:-1], model])


def train_gbt(df: DataFrame, features: Sequence[str], target: str = "load", **over) -> PipelineModel:
    return _fit_boosted(df, features, Boosting(featuresCol=VEC, labelCol=target, predictionCol="prediction", **gbt_params(**over)))


def held_out(df: DataFrame, features: Sequence[str], share: int = 5) -> DataFrame:
    """Flag one row in ``share`` for validation by a hash of its content, however the table is partitioned."""
    return df.withColumn("is_validation", F.pmod(F.xxhash64(*features, F.lit(P.SEED)), F.lit(share)) == 0)


def best_iteration(errors: Sequence[float], patience: int) -> int:
    """Number of trees up to the least error; the search ends ``patience`` trees after
    the last improvement.  Without errors to compare (no held-out rows) all trees."""
    best = None
    for m, e in enumerate(errors, 1):
        if best is None and e == e or best is not None and e < errors[best - 1]:
            best = m
        elif best is not None and m - best >= patience:
            break
    return len(errors) if best is None else best


def _first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    old = model._java_obj
    if n == old.getNumTrees():
        return model
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(old.trees())[:n], list(old.treeWeights())[:n])):
        trees[i], weights[i] = tree, weight
    new = BoostedModel(gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(
        old.uid(), trees, weights, old.numFeatures()))
    return model._copyValues(new)


def train_gbt_early_stop(df: DataFrame, features: Sequence[str], target: str = "load",
                         valid_col: str = "is_validation", patience: int = P.GBT_PATIENCE, **over) -> PipelineModel:
    """Boosting monitored on the rows flagged ``valid_col``, which it is not fitted
    on: the model is kept up to the tree with the least validation error, looked for
    until ``patience`` trees bring no better one.  (Spark's own ``validationTol``
    stops at the first tree without enough improvement.)"""
    p = gbt_params(**over)
    p.setdefault("maxDepth", 5)
    est = Boosting(featuresCol=VEC, labelCol=target, **p)
    assembler, model = _fit_boosted(df.filter(~F.col(valid_col)), features, est).stages
    errors = model.evaluateEachIteration(assembler.transform(df.filter(F.col(valid_col))), "squared")
    return PipelineModel([assembler, _first_trees(model, best_iteration(errors, patience))])


def train_interval_model(df: DataFrame, point: PipelineModel, features: Sequence[str],
                         target: str = "load", trees: int = P.INTERVAL_TREES,
                         depth: int = P.INTERVAL_DEPTH, seed: int = P.SEED) -> PipelineModel:
    """Forest on ``|y - yhat|`` of the training rows (uncertainty model)."""
    res = point.transform(df).withColumn("_abs_res", F.abs(F.col(target) - F.col("prediction"))) \
               .drop("prediction", VEC)
    est = Forest(featuresCol=VEC, labelCol="_abs_res", predictionCol="uncertainty",
                                numTrees=trees, maxDepth=depth, seed=seed)
    return _pipeline(features, est).fit(res)


@dataclass
class TrainedModel:
    point: PipelineModel
    interval: PipelineModel | None
    features: list
    target: str
    metrics: dict = field(default_factory=dict)
    model_type: str = "gbt"


def train_model(df: DataFrame, features: Sequence[str], target: str = "load", with_interval: bool = True,
                interval_trees: int = P.INTERVAL_TREES, interval_depth: int = P.INTERVAL_DEPTH,
                **over) -> TrainedModel:
    """Point model + interval model + training metrics (one aggregate), on rows stored once."""
    rows = fit_rows(df, [*features, target])
    point = train_gbt(rows, features, target, **over)
    interval = train_interval_model(rows, point, features, target, interval_trees, interval_depth) \
        if with_interval else None
    scored = point.transform(rows).select(F.lit("train").alias("model"), F.col(target).alias("y"),
                                        F.col("prediction").alias("yhat"))
    m = met.regression_metrics(scored, ["model"]).drop("model").first().asDict()
    return TrainedModel(point, interval, list(features), target, m)


def fit_model(kind: str, df: DataFrame, features: Sequence[str], target: str = "load", **over) -> PipelineModel:
    """One of ``MODEL_TYPES``, fitted on ``df``."""
    if kind == "gbt":
        return train_gbt(df, features, target, **over)
    if kind == "gbt_early_stop":
        return train_gbt_early_stop(held_out(df, features), features, target, **over)
    if kind == "forest":
        est = Forest(featuresCol=VEC, labelCol=target, numTrees=over.get("numTrees", P.INTERVAL_TREES),
                                    maxDepth=over.get("maxDepth", P.INTERVAL_DEPTH), seed=P.SEED)
        return _pipeline(features, est).fit(df)
    raise ValueError(f"unknown model {kind}")


def train_all_models(df: DataFrame, features: Sequence[str], target: str = "load",
                     models: Sequence[str] = MODEL_TYPES, threads: int = FIT_THREADS, **over) -> dict:
    """The chosen subset of models, fitted on the same rows, which are read once and stored; concurrently."""
    for name in models:
        if name not in MODEL_TYPES:
            raise ValueError(f"unknown model {name}")
    rows = fit_rows(df, [*features, target])
    return fit_concurrently(df.sparkSession, {name: partial(fit_model, name, rows, features, target, **over) for name in models}, threads)


def predict_batch(tm: TrainedModel, df: DataFrame, return_confidence: bool = True,
                  z: float = P.Z_95) -> DataFrame:
    """``predicted_load = round(yhat, 2)``; bounds ``max(0, yhat - z*u)``
    and ``yhat + z*u`` rounded to 2 (u from the interval model)."""
    from .standardize import fill_absent_features
    base = fill_absent_features(df, tm.features)
    out = tm.point.transform(base).withColumnRenamed("prediction", "_yhat").drop(VEC)
    if return_confidence and tm.interval is not None:
        out = tm.interval.transform(out).drop(VEC)
        u = F.col("uncertainty")
        out = out.withColumns({"lower_bound": F.round(F.greatest(F.lit(0.0), F.col("_yhat") - z * u), 2),
                               "upper_bound": F.round(F.col("_yhat") + z * u, 2),
                               "confidence_interval": F.round(z * u, 2)})
        out = out.drop("uncertainty")
    return out.withColumn("predicted_load", F.round("_yhat", 2)).drop("_yhat")


def predict_requests(tm: TrainedModel, requests: DataFrame) -> DataFrame:
    """Feature rows from raw requests, then batch prediction + unit."""
    from .standardize import prediction_features
    feats = prediction_features(requests)
    return predict_batch(tm, feats).withColumn("unit", F.lit("MW"))


def predict_with_history(tm: TrainedModel, requests: DataFrame, history: DataFrame) -> DataFrame:
    """History look-ups at exact offsets (lags, changes, range means), then
    features and prediction."""
    from . import joins as jn
    from .standardize import prediction_features
    r = jn.history_lag_lookup(requests, history)
    r = jn.history_range_mean(r, history)
    r = jn.history_change(r)
    feats = prediction_features(r)
    # keep the looked-up history features over the request defaults
    for c in ("load_ma_3h", "load_ma_24h", "load_change_1h", "load_change_24h"):
        feats = feats.drop(c)
    keep = r.select("datetime", "load_ma_3h", "load_ma_24h",
                    F.coalesce("load_change_1h", F.lit(0.0)).alias("load_change_1h"),
                    F.coalesce("load_change_24h", F.lit(0.0)).alias("load_change_24h"))
    return predict_batch(tm, feats.join(keep, "datetime", "left"))


def sequence_regressor(df: DataFrame, features: Sequence[str], target: str = "load", length: int = 24,
                       time_col: str = "datetime", reg: float = 0.0):
    """Re-aim of the recurrent model: the previous ``length`` rows' features
    (standardised inside the pipeline) -> next value with a linear model.
    Returns ``(model, flat_table)``; predictions start at row ``length``."""
    from pyspark.ml.feature import StandardScaler
    seq = sequence_windows(df, features, target, length, time_col)
    flat = seq.select("row_id", time_col, "target", F.flatten("sequence").alias("_flat"))
    n = length * len(features)
    flat = flat.select("row_id", time_col, "target", *[F.col("_flat")[i].alias(f"s{i}") for i in range(n)])
    cols = [f"s{i}" for i in range(n)]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol=VEC, withMean=True, withStd=True),
                            LinearRegression(featuresCol=VEC, labelCol="target", regParam=reg)])
    return pipe.fit(flat), flat


def fit_concurrently(spark: SparkSession, fits: dict, threads: int = FIT_THREADS) -> dict:
    """Results of independent fits by name, ``threads`` at a time.

    A boosted model is hundreds of small jobs one after the other, which leave a cluster idle; fits
    that do not need one another fill it.  Each runs in a scheduler pool of its own (which
    a FAIR scheduler serves in turn) and in a thread that inherits the session's properties."""
    def run(name, fit):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        return fit()

    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(fits)))) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(run), name, fit) for name, fit in fits.items()}
        return {name: f.result() for name, f in futures.items()}


def cross_validate(df: DataFrame, features: Sequence[str], target: str = "load", n_splits: int = P.CV_SPLITS,
                   model_type: str | Sequence[str] = "gbt", time_col: str = "datetime", threads: int = FIT_THREADS,
                   **over) -> DataFrame:
    """Expanding-window CV of one model type or several: long rows
    ``(model, fold, train_size, test_size, metric, value)``.

    The rows are indexed and stored once; a fold is a range of ``row_id`` over that table
    (``ts = n // (k + 1)``; fold i tests ``[n - (k - i) ts, n - (k - i - 1) ts)`` and trains on all
    earlier rows).  All fits, ``n_splits`` a model type, run concurrently, and one aggregate
    over the scored folds gives all metrics."""
    kinds = [model_type] if isinstance(model_type, str) else list(model_type)
    for kind in kinds:
        if kind not in MODEL_TYPES:
            raise ValueError(f"unknown model type {kind}")
    spark = df.sparkSession
    rows = with_row_index(df.select(time_col, *features, target), [time_col], idx="row_id", checkpoint=True)
    n = rows.count()
    rows = fit_rows(rows, ["row_id", *features, target], n)
    size = n // (n_splits + 1)
    if not size:
        raise ValueError(f"{n} rows are too few for {n_splits} folds")
    starts = [n - (n_splits - k) * size for k in range(n_splits)]
    fits = {(kind, k): partial(fit_model, kind, rows.filter(F.col("row_id") < lo), features, target, **over)
            for k, lo in enumerate(starts) for kind in kinds}
    models = fit_concurrently(spark, fits, threads)
    scored = [models[kind, k].transform(rows.filter((F.col("row_id") >= lo) & (F.col("row_id") < lo + size))).select(
        F.lit(kind).alias("model"), F.lit(k).alias("fold"), F.lit(lo).cast("long").alias("train_size"),
        F.col(target).alias("y"), F.col("prediction").alias("yhat")) for k, lo in enumerate(starts) for kind in kinds]
    m = met.regression_metrics(reduce(DataFrame.unionByName, scored), ["model", "fold", "train_size"])
    return m.select("model", "fold", "train_size", F.col("n").alias("test_size"),
                    F.expr("stack(4, 'mae', mae, 'rmse', rmse, 'mape', mape, 'r2', r2)").alias("metric", "value"))


def model_store_path(spark: SparkSession, name: str | None = None) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "models", name or uuid.uuid4().hex)


def save_model(tm: TrainedModel, path: str) -> None:
    """Point + interval pipelines and a one-row JSON metadata table."""
    spark = SparkSession.getActiveSession()
    tm.point.write().overwrite().save(os.path.join(path, "point"))
    if tm.interval is not None:
        tm.interval.write().overwrite().save(os.path.join(path, "interval"))
    meta = {"features": tm.features, "target": tm.target, "metrics": tm.metrics, "model_type": tm.model_type,
            "has_interval": tm.interval is not None}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite") \
         .text(os.path.join(path, "meta"))


def load_model(path: str) -> TrainedModel:
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    point = PipelineModel.load(os.path.join(path, "point"))
    interval = PipelineModel.load(os.path.join(path, "interval")) if meta["has_interval"] else None
    return TrainedModel(point, interval, meta["features"], meta["target"], meta["metrics"], meta["model_type"])


def feature_importance(pm: PipelineModel, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` from the tree ensemble, sorted desc at the sink."""
    spark = SparkSession.getActiveSession()
    imp = pm.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")


def model_info(tm: TrainedModel) -> DataFrame:
    """One row of model facts + training metrics; importances separately."""
    spark = SparkSession.getActiveSession()
    last = tm.point.stages[-1]
    row = {"model_type": tm.model_type, "n_features": len(tm.features), "n_trees": int(last.getNumTrees),
           "features": ",".join(tm.features), **{f"train_{k}": (None if v is None else float(v))
                                                  for k, v in tm.metrics.items() if k != "n"},
           "n_samples": int(tm.metrics.get("n", 0))}
    return spark.createDataFrame([row])
