"""Model explanations: exact path-dependent TreeSHAP (values, interaction
values, expected value), global SHAP summaries, Friedman H, LIME local
surrogates, partial dependence (1-D, 2-D, bootstrap CI) and ICE curves.

TreeSHAP runs in ``mapInPandas``: the fitted trees are read once from the
saved model (a model-sized table) and turned into per-leaf tables of the
Shapley values of every pattern of met splits (``leaf_tables``), which are
broadcast; a row costs one pattern and a few look-ups a leaf.  PDP / ICE / LIME predictions are one
``crossJoin`` with a bounded grid + one ``model.transform`` (JVM)."""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..session import ensure_checkpoint_dir
from . import leaf_tables as leaf
from . import ranking as rk

# ---------------------------------------------------------------- tree tables


@dataclass
class Tree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: float


def tree_tables(pm: PipelineModel, spark: SparkSession | None = None) -> list[Tree]:
    """Node arrays of the ensemble (last stage of ``pm``), read from the
    saved model in the shared checkpoint folder.  Size = model size."""
    spark = spark or SparkSession.getActiveSession()
    est = pm.stages[-1]
    path = os.path.join(ensure_checkpoint_dir(spark), "models", "shap-" + uuid.uuid4().hex)
    est.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold")).toPandas()
    weights = list(est.treeWeights)
    scale = 1.0
    if type(est).__name__.startswith("RandomForest"):
        scale = 1.0 / len(weights)   # a forest averages its trees
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        arr = lambda col, fill, dt: np.full(n, fill, dtype=dt)
        left, right = arr(0, -1, np.int64), arr(0, -1, np.int64)
        feat, thr = arr(0, -1, np.int64), arr(0, 0.0, np.float64)
        val, cov = arr(0, 0.0, np.float64), arr(0, 0.0, np.float64)
        ids = g["id"].to_numpy()
        left[ids], right[ids] = g["leftChild"].to_numpy(), g["rightChild"].to_numpy()
        feat[ids] = g["featureIndex"].fillna(-1).to_numpy().astype(np.int64)
        thr[ids] = g["threshold"].fillna(0.0).to_numpy()
        val[ids], cov[ids] = g["prediction"].to_numpy(), g["rawCount"].to_numpy().astype(np.float64)
        trees.append(Tree(left, right, feat, thr, val, cov, float(weights[int(tid)]) * scale))
    return trees


def expected_value(trees: list[Tree]) -> float:
    """Cover-weighted mean leaf value per tree, times the tree weight."""
    total = 0.0
    for t in trees:
        leaves = t.left < 0
        total += t.weight * float(np.sum(t.value[leaves] * t.cover[leaves]) / t.cover[0])
    return total


# ----------------------------------------------------------- Shapley columns

#: Bytes of leaf tables up to which they are made once on the driver and broadcast; larger
#: models make each tree's tables where they are used, a batch at a time.
TABLE_BYTES = 64 << 20


@dataclass
class LeafModel:
    """An ensemble ready to give the asked Shapley columns: made tables, or only the leaves' paths."""

    paths: list
    columns: dict
    made: list | None

    def values(self, X: np.ndarray) -> np.ndarray:
        """(rows, columns) for the rows ``X``; a row without a split on a column's features has 0."""
        out = np.zeros((len(X), len(self.columns)))
        for i, p in enumerate(self.paths):
            if p.width > leaf.MAX_FEATURES:
                leaf.add_wide_values(out, X, p, self.columns)
            else:
                leaf.add_values(out, X, self.made[i] if self.made else leaf.tables(p, self.columns))
        return out


def leaf_model(trees: list[Tree], columns: Sequence[tuple[int, ...]]) -> LeafModel:
    """Tabulate the trees' leaves for the asked columns: (i,) is the value of feature i, (i, i) its
    main effect, (i, j) with i < j an interaction (see ``leaf_tables``)."""
    wanted = {c: k for k, c in enumerate(columns)}
    paths = [leaf.paths(t) for t in trees]
    pairs = any(len(c) == 2 for c in wanted)
    entries = sum(len(p.value) * p.width * (p.width + 1 if pairs else 2) // 2 * (8 << p.width) for p in paths)     # at most
    made = [leaf.tables(p, wanted) for p in paths] if entries <= TABLE_BYTES else None
    return LeafModel(paths, wanted, made)


def tree_shap(X: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """SHAP values ``(n_rows, n_features)`` of the ensemble for rows ``X``."""
    return leaf_model(trees, [(i,) for i in range(X.shape[1])]).values(X)


def interaction_columns(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted({(min(a, b), max(a, b)) for a, b in pairs})


def shap_interaction_matrix(X: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Interaction values ``(n, m, m)``: symmetric, and each row sums to the feature's SHAP value."""
    m = X.shape[1]
    columns = interaction_columns([(i, j) for i in range(m) for j in range(m)])
    v = leaf_model(trees, columns).values(X)
    out = np.zeros((len(X), m, m))
    for k, (i, j) in enumerate(columns):
        out[:, i, j] = out[:, j, i] = v[:, k]
    return out


# ------------------------------------------------------- Spark-level wrappers

_SHAP_SCHEMA = "row_id long, feature string, shap_value double, feature_value double"


def tree_shap_table(pm: PipelineModel, df: DataFrame, features: Sequence[str], row_col: str = "row_id",
                    trees: list[Tree] | None = None) -> DataFrame:
    """Long SHAP table ``(row_id, feature, shap_value, feature_value,
    direction, abs_contribution, rank)``; rank by |value| desc per row.

    Batches of rows are explained inside ``mapInPandas`` with the leaf
    tables shipped in a broadcast variable (model-sized)."""
    spark = df.sparkSession
    feats = list(features)
    bc = spark.sparkContext.broadcast(leaf_model(trees or tree_tables(pm, spark), [(i,) for i in range(len(feats))]))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = bc.value
        for b in batches:
            if b.empty:
                continue
            X = b[feats].to_numpy(dtype=np.float64)
            phi = model.values(X)
            n, m = phi.shape
            yield pd.DataFrame({"row_id": np.repeat(b[row_col].to_numpy(), m),
                                "feature": np.tile(np.array(feats, dtype=object), n),
                                "shap_value": phi.reshape(-1), "feature_value": X.reshape(-1)})

    long = df.select(F.col(row_col).cast("long").alias(row_col),
                     *[F.col(c).cast("double") for c in feats]).mapInPandas(explain, _SHAP_SCHEMA)
    if row_col != "row_id":
        long = long.withColumnRenamed("row_id", row_col)
    w = Window.partitionBy(row_col).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    return long.withColumns({"direction": F.when(F.col("shap_value") > 0, "positive").otherwise("negative"),
                             "abs_contribution": F.abs("shap_value")}).withColumn("rank", F.row_number().over(w))


def shap_expected_value(pm: PipelineModel, spark: SparkSession | None = None) -> DataFrame:
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame([(float(expected_value(tree_tables(pm, spark))),)], "expected_value double")


def shap_global(shap_long: DataFrame) -> DataFrame:
    """Per feature: mean |phi|, population std of phi, share positive, mean
    feature value; ordered by mean |phi| (rank)."""
    g = shap_long.groupBy("feature").agg(
        F.avg(F.abs("shap_value")).alias("mean_abs_shap"), F.stddev_pop("shap_value").alias("std_shap"),
        F.avg(F.when(F.col("shap_value") > 0, 1.0).otherwise(0.0)).alias("positive_ratio"),
        F.avg("feature_value").alias("feature_value_mean"))
    # one row per feature: the ranking window runs on a feature-sized table
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_abs_shap").desc(), "feature")))


_INTER_SCHEMA = "row_id long, feature1 string, feature2 string, interaction double"


def shap_interaction_table(pm: PipelineModel, df: DataFrame, features: Sequence[str],
                           pairs: Sequence[tuple[str, str]] | None = None, row_col: str = "row_id",
                           trees: list[Tree] | None = None) -> DataFrame:
    """Per row interaction values for the requested feature pairs (all
    ordered pairs incl. the diagonal when ``pairs`` is None).  Only the asked
    pairs are tabulated and looked up."""
    spark = df.sparkSession
    feats = list(features)
    idx = {f: i for i, f in enumerate(feats)}
    want = [(idx[a], idx[b]) for a, b in pairs] if pairs else [(i, j) for i in range(len(feats))
                                                               for j in range(len(feats))]
    columns = interaction_columns(want)
    at = {c: k for k, c in enumerate(columns)}
    bc = spark.sparkContext.broadcast(leaf_model(trees or tree_tables(pm, spark), columns))

    def explain(batches):
        model = bc.value
        for b in batches:
            if b.empty:
                continue
            v = model.values(b[feats].to_numpy(dtype=np.float64))
            rows = b[row_col].to_numpy()
            parts = [pd.DataFrame({"row_id": rows, "feature1": feats[i], "feature2": feats[j],
                                   "interaction": v[:, at[min(i, j), max(i, j)]]}) for i, j in want]
            yield pd.concat(parts, ignore_index=True)

    return df.select(F.col(row_col).cast("long").alias("row_id"), *[F.col(c).cast("double") for c in feats]) \
             .mapInPandas(explain, _INTER_SCHEMA)


def friedman_h(inter: DataFrame) -> DataFrame:
    """``H = mean|v12 v21| / mean(v11^2 + v22^2 + |v12 v21|)`` per feature
    pair (0 when the denominator is 0), from a per-row interaction table."""
    a = inter.filter(F.col("feature1") < F.col("feature2")).select(
        "row_id", "feature1", "feature2", F.col("interaction").alias("v12"))
    b = inter.select("row_id", F.col("feature1").alias("feature2"), F.col("feature2").alias("feature1"),
                     F.col("interaction").alias("v21"))
    d = inter.filter(F.col("feature1") == F.col("feature2")).select("row_id", "feature1",
                                                                     F.col("interaction").alias("vd"))
    j = (a.join(b, ["row_id", "feature1", "feature2"])
          .join(d.withColumnRenamed("vd", "v11"), ["row_id", "feature1"])
          .join(d.select("row_id", F.col("feature1").alias("feature2"), F.col("vd").alias("v22")),
                ["row_id", "feature2"]))
    g = j.groupBy("feature1", "feature2").agg(
        F.avg(F.abs(F.col("v12") * F.col("v21"))).alias("_num"),
        F.avg(F.col("v11") ** 2 + F.col("v22") ** 2 + F.abs(F.col("v12") * F.col("v21"))).alias("_den"))
    return g.select("feature1", "feature2",
                    F.when(F.col("_den") == 0, F.lit(0.0)).otherwise(F.col("_num") / F.col("_den")).alias("h"))


def all_interactions(pm: PipelineModel, df: DataFrame, features: Sequence[str], shap_long: DataFrame,
                     top_n: int = 5, row_col: str = "row_id") -> DataFrame:
    """H statistic for every pair of the ``top_n`` most important features
    (by mean |phi|), strongest first.  One interaction table, grouped by pair."""
    spark = df.sparkSession
    top = [r["feature"] for r in shap_global(shap_long).filter(F.col("rank") <= top_n)
           .select("feature").collect()]   # at most top_n names (a parameter)
    pairs = [(a, b) for a in top for b in top]
    inter = shap_interaction_table(pm, df, features, pairs, row_col)
    h = friedman_h(inter)
    return h.withColumn("rank", F.row_number().over(Window.orderBy(F.col("h").desc(), "feature1", "feature2")))


# ------------------------------------------------------------------ PDP / ICE

def feature_grid(df: DataFrame, feature: str, n: int = P.PDP_GRID, name: str = "grid_value") -> DataFrame:
    """``n`` evenly spaced values from min to max of ``feature``."""
    rng = df.agg(F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    g = rng.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("grid_index"), "_lo", "_hi")
    return g.select("grid_index", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("grid_index")
                                   / F.lit(max(n - 1, 1))).cast("double").alias(name))


def _spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores: a table of few partitions makes up to 900 times its rows to predict."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _predict_on_grid(pm: PipelineModel, rows: DataFrame, feature: str, grid: DataFrame,
                     value: str = "grid_value") -> DataFrame:
    """rows x grid (grid size is a parameter: broadcast) with ``feature``
    set to each grid value, one ``transform``."""
    j = _spread(rows).crossJoin(F.broadcast(grid)).withColumn(feature, F.col(value))
    return pm.transform(j).drop("features_vec")


def pdp_1d(pm: PipelineModel, df: DataFrame, feature: str, n_grid: int = P.PDP_GRID) -> DataFrame:
    """Mean prediction with ``feature`` set to each grid value, plus the
    feature's population std over the data."""
    grid = feature_grid(df, feature, n_grid)
    p = _predict_on_grid(pm, df, feature, grid)
    sd = df.agg(F.stddev_pop(feature).alias("feature_std"))
    return p.groupBy("grid_index", "grid_value").agg(F.avg("prediction").alias("avg_prediction")) \
            .crossJoin(sd).withColumn("feature", F.lit(feature))


def pdp_2d(pm: PipelineModel, df: DataFrame, f1: str, f2: str, n_grid: int = P.PDP_GRID_2D,
           sample: int | None = None, key_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """Mean prediction over all rows on an ``n x n`` grid of two features
    (optionally a deterministic key-hash sample of rows)."""
    rows = rk.sample_n(df, sample, key_cols) if sample else df
    g1 = feature_grid(df, f1, n_grid, "v1").withColumnRenamed("grid_index", "i1")
    g2 = feature_grid(df, f2, n_grid, "v2").withColumnRenamed("grid_index", "i2")
    grid = g1.crossJoin(g2)
    j = _spread(rows).crossJoin(F.broadcast(grid)).withColumn(f1, F.col("v1")).withColumn(f2, F.col("v2"))
    p = pm.transform(j)
    return p.groupBy("i1", "i2", "v1", "v2").agg(F.avg("prediction").alias("avg_prediction"))


def pdp_ci(pm: PipelineModel, df: DataFrame, feature: str, key_col: str = "row_id", n_grid: int = P.PDP_GRID,
           replicates: int = 10, seed: int = P.SEED) -> DataFrame:
    """Bootstrap band of the partial dependence: predictions once per
    (row, grid value); each replicate is a Poisson(1)-weighted mean;
    2.5 / 97.5 percentiles and std over replicates."""
    grid = feature_grid(df, feature, n_grid)
    p = _predict_on_grid(pm, df, feature, grid).select(key_col, "grid_index", "grid_value", "prediction")
    reps = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    w = p.crossJoin(F.broadcast(reps)).withColumn("_w", rk.poisson1(F.col(key_col), seed, F.col("replicate")))
    per = w.groupBy("grid_index", "grid_value", "replicate").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("prediction")), F.sum("_w")).alias("_m"))
    mean = p.groupBy("grid_index").agg(F.avg("prediction").alias("avg_prediction"))
    band = per.groupBy("grid_index", "grid_value").agg(
        F.percentile("_m", 0.025).alias("lower"), F.percentile("_m", 0.975).alias("upper"),
        F.stddev_samp("_m").alias("std"))
    return band.join(mean, "grid_index")


def ice(pm: PipelineModel, df: DataFrame, feature: str, key_col: str = "row_id", n_grid: int = P.ICE_GRID,
        sample: int | None = None, seed: int = P.SEED) -> DataFrame:
    """Individual curves: each row's prediction at every grid value (``sample``: of that many rows only)."""
    rows = rk.sample_n(df, sample, [key_col], seed) if sample else df
    grid = feature_grid(df, feature, n_grid)
    return _predict_on_grid(pm, rows, feature, grid).select(key_col, "grid_index", "grid_value", "prediction")


def ice_summary(curves: DataFrame) -> DataFrame:
    """Mean and population std over curves per grid value (mean = PDP of
    the sampled rows)."""
    return curves.groupBy("grid_index", "grid_value").agg(F.avg("prediction").alias("mean"),
                                                          F.stddev_pop("prediction").alias("std"))


def ice_centered(curves: DataFrame, key_col: str = "row_id") -> DataFrame:
    """Each curve minus its value at the first grid point."""
    w = Window.partitionBy(key_col).orderBy("grid_index")
    return curves.withColumn("centered", F.col("prediction") - F.first("prediction").over(w))


def ice_decile(pm: PipelineModel, df: DataFrame, feature: str, key_col: str = "row_id",
               n_grid: int = P.ICE_GRID, n_bins: int = 10) -> DataFrame:
    """Rows bucketed by their own prediction into quantile bins (edges at
    0, 1/n, ..., 1; duplicate edges dropped; first bin closed on the left),
    then the mean curve per bin."""
    from ..plans.quantiles import quantiles
    base = pm.transform(df).select(key_col, F.col("prediction").alias("_own"))
    q = quantiles(base, "_own", [i / n_bins for i in range(n_bins + 1)])
    # n_bins + 1 edges: a bounded array
    uniq = q.agg(F.array_distinct(F.array_sort(F.collect_list("quantile"))).alias("_e"))
    b = base.crossJoin(F.broadcast(uniq)).withColumn(
        "bin", F.size(F.filter(F.slice("_e", 2, n_bins + 1),
                               lambda e: e < F.col("_own"))) - F.when(F.col("_own") > F.element_at("_e", -1), 1)
        .otherwise(0))
    b = b.withColumn("bin", F.least(F.col("bin"), F.size("_e") - 2))
    curves = ice(pm, df, feature, key_col, n_grid, sample=None)
    return curves.join(b.select(key_col, "bin"), key_col).groupBy("bin", "grid_index", "grid_value").agg(
        F.avg("prediction").alias("mean_prediction"), F.count(F.lit(1)).alias("n_rows"))


# ----------------------------------------------------------------------- LIME

def _normal(key, seed, sample, j):
    u1 = (F.pmod(F.xxhash64(key, F.lit(seed), sample, F.lit(2 * j)), F.lit(2 ** 52)).cast("double") + 0.5) / 2 ** 52
    u2 = (F.pmod(F.xxhash64(key, F.lit(seed), sample, F.lit(2 * j + 1)), F.lit(2 ** 52)).cast("double") + 0.5) \
        / 2 ** 52
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def lime_explain(pm: PipelineModel, df: DataFrame, features: Sequence[str], rows: DataFrame,
                 key_col: str = "row_id", n_samples: int = P.LIME_SAMPLES, top: int = P.LIME_FEATURES,
                 seed: int = P.SEED, ridge: float = 1.0) -> DataFrame:
    """Local linear surrogate per explained row.

    Perturbations ``x + N(0,1) * std_f`` from seeded hashes (the same under
    any partitioning), predictions with one ``transform``, kernel weights
    ``exp(-d^2 / w^2)`` with ``d`` the distance in standard units and
    ``w = 0.75 sqrt(m)``; a weighted ridge fit per row in ``applyInPandas``
    (n_samples rows per group, a parameter).  Returns ``(row_id, feature,
    weight, rank)`` for the ``top`` largest |weights| plus the intercept and
    the local prediction."""
    feats = list(features)
    m = len(feats)
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in feats])
    sd = sd.select(*[F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(1.0)).alias("_sd_" + c) for c in feats])
    samp = df.sparkSession.range(n_samples).select(F.col("id").cast("int").alias("_s"))
    base = rows.select(key_col, *feats).crossJoin(F.broadcast(sd)).crossJoin(F.broadcast(samp))
    z = {c: F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(_normal(F.col(key_col), seed, F.col("_s"), j))
         for j, c in enumerate(feats)}
    pert = base.select(key_col, "_s", *[(F.col(c) + z[c] * F.col("_sd_" + c)).alias(c) for c in feats],
                       *[z[c].alias("_z_" + c) for c in feats])
    width = 0.75 * math.sqrt(m)
    d2 = sum((F.col("_z_" + c) ** 2 for c in feats), F.lit(0.0))
    scored = pm.transform(pert).select(key_col, "_s", "prediction", *["_z_" + c for c in feats],
                                       F.exp(-d2 / (width ** 2)).alias("_kw"))
    out_schema = T.StructType([T.StructField(key_col, T.LongType()), T.StructField("feature", T.StringType()),
                               T.StructField("weight", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
                               T.StructField("local_prediction", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        Z = pdf[["_z_" + c for c in feats]].to_numpy(dtype=np.float64)
        y = pdf["prediction"].to_numpy(dtype=np.float64)
        w = pdf["_kw"].to_numpy(dtype=np.float64)
        A = np.hstack([np.ones((Z.shape[0], 1)), Z])
        W = A * w[:, None]
        reg = ridge * np.eye(m + 1)
        reg[0, 0] = 0.0
        coef = np.linalg.solve(A.T @ W + reg, W.T @ y)
        own = pdf["_s"].to_numpy() == 0
        local = float(coef[0]) if own.any() else float("nan")
        return pd.DataFrame({key_col: int(pdf[key_col].iloc[0]), "feature": feats, "weight": coef[1:],
                             "intercept": float(coef[0]), "local_prediction": local})

    res = scored.groupBy(key_col).applyInPandas(fit, out_schema)
    w = Window.partitionBy(key_col).orderBy(F.abs("weight").desc(), F.col("feature"))
    return res.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def permutation_importance(pm: PipelineModel, df: DataFrame, features: Sequence[str], target: str = "load",
                           key_col: str = "row_id", seed: int = P.SEED) -> DataFrame:
    """Increase of MAE when one feature's values are permuted across rows.

    One seeded permutation (position ``i`` in key order paired with position
    ``i`` in hash order, both from the distributed row index) gives every
    row a partner; each feature's variant takes that feature from the
    partner.  All variants are scored in one ``transform`` + one grouped
    aggregate."""
    from ..plans import ordered as o
    feats = list(features)
    pos = o.with_row_index(df.select(key_col), [key_col]).withColumnRenamed(o.IDX, "_pos")
    src = df.select(F.col(key_col).alias("_pk"), F.xxhash64(F.col(key_col), F.lit(seed)).alias("_h"))
    perm = o.with_row_index(src, ["_h", "_pk"]).select("_pk", F.col(o.IDX).alias("_pos"))
    partner = pos.join(perm, "_pos").select(key_col, "_pk")
    pvals = df.select(F.col(key_col).alias("_pk"), *[F.col(f).alias("_p_" + f) for f in feats])
    rows = df.join(partner, key_col).join(pvals, "_pk")
    base = pm.transform(df).agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("_mae0"))
    variants = None
    for f in feats:
        v = rows.withColumn(f, F.col("_p_" + f)).withColumn("feature", F.lit(f))
        variants = v if variants is None else variants.unionByName(v)
    scored = pm.transform(variants.drop(*["_p_" + f for f in feats], "_pk"))
    mae = scored.groupBy("feature").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("_mae"))
    return mae.crossJoin(F.broadcast(base)).select("feature", (F.col("_mae") - F.col("_mae0")).alias("score"))
