"""Forecast metrics, model comparison, CV summaries, ensemble weights and
predictions, rank agreement (Kendall W) — all grouped aggregates over long
tables ``(model, row_id, y, yhat)`` / ``(method, feature, score)``."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import quantile_columns

# ---- fixed values ---------------------------------------------------------
MASE_SEASON = 24
SOFTMAX_SCALE = 10.0
KENDALL_BANDS = [(0.9, "very high agreement"), (0.7, "high agreement"), (0.5, "moderate agreement"),
                 (0.3, "low agreement")]
KENDALL_OTHER = "very low agreement"
SEQUENCE_SKIP = 24
# ---------------------------------------------------------------------------


def seasonal_scale(train: DataFrame, keys: Sequence[str] = ("model",), y: str = "y",
                   row_col: str = "row_id", season: int = MASE_SEASON) -> DataFrame:
    """MASE scale per key: ``mean |y_t - y_{t-season}|`` over the training
    rows (lag 1 when a key has <= season rows).  Exact row offsets through
    an equi self-join on ``row_id + season`` — no per-series sort."""
    keys = list(keys)
    a = train.select(*keys, F.col(row_col).alias("_r"), F.col(y).alias("_y"))
    n = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = []
    for lag in (season, 1):
        b = a.select(*keys, (F.col("_r") + lag).alias("_r"), F.col("_y").alias("_yp"))
        d = a.join(b, keys + ["_r"]).groupBy(*keys).agg(F.avg(F.abs(F.col("_y") - F.col("_yp"))).alias(f"_s{lag}"))
        parts.append(d)
    j = n.join(parts[0], keys, "left").join(parts[1], keys, "left") if keys else \
        n.crossJoin(parts[0]).crossJoin(parts[1])
    return j.select(*keys, F.when(F.col("_n") > season, F.col(f"_s{season}")).otherwise(F.col("_s1")).alias("scale"))


def regression_metrics(df: DataFrame, keys: Sequence[str] = ("model",), y: str = "y", yhat: str = "yhat",
                       scale: DataFrame | None = None) -> DataFrame:
    """MAE, RMSE, MAPE (rows with y = 0 masked, null if none), R2 (null if
    ss_tot = 0), SMAPE (zero denominators masked), MASE (with ``scale``;
    null if the scale is 0).  One aggregate: ss_tot is the population
    variance of y times the count."""
    keys = list(keys)
    yt, yp = F.col(y), F.col(yhat)
    den = (F.abs(yt) + F.abs(yp)) / 2
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(yt - yp)).alias("mae"),
        F.sqrt(F.avg((yt - yp) * (yt - yp))).alias("rmse"),
        (F.avg(F.when(yt != 0, F.abs((yt - yp) / yt))) * 100).alias("mape"),
        F.sum((yt - yp) * (yt - yp)).alias("_ssr"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        (F.avg(F.when(den != 0, F.abs(yp - yt) / den)) * 100).alias("smape"))
    out = agg.select(*keys, "n", "mae", "rmse", "mape",
                     F.when(F.col("_sst") != 0, 1 - F.col("_ssr") / F.col("_sst")).alias("r2"), "smape")
    if scale is not None:
        out = out.join(scale, keys, "left") if keys else out.crossJoin(scale)
        out = out.withColumn("mase", F.when(F.col("scale") != 0, F.col("mae") / F.col("scale"))).drop("scale")
    return out


def evaluate_model(df: DataFrame, keys: Sequence[str] = ("model",), y: str = "y", yhat: str = "yhat",
                   lower: str | None = "lower_bound", upper: str | None = "upper_bound",
                   approx: bool = False) -> DataFrame:
    """Metrics + interval coverage % (inclusive, 2 dp) + mean / population
    std of actual and predicted + max / min error + count of |errors| above
    their 95th percentile."""
    keys = list(keys)
    base = regression_metrics(df, keys, y, yhat)
    err = F.col(y) - F.col(yhat)
    pct = quantile_columns(df.withColumn("_ae", F.abs(err)), "_ae", {"_p95": 0.95}, keys, approx)
    j = df.join(pct, keys, "left") if keys else df.crossJoin(F.broadcast(pct))
    extra = [F.avg(y).alias("actual_mean"), F.stddev_pop(y).alias("actual_std"),
             F.avg(yhat).alias("predicted_mean"), F.stddev_pop(yhat).alias("predicted_std"),
             F.max(err).alias("max_error"), F.min(err).alias("min_error"),
             F.count_if(F.abs(err) > F.col("_p95")).alias("n_large_errors")]
    if lower and upper and lower in df.columns and upper in df.columns:
        extra.append(F.round(F.avg(F.when(F.col(y).between(F.col(lower), F.col(upper)), 1.0).otherwise(0.0))
                             * 100, 2).alias("coverage_pct"))
    e = j.groupBy(*keys).agg(*extra)
    return base.join(e, keys, "left") if keys else base.crossJoin(e)


def compare_models(preds: DataFrame, keys: Sequence[str] = ("model",), sequence_models: Sequence[str] = (),
                   row_col: str = "row_id", skip: int = SEQUENCE_SKIP, scale: DataFrame | None = None) -> DataFrame:
    """Per-model metrics on the test rows; sequence models have no
    prediction for their first ``skip`` targets, so those rows are skipped
    for them only."""
    seq = F.col(keys[0]).isin(*sequence_models) if sequence_models else F.lit(False)
    start = preds.agg(F.min(row_col).alias("_r0"))
    p = preds.crossJoin(F.broadcast(start)).filter(~seq | (F.col(row_col) >= F.col("_r0") + skip)).drop("_r0")
    return regression_metrics(p, keys, scale=scale)


def comparison_table(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Models ranked by MAE asc and R2 desc (one row per model)."""
    return metrics.withColumns({
        "rank_mae": F.row_number().over(Window.orderBy(F.col("mae").asc_nulls_last(), F.col(model_col))),
        "rank_r2": F.row_number().over(Window.orderBy(F.col("r2").desc_nulls_last(), F.col(model_col))),
    })


def cv_average(cv: DataFrame, keys: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Mean and population std of each metric over folds."""
    return cv.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                 F.count(F.lit(1)).alias("n_folds"))


def cv_compare(avg: DataFrame, metric: str = "mae") -> DataFrame:
    """Best model by the lowest mean of ``metric``."""
    m = avg.filter(F.lower(F.col("metric")) == metric)
    return m.agg(F.min_by(F.struct("model", "mean", "std"), F.col("mean")).alias("_b")).select(
        F.col("_b.model").alias("best_model"), F.col("_b.mean").alias("mean"), F.col("_b.std").alias("std"))


def ensemble_weights_manual(weights: DataFrame, weight_col: str = "weight") -> DataFrame:
    """Normalise to sum 1; equal weights if the total is <= 0."""
    tot = weights.agg(F.sum(weight_col).alias("_t"), F.count(F.lit(1)).alias("_k"))
    j = weights.crossJoin(F.broadcast(tot))
    return j.withColumn(weight_col, F.when(F.col("_t") > 0, F.col(weight_col) / F.col("_t"))
                        .otherwise(1.0 / F.col("_k"))).drop("_t", "_k")


def validation_errors(preds: DataFrame, metric: str = "mae", model_col: str = "model",
                      y: str = "y", yhat: str = "yhat") -> DataFrame:
    yt, yp = F.col(y), F.col(yhat)
    if metric == "rmse":
        e = F.sqrt(F.avg((yt - yp) * (yt - yp)))
    elif metric == "mape":
        e = F.avg(F.when(yt != 0, F.abs((yt - yp) / yt)))
    else:
        e = F.avg(F.abs(yt - yp))
    return preds.groupBy(model_col).agg(e.alias("error"))


def ensemble_weights_auto(preds: DataFrame, metric: str = "mae", model_col: str = "model",
                          row_col: str = "row_id", skip: int = SEQUENCE_SKIP) -> DataFrame:
    """``softmax(-10 * error)`` over models (rows before ``skip`` ignored).
    Computed as ``exp(-10 (e - min e))`` / sum — identical where the naive
    form is finite, and no underflow to 0/0 at large errors."""
    start = preds.agg(F.min(row_col).alias("_r0"))
    p = preds.crossJoin(F.broadcast(start)).filter(F.col(row_col) >= F.col("_r0") + skip)
    err = validation_errors(p, metric, model_col)
    mn = err.agg(F.min("error").alias("_m"))
    e = err.crossJoin(F.broadcast(mn)).withColumn("_x", F.exp(-SOFTMAX_SCALE * (F.col("error") - F.col("_m"))))
    tot = e.agg(F.sum("_x").alias("_s"))
    return e.crossJoin(F.broadcast(tot)).select(model_col, "error", (F.col("_x") / F.col("_s")).alias("weight"))


def ensemble_predict(preds: DataFrame, weights: DataFrame, model_col: str = "model",
                     row_col: str = "row_id") -> DataFrame:
    """Weighted sum of model predictions per row; models without a weight
    count 0.  The weight table has one row per model: broadcast."""
    j = preds.join(F.broadcast(weights.select(model_col, "weight")), model_col, "left")
    keep = [c for c in ("y",) if c in preds.columns]
    return j.groupBy(row_col).agg(*[F.first(c).alias(c) for c in keep],
                                  F.sum(F.coalesce(F.col("weight"), F.lit(0.0)) * F.col("yhat")).alias("ensemble"),
                                  F.map_from_entries(F.collect_list(F.struct(model_col, "yhat"))).alias("individual"))


def ensemble_interval(preds: DataFrame, weights: DataFrame, replicates: int = 100, draws: int | None = None,
                      seed: int = 42, model_col: str = "model", row_col: str = "row_id") -> DataFrame:
    """Bootstrap interval: replicate b draws k models with replacement by
    weight and averages their predictions; 2.5 / 97.5 percentiles per row.

    The draw table (replicates x models, counts) is built from the weights
    with seeded hashes and is small (broadcast); each row's replicate means
    come from one join + aggregation."""
    spark = preds.sparkSession
    w = weights.select(model_col, "weight")
    k = draws or None
    cum = w.withColumn("_hi", F.sum("weight").over(Window.orderBy(model_col).rowsBetween(
        Window.unboundedPreceding, 0))).withColumn("_lo", F.col("_hi") - F.col("weight"))
    nmod = w.agg(F.count(F.lit(1)).alias("_k"))
    reps = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    slots = reps.crossJoin(nmod).select("replicate", F.explode(F.sequence(F.lit(1), F.lit(k) if k else F.col("_k")))
                                        .alias("slot"))
    u = (F.pmod(F.xxhash64(F.col("replicate"), F.col("slot"), F.lit(seed)), F.lit(2 ** 52)).cast("double") + 0.5) \
        / float(2 ** 52)
    slots = slots.withColumn("_u", u)
    picks = slots.join(F.broadcast(cum), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    counts = picks.groupBy("replicate", model_col).agg(F.count(F.lit(1)).alias("_c"))
    j = preds.join(F.broadcast(counts), model_col)
    rep = j.groupBy(row_col, "replicate").agg((F.sum(F.col("_c") * F.col("yhat")) / F.sum("_c")).alias("_m"))
    return rep.groupBy(row_col).agg(F.percentile("_m", 0.025).alias("lower"),
                                    F.percentile("_m", 0.975).alias("upper"))


def kendall_w(ranks: DataFrame, method_col: str = "method", feature_col: str = "feature",
              rank_col: str = "rank") -> DataFrame:
    """Rank agreement of k methods over n features.

    ``kendall_w`` is the standard ``12 S / (k^2 (n^3 - n))`` with ``S`` over
    rank sums; ``kendall_w_ref`` is the same formula on rank *means*
    (= W / k^2), as the modelled application computes it.  Ranks must be
    complete (see ``importance_union``)."""
    per = ranks.groupBy(feature_col).agg(F.sum(rank_col).alias("_rs"), F.avg(rank_col).alias("_rm"))
    dims = ranks.agg(F.countDistinct(method_col).alias("k"), F.countDistinct(feature_col).alias("n"))
    j = per.crossJoin(F.broadcast(dims))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    agg = j.groupBy("k", "n").agg(
        F.sum(F.pow(F.col("_rs") - k * (n + 1) / 2, 2)).alias("_s"),
        F.sum(F.pow(F.col("_rm") - (n + 1) / 2, 2)).alias("_sm"))
    den = k * k * (F.pow(n, 3) - n)
    out = agg.select("k", "n", (12 * F.col("_s") / den).alias("kendall_w"),
                     (12 * F.col("_sm") / den).alias("kendall_w_ref"))
    label = None
    for edge, name in KENDALL_BANDS:
        cond = F.col("kendall_w") >= edge
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return out.withColumn("interpretation", label.otherwise(KENDALL_OTHER))


def consensus_rank(ranks: DataFrame, feature_col: str = "feature", rank_col: str = "rank") -> DataFrame:
    """Features ordered by rank sum (ties by name) -> consensus position."""
    s = ranks.groupBy(feature_col).agg(F.sum(rank_col).alias("rank_sum"))
    # one row per feature: bounded by the feature count
    return s.withColumn("consensus_rank", F.row_number().over(Window.orderBy("rank_sum", feature_col)))


def xai_rank_compare(ranks: DataFrame, methods: Sequence[str] = ("SHAP", "LIME", "Gain", "Permutation"),
                     method_col: str = "method", feature_col: str = "feature") -> DataFrame:
    """Wide table: rank and score per method, one row per feature, ordered by
    the SHAP rank at the sink.  The pivot values are fixed (no extra pass)."""
    return ranks.groupBy(feature_col).pivot(method_col, list(methods)).agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"))
