"""Sorting, top-k, ranking, deterministic sampling and bootstrap weights."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .insight import severity_rank

# ---- fixed values ---------------------------------------------------------
DEVIATION_SEVERITY_ORDER = ["critical", "high", "medium", "low"]
# ---------------------------------------------------------------------------


def severity_topn(df: DataFrame, n: int = 20, severity_col: str = "severity",
                  order: Sequence[str] = DEVIATION_SEVERITY_ORDER, time_col: str = "datetime") -> DataFrame:
    """Top ``n`` by custom severity order, then time (stable).  A top-k:
    ``TakeOrderedAndProject`` keeps n rows per partition, never a full sort."""
    return (df.withColumn("_sev", severity_rank(F.col(severity_col), order))
              .orderBy("_sev", time_col).limit(n).drop("_sev"))


def abs_topk(df: DataFrame, k: int, value_col: str = "shap_value", group_cols: Sequence[str] = ("row_id",),
             tie_col: str = "feature") -> DataFrame:
    """Per group: rows by |value| desc (ties by ``tie_col``), rank <= k."""
    w = Window.partitionBy(*group_cols).orderBy(F.abs(value_col).desc(), F.col(tie_col))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_rank_desc(df: DataFrame, score_col: str = "score", group_cols: Sequence[str] = ("method",),
                    tie_col: str = "feature") -> DataFrame:
    """Rank 1..n by score desc within each group; ties broken by name."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc(), F.col(tie_col))
    return df.withColumn("rank", F.row_number().over(w))


def model_ranking(metrics: DataFrame, metric: str = "mae", ascending: bool = True,
                  model_col: str = "model") -> DataFrame:
    """Rank models by one metric (one row per model: a small table)."""
    o = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(o, F.col(model_col))))


def select_best(metrics: DataFrame, metric: str = "mae", lower_is_better: bool = True,
                model_col: str = "model", keys: Sequence[str] = ()) -> DataFrame:
    """Best model per key by ``min_by`` / ``max_by`` (a partial aggregate)."""
    pick = F.min_by if lower_is_better else F.max_by
    best = pick(F.struct(F.col(model_col), F.col(metric)), F.col(metric))
    return metrics.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b")[model_col].alias("best_model"), F.col("_b")[metric].alias(metric))


def hash_order(key_cols: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed))


def sample_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chosen by a seeded hash of the key:
    the same rows under any partitioning (a top-k on the hash)."""
    return df.withColumn("_h", hash_order(key_cols, seed)).orderBy("_h", *key_cols).limit(n).drop("_h")


def _uniform(key: Column, seed: int, salt: Column | int) -> Column:
    """Deterministic U(0,1) from a hash of (key, seed, salt)."""
    h = F.xxhash64(key, F.lit(seed), salt if isinstance(salt, Column) else F.lit(salt))
    return (F.pmod(h, F.lit(2 ** 52)).cast("double") + 0.5) / float(2 ** 52)


def poisson1(key: Column, seed: int, replicate: Column) -> Column:
    """Poisson(1) draw by inversion of a hashed uniform (counts 0..7)."""
    u = _uniform(key, seed, replicate)
    cdf, p, expr = 0.0, math.exp(-1.0), None
    for k in range(8):
        cdf += p
        cond = u <= cdf
        expr = F.when(cond, k) if expr is None else expr.when(cond, k)
        p = p / (k + 1)
    return expr.otherwise(8)


def bootstrap_weights(df: DataFrame, key_col: str, replicates: int, seed: int = 42) -> DataFrame:
    """Rows x replicates with a Poisson(1) weight each (the streaming form of
    resampling n rows with replacement).  The replicate table has
    ``replicates`` rows: broadcast."""
    reps = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    j = df.crossJoin(F.broadcast(reps))
    return j.withColumn("weight", poisson1(F.col(key_col), seed, F.col("replicate")))


def feature_set_union(*dfs: DataFrame, feature_col: str = "feature") -> DataFrame:
    out = None
    for d in dfs:
        s = d.select(feature_col)
        out = s if out is None else out.union(s)
    return out.distinct()
