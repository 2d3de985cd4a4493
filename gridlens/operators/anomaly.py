"""Deviation scan, rule-based root causes, feature context text and the
anomaly report table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import ANOMALY_MAX_RESULTS, ANOMALY_THRESHOLD_PCT
from .insight import severity_rank
from .text import display_name_expr

# ---- fixed values ---------------------------------------------------------
SEVERITY_ORDER = ["critical", "high", "medium", "low"]
CRITICAL_PCT, HIGH_PCT = 50.0, 30.0
ROOT_HOT_T, ROOT_COLD_T, ROOT_DEFAULT_T = 38.0, 2.0, 20.0
JUMP_FACTOR = 1.5
ROOT_TEXT = {
    "hot": "extreme heat drove cooling load above the forecast",
    "cold": "extreme cold drove heating load above the forecast",
    "holiday": "holiday activity departs from the model's assumptions",
    "offday": "non-workday load pattern is unusual",
    "jump": "a sudden load change was not reflected in the forecast",
    "shap": "mainly driven by %s",
    "none": "root cause undetermined",
}
CONTEXT_FEATURES = [("temperature", "Temperature", " C"), ("humidity", "Humidity", " %"),
                    ("hour", "Hour", ""), ("day_of_week", "Day of week", ""), ("is_workday", "Workday", ""),
                    ("is_holiday", "Holiday", ""), ("season", "Season", "")]
CONTEXT_LAGS = [("load_lag_1h", "Load 1 h earlier"), ("load_lag_24h", "Load 24 h earlier"),
                ("load_lag_168h", "Load same hour last week")]
REPORT_PER_SEVERITY = 5
# ---------------------------------------------------------------------------

EXCLUDE = {"actual_load", "predicted_load", "load", "datetime"}


def deviation_scan(df: DataFrame, threshold_pct: float | None = None, top: int | None = ANOMALY_MAX_RESULTS,
                   actual: str = "actual_load", predicted: str = "predicted_load",
                   time_col: str = "datetime") -> DataFrame:
    """Rows with ``|a - p| / p * 100 > threshold`` (p = 0 or nulls skipped);
    severity > 50 critical, > 30 high, else medium; non-null other columns
    kept as a ``features`` map.  With ``top``: the first ``top`` by severity
    then time (a bounded top-k)."""
    thr = threshold_pct or ANOMALY_THRESHOLD_PCT
    a, p = F.col(actual), F.col(predicted)
    pct = F.abs(a - p) / p * 100
    sev = F.when(pct > CRITICAL_PCT, "critical").when(pct > HIGH_PCT, "high").otherwise("medium")
    feats = [c for c in df.columns if c not in EXCLUDE | {time_col}]
    fmap = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in feats]),
        lambda e: e["v"].isNotNull())) if feats else F.create_map()
    out = df.filter(a.isNotNull() & p.isNotNull() & (p != 0) & (pct > thr)).select(
        F.col(time_col).alias("datetime"), a.alias("actual_load"), p.alias("predicted_load"),
        pct.alias("deviation_pct"), sev.alias("severity"), *[F.col(c) for c in feats],
        fmap.alias("features"))
    if top:
        out = (out.withColumn("_sev", severity_rank(F.col("severity"), SEVERITY_ORDER))
                  .orderBy("_sev", "datetime").limit(top).drop("_sev"))
    return out


def root_cause_rules(anoms: DataFrame, top_shap: DataFrame | None = None,
                     time_col: str = "datetime") -> DataFrame:
    """Rule-based root cause text per deviation row; with ``top_shap``
    (``datetime, feature`` of the largest contribution) a driver clause is
    added (equi join on time)."""
    cols = set(anoms.columns)
    t = F.coalesce(F.col("temperature"), F.lit(ROOT_DEFAULT_T)) if "temperature" in cols else F.lit(ROOT_DEFAULT_T)
    hol = F.coalesce(F.col("is_holiday"), F.lit(False)) if "is_holiday" in cols else F.lit(False)
    wd = F.coalesce(F.col("is_workday"), F.lit(0)) if "is_workday" in cols else F.lit(0)
    a, p = F.col("actual_load"), F.col("predicted_load")
    parts = [F.when(t > ROOT_HOT_T, ROOT_TEXT["hot"]).when(t < ROOT_COLD_T, ROOT_TEXT["cold"]),
             F.when(hol, ROOT_TEXT["holiday"]).when((wd == 0) & (a > p), ROOT_TEXT["offday"])]
    if "load_lag_1h" in cols:
        lag = F.col("load_lag_1h")
        parts.append(F.when(lag.isNotNull() & (lag != 0) &
                            (F.abs(a - lag) > F.abs(p - lag) * JUMP_FACTOR), ROOT_TEXT["jump"]))
    df = anoms
    if top_shap is not None:
        df = df.join(top_shap.select(F.col(time_col).alias("datetime"), F.col("feature").alias("_top_feature")),
                     "datetime", "left")
        parts.append(F.when(F.col("_top_feature").isNotNull(),
                            F.format_string(ROOT_TEXT["shap"], display_name_expr(F.col("_top_feature")))))
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    text = F.when(F.size(arr) == 0, F.lit(ROOT_TEXT["none"])).otherwise(F.array_join(arr, "; "))
    out = df.withColumn("root_cause", text)
    return out.drop("_top_feature") if top_shap is not None else out


def feature_context_text(df: DataFrame) -> Column:
    """Newline-joined ``- name: value unit`` lines for the key features and
    load lags present (lags with 1 decimal)."""
    cols = set(df.columns)
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {name}: "), F.col(c).cast("string"), F.lit(unit)))
             for c, name, unit in CONTEXT_FEATURES if c in cols]
    parts += [F.when(F.col(c).isNotNull(), F.format_string(f"- {name}: %.1f MW", F.round(F.col(c), 1)))
              for c, name in CONTEXT_LAGS if c in cols]
    if not parts:
        return F.lit("(no feature details)")
    s = F.concat_ws("\n", *parts)
    return F.when(s == "", F.lit("(no feature details)")).otherwise(s)


def anomaly_report(anoms: DataFrame, per_severity: int = REPORT_PER_SEVERITY) -> DataFrame:
    """Per severity: count and the first ``per_severity`` rows (by time) as
    rendered lines ``(severity, severity_rank, n, line_no, line)``."""
    w = Window.partitionBy("severity").orderBy("datetime")
    counts = anoms.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    top = anoms.withColumn("line_no", F.row_number().over(w)).filter(F.col("line_no") <= per_severity)
    lines = top.join(counts, "severity").select(
        "severity", severity_rank(F.col("severity"), SEVERITY_ORDER).alias("severity_rank"), "n", "line_no",
        F.format_string("%s actual %.1f MW, predicted %.1f MW, deviation %.1f%%",
                        F.date_format("datetime", "yyyy-MM-dd HH:mm"), F.col("actual_load"),
                        F.col("predicted_load"), F.col("deviation_pct")).alias("line"))
    return lines
