"""Report tables and template text: summaries, recommendations, comparison
and explanation text, prompts, insight summaries, report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import display_name_expr

# ---- fixed values ---------------------------------------------------------
HOT_PEAK_T = 35.0
WORKDAY_GAP_MW = 200.0
MAX_RECOMMENDATIONS = 5
MIN_RECOMMENDATIONS = 3
DEFAULT_RECOMMENDATIONS = [
    "Keep improving the forecast model and refresh its training data to follow new load trends.",
    "Run a seasonal load study to plan generation and grid capacity ahead of time.",
]
BAND_LARGE, BAND_MEDIUM = 20.0, 10.0
WORKDAY_SHIFT_MW = 50.0
PAIR_TEMP_SHIFT = 2.0
LAG_EFFECT_MW = 50.0
HOT_T, COLD_T = 30.0, 10.0
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
FACTOR_WORDS = {"temperature": "high temperature", "humidity": "high humidity",
                "load_lag_1h": "load inertia from the previous hour", "load_lag_24h": "load at the same hour yesterday",
                "load_lag_168h": "load at the same hour last week", "is_workday": "the workday effect"}
FACTOR_OTHER = "this factor"
DETAIL_LEVELS = ("brief", "standard", "detailed")
CONTRIB_TOP = 5
# normal value ranges per feature, and the extreme-contribution level (MW)
NORMAL_RANGES = {"temperature": (5, 40), "humidity": (20, 95), "hour": (0, 23),
                 "load_lag_1h": (500, 4000), "load_lag_24h": (500, 4000), "load_lag_168h": (500, 4000)}
EXTREME_CONTRIBUTION = 200.0
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def template_summary(stats: DataFrame, accuracy: DataFrame | None = None,
                     anomalies: DataFrame | None = None) -> DataFrame:
    """2-4 sentences from one-row statistics (``start, end, n, mean, max``),
    optional accuracy (``mape, r2``) and anomaly counts (``n_anomalies,
    n_high``).  One-row inputs: cross joins of single rows."""
    j = stats
    parts = [F.format_string("This report covers %s to %s with %d records.", F.col("start").cast("string"),
                             F.col("end").cast("string"), F.col("n")),
             F.format_string("Mean load was %.2f MW with a peak of %.2f MW.", F.col("mean"), F.col("max"))]
    if accuracy is not None:
        j = j.crossJoin(accuracy.select("mape", "r2"))
        parts.append(F.format_string("The forecast's mean absolute percentage error is %.1f%%, R2 %.3f.",
                                     F.col("mape"), F.coalesce(F.col("r2"), F.lit(0.0))))
    if anomalies is not None:
        j = j.crossJoin(anomalies.select("n_anomalies", "n_high"))
        parts.append(F.when(F.col("n_anomalies") > 0, F.format_string(
            "%d anomalies were detected, %d of them need attention.", F.col("n_anomalies"), F.col("n_high"))))
    return j.select(F.concat_ws(" ", *parts).alias("summary"))


def template_recommendations(stats: DataFrame, top_driver: DataFrame | None = None,
                             n_high: DataFrame | None = None) -> DataFrame:
    """Up to 5 recommendations: top driver, heat peak (> 35 C), workday /
    weekend gap (> 200 MW), high-deviation count; two defaults when fewer
    than 3.  Returns ``(rank, recommendation)``."""
    j = stats
    items = []
    if top_driver is not None:
        j = j.crossJoin(top_driver.select(F.col("feature").alias("_tf"), F.col("correlation").alias("_tc")))
        items.append(F.when(F.col("_tf").isNotNull(), F.format_string(
            "Watch %s: it correlates most with load (%.3f); set up real-time monitoring.",
            display_name_expr(F.col("_tf")), F.col("_tc"))))
    if "temperature_max" in stats.columns:
        items.append(F.when(F.col("temperature_max") > HOT_PEAK_T, F.format_string(
            "Prepare cooling-load plans for hot spells (peak %.1f C) to keep the grid stable.",
            F.col("temperature_max"))))
    if {"workday_mean", "weekend_mean"} <= set(stats.columns):
        gap = F.col("workday_mean") - F.col("weekend_mean")
        items.append(F.when(F.abs(gap) > WORKDAY_GAP_MW, F.format_string(
            "Workday and weekend load differ by about %.0f MW; adjust the unit commitment for weekends.",
            F.abs(gap))))
    if n_high is not None:
        j = j.crossJoin(n_high.select(F.col("n_high").alias("_nh")))
        items.append(F.when(F.col("_nh") > 0, F.format_string(
            "%d high-deviation periods found; check metering and sensors for faults.", F.col("_nh"))))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")
    arr = F.when(F.size(arr) < MIN_RECOMMENDATIONS,
                 F.concat(arr, F.array(*[F.lit(x) for x in DEFAULT_RECOMMENDATIONS]))).otherwise(arr)
    arr = F.slice(arr, 1, MAX_RECOMMENDATIONS)
    return j.select(F.posexplode(arr).alias("rank", "recommendation")).withColumn("rank", F.col("rank") + 1)


def comparison_text(diff: DataFrame, workday: DataFrame | None = None) -> DataFrame:
    """Rule text of a period comparison: higher / lower, size band (20 / 10 %)
    and the workday shift (+-50 MW).  ``diff`` is one row (mean_diff,
    mean_diff_pct); ``workday`` the workday_diff table."""
    j = diff
    md, mp = F.col("mean_diff"), F.col("mean_diff_pct")
    parts = [F.when(md > 0, F.format_string("Period 2 mean load is %.1f MW (%.1f%%) higher than period 1.", md, mp))
              .otherwise(F.format_string("Period 2 mean load is %.1f MW (%.1f%%) lower than period 1.",
                                         F.abs(md), F.abs(mp))),
             F.when(F.abs(mp) > BAND_LARGE, F.lit("The change is large; check for special events or anomalies."))
              .when(F.abs(mp) > BAND_MEDIUM, F.lit("The change is moderate, likely seasonal or weather driven."))
              .otherwise(F.lit("The change is within the normal range; operations are stable."))]
    if workday is not None:
        wd = workday.filter(F.col("day_type") == "workday").select(F.col("diff").alias("_wd"))
        j = j.crossJoin(wd.unionByName(wd.sparkSession.createDataFrame([], "_wd double"))
                        .agg(F.max("_wd").alias("_wd")))
        parts.append(F.when(F.col("_wd") > WORKDAY_SHIFT_MW, F.lit(
            "Workday load rose markedly, which may reflect economic growth or structural change."))
                      .when(F.col("_wd") < -WORKDAY_SHIFT_MW, F.lit(
                          "Workday load fell markedly, possibly due to efficiency policy or relocation.")))
    return j.select(F.concat_ws(" ", *parts).alias("interpretation"))


def pair_text(pairs: DataFrame) -> Column:
    """Text for a pair comparison row with ``prediction1, prediction2,
    key_drivers, key_reducers, temperature1, temperature2, is_workday1,
    is_workday2``."""
    d = F.col("prediction2") - F.col("prediction1")
    pct = F.try_divide(d, F.col("prediction1")) * 100
    parts = [F.format_string("The forecast changes by %.1f MW (%.1f%%).", d, F.coalesce(pct, F.lit(0.0))),
             F.when(F.size("key_drivers") > 0, F.concat(F.lit("Main drivers: "),
                                                       F.array_join(F.transform("key_drivers", lambda x: display_name_expr(x)), ", "),
                                                       F.lit("."))),
             F.when(F.size("key_reducers") > 0, F.concat(F.lit("Main reducers: "),
                                                        F.array_join(F.transform("key_reducers", lambda x: display_name_expr(x)), ", "),
                                                        F.lit(".")))]
    dt = F.col("temperature2") - F.col("temperature1")
    parts.append(F.when(F.abs(dt) > PAIR_TEMP_SHIFT, F.format_string(
        "Temperature moved by %.1f C, from %.1f C to %.1f C.", dt, F.col("temperature1"), F.col("temperature2"))))
    parts.append(F.when(F.col("is_workday1") != F.col("is_workday2"),
                        F.when(F.col("is_workday2") == 1, F.lit("The second period is a workday, the first is not."))
                         .otherwise(F.lit("The first period is a workday, the second is not."))))
    return F.concat_ws(" ", *parts)


def contribution_summary(contrib: DataFrame, top_n: int = CONTRIB_TOP, row_col: str = "row_id") -> DataFrame:
    """Per row: counts of positive / negative contributions among the top
    ``top_n`` by |value|, their totals and the net, rounded to 2."""
    w = Window.partitionBy(row_col).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    t = contrib.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top_n)
    v = F.col("shap_value")
    return t.groupBy(row_col).agg(
        F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"),
        F.round(F.sum(F.when(v > 0, v).otherwise(0.0)), 2).alias("total_positive"),
        F.round(F.sum(F.when(v < 0, v).otherwise(0.0)), 2).alias("total_negative"),
        F.round(F.sum(v), 2).alias("net"))


def explanation_text(pred: DataFrame, contrib: DataFrame, detail: str = "standard",
                     row_col: str = "row_id") -> DataFrame:
    """Template explanation per prediction row.

    ``pred``: ``row_id, prediction, temperature, hour, day_of_week,
    is_workday, load_lag_1h``; ``contrib``: long contributions.  The
    top factor, totals and lag effect are one grouped aggregate joined on
    ``row_id``."""
    w = Window.partitionBy(row_col).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    v = F.col("shap_value")
    top = contrib.withColumn("_k", F.row_number().over(w))
    agg = top.groupBy(row_col).agg(
        F.max_by(F.struct("feature", "shap_value"), F.when(F.col("_k") == 1, 1)).alias("_top"),
        F.sum(F.when(v > 0, v).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("_neg"),
        F.sum(F.when(F.col("feature").contains("lag"), v).otherwise(0.0)).alias("_lag"))
    j = pred.join(agg, row_col, "left")
    names = F.create_map(*[F.lit(x) for kv in FACTOR_WORDS.items() for x in kv])
    days = F.array(*[F.lit(d) for d in DAY_NAMES])
    p, t = F.col("prediction"), F.col("temperature")
    top_f = F.col("_top.feature")
    factor = F.coalesce(F.element_at(names, top_f), F.lit(FACTOR_OTHER))
    parts = [F.format_string("%s %d:00 forecast load is %.2f MW.", F.element_at(days, F.col("day_of_week") + 1),
                             F.col("hour"), p),
             F.when(top_f.isNotNull(), F.format_string(
                 "Mainly driven by %s, which %s the forecast by about %.1f MW.", factor,
                 F.when(F.col("_top.shap_value") > 0, F.lit("raises")).otherwise(F.lit("lowers")),
                 F.abs(F.col("_top.shap_value"))))]
    if detail == "detailed":
        parts += [F.format_string("Positive contributions total about %.1f MW, negative about %.1f MW.",
                                  F.coalesce(F.col("_pos"), F.lit(0.0)), F.coalesce(F.col("_neg"), F.lit(0.0))),
                  F.lit("The interval reflects model certainty for this input and widens in extreme weather.")]
    parts += [F.when(t > HOT_T, F.format_string("It is hot (%.1f C), so cooling demand rises clearly.", t))
               .when(t < COLD_T, F.format_string("It is cold (%.1f C), so heating demand is significant.", t)),
              F.when(F.col("is_workday") == 1, F.lit("Workday industrial and commercial demand is strong.")),
              F.when(F.col("load_lag_1h").isNotNull() & (F.col("load_lag_1h") != 0) &
                     (F.abs(F.col("_lag")) > LAG_EFFECT_MW),
                     F.format_string("Load history contributes about %.1f MW.", F.col("_lag"))),
              F.format_string("Overall the peak load is expected at %.2f MW; keep watching the weather.", p)]
    return j.select(row_col, F.concat_ws(" ", *parts).alias("explanation"))


def prompt_table(pred: DataFrame, contrib: DataFrame, detail: str = "standard", top: int = 5,
                 row_col: str = "row_id") -> DataFrame:
    """Render a prompt per prediction (date type, season, top factors,
    detail level) as a column, for a batch job elsewhere; no network."""
    w = Window.partitionBy(row_col).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    t = contrib.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top)
    lines = t.groupBy(row_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "_k", F.format_string("- %s: %+.1f MW", display_name_expr(F.col("feature")), F.col("shap_value"))
        .alias("s")))), lambda x: x["s"]), "\n").alias("_factors"))
    j = pred.join(lines, row_col, "left")
    day_type = F.when(F.col("is_workday") == 1, F.lit("workday")).otherwise(F.lit("non-workday"))
    return j.select(row_col, F.format_string(
        "Explain a load forecast of %.2f MW at %s (%s, season %s).\nTop factors:\n%s\nDetail level: %s.",
        F.col("prediction"), F.col("datetime").cast("string"), day_type,
        F.coalesce(F.col("season"), F.lit("unknown")), F.coalesce(F.col("_factors"), F.lit("(none)")),
        F.lit(detail)).alias("prompt"))


def _first_lines(df: DataFrame, order: list[str], line: Column, name: str, k: int = 3) -> DataFrame:
    """The first ``k`` lines in order, joined (one row): a top-k, then an array of at most k."""
    top = df.withColumn("_line", line).orderBy(*order).limit(k).select(F.struct(*order, "_line").alias("_s"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["_line"]), "\n").alias(name))


def insight_summary(trends: DataFrame, anomalies: DataFrame, correlations: DataFrame) -> DataFrame:
    """Counts of trends, high / medium anomalies and correlations plus the
    first three lines of each (one row).  Each part is an aggregate or a
    top-k with one row, so the joins are of single rows."""
    parts = [
        trends.agg(F.count(F.lit(1)).alias("n_trends")),
        anomalies.agg(F.count_if(F.col("severity") == "high").alias("n_high_anomalies"),
                      F.count_if(F.col("severity") == "medium").alias("n_medium_anomalies")),
        correlations.agg(F.count(F.lit(1)).alias("n_correlations")),
        _first_lines(trends, ["start_time"], F.format_string(
            "%s trend over %d hours (%.1f%%)", "trend_type", "duration", F.col("change_rate") * 100), "top_trends"),
        _first_lines(anomalies, ["severity_rank", "datetime"], F.format_string(
            "%s: %.1f%% deviation (%s)", F.col("datetime").cast("string"), "error_percentage", "severity"), "top_anomalies"),
        _first_lines(correlations, ["rank"], F.format_string("lag %d h: r = %.3f", "lag", "correlation"), "top_correlations"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def sections_markdown(sections: DataFrame) -> DataFrame:
    """``(section_no, section, line_no, line)`` -> markdown lines with a
    heading per section (ordered at the sink)."""
    heads = sections.select("section_no", "section").distinct().select(
        "section_no", "section", F.lit(0).alias("line_no"), F.concat(F.lit("## "), F.col("section")).alias("line"))
    return heads.unionByName(sections.select("section_no", "section", "line_no", "line"))


def write_report_text(lines: DataFrame, path: str) -> None:
    """Sink: rendered lines in order, one text file per output partition."""
    (lines.orderBy("section_no", "line_no").select("line").coalesce(1)
          .write.mode("overwrite").text(path))


def shap_chart_data(contrib: DataFrame, top: int = 10, row_col: str = "row_id") -> DataFrame:
    """Waterfall rows: per row the top contributions with a running total."""
    w = Window.partitionBy(row_col).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    t = contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    cum = Window.partitionBy(row_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cumulative", F.sum("shap_value").over(cum))


def dashboard_data(df: DataFrame, target: str = "load", time_col: str = "datetime") -> DataFrame:
    """Long ``(panel, key, value)``: daily means, hourly means, weekday means
    (one GROUPING SETS aggregation)."""
    t = F.col(time_col)
    b = df.select(F.date_format(t, "yyyy-MM-dd").alias("d"), F.hour(t).alias("h"), F.weekday(t).alias("w"),
                  F.col(target).alias("_y"))
    g = b.groupingSets([["d"], ["h"], ["w"]], "d", "h", "w").agg(
        F.avg("_y").alias("value"), F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") == 3, "daily").when(F.col("_g") == 5, "hourly").otherwise("weekday")
                    .alias("panel"),
                    F.coalesce(F.col("d"), F.col("h").cast("string"), F.col("w").cast("string")).alias("key"),
                    "value")


def abnormal_features(contrib: DataFrame, ranges: dict | None = None,
                      extreme: float = EXTREME_CONTRIBUTION) -> DataFrame:
    """Per contribution row: value outside its normal range (deviation low /
    high by how much) and, separately, |contribution| above ``extreme``.
    The range table is a fixed-size parameter (broadcast join)."""
    ranges = ranges or NORMAL_RANGES
    spark = contrib.sparkSession
    rt = spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in ranges.items()],
                               "feature string, _lo double, _hi double")
    j = contrib.join(F.broadcast(rt), "feature", "left")
    v = F.col("feature_value")
    out_range = j.filter((v < F.col("_lo")) | (v > F.col("_hi"))).select(
        *[c for c in contrib.columns if c in ("row_id", "datetime")], "feature", v.alias("value"),
        F.lit(None).cast("double").alias("shap_value"),
        F.when(v < F.col("_lo"), "low").otherwise("high").alias("deviation"),
        F.when(v < F.col("_lo"), F.abs(v - F.col("_lo"))).otherwise(F.abs(v - F.col("_hi"))).alias("deviation_amount"))
    extreme_rows = j.filter(F.col("abs_contribution") > extreme).select(
        *[c for c in contrib.columns if c in ("row_id", "datetime")], "feature", v.alias("value"),
        F.col("shap_value"), F.lit("extreme_contribution").alias("deviation"),
        F.col("abs_contribution").alias("deviation_amount"))
    return out_range.unionByName(extreme_rows)


def data_profile(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Long profile ``(section, name, metric, value)``: basic info, missing
    values, distribution summary and the hour / weekday / month patterns."""
    from . import profile as prof
    info = prof.basic_info(df, time_col).select(
        F.lit("info").alias("section"), F.lit("table").alias("name"),
        F.expr("stack(3, 'n_rows', CAST(n_rows AS DOUBLE), 'n_columns', CAST(n_columns AS DOUBLE), "
               "'date_range_days', CAST(date_range_days AS DOUBLE))").alias("metric", "value"))
    miss = prof.missing_stats(df).select(F.lit("missing").alias("section"), F.col("column").alias("name"),
                                         F.expr("stack(2, 'missing_count', CAST(missing_count AS DOUBLE), "
                                                "'missing_pct', missing_pct)").alias("metric", "value"))
    num = [c for c in df.columns if c != time_col and dict(df.dtypes)[c] in ("double", "float", "int", "bigint")]
    dist = prof.distribution_summary(df, num).select(
        F.lit("distribution").alias("section"), F.col("column").alias("name"),
        F.expr("stack(10, 'count', CAST(count AS DOUBLE), 'mean', mean, 'std', std, 'min', min, 'q25', q25, "
               "'median', median, 'q75', q75, 'max', max, 'skew', skew, 'kurtosis', kurtosis)")
        .alias("metric", "value"))
    pats = prof.patterns_grouping_sets(df, num[0], time_col).select(
        F.concat(F.lit("pattern:"), F.col("pattern")).alias("section"), F.col("key").cast("string").alias("name"),
        F.expr("stack(2, 'mean', mean, 'std', std)").alias("metric", "value"))
    return info.unionByName(miss).unionByName(dist).unionByName(pats)
