"""Period and pair comparisons: stats per period, differences, hour /
workday patterns, granular means, feature-contribution changes."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..plans import ordered as o
from ..plans.quantiles import quantile_columns
from ..session import cut_lineage

# ---- fixed values ---------------------------------------------------------
DRIVER_SHAP_CHANGE = 20.0       # |shap change| above -> driver / reducer
REPORT_CHANGE_MIN = 10.0        # report diff keeps |change| above this
TOP_CHANGES = 10
TOP_DRIVERS = 3
GRANULARITIES = ("daily", "weekly", "monthly", "yearly")
# ---------------------------------------------------------------------------


def periods_table(spark, periods: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``[(label, start, end), ...]`` -> a small table with ntz bounds."""
    df = spark.createDataFrame(list(periods), "period string, _start string, _end string")
    return df.select("period", F.to_timestamp_ntz("_start").alias("_lo"),
                     F.to_timestamp_ntz("_end").alias("_hi"))


def tag_periods(df: DataFrame, periods: Sequence[tuple[str, str, str]],
                time_col: str = "datetime") -> DataFrame:
    """Attach the period label(s) whose ``[start, end]`` holds the row.

    The period table has one row per requested period (a parameter, so its
    size is bounded): broadcast range join, no shuffle of the facts."""
    p = periods_table(df.sparkSession, periods)
    t = F.col(time_col)
    return df.join(F.broadcast(p), (t >= F.col("_lo")) & (t <= F.col("_hi")), "inner").drop("_lo", "_hi")


def period_stats(df: DataFrame, periods: Sequence[tuple[str, str, str]], target: str = "load",
                 time_col: str = "datetime", approx: bool = False) -> DataFrame:
    """count, mean, std, min, max, median, sum of ``target`` per period."""
    tagged = tag_periods(df, periods, time_col)
    med = quantile_columns(tagged, target, {"median": 0.5}, ["period"], approx)
    return tagged.groupBy("period").agg(
        F.count(F.lit(1)).alias("count"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"), F.max(target).alias("max"),
        F.sum(target).alias("sum")).join(med, "period", "left").select(
        "period", "count", "mean", "std", "min", "max", "median", "sum")


def prefix_totals(df: DataFrame, target: str = "load", unit: str = "hour", time_col: str = "datetime") -> DataFrame:
    """(bucket, total, count): sum and number of ``target`` values from the start up to and with each bucket.

    Every bucket from the first to the last stands, also those without rows, so that any time inside
    is an equi-join key.  Values are added as decimals of six places, so a difference of
    two totals is exactly the sum between them.  Running sums are chunk-wise with a carry table."""
    x = F.col(target).cast("decimal(18,6)")
    b = df.groupBy(F.date_trunc(unit, F.col(time_col)).cast("timestamp_ntz").alias("bucket")).agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    b = cut_lineage(b.filter(F.col("bucket").isNotNull()))
    spine = b.agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi")).filter(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL 1 {unit.upper()}"))).alias("bucket"))
    lo = o.layout(spine.join(b, "bucket", "left"), "bucket", halo=0)
    run = o.running_sum(o.running_sum(lo.core(), "_s", "total"), "_c", "count")
    return run.select("bucket", F.col("total").cast("decimal(38,6)").alias("total"), "count")


def range_means(ranges: DataFrame, prefix: DataFrame, start: str, end: str, unit: str = "hour", prefix_name: str = "range") -> DataFrame:
    """``ranges`` with the count and the mean of the values in each row's ``[start, end]``.

    However long the ranges are and however many, a row takes two look-ups in the table of
    ``prefix_totals``: at its end, and before its start.  A range without values (also: no bounds) has
    count 0 and mean null."""
    edge = F.broadcast(prefix.agg(F.min("bucket").alias("_first"), F.max("bucket").alias("_last")))      # one row
    down = lambda t: F.date_trunc(unit, t).cast("timestamp_ntz")
    last = F.least(down(F.col(end)), F.col("_last"))
    before = F.least(down(F.col(start) - F.expr("INTERVAL 1 MICROSECOND")), F.col("_last"))
    r = ranges.crossJoin(edge).withColumns({"_at": last, "_before": before})
    hi, lo = (prefix.select(F.col("bucket").alias("_b" + k), F.col("total").alias("_t" + k), F.col("count").alias("_n" + k)) for k in "hl")
    r = r.join(hi, F.col("_at") == F.col("_bh"), "left").join(lo, F.col("_before") == F.col("_bl"), "left")
    some = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))
    n = F.when(some, F.coalesce("_nh", F.lit(0)) - F.coalesce("_nl", F.lit(0))).otherwise(0).cast("long")
    total = (F.coalesce("_th", F.lit(0).cast("decimal(38,6)")) - F.coalesce("_tl", F.lit(0).cast("decimal(38,6)"))).cast("double")
    return r.withColumn("_n", n).select(*ranges.columns, F.col("_n").alias(f"{prefix_name}_n"),
                                        F.when(F.col("_n") > 0, total / F.col("_n")).alias(f"{prefix_name}_mean"))


def period_diff(stats: DataFrame, p1: str, p2: str) -> DataFrame:
    """Differences period 2 - period 1 (rounded to 2), mean pct (0 when the
    period-1 mean is 0).  ``stats`` has one row per period."""
    s = stats.groupBy().pivot("period", [p1, p2]).agg(
        F.first(F.struct("mean", "max", "min", "sum")))
    a, b = F.col(f"`{p1}`"), F.col(f"`{p2}`")
    return s.select(
        F.round(b["mean"] - a["mean"], 2).alias("mean_diff"),
        F.when(a["mean"] != 0, F.round((b["mean"] - a["mean"]) / a["mean"] * 100, 2))
         .otherwise(F.lit(0.0)).alias("mean_diff_pct"),
        F.round(b["max"] - a["max"], 2).alias("max_diff"),
        F.round(b["min"] - a["min"], 2).alias("min_diff"),
        F.round(b["sum"] - a["sum"], 2).alias("sum_diff"))


def granularity_key(t: Column, granularity: str) -> Column:
    """daily '2024-01-05', weekly '2024-01-01/2024-01-07' (Mon-Sun),
    monthly '2024-01', yearly '2024'."""
    if granularity == "daily":
        return F.date_format(t, "yyyy-MM-dd")
    if granularity == "weekly":
        mon = F.date_trunc("week", t)
        return F.concat_ws("/", F.date_format(mon, "yyyy-MM-dd"),
                           F.date_format(F.date_add(F.to_date(mon), 6), "yyyy-MM-dd"))
    if granularity == "monthly":
        return F.date_format(t, "yyyy-MM")
    if granularity == "yearly":
        return F.year(t).cast("string")
    raise ValueError(f"unsupported granularity {granularity}")


def granular_means(df: DataFrame, periods: Sequence[tuple[str, str, str]], granularity: str = "daily",
                   target: str = "load", time_col: str = "datetime") -> DataFrame:
    tagged = tag_periods(df, periods, time_col)
    return tagged.groupBy("period", granularity_key(F.col(time_col), granularity).alias("bucket")).agg(
        F.avg(target).alias("mean"), F.count(F.lit(1)).alias("count"))


def hourly_diff(df: DataFrame, p1: tuple[str, str], p2: tuple[str, str], target: str = "load",
                time_col: str = "datetime") -> DataFrame:
    """Per hour present in both periods: p1 avg, p2 avg, diff, diff pct
    (0 when p1 avg is 0), plus flags for the hours of largest and smallest
    absolute difference (lowest hour on ties)."""
    tagged = tag_periods(df, [("p1", *p1), ("p2", *p2)], time_col)
    h = tagged.groupBy(F.hour(time_col).alias("hour")).agg(
        F.avg(F.when(F.col("period") == "p1", F.col(target))).alias("p1_avg"),
        F.avg(F.when(F.col("period") == "p2", F.col(target))).alias("p2_avg"))
    h = h.filter(F.col("p1_avg").isNotNull() & F.col("p2_avg").isNotNull())
    h = h.withColumns({"diff": F.col("p2_avg") - F.col("p1_avg"),
                       "diff_pct": F.when(F.col("p1_avg") != 0,
                                          (F.col("p2_avg") - F.col("p1_avg")) / F.col("p1_avg") * 100)
                                    .otherwise(F.lit(0.0))})
    # at most 24 rows: the ranking windows run on a bounded table
    hi = Window.orderBy(F.abs("diff").desc(), F.col("hour"))
    lo = Window.orderBy(F.abs("diff").asc(), F.col("hour"))
    return h.withColumns({"is_max_diff": F.row_number().over(hi) == 1,
                          "is_min_diff": F.row_number().over(lo) == 1})


def workday_diff(df: DataFrame, p1: tuple[str, str], p2: tuple[str, str], target: str = "load",
                 time_col: str = "datetime", workday_col: str | None = None) -> DataFrame:
    """Mean by day type per period, diff and pct; a day type appears only
    when both periods have rows of it."""
    tagged = tag_periods(df, [("p1", *p1), ("p2", *p2)], time_col)
    t = F.col(time_col)
    wd = F.col(workday_col) if workday_col else cal.workday_flag(F.weekday(t) >= 5, cal.holiday_flag(t))
    g = tagged.groupBy(F.when(wd == 1, "workday").otherwise("weekend").alias("day_type")).agg(
        F.avg(F.when(F.col("period") == "p1", F.col(target))).alias("p1_avg"),
        F.avg(F.when(F.col("period") == "p2", F.col(target))).alias("p2_avg"))
    g = g.filter(F.col("p1_avg").isNotNull() & F.col("p2_avg").isNotNull())
    return g.withColumns({"diff": F.col("p2_avg") - F.col("p1_avg"),
                          "diff_pct": F.when(F.col("p1_avg") != 0,
                                             (F.col("p2_avg") - F.col("p1_avg")) / F.col("p1_avg") * 100)
                                       .otherwise(F.lit(0.0))})


def feature_change(contrib: DataFrame, pairs: DataFrame, row_col: str = "row_id",
                   threshold: float = DRIVER_SHAP_CHANGE) -> DataFrame:
    """Change of each feature's value and contribution between the two rows
    of every pair ``(pair_id, row1, row2)``.

    Full outer join on ``(pair_id, feature)`` (a feature missing on one side
    counts as 0): ``impact_type`` driver / reducer / neutral, ``rank`` by
    |shap change| desc within the pair."""
    c = contrib.select(F.col(row_col).alias("_row"), "feature", "feature_value", "shap_value")
    s1 = pairs.join(c, pairs["row1"] == c["_row"]).select(
        "pair_id", "feature", F.col("feature_value").alias("value1"), F.col("shap_value").alias("shap1"))
    s2 = pairs.join(c, pairs["row2"] == c["_row"]).select(
        "pair_id", "feature", F.col("feature_value").alias("value2"), F.col("shap_value").alias("shap2"))
    j = s1.join(s2, ["pair_id", "feature"], "full_outer")
    j = j.select("pair_id", "feature",
                 *[F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in ("value1", "value2", "shap1", "shap2")])
    j = j.withColumns({"value_change": F.col("value2") - F.col("value1"),
                       "shap_change": F.col("shap2") - F.col("shap1")})
    j = j.withColumn("impact_type", F.when(F.col("shap_change") > threshold, "driver")
                     .when(F.col("shap_change") < -threshold, "reducer").otherwise("neutral"))
    w = Window.partitionBy("pair_id").orderBy(F.abs("shap_change").desc(), F.col("feature"))
    return j.withColumn("rank", F.row_number().over(w))


def key_factors(changes: DataFrame, top: int = TOP_DRIVERS) -> DataFrame:
    """Per pair: top drivers and top reducers (by |shap change|)."""
    w = Window.partitionBy("pair_id", "impact_type").orderBy(F.abs("shap_change").desc(), F.col("feature"))
    r = changes.filter(F.col("impact_type") != "neutral").withColumn("_k", F.row_number().over(w)) \
               .filter(F.col("_k") <= top)
    return r.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("impact_type") == "driver",
                                           F.struct(F.col("_k"), F.col("feature"))))).alias("_d"),
        F.array_sort(F.collect_list(F.when(F.col("impact_type") == "reducer",
                                           F.struct(F.col("_k"), F.col("feature"))))).alias("_r")
    ).select("pair_id", F.transform("_d", lambda x: x["feature"]).alias("key_drivers"),
             F.transform("_r", lambda x: x["feature"]).alias("key_reducers"))


def report_diff(contrib: DataFrame, pairs: DataFrame, row_col: str = "row_id", top: int = 5,
                min_change: float = REPORT_CHANGE_MIN) -> DataFrame:
    """Compare the top-``top`` contributions of two explanation reports:
    full outer join on feature, keep |change| > min_change."""
    w = Window.partitionBy(row_col).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    topc = contrib.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top).drop("_k")
    ch = feature_change(topc, pairs, row_col)
    return ch.filter(F.abs("shap_change") > min_change).select(
        "pair_id", "feature", "shap1", "shap2", F.col("shap_change").alias("change"),
        F.when(F.col("shap_change") > 0, "increase").otherwise("decrease").alias("change_direction"))


def offset_pairs(df: DataFrame, offset_hours: int, row_col: str = "row_id",
                 time_col: str = "datetime") -> DataFrame:
    """Pairs ``(row at t - offset, row at t)`` by exact time offset: an equi
    join on ``t - offset`` (shuffle on time, no range join)."""
    a = df.select(F.col(row_col).alias("row1"), F.col(time_col).alias("_t1")).distinct()
    b = df.select(F.col(row_col).alias("row2"), F.col(time_col).alias("_t2")).distinct()
    j = a.join(b, F.col("_t1") == F.col("_t2") - F.expr(f"INTERVAL {offset_hours} HOURS"))
    return j.select(F.col("row2").alias("pair_id"), "row1", "row2")
