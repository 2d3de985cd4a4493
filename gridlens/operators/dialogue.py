"""Question-table operators: intent classification, follow-up routing,
period / date / scenario parsing, what-if scoring and the batch dialogue.

Every function works on a table of turns ``(conv_id, turn, text)``; the
keyword tables are parameters (a handful of literals compiled into one
projection, no join)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..plans import ordered as o
from ..session import cut_lineage
from . import compare
from .standardize import latest_features

# ---- fixed values: default keyword table (intent order = tie order) -------
INTENT_KEYWORDS = {
    "anomaly": ["异常", "偏差", "不正常", "哪里出了问题", "为什么不对", "错误"],
    "comparison": ["对比", "比较", "和...比", "差异", "变化", "增长", "下降", "昨天", "上周", "上周同期"],
    "report": ["报告", "总结", "摘要", "汇总", "分析报告", "生成报告"],
    "attribution": ["原因", "为什么", "是什么导致的", "归因", "因素", "贡献", "影响", "驱动力"],
    "what_if": ["如果", "假如", "假设", "预测", "会", "将要", "将会", "会到多少"],
}
DEFAULT_INTENT = "attribution"
FOLLOW_WHATIF = ["如果", "假设", "假如"]
FOLLOW_REPORT = ["报告", "导出", "生成"]
MONTH_PATTERN = r"(\d+)月"
DATE_PATTERN = r"\d{4}[-/]\d{2}[-/]\d{2}"
TEMP_PATTERN = r"(\d+(?:\.\d+)?)\s*°?C"
HUMIDITY_PATTERN = r"湿度\s*(\d+(?:\.\d+)?)"
DAYTYPE_PATTERN = r"(工作日|周末|节假日)"
WORKDAY_WORD, WEEKEND_WORD = "工作日", "周末"
PERIOD_YEAR = 2023
DEFAULT_PERIODS = (("2023-06-01", "2023-06-30"), ("2023-07-01", "2023-07-31"))
PARSED_MONTH_LAST_DAY = 28
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hits(text: Column, words: Sequence[str]) -> Column:
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def intent_scores(text, keywords: dict[str, list[str]] | None = None) -> dict[str, Column]:
    kw = keywords or INTENT_KEYWORDS
    t = F.lower(_c(text))
    return {intent: _hits(t, words) for intent, words in kw.items()}


def classify_intent(text, keywords: dict[str, list[str]] | None = None,
                    default: str = DEFAULT_INTENT) -> Column:
    """Intent with the most keyword hits; ties go to the earlier intent;
    no hit -> ``default``."""
    scores = intent_scores(text, keywords)
    best = F.greatest(*scores.values()) if len(scores) > 1 else list(scores.values())[0]
    expr = None
    for intent, s in scores.items():
        cond = s == best
        expr = F.when(cond, intent) if expr is None else expr.when(cond, intent)
    return F.when(best == 0, F.lit(default)).otherwise(expr)


def intent_classify(turns: DataFrame, text_col: str = "text",
                    keywords: dict[str, list[str]] | None = None) -> DataFrame:
    return turns.withColumn("intent", classify_intent(text_col, keywords))


def follow_up_intent(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                     text_col: str = "text", keywords: dict[str, list[str]] | None = None,
                     whatif_words: Sequence[str] = FOLLOW_WHATIF,
                     report_words: Sequence[str] = FOLLOW_REPORT) -> DataFrame:
    """Previous turn's intent (overridden to what_if / report by follow-up
    words in this turn) and the route taken: what_if, report or general."""
    t = _c(text_col)
    # chunks of consecutive turns: a conversation with very many turns is many tasks
    lo = o.layout(turns.withColumn("intent", classify_intent(text_col, keywords)), turn_col, [conv_col], halo=1)
    prev = F.lag("intent", 1).over(lo.window)
    prev = (F.when(_hits(t, report_words) > 0, F.lit("report"))
             .when(_hits(t, whatif_words) > 0, F.lit("what_if")).otherwise(prev))
    route = F.when(F.col("intent") == "what_if", "what_if").when(F.col("intent") == "report", "report") \
             .otherwise("general")
    return lo.finish(lo.df.withColumn("previous_intent", prev)).withColumn("route", route)


def parse_periods(text, year: int = PERIOD_YEAR) -> Column:
    """Two month mentions -> ``(YYYY-MM-01, YYYY-MM-28)`` twice; otherwise
    the default June / July periods.  Struct ``p1_start, p1_end, p2_start,
    p2_end``."""
    ms = F.regexp_extract_all(_c(text), F.lit(MONTH_PATTERN), 1)
    has = F.size(ms) >= 2

    def day(i, d):
        return F.format_string(f"{year}-%02d-{d:02d}", ms[i].cast("int"))
    (a0, a1), (b0, b1) = DEFAULT_PERIODS
    return F.struct(F.when(has, day(0, 1)).otherwise(F.lit(a0)).alias("p1_start"),
                    F.when(has, day(0, PARSED_MONTH_LAST_DAY)).otherwise(F.lit(a1)).alias("p1_end"),
                    F.when(has, day(1, 1)).otherwise(F.lit(b0)).alias("p2_start"),
                    F.when(has, day(1, PARSED_MONTH_LAST_DAY)).otherwise(F.lit(b1)).alias("p2_end"))


def parse_date_range(text) -> Column:
    """Dates ``YYYY-MM-DD`` / ``YYYY/MM/DD``: two -> start, end; one -> the
    same day; none -> nulls."""
    ds = F.regexp_extract_all(_c(text), F.lit(DATE_PATTERN), 0)
    n = F.size(ds)
    return F.struct(F.when(n >= 1, ds[0]).alias("start"),
                    F.when(n >= 2, ds[1]).when(n == 1, ds[0]).alias("end"))


def parse_whatif(text) -> Column:
    """Scenario overrides: temperature (number before C), humidity (number
    after the humidity word), day type -> is_workday 1 / 0."""
    t = _c(text)
    temp = F.regexp_extract(t, TEMP_PATTERN, 1)
    hum = F.regexp_extract(t, HUMIDITY_PATTERN, 1)
    day = F.regexp_extract(t, DAYTYPE_PATTERN, 1)
    return F.struct(F.when(temp != "", temp.cast("double")).alias("temperature"),
                    F.when(hum != "", hum.cast("double")).alias("humidity"),
                    F.when(day == WORKDAY_WORD, 1).when(day == WEEKEND_WORD, 0).alias("is_workday"))


def whatif_scenario(turns: DataFrame, features: DataFrame, baseline: DataFrame,
                    text_col: str = "text", time_col: str = "datetime") -> DataFrame:
    """Per question: latest features overridden by the parsed scenario,
    rule score, and the difference to the baseline mean load.

    ``features`` is the feature table (its latest row is one aggregate),
    ``baseline`` a one-row table with ``baseline_load``; both broadcast
    (one row each)."""
    latest = latest_features(features, time_col)
    sc = turns.withColumn("_s", parse_whatif(text_col))
    j = sc.crossJoin(F.broadcast(latest)).crossJoin(F.broadcast(baseline))
    t = F.coalesce(F.col("_s.temperature"), F.col("temperature")) if "temperature" in latest.columns \
        else F.col("_s.temperature")
    h = F.col("hour") if "hour" in latest.columns else F.lit(None)
    wd = F.coalesce(F.col("_s.is_workday"), F.col("is_workday")) if "is_workday" in latest.columns \
        else F.col("_s.is_workday")
    score = rules.whatif_rule_score(t, h, wd)
    out = j.select(*turns.columns, t.alias("scenario_temperature"), wd.alias("scenario_is_workday"),
                   score.alias("scenario_load"), "baseline_load")
    return out.withColumns({
        "diff": F.col("scenario_load") - F.col("baseline_load"),
        "diff_pct": F.try_divide(F.col("scenario_load") - F.col("baseline_load"), F.col("baseline_load")) * 100})


def period_answers(turns: DataFrame, series: DataFrame, unit: str = "hour", text_col: str = "text", year: int = PERIOD_YEAR,
                   target: str = "load", time_col: str = "datetime") -> DataFrame:
    """Each turn with the comparison of its own two periods: ``period_1``, ``period_2`` (first days), ``p1_n``, ``p1_mean``,
    ``p2_n``, ``p2_mean``, ``mean_diff`` and ``mean_diff_pct`` (0 where the first mean is 0; null where a period has no values).

    Periods are parsed from the text; all turns are answered by look-ups in one table of running totals."""
    prefix = cut_lineage(compare.prefix_totals(series, target, unit, time_col))
    day = lambda c: F.to_timestamp_ntz(F.col("_p")[c])
    t = turns.withColumn("_p", parse_periods(text_col, year)).withColumns({f"_{k}": day(k) for k in ("p1_start", "p1_end", "p2_start", "p2_end")})
    for p in ("p1", "p2"):
        t = compare.range_means(t, prefix, f"_{p}_start", f"_{p}_end", unit, p)
    diff = F.col("p2_mean") - F.col("p1_mean")
    return t.select(*turns.columns, F.col("_p.p1_start").alias("period_1"), F.col("_p.p2_start").alias("period_2"), "p1_n", "p1_mean", "p2_n", "p2_mean",
                    diff.alias("mean_diff"), F.when(F.col("p1_mean") == 0, F.lit(0.0)).otherwise(diff / F.col("p1_mean") * 100).alias("mean_diff_pct"))


def date_range_answers(turns: DataFrame, series: DataFrame, unit: str = "hour", text_col: str = "text",
                       target: str = "load", time_col: str = "datetime") -> DataFrame:
    """Each turn with ``range_start``, ``range_end``, ``range_n`` and ``range_mean`` of the dates that it names, both days
    whole; the series' own first and last day where it names none."""
    prefix = cut_lineage(compare.prefix_totals(series, target, unit, time_col))
    whole = F.broadcast(prefix.agg(F.to_date(F.min("bucket")).alias("_d0"), F.to_date(F.max("bucket")).alias("_d1")))      # one row
    said = lambda c: F.try_to_date(F.translate(F.col("_p")[c], "/", "-"))
    t = turns.withColumn("_p", parse_date_range(text_col)).crossJoin(whole)
    t = t.withColumns({"range_start": F.coalesce(said("start"), "_d0"), "range_end": F.coalesce(said("end"), "_d1")})
    t = t.withColumns({"_from": F.col("range_start").cast("timestamp_ntz"),
                       "_to": F.date_add("range_end", 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")})
    return compare.range_means(t, prefix, "_from", "_to", unit).select(*turns.columns, "range_start", "range_end", "range_n", "range_mean")


def batch_dialogue(turns: DataFrame, answers: dict[str, DataFrame], text_col: str = "text",
                   keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Classify every turn and attach the answer of its intent.

    ``answers`` maps intent -> one-row answer table ``(answer string)``
    computed once over the data (anomaly scan, comparison, report, ...).  The
    turns are read once and joined with the table of answers (broadcast: one
    row an intent)."""
    tagged = intent_classify(turns, text_col, keywords)
    table = None
    for intent, ans in answers.items():
        one = ans.select(F.lit(intent).alias("_intent"), F.col("answer").cast("string").alias("answer"))
        table = one if table is None else table.unionByName(one)
    if table is None:
        return tagged.withColumn("answer", F.lit(None).cast("string"))
    return tagged.join(F.broadcast(table), F.col("intent") == F.col("_intent"), "left").drop("_intent")
