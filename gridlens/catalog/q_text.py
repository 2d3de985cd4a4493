"""Queries: anomaly scan / root causes / reports, dialogue and template
text (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import compare as cmp
from ..operators import dialogue as dlg
from ..operators import insight
from ..operators import profile as prof
from ..operators import report as rep
from ..sources import fixtures as fx
from . import fixture_sql as fs
from .registry import register, round6, sql

# ---- keyword table for the driver's prose (the defaults never occur there)
PROSE_KEYWORDS = {
    "anomaly": ["error", "wrong", "ther"],
    "comparison": ["than", "compar", "differ"],
    "report": ["report", "summar", "this"],
    "attribution": ["because", "why", "reason"],
    "what_if": ["if ", "would", "will"],
}


def _kw_sql(text: str, kw: dict) -> tuple[str, str]:
    scores = {i: " + ".join(f"(CASE WHEN contains(lower({text}), '{w}') THEN 1 ELSE 0 END)" for w in ws)
              for i, ws in kw.items()}
    best = "greatest(" + ", ".join(f"({s})" for s in scores.values()) + ")"
    whens = " ".join(f"WHEN ({s}) = {best} THEN '{i}'" for i, s in scores.items())
    return f"(CASE WHEN {best} = 0 THEN 'attribution' ELSE (CASE {whens} END) END)", best


_INTENT_SQL, _ = _kw_sql("text", PROSE_KEYWORDS)


@register("intent_classify", sql("", f"SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM conversations"))
def q_intent(spark, sf_dir):
    c = fx.conversations(spark, sf_dir)
    return dlg.intent_classify(c, keywords=PROSE_KEYWORDS).select("conv_id", "turn", "intent")


_FOLLOW_WHATIF = ["if ", "suppose"]
_FOLLOW_REPORT = ["report", "export", "generat"]


def _any_sql(words):
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


@register("follow_up_intent", sql("", f"""
SELECT conv_id, turn, intent,
       CASE WHEN {_any_sql(_FOLLOW_REPORT)} THEN 'report' WHEN {_any_sql(_FOLLOW_WHATIF)} THEN 'what_if'
            ELSE lag(intent) OVER (PARTITION BY conv_id ORDER BY turn) END AS previous_intent,
       CASE WHEN intent = 'what_if' THEN 'what_if' WHEN intent = 'report' THEN 'report' ELSE 'general' END AS route
FROM (SELECT *, {_INTENT_SQL} AS intent FROM conversations)"""))
def q_follow_up(spark, sf_dir):
    c = fx.conversations(spark, sf_dir)
    return dlg.follow_up_intent(c, keywords=PROSE_KEYWORDS, whatif_words=_FOLLOW_WHATIF,
                                report_words=_FOLLOW_REPORT).select("conv_id", "turn", "intent",
                                                                    "previous_intent", "route")


@register("parse_periods", sql(fs.QUESTIONS, r"""
SELECT conv_id, turn,
  CASE WHEN len(regexp_extract_all(text, '(\d+)月', 1)) >= 2 THEN printf('2023-%02d-01', CAST(regexp_extract_all(text, '(\d+)月', 1)[1] AS INTEGER)) ELSE '2023-06-01' END AS p1_start,
  CASE WHEN len(regexp_extract_all(text, '(\d+)月', 1)) >= 2 THEN printf('2023-%02d-28', CAST(regexp_extract_all(text, '(\d+)月', 1)[1] AS INTEGER)) ELSE '2023-06-30' END AS p1_end,
  CASE WHEN len(regexp_extract_all(text, '(\d+)月', 1)) >= 2 THEN printf('2023-%02d-01', CAST(regexp_extract_all(text, '(\d+)月', 1)[2] AS INTEGER)) ELSE '2023-07-01' END AS p2_start,
  CASE WHEN len(regexp_extract_all(text, '(\d+)月', 1)) >= 2 THEN printf('2023-%02d-28', CAST(regexp_extract_all(text, '(\d+)月', 1)[2] AS INTEGER)) ELSE '2023-07-31' END AS p2_end
FROM questions"""))
def q_parse_periods(spark, sf_dir):
    c = fx.questions(spark, sf_dir)
    return c.select("conv_id", "turn", dlg.parse_periods("text").alias("p")).select("conv_id", "turn", "p.*")


@register("parse_date_range", sql(fs.QUESTIONS, r"""
SELECT conv_id, turn,
  CASE WHEN len(regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}')) >= 1 THEN regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}')[1] END AS start,
  CASE WHEN len(regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}')) >= 2 THEN regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}')[2]
       WHEN len(regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}')) = 1 THEN regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}')[1] END AS "end"
FROM questions"""))
def q_parse_date_range(spark, sf_dir):
    c = fx.questions(spark, sf_dir)
    return c.select("conv_id", "turn", dlg.parse_date_range("text").alias("p")).select("conv_id", "turn", "p.*")


@register("parse_whatif", sql(fs.QUESTIONS, r"""
SELECT conv_id, turn,
  CASE WHEN regexp_extract(text, '(\d+(?:\.\d+)?)\s*°?C', 1) <> '' THEN CAST(regexp_extract(text, '(\d+(?:\.\d+)?)\s*°?C', 1) AS DOUBLE) END AS temperature,
  CASE WHEN regexp_extract(text, '湿度\s*(\d+(?:\.\d+)?)', 1) <> '' THEN CAST(regexp_extract(text, '湿度\s*(\d+(?:\.\d+)?)', 1) AS DOUBLE) END AS humidity,
  CASE WHEN regexp_extract(text, '(工作日|周末|节假日)', 1) = '工作日' THEN 1 WHEN regexp_extract(text, '(工作日|周末|节假日)', 1) = '周末' THEN 0 END AS is_workday
FROM questions"""))
def q_parse_whatif(spark, sf_dir):
    c = fx.questions(spark, sf_dir)
    return c.select("conv_id", "turn", dlg.parse_whatif("text").alias("p")).select("conv_id", "turn", "p.*")


@register("whatif_scenario", sql(fs.HOURLY + "," + fs.QUESTIONS + """,
latest AS (SELECT arg_max(temperature, datetime) AS temperature, CAST(hour(max(datetime)) AS INTEGER) AS hour FROM hourly),
base AS (SELECT avg(load) AS baseline_load FROM hourly),
sc AS (SELECT c.conv_id, c.turn, coalesce(TRY_CAST(nullif(regexp_extract(c.text, '(\\d+(?:\\.\\d+)?)\\s*°?C', 1), '') AS DOUBLE), l.temperature) AS scenario_temperature,
              CASE WHEN regexp_extract(c.text, '(工作日|周末|节假日)', 1) = '工作日' THEN 1
                   WHEN regexp_extract(c.text, '(工作日|周末|节假日)', 1) = '周末' THEN 0 END AS scenario_is_workday,
              l.hour, b.baseline_load
       FROM questions c, latest l, base b)""", """
SELECT conv_id, turn, scenario_temperature, scenario_is_workday,
  greatest(2500.0 + (CASE WHEN scenario_temperature > 25 THEN (scenario_temperature - 25) * 15
                          WHEN scenario_temperature < 15 THEN (15 - scenario_temperature) * 10 ELSE 0.0 END)
           + (CASE WHEN hour BETWEEN 8 AND 22 THEN 200.0 ELSE -200.0 END)
           + (CASE WHEN coalesce(scenario_is_workday, 1) = 1 THEN 150.0 ELSE -150.0 END), 500.0) AS scenario_load,
  baseline_load
FROM sc""", ["scenario_temperature", "scenario_load", "baseline_load"]))
def q_whatif_scenario(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    feats = h.select("datetime", "temperature", F.hour("datetime").alias("hour"))
    base = h.agg(F.avg("load").alias("baseline_load"))
    c = fx.questions(spark, sf_dir).select("conv_id", "turn", "text")
    out = dlg.whatif_scenario(c, feats, base)
    return round6(out.select("conv_id", "turn", "scenario_temperature", "scenario_is_workday", "scenario_load",
                             "baseline_load"))


DIALOGUE_YEAR = 1995        # a year that the table of orders covers
_P = r"regexp_extract_all(text, '(\d+)月', 1)"
_DATES = r"regexp_extract_all(text, '\d{4}[-/]\d{2}[-/]\d{2}')"
_MONTH = f"CASE WHEN len({_P}) >= 2 THEN make_date({DIALOGUE_YEAR}, CAST({_P}[%d] AS INTEGER), %d) ELSE DATE '%s' END"


@register("batch_dialogue", sql(fs.DAILY_ORDERS + "," + fs.HOURLY + "," + fs.QUESTIONS + f""",
said AS (SELECT conv_id, turn, text, {_INTENT_SQL} AS intent,
                {_MONTH % (1, 1, '2023-06-01')} AS a0, {_MONTH % (1, 28, '2023-06-30')} AS a1, {_MONTH % (2, 1, '2023-07-01')} AS b0, {_MONTH % (2, 28, '2023-07-31')} AS b1,
                coalesce(TRY_CAST(replace({_DATES}[1], '/', '-') AS DATE), (SELECT CAST(min(datetime) AS DATE) FROM hourly)) AS d0,
                coalesce(TRY_CAST(replace({_DATES}[least(2, len({_DATES}))], '/', '-') AS DATE), (SELECT CAST(max(datetime) AS DATE) FROM hourly)) AS d1 FROM questions),
m AS (SELECT DISTINCT a0 AS lo, a1 AS hi FROM said UNION SELECT DISTINCT b0, b1 FROM said),
means AS (SELECT lo, hi, count(load) AS n, CAST(sum(CAST(load AS DECIMAL(18, 6))) AS DOUBLE) / count(load) AS mean FROM m LEFT JOIN daily_orders ON datetime >= lo AND datetime <= hi GROUP BY 1, 2),
r AS (SELECT d0, d1, count(load) AS n, CAST(sum(CAST(load AS DECIMAL(18, 6))) AS DOUBLE) / count(load) AS mean
      FROM (SELECT DISTINCT d0, d1 FROM said) LEFT JOIN hourly ON datetime >= d0 AND datetime < d1 + INTERVAL 1 DAY GROUP BY 1, 2)""", """
SELECT conv_id, turn, intent,
       CASE WHEN intent = 'comparison' THEN strftime(a0, '%Y-%m-%d') END AS period_1, CASE WHEN intent = 'comparison' THEN strftime(b0, '%Y-%m-%d') END AS period_2,
       CASE WHEN intent = 'comparison' THEN x.n END AS p1_n, CASE WHEN intent = 'comparison' THEN y.n END AS p2_n,
       CASE WHEN intent = 'comparison' AND x.n > 0 THEN x.mean END AS p1_mean, CASE WHEN intent = 'comparison' AND y.n > 0 THEN y.mean END AS p2_mean,
       CASE WHEN intent = 'comparison' AND x.n > 0 AND y.n > 0 THEN (y.mean - x.mean) / x.mean * 100 END AS mean_diff_pct,
       CASE WHEN intent = 'report' THEN said.d0 END AS range_start, CASE WHEN intent = 'report' THEN said.d1 END AS range_end,
       CASE WHEN intent = 'report' THEN r.n END AS range_n, CASE WHEN intent = 'report' AND r.n > 0 THEN r.mean END AS range_mean
FROM said JOIN means x ON x.lo = a0 AND x.hi = a1 JOIN means y ON y.lo = b0 AND y.hi = b1 JOIN r ON r.d0 = said.d0 AND r.d1 = said.d1""",
                                ["p1_mean", "p2_mean", "mean_diff_pct", "range_mean"]))
def q_batch_dialogue(spark, sf_dir):
    """Every turn with the numbers of its answer: its own periods compared, its own dates reported."""
    turns = dlg.intent_classify(fx.questions(spark, sf_dir), keywords=PROSE_KEYWORDS).select("conv_id", "turn", "intent", "text")
    own = dlg.period_answers(turns, fx.daily_orders(spark, sf_dir), "day", year=DIALOGUE_YEAR)
    own = dlg.date_range_answers(own, fx.hourly(spark, sf_dir), "hour")
    of = {"comparison": ["period_1", "period_2", "p1_n", "p2_n", "p1_mean", "p2_mean", "mean_diff_pct"], "report": ["range_start", "range_end", "range_n", "range_mean"]}
    return round6(own.select("conv_id", "turn", "intent", *[F.when(F.col("intent") == i, F.col(c)).alias(c) for i, cols in of.items() for c in cols]))


@register("batch_dialogue_text")
def q_batch_dialogue_text(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    p = fx.predictions_naive(spark, sf_dir)
    a = an.deviation_scan(p, top=None)
    answers = {
        "anomaly": a.agg(F.format_string("%d deviations above 15%%, %d critical", F.count(F.lit(1)),
                                         F.count_if(F.col("severity") == "critical")).alias("answer")),
        "report": h.agg(F.format_string("mean load %.1f MW, peak %.1f MW", F.avg("load"), F.max("load"))
                        .alias("answer")),
        "what_if": h.agg(F.format_string("baseline %.1f MW", F.avg("load")).alias("answer")),
    }
    shares = fx.contributions_linear(spark, sf_dir).groupBy("feature").agg(F.avg("abs_contribution").alias("mean_abs"))
    top = shares.orderBy(F.col("mean_abs").desc(), "feature").limit(3)
    answers["attribution"] = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("mean_abs"), "feature"))),
                                                              lambda x: x["feature"]), ", ").alias("answer"))
    c = fx.questions(spark, sf_dir)
    said = dlg.batch_dialogue(c, answers, keywords=PROSE_KEYWORDS).select("conv_id", "turn", "intent", "text", "answer")
    own = dlg.period_answers(said, fx.daily_orders(spark, sf_dir), "day", year=DIALOGUE_YEAR)
    compared = F.format_string("%s: %.2f MW, %s: %.2f MW, difference %.2f MW (%.1f%%)", "period_1", "p1_mean", "period_2", "p2_mean", "mean_diff", "mean_diff_pct")
    return own.select("conv_id", "turn", "intent", F.when(F.col("intent") == "comparison", F.coalesce(compared, F.lit("a period has no data"))).otherwise(F.col("answer")).alias("answer"))


_DEV = fs.PRED + """,
dev AS (SELECT datetime, actual_load, predicted_load, abs(actual_load - predicted_load) / predicted_load * 100 AS deviation_pct,
               CASE WHEN abs(actual_load - predicted_load) / predicted_load * 100 > 50 THEN 'critical'
                    WHEN abs(actual_load - predicted_load) / predicted_load * 100 > 30 THEN 'high' ELSE 'medium' END AS severity,
               temperature, humidity, load_lag_1h, hour, month, is_weekend, is_holiday, is_workday
        FROM pred WHERE predicted_load IS NOT NULL AND predicted_load <> 0 AND actual_load IS NOT NULL
          AND abs(actual_load - predicted_load) / predicted_load * 100 > 15)"""


@register("deviation_scan", sql(_DEV, """
SELECT datetime, actual_load, predicted_load, deviation_pct, severity FROM dev""",
                                ["actual_load", "predicted_load", "deviation_pct"]))
def q_deviation_scan(spark, sf_dir):
    d = an.deviation_scan(fx.predictions_naive(spark, sf_dir), top=None)
    return round6(d.select("datetime", "actual_load", "predicted_load", "deviation_pct", "severity"))


_RC = {k: v.replace("'", "''") for k, v in an.ROOT_TEXT.items()}


@register("root_cause_rules", sql(_DEV, f"""
SELECT datetime, coalesce(nullif(concat_ws('; ',
    CASE WHEN coalesce(temperature, 20.0) > 38 THEN '{_RC["hot"]}' WHEN coalesce(temperature, 20.0) < 2 THEN '{_RC["cold"]}' END,
    CASE WHEN coalesce(is_holiday, false) THEN '{_RC["holiday"]}'
         WHEN coalesce(is_workday, 0) = 0 AND actual_load > predicted_load THEN '{_RC["offday"]}' END,
    CASE WHEN load_lag_1h IS NOT NULL AND load_lag_1h <> 0
              AND abs(actual_load - load_lag_1h) > abs(predicted_load - load_lag_1h) * 1.5 THEN '{_RC["jump"]}' END),
  ''), '{_RC["none"]}') AS root_cause
FROM dev"""))
def q_root_cause(spark, sf_dir):
    d = an.deviation_scan(fx.predictions_naive(spark, sf_dir), top=None)
    return an.root_cause_rules(d).select("datetime", "root_cause")


@register("feature_context_text")
def q_feature_context(spark, sf_dir):
    d = an.deviation_scan(fx.predictions_naive(spark, sf_dir), top=None)
    d = d.withColumns({"temperature": F.round("temperature", 2), "humidity": F.round("humidity", 2)})
    d = d.select("datetime", "temperature", "humidity", "hour", "is_workday", "is_holiday", "load_lag_1h")
    return d.select("datetime", an.feature_context_text(d).alias("context"))


@register("anomaly_report", sql(_DEV, """
SELECT severity, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS INTEGER) AS severity_rank,
       count(*) OVER (PARTITION BY severity) AS n,
       CAST(row_number() OVER (PARTITION BY severity ORDER BY datetime) AS INTEGER) AS line_no, datetime
FROM dev QUALIFY line_no <= 5"""))
def q_anomaly_report(spark, sf_dir):
    d = an.deviation_scan(fx.predictions_naive(spark, sf_dir), top=None)
    r = an.anomaly_report(d)
    # the time of each listed row is compared instead of the rendered line
    w = F.to_timestamp_ntz(F.substring("line", 1, 16), F.lit("yyyy-MM-dd HH:mm"))
    return r.select("severity", "severity_rank", "n", "line_no", w.alias("datetime"))


@register("contribution_summary", sql(fs.CONTRIB + """,
t5 AS (SELECT * FROM contributions QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature) <= 5)""",
                                      """
SELECT row_id, count(*) FILTER (WHERE shap_value > 0) AS n_positive, count(*) FILTER (WHERE shap_value < 0) AS n_negative,
       round(sum(CASE WHEN shap_value > 0 THEN shap_value ELSE 0.0 END), 2) AS total_positive,
       round(sum(CASE WHEN shap_value < 0 THEN shap_value ELSE 0.0 END), 2) AS total_negative,
       round(sum(shap_value), 2) AS net FROM t5 GROUP BY row_id""", ["total_positive", "total_negative", "net"]))
def q_contribution_summary(spark, sf_dir):
    return round6(rep.contribution_summary(fx.contributions_linear(spark, sf_dir)))


def _explain_inputs(spark, sf_dir):
    c = fx.contributions_linear(spark, sf_dir)
    h = fx.hourly_indexed(spark, sf_dir)
    from ..functions import calendar as cal
    t = F.col("datetime")
    p = h.join(c.select("row_id").distinct(), "row_id").select(
        "row_id", "datetime", F.col("load_lag_24h").alias("prediction"), F.round("temperature", 1).alias("temperature"),
        F.hour(t).alias("hour"), F.weekday(t).alias("day_of_week"), "load_lag_1h",
        cal.workday_flag(F.weekday(t) >= 5, cal.holiday_flag(t)).alias("is_workday"), cal.season(t).alias("season"))
    return p, c


@register("explanation_text")
def q_explanation_text(spark, sf_dir):
    p, c = _explain_inputs(spark, sf_dir)
    return rep.explanation_text(p, c, "detailed")


@register("prompt_table")
def q_prompt_table(spark, sf_dir):
    p, c = _explain_inputs(spark, sf_dir)
    return rep.prompt_table(p, c)


@register("template_summary")
def q_template_summary(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    stats = h.agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.count(F.lit(1)).alias("n"),
                  F.avg("load").alias("mean"), F.max("load").alias("max"))
    acc = prof.accuracy_stats(fx.predictions_naive(spark, sf_dir))
    d = an.deviation_scan(fx.predictions_naive(spark, sf_dir), top=None)
    cnt = d.agg(F.count(F.lit(1)).alias("n_anomalies"),
                F.count_if(F.col("severity").isin("high", "critical")).alias("n_high"))
    return rep.template_summary(stats, acc, cnt)


@register("template_recommendations")
def q_template_recs(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    stats = prof.series_statistics(h)
    drivers = prof.top_drivers(fx.hourly_indexed(spark, sf_dir).drop("row_id"), min_abs=0.0).filter(
        F.col("rank") == 1)
    d = an.deviation_scan(fx.predictions_naive(spark, sf_dir), top=None)
    nh = d.agg(F.count_if(F.col("severity").isin("high", "critical")).alias("n_high"))
    return rep.template_recommendations(stats, drivers, nh)


@register("comparison_text")
def q_comparison_text(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    p1, p2 = ("2024-01-01", "2024-01-14"), ("2024-01-15", "2024-01-28")
    diff = cmp.period_diff(cmp.period_stats(h, [("p1", *p1), ("p2", *p2)]), "p1", "p2")
    return rep.comparison_text(diff, cmp.workday_diff(h, p1, p2))


@register("insight_summary")
def q_insight_summary(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    trends = insight.trend_runs(fx.daily_orders(spark, sf_dir), min_duration=3)
    anoms = insight.anomaly_insights(fx.predictions_naive(spark, sf_dir))
    corr = insight.lagged_correlation(h, "load", "load", max_lag=12)
    return rep.insight_summary(trends, anoms, corr)


@register("shap_chart_data", sql(fs.CONTRIB + """,
t AS (SELECT row_id, feature, shap_value,
             CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature) AS INTEGER) AS rank
      FROM contributions QUALIFY rank <= 10)""", """
SELECT row_id, feature, shap_value, rank, sum(shap_value) OVER (PARTITION BY row_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cumulative
FROM t""", ["shap_value", "cumulative"]))
def q_shap_chart(spark, sf_dir):
    c = fx.contributions_linear(spark, sf_dir)
    return round6(rep.shap_chart_data(c).select("row_id", "feature", "shap_value", "rank", "cumulative"))


@register("prediction_vs_actual", sql(fs.PRED, """
SELECT CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime, avg(actual_load) AS actual_load,
       avg(predicted_load) AS predicted_load FROM pred GROUP BY 1""", ["actual_load", "predicted_load"]))
def q_pred_vs_actual(spark, sf_dir):
    p = fx.predictions_naive(spark, sf_dir).select("datetime", "actual_load", "predicted_load")
    return round6(prof.resample_mean(p, "day", fill_empty=False))


@register("dashboard_data", sql(fs.HOURLY, """
SELECT 'daily' AS panel, strftime(datetime, '%Y-%m-%d') AS key, avg(load) AS value FROM hourly GROUP BY 2
UNION ALL SELECT 'hourly', CAST(hour(datetime) AS VARCHAR), avg(load) FROM hourly GROUP BY 2
UNION ALL SELECT 'weekday', CAST(isodow(datetime) - 1 AS VARCHAR), avg(load) FROM hourly GROUP BY 2""", ["value"]))
def q_dashboard(spark, sf_dir):
    return round6(rep.dashboard_data(fx.hourly(spark, sf_dir)))
