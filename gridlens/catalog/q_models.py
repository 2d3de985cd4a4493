"""Queries: MLlib training / prediction / CV / ensembles (§2.9) and model
explanations (§2.10).  Model queries are checked rows-only (MLlib training
has no SQL equivalent); their invariants are tested in ``tests/``.

Registered queries use the library's default sizes (boosting of 200 trees of
depth 6 on all training rows, forests of 100 trees of depth 8)."""

from __future__ import annotations

import os
import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import features as feat
from ..operators import insight
from ..operators import metrics as met
from ..operators import models as M
from ..operators import compare as cmp
from ..operators import report as rep
from ..operators import standardize as std
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import fixtures as fx
from .registry import register, round6

CANDIDATES = ("gbt", "gbt_early_stop", "forest")
FEATURES = feat.FEATURES
_CACHE: dict = {}


def _hourly(spark, sf_dir):
    """The hourly series, stored once: each table made of it would scan the events anew."""
    key = ("hourly", sf_dir, spark.sparkContext.applicationId)
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(fx.hourly(spark, sf_dir))
    return _CACHE[key]


def feature_table(spark, sf_dir):
    """Standardised hourly series -> 30 features, ``row_id`` and split."""
    key = ("features", sf_dir, spark.sparkContext.applicationId)
    if key not in _CACHE:
        base = std.standardize_columns(_hourly(spark, sf_dir))
        fe = feat.create_features(base)
        # fits, scores and explanations read it again and again: store it once
        _CACHE[key] = cut_lineage(feat.train_test_split(fe))
    return _CACHE[key]


def trained(spark, sf_dir) -> M.TrainedModel:
    key = ("model", sf_dir, spark.sparkContext.applicationId)
    if key not in _CACHE:
        fe = feature_table(spark, sf_dir)
        _CACHE[key] = M.train_model(fe.filter(F.col("split") == "train"), FEATURES)
    return _CACHE[key]


def _test(spark, sf_dir):
    return feature_table(spark, sf_dir).filter(F.col("split") == "test")


def _trees(spark, sf_dir):
    key = ("trees", sf_dir, spark.sparkContext.applicationId)
    if key not in _CACHE:
        _CACHE[key] = X.tree_tables(trained(spark, sf_dir).point, spark)
    return _CACHE[key]


# ------------------------------------------------------------------ training
@register("train_gbt")
def q_train_gbt(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(tm.point.transform(_test(spark, sf_dir)).select("row_id", "load", "prediction"))


@register("train_gbt_early_stop")
def q_train_gbt_es(spark, sf_dir):
    fe = feature_table(spark, sf_dir)
    pm = M.train_gbt_early_stop(M.held_out(fe.filter(F.col("split") == "train"), FEATURES), FEATURES)
    return round6(pm.transform(_test(spark, sf_dir)).select("row_id", "load", "prediction"))


@register("train_interval_model")
def q_train_interval(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(tm.interval.transform(_test(spark, sf_dir)).select("row_id", "uncertainty"))


@register("sequence_regressor")
def q_sequence_regressor(spark, sf_dir):
    h = fx.hourly(spark, sf_dir)
    model, flat = M.sequence_regressor(h, ["load", "temperature", "humidity"])
    return round6(model.transform(flat).select("row_id", "target", "prediction"))


@register("train_model")
def q_train_model(spark, sf_dir):
    return round6(M.model_info(trained(spark, sf_dir)))


@register("train_all_models")
def q_train_all(spark, sf_dir):
    fe = feature_table(spark, sf_dir)
    tr = fe.filter(F.col("split") == "train")
    models = M.train_all_models(tr, FEATURES, models=CANDIDATES)
    te = _test(spark, sf_dir)
    parts = [m.transform(te).select(F.lit(n).alias("model"), "row_id", F.col("load").alias("y"),
                                    F.col("prediction").alias("yhat")) for n, m in models.items()]
    return round6(reduce(DataFrame.unionByName, parts))


@register("predict_batch")
def q_predict_batch(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(M.predict_batch(tm, _test(spark, sf_dir)).select(
        "row_id", "datetime", "load", "predicted_load", "lower_bound", "upper_bound"))


@register("predict_requests")
def q_predict_requests(spark, sf_dir):
    tm = trained(spark, sf_dir)
    r = fx.requests(spark, sf_dir)
    return round6(M.predict_requests(tm, r).select("datetime", "predicted_load", "lower_bound", "upper_bound",
                                                  "confidence_interval", "unit"))


@register("predict_with_history")
def q_predict_with_history(spark, sf_dir):
    tm = trained(spark, sf_dir)
    r = fx.requests(spark, sf_dir).drop("load_lag_1h", "load_lag_24h", "load_lag_168h")
    return round6(M.predict_with_history(tm, r, fx.hourly(spark, sf_dir)).select(
        "datetime", "load_lag_1h", "load_lag_24h", "load_ma_3h", "predicted_load", "lower_bound", "upper_bound"))


def _test_preds(spark, sf_dir):
    tm = trained(spark, sf_dir)
    p = M.predict_batch(tm, _test(spark, sf_dir))
    return p.select(F.lit("gbt").alias("model"), "row_id", F.col("load").alias("y"),
                    F.col("predicted_load").alias("yhat"), "lower_bound", "upper_bound")


@register("evaluation_report_text")
def q_eval_text(spark, sf_dir):
    e = met.evaluate_model(_test_preds(spark, sf_dir))
    lines = e.select(F.explode(F.array(
        F.format_string("Model %s evaluated on %d rows", F.col("model"), F.col("n")),
        F.format_string("MAE %.2f MW, RMSE %.2f MW, MAPE %.2f%%, R2 %.4f", F.col("mae"), F.col("rmse"),
                        F.col("mape"), F.coalesce(F.col("r2"), F.lit(0.0))),
        F.format_string("Interval coverage %.2f%%", F.col("coverage_pct")),
        F.format_string("Errors from %.1f to %.1f MW; %d beyond their 95th percentile", F.col("min_error"),
                        F.col("max_error"), F.col("n_large_errors")))).alias("line"))
    return lines


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    fe = feature_table(spark, sf_dir).drop("row_id", "split")
    return round6(_cv(fe))


def _cv(fe):
    return M.cross_validate(fe, FEATURES, n_splits=5, model_type=CANDIDATES)


def _cv_avg(spark, sf_dir):
    key = ("cv", sf_dir, spark.sparkContext.applicationId)
    if key not in _CACHE:
        fe = feature_table(spark, sf_dir).drop("row_id", "split")
        _CACHE[key] = cut_lineage(met.cv_average(_cv(fe)))
    return _CACHE[key]


@register("cv_compare")
def q_cv_compare(spark, sf_dir):
    return round6(met.cv_compare(_cv_avg(spark, sf_dir)))


def _candidate_metrics(spark, sf_dir):
    """Test metrics of every candidate model."""
    key = ("candidates", sf_dir, spark.sparkContext.applicationId)
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(met.regression_metrics(q_train_all(spark, sf_dir)))
    return _CACHE[key]


def _candidates(spark, sf_dir):
    """``(test metrics, CV averages)`` of the candidates; neither set of fits needs the other, so they run together."""
    feature_table(spark, sf_dir)    # both read it
    found = M.fit_concurrently(spark, {"test": partial(_candidate_metrics, spark, sf_dir),
                                       "cv": partial(_cv_avg, spark, sf_dir)})
    return found["test"], found["cv"]


@register("candidate_pool")
def q_candidate_pool(spark, sf_dir):
    test, cv = _candidates(spark, sf_dir)
    test = test.select(
        "model", F.lit("test").alias("source"), F.expr("stack(2, 'mae', mae, 'rmse', rmse)").alias("metric", "value"))
    cv = cv.select("model", F.lit("cv").alias("source"), "metric", F.col("mean").alias("value"))
    return round6(test.unionByName(cv))


@register("selection_summary")
def q_selection_summary(spark, sf_dir):
    test, cv = _candidates(spark, sf_dir)
    ranked = met.comparison_table(test)
    cv = cv.filter(F.col("metric") == "mae").select(
        "model", F.col("mean").alias("cv_mae_mean"), F.col("std").alias("cv_mae_std"))
    return round6(ranked.join(cv, "model", "left").select("model", "mae", "r2", "rank_mae", "rank_r2",
                                                         "cv_mae_mean", "cv_mae_std"))


@register("ensemble_importance")
def q_ensemble_importance(spark, sf_dir):
    fe = feature_table(spark, sf_dir)
    tr = fe.filter(F.col("split") == "train")
    models = M.train_all_models(tr, FEATURES, models=CANDIDATES)
    parts = [M.feature_importance(m, FEATURES).withColumn("model", F.lit(n)) for n, m in models.items()]
    return round6(reduce(DataFrame.unionByName, parts))


@register("model_store")
def q_model_store(spark, sf_dir):
    tm = trained(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), "models", "store-" + uuid.uuid4().hex)
    M.save_model(tm, path)
    back = M.load_model(path)
    return round6(M.predict_batch(back, _test(spark, sf_dir)).select("row_id", "predicted_load", "lower_bound",
                                                                     "upper_bound"))


@register("model_info")
def q_model_info(spark, sf_dir):
    return round6(M.model_info(trained(spark, sf_dir)))


# --------------------------------------------------------------- explanations
def _shap(spark, sf_dir):
    key = ("shap", sf_dir, spark.sparkContext.applicationId)
    if key not in _CACHE:
        tm = trained(spark, sf_dir)
        # the SHAP table feeds several joins: write it once (reliable checkpoint)
        _CACHE[key] = cut_lineage(X.tree_shap_table(tm.point, feature_table(spark, sf_dir), FEATURES,
                                                    trees=_trees(spark, sf_dir)))
    return _CACHE[key]


@register("tree_shap")
def q_tree_shap(spark, sf_dir):
    return round6(_shap(spark, sf_dir))


@register("shap_expected_value")
def q_shap_ev(spark, sf_dir):
    ev = X.expected_value(_trees(spark, sf_dir))
    # checked against the data: mean prediction of the training rows alongside
    tm = trained(spark, sf_dir)
    tr = feature_table(spark, sf_dir).filter(F.col("split") == "train")
    return round6(tm.point.transform(tr).agg(F.avg("prediction").alias("mean_train_prediction"))
                  .withColumn("expected_value", F.lit(float(ev))))


@register("shap_global")
def q_shap_global(spark, sf_dir):
    return round6(X.shap_global(_shap(spark, sf_dir)))


@register("shap_interaction")
def q_shap_interaction(spark, sf_dir):
    tm = trained(spark, sf_dir)
    rows = _test(spark, sf_dir)
    pairs = [("temperature", "hour"), ("hour", "temperature"), ("temperature", "temperature"),
             ("hour", "hour"), ("load_lag_1h", "hour")]
    return round6(X.shap_interaction_table(tm.point, rows, FEATURES, pairs, trees=_trees(spark, sf_dir)))


@register("friedman_h")
def q_friedman_h(spark, sf_dir):
    tm = trained(spark, sf_dir)
    rows = _test(spark, sf_dir)
    pairs = [(a, b) for a in ("temperature", "hour", "load_lag_1h") for b in ("temperature", "hour", "load_lag_1h")]
    inter = X.shap_interaction_table(tm.point, rows, FEATURES, pairs, trees=_trees(spark, sf_dir))
    return round6(X.friedman_h(inter))


@register("all_interactions")
def q_all_interactions(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(X.all_interactions(tm.point, _test(spark, sf_dir), FEATURES, _shap(spark, sf_dir), top_n=10))


@register("lime_explain")
def q_lime(spark, sf_dir):
    tm = trained(spark, sf_dir)
    fe = feature_table(spark, sf_dir)
    rows = _test(spark, sf_dir)
    return round6(X.lime_explain(tm.point, fe, FEATURES, rows))


@register("pdp_1d")
def q_pdp_1d(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(X.pdp_1d(tm.point, feature_table(spark, sf_dir), "temperature"))


@register("pdp_2d")
def q_pdp_2d(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(X.pdp_2d(tm.point, feature_table(spark, sf_dir), "temperature", "hour"))


@register("pdp_ci")
def q_pdp_ci(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(X.pdp_ci(tm.point, feature_table(spark, sf_dir), "temperature"))


def _ice(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return X.ice(tm.point, feature_table(spark, sf_dir), "temperature")


@register("ice")
def q_ice(spark, sf_dir):
    return round6(_ice(spark, sf_dir))


@register("ice_summary")
def q_ice_summary(spark, sf_dir):
    return round6(X.ice_summary(_ice(spark, sf_dir)))


@register("ice_centered")
def q_ice_centered(spark, sf_dir):
    return round6(X.ice_centered(_ice(spark, sf_dir)))


@register("ice_decile")
def q_ice_decile(spark, sf_dir):
    tm = trained(spark, sf_dir)
    return round6(X.ice_decile(tm.point, feature_table(spark, sf_dir), "temperature"))


@register("xai_rank_compare_model")
def q_xai_model(spark, sf_dir):
    """SHAP / LIME / gain / permutation importances of the trained model,
    ranked per method, plus Kendall W over the four rankings."""
    tm = trained(spark, sf_dir)
    fe = feature_table(spark, sf_dir)
    shap = X.shap_global(_shap(spark, sf_dir)).select(F.lit("SHAP").alias("method"), "feature",
                                                      F.col("mean_abs_shap").alias("score"))
    lime = X.lime_explain(tm.point, fe, FEATURES, _test(spark, sf_dir), top=len(FEATURES)) \
            .groupBy("feature").agg(F.avg(F.abs("weight")).alias("score")).select(F.lit("LIME").alias("method"),
                                                                                  "feature", "score")
    gain = M.feature_importance(tm.point, FEATURES).select(F.lit("Gain").alias("method"), "feature",
                                                           F.col("importance").alias("score"))
    perm = X.permutation_importance(tm.point, fe, FEATURES).select(F.lit("Permutation").alias("method"),
                                                                       "feature", "score")
    # methods x features rows, read three times below: materialise once
    from ..session import cut_lineage
    imp = cut_lineage(shap.unionByName(lime).unionByName(gain).unionByName(perm))
    from ..operators import joins as jn
    ranks = jn.importance_union(imp)
    return round6(met.xai_rank_compare(ranks))


@register("explanation_report")
def q_explanation_report(spark, sf_dir):
    """Per test prediction: top 5 factors, positive / negative top 5 and the
    template text, one row per prediction."""
    tm = trained(spark, sf_dir)
    te = M.predict_batch(tm, _test(spark, sf_dir))
    contrib = _shap(spark, sf_dir).join(te.select("row_id"), "row_id")
    def _top5(cond, name):
        w = Window.partitionBy("row_id").orderBy(F.abs("shap_value").desc(), F.col("feature"))
        t = contrib.filter(cond).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 5)
        return t.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("_k", "feature"))), lambda x: x["feature"]), ",").alias(name))
    top = _top5(F.lit(True), "top_features").join(_top5(F.col("shap_value") > 0, "top_positive"), "row_id", "left") \
        .join(_top5(F.col("shap_value") < 0, "top_negative"), "row_id", "left")
    summ = rep.contribution_summary(contrib)
    p = te.select("row_id", "datetime", F.col("predicted_load").alias("prediction"), "temperature", "hour",
                  "day_of_week", "is_workday", "load_lag_1h")
    text = rep.explanation_text(p, contrib)
    return round6(p.join(top, "row_id").join(summ, "row_id").join(text, "row_id"))


def _pair_explain(spark, sf_dir, offset_hours):
    tm = trained(spark, sf_dir)
    fe = feature_table(spark, sf_dir)
    preds = M.predict_batch(tm, fe).select("row_id", "datetime", "predicted_load", "temperature", "is_workday")
    contrib = _shap(spark, sf_dir)
    test_ids = _test(spark, sf_dir).select("row_id")
    pairs = cmp.offset_pairs(preds.select("row_id", "datetime"), offset_hours).join(
        test_ids.withColumnRenamed("row_id", "row2"), "row2")
    changes = cmp.feature_change(contrib, pairs)
    factors = cmp.key_factors(changes)
    top10 = changes.filter(F.col("rank") <= 10).groupBy("pair_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("top_changes"))
    p1 = preds.select(F.col("row_id").alias("row1"), F.col("predicted_load").alias("prediction1"),
                      F.col("temperature").alias("temperature1"), F.col("is_workday").alias("is_workday1"))
    p2 = preds.select(F.col("row_id").alias("row2"), F.col("predicted_load").alias("prediction2"),
                      F.col("temperature").alias("temperature2"), F.col("is_workday").alias("is_workday2"))
    j = pairs.join(p1, "row1").join(p2, "row2").join(factors, "pair_id", "left").join(top10, "pair_id", "left") \
        .withColumns({"key_drivers": F.coalesce("key_drivers", F.array().cast("array<string>")),
                      "key_reducers": F.coalesce("key_reducers", F.array().cast("array<string>"))})
    d = F.col("prediction2") - F.col("prediction1")
    out = j.select("pair_id", "row1", "row2", "prediction1", "prediction2", F.round(d, 2).alias("prediction_diff"),
                   F.coalesce(F.round(F.try_divide(d, F.col("prediction1")) * 100, 2), F.lit(0.0))
                   .alias("prediction_diff_pct"), "top_changes",
                   F.array_join("key_drivers", ",").alias("key_drivers"),
                   F.array_join("key_reducers", ",").alias("key_reducers"), rep.pair_text(j).alias("explanation"))
    return round6(out)


@register("period_pair_explain")
def q_period_pair(spark, sf_dir):
    """Each test hour against the same hour one day earlier: prediction
    change, top 10 changed features, drivers / reducers and the pair text."""
    return _pair_explain(spark, sf_dir, 24)


@register("period_pair_explain_last_week")
def q_period_pair_week(spark, sf_dir):
    """The same against the same hour one week earlier."""
    return _pair_explain(spark, sf_dir, 168)


# ------------------------------------------------------------------ flagships
@register("insights_bundle")
def q_insights_bundle(spark, sf_dir):
    """Trends of the last 168 processed hours, anomalies of the test predictions with
    their causes, lagged correlations up to 12 h and the summary over all of them
    (counts and first lines), as one long table; cells that a section does not have are null."""
    from ..operators import windows as win
    h = feature_table(spark, sf_dir)
    # each is listed, counted and summarised: bounded by 168 hours, the test rows and the lags
    trends = cut_lineage(insight.trend_runs(win.tail_n(h.select("datetime", "load"), 168), min_duration=3))
    tm = trained(spark, sf_dir)
    te = M.predict_batch(tm, _test(spark, sf_dir)).select(
        "datetime", F.col("load").alias("actual_load"), "predicted_load", "temperature", "load_lag_1h", "month",
        "is_holiday", "is_weekend")
    anoms = cut_lineage(insight.anomaly_insights(te))
    corr = cut_lineage(insight.lagged_correlation(h, "load", "temperature", max_lag=12, min_abs=0.0))
    # top-k first (bounded TakeOrderedAndProject), then rank the k rows
    t5 = trends.orderBy("start_time").limit(5)
    a10 = anoms.orderBy("severity_rank", "datetime").limit(10)
    t = t5.select(F.lit("trend").alias("section"), F.row_number().over(
        _w("start_time")).alias("rank"), F.col("trend_type").alias("label"),
        F.col("change_rate").alias("value"), F.col("start_time").alias("datetime"),
        F.col("duration").cast("long").alias("duration"), "confidence")
    a = a10.select(F.lit("anomaly").alias("section"), F.row_number().over(
        _w("severity_rank", "datetime")).alias("rank"), F.col("severity").alias("label"),
        F.col("error_percentage").alias("value"), "datetime", "anomaly_type",
        F.array_join("possible_causes", "; ").alias("text"))
    c = corr.select(F.lit("correlation").alias("section"), F.col("rank"), F.format_string("lag %d", F.col("lag"))
                    .alias("label"), F.col("correlation").alias("value"),
                    "feature1", "feature2", F.col("lag").cast("long").alias("lag"),
                    F.format_string("%s and %s: r = %.3f at a lag of %d h", "feature1", "feature2", "correlation", "lag")
                    .alias("text"))
    s = rep.insight_summary(trends, anoms, corr).crossJoin(
        F.broadcast(anoms.agg(F.count(F.lit(1)).alias("n_anomalies"))))
    lines = {"n_trends": "top_trends", "n_anomalies": "top_anomalies", "n_high_anomalies": None,
             "n_medium_anomalies": None, "n_correlations": "top_correlations"}
    s = s.select(F.lit("summary").alias("section"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("rank"), F.lit(n).alias("label"), F.col(n).cast("double").alias("value"),
                 (F.col(text) if text else F.lit(None).cast("string")).alias("text"))
        for k, (n, text) in enumerate(lines.items(), 1)])))
    out = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), [t, a, c, s])
    return round6(out.select("section", "rank", "label", "value", "datetime", "duration", "confidence", "anomaly_type",
                             "feature1", "feature2", "lag", "text"))


def _w(*cols):
    from pyspark.sql import Window
    return Window.orderBy(*cols)


@register("series_report")
def q_series_report(spark, sf_dir):
    """Sections of the analysis report as ``(section_no, section, line_no,
    line)``: statistics, accuracy, anomalies with causes, drivers,
    recommendations."""
    from ..operators import anomaly as an
    from ..operators import profile as prof
    h = fx.hourly(spark, sf_dir)
    preds = fx.predictions_naive(spark, sf_dir)
    stats = prof.series_statistics(h)
    acc = prof.accuracy_stats(preds)
    dev = an.root_cause_rules(an.deviation_scan(preds, top=10))
    drivers = prof.top_drivers(fx.hourly_indexed(spark, sf_dir).drop("row_id"), min_abs=0.0)
    nh = an.deviation_scan(preds, top=None).agg(
        F.count_if(F.col("severity").isin("high", "critical")).alias("n_high"))
    recs = rep.template_recommendations(stats, drivers.filter(F.col("rank") == 1), nh)
    s1 = stats.select(F.lit(1).alias("section_no"), F.lit("Statistics").alias("section"), F.posexplode(F.array(
        F.format_string("Mean load %.2f MW, std %.2f MW", F.col("mean"), F.col("std")),
        F.format_string("Range %.2f .. %.2f MW, median %.2f MW", F.col("min"), F.col("max"), F.col("median")),
        F.format_string("Workday mean %.2f MW, weekend mean %.2f MW", F.col("workday_mean"),
                        F.col("weekend_mean")))).alias("line_no", "line"))
    s2 = acc.select(F.lit(2).alias("section_no"), F.lit("Accuracy").alias("section"), F.lit(0).alias("line_no"),
                    F.format_string("MAE %.2f, RMSE %.2f, MAPE %.2f%%, R2 %.3f", F.col("mae"), F.col("rmse"),
                                    F.col("mape"), F.col("r2")).alias("line"))
    s3 = dev.select(F.lit(3).alias("section_no"), F.lit("Anomalies").alias("section"),
                    F.row_number().over(_w("datetime")).alias("line_no"),
                    F.format_string("%s %s deviation %.1f%%: %s", F.col("datetime").cast("string"),
                                    F.col("severity"), F.col("deviation_pct"), F.col("root_cause")).alias("line"))
    s4 = drivers.filter(F.col("rank") <= 5).select(F.lit(4).alias("section_no"), F.lit("Drivers").alias("section"),
                                                   F.col("rank").alias("line_no"),
                                                   F.format_string("%s r = %.3f", F.col("feature"),
                                                                   F.col("correlation")).alias("line"))
    s5 = recs.select(F.lit(5).alias("section_no"), F.lit("Recommendations").alias("section"),
                     F.col("rank").alias("line_no"), F.col("recommendation").alias("line"))
    body = s1.unionByName(s2).unionByName(s3).unionByName(s4).unionByName(s5)
    return rep.sections_markdown(body)
