"""Oracles for the schema-level validation checks, the validation bundle,
the feature vector and the profile bundle (registered over the earlier
rows-only entries)."""

from __future__ import annotations

from ..operators import validation as val
from . import fixture_sql as fs
from .registry import ORACLE
from .q_features import _CF_SQL

_DUCK_TO_SPARK = ("CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
                  "WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
                  "WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(column_type) END")


def _describe(ctes: str, rel: str) -> str:
    return f"(SELECT column_name, {_DUCK_TO_SPARK} AS spark_type FROM (DESCRIBE (WITH {ctes.strip()} SELECT * FROM {rel})))"


def _columns_sql(d: str) -> str:
    req = " UNION ALL ".join(
        f"SELECT 'columns' AS \"check\", '{c}' AS \"column\", "
        f"CASE WHEN '{c}' IN (SELECT column_name FROM {d}) THEN 'passed' ELSE 'error' END AS status, "
        f"CAST(CASE WHEN '{c}' IN (SELECT column_name FROM {d}) THEN 0 ELSE 1 END AS BIGINT) AS n_bad"
        for c in val.REQUIRED_COLUMNS)
    opt = " UNION ALL ".join(
        f"SELECT 'columns', '{c}', 'warning', CAST(1 AS BIGINT) WHERE '{c}' NOT IN (SELECT column_name FROM {d})"
        for c in val.OPTIONAL_COLUMNS)
    return req + " UNION ALL " + opt


def _dtypes_sql(d: str) -> str:
    return " UNION ALL ".join(
        f"SELECT 'dtypes', '{c}', CASE WHEN spark_type IN ({', '.join(repr(t) for t in allowed)}) "
        f"THEN 'passed' ELSE 'warning' END, CAST(CASE WHEN spark_type IN ({', '.join(repr(t) for t in allowed)}) "
        f"THEN 0 ELSE 1 END AS BIGINT) FROM {d} WHERE column_name = '{c}'"
        for c, allowed in val.DTYPE_RULES.items())


def _ranges_sql(rel: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'ranges', '{c}', CASE WHEN count({c}) = 0 THEN 'warning' "
        f"WHEN count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) > 0 THEN 'error' ELSE 'passed' END, "
        f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) FROM {rel}"
        for c, (lo, hi) in val.RANGE_RULES.items() if c in cols)


def _missing_sql(rel: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'missing', '{c}', CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 'passed' "
        f"WHEN count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) > 10 THEN 'error' ELSE 'warning' END, "
        f"count(*) FILTER (WHERE {c} IS NULL) FROM {rel}" for c in cols)


def _dups_sql(rel: str) -> str:
    return (f"SELECT 'duplicates', 'datetime', CASE WHEN count(*) - count(DISTINCT datetime) > 0 THEN 'error' "
            f"ELSE 'passed' END, count(*) - count(DISTINCT datetime) FROM {rel} UNION ALL "
            f"SELECT 'duplicates', NULL, CASE WHEN d > 0 THEN 'warning' ELSE 'passed' END, d FROM "
            f"(SELECT (SELECT count(*) FROM {rel}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {rel})) AS d)")


def _continuity_sql(rel: str) -> str:
    return (f"SELECT 'continuity', 'datetime', CASE WHEN count(*) FILTER (WHERE g > 2) > 0 THEN 'warning' "
            f"ELSE 'passed' END, count(*) FILTER (WHERE g > 2) FROM (SELECT date_diff('second', "
            f"lag(datetime) OVER (ORDER BY datetime), datetime) / 3600.0 AS g FROM {rel})")


_NULLS_D = _describe(fs.HOURLY_NULLS, "hourly_nulls")
_ALL = " UNION ALL ".join([
    _columns_sql(_NULLS_D), _dtypes_sql(_NULLS_D),
    _ranges_sql("hourly_nulls", ["load", "temperature", "humidity"]),
    _missing_sql("hourly_nulls", ["datetime", "load", "temperature", "humidity"]),
    _dups_sql("hourly_nulls"), _continuity_sql("hourly_nulls")])

ORACLE["validate_columns"] = f"WITH {fs.HOURLY_NULLS.strip()} {_columns_sql(_NULLS_D)}"
_TEXT_D = ("(SELECT CASE column_name WHEN 'Datetime' THEN 'datetime' ELSE column_name END AS column_name, spark_type "
           "FROM " + _describe(fs.HOURLY + """,
hourly_text AS (
  SELECT strftime(datetime, '%Y-%m-%d %H:%M:%S') AS Datetime,
         CASE WHEN ((day(datetime) - 1) * 24 + hour(datetime)) % 50 = 49 THEN 'n/a' ELSE CAST(load AS VARCHAR) END AS load_MW,
         temperature AS db_temp, humidity AS rh FROM hourly)""", "hourly_text") + ")")
ORACLE["validate_dtypes"] = f"SELECT * FROM ({_dtypes_sql(_TEXT_D)}) t(\"check\", \"column\", status, n_bad)"
ORACLE["validate_all"] = f"WITH {fs.HOURLY_NULLS.strip()} SELECT * FROM ({_ALL}) t(\"check\", \"column\", status, n_bad)"
ORACLE["validation_summary"] = (
    f"WITH {fs.HOURLY_NULLS.strip()}, r AS (SELECT * FROM ({_ALL}) t(\"check\", \"column\", status, n_bad)) "
    "SELECT count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'warning') AS warnings, "
    "count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'error') = 0 AS is_valid FROM r")

_CF_BODY = __import__("gridlens.catalog.q_features", fromlist=["_CF_BODY"])._CF_BODY
_FEATS = __import__("gridlens.operators.features", fromlist=["FEATURES"]).FEATURES
ORACLE["feature_vector"] = (
    f"WITH {_CF_SQL.strip()}, pp AS ({_CF_BODY}) SELECT datetime, {len(_FEATS)} AS n_features, "
    f"round(CAST({' + '.join('CAST(' + c + ' AS DOUBLE)' for c in _FEATS)} AS DOUBLE), 6) AS vector_sum FROM pp")

_PROF_COLS = ["load", "temperature", "humidity"]
_DIST = " UNION ALL ".join(
    f"SELECT 'distribution' AS section, '{c}' AS name, m AS metric, v AS value FROM (SELECT "
    f"CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, "
    f"round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skew, "
    f"round(kurtosis({c}), 4) AS kurtosis FROM hourly_nulls) UNPIVOT (v FOR m IN (count, mean, std, min, q25, median, "
    f"q75, max, skew, kurtosis))" for c in _PROF_COLS)
_MISSP = " UNION ALL ".join(
    f"SELECT 'missing', '{c}', 'missing_count', CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) FROM hourly_nulls "
    f"UNION ALL SELECT 'missing', '{c}', 'missing_pct', round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) "
    f"FROM hourly_nulls" for c in ["datetime"] + _PROF_COLS)
_INFO = ("SELECT 'info', 'table', 'n_rows', CAST(count(*) AS DOUBLE) FROM hourly_nulls UNION ALL "
         "SELECT 'info', 'table', 'n_columns', 4.0 UNION ALL SELECT 'info', 'table', 'date_range_days', "
         "CAST(floor(date_diff('second', min(datetime), max(datetime)) / 86400) AS DOUBLE) FROM hourly_nulls")
_PATS = ("SELECT 'pattern:' || p, CAST(k AS VARCHAR), m, v FROM (SELECT CASE WHEN grouping(h) = 0 THEN 'hour' "
         "WHEN grouping(d) = 0 THEN 'day_of_week' ELSE 'month' END AS p, coalesce(h, d, mo) AS k, avg(load) AS mean, "
         "stddev_samp(load) AS std FROM (SELECT hour(datetime) AS h, isodow(datetime) - 1 AS d, month(datetime) AS mo, "
         "load FROM hourly_nulls) GROUP BY GROUPING SETS ((h), (d), (mo))) UNPIVOT (v FOR m IN (mean, std))")
ORACLE["data_profile"] = (
    f"WITH {fs.HOURLY_NULLS.strip()}, r(section, name, metric, value) AS ({_INFO} UNION ALL {_MISSP} UNION ALL {_DIST} UNION ALL {_PATS}) "
    "SELECT section, name, metric, CASE WHEN round(value, 6) = 0 THEN 0.0 ELSE round(value, 6) END AS value FROM r")

_PRED = fs.PRED
ORACLE["template_summary"] = f"""WITH {_PRED.strip()},
st AS (SELECT min(datetime) AS s, max(datetime) AS e, count(*) AS n, avg(load) AS mean, max(load) AS mx FROM hourly),
acc AS (SELECT avg(abs(actual_load - predicted_load) / abs(CASE WHEN actual_load = 0 THEN 1 ELSE actual_load END) * 100) AS mape,
               CASE WHEN sum((actual_load - (SELECT avg(actual_load) FROM pred)) ^ 2) = 0 THEN 0.0
                    ELSE 1 - sum((actual_load - predicted_load) ^ 2) / sum((actual_load - (SELECT avg(actual_load) FROM pred)) ^ 2) END AS r2
        FROM pred),
an AS (SELECT count(*) AS n_anomalies,
              count(*) FILTER (WHERE abs(actual_load - predicted_load) / predicted_load * 100 > 30) AS n_high
       FROM pred WHERE predicted_load <> 0 AND abs(actual_load - predicted_load) / predicted_load * 100 > 15)
SELECT concat_ws(' ',
  printf('This report covers %s to %s with %d records.', CAST(st.s AS VARCHAR), CAST(st.e AS VARCHAR), st.n),
  printf('Mean load was %.2f MW with a peak of %.2f MW.', st.mean, st.mx),
  printf('The forecast''s mean absolute percentage error is %.1f%%, R2 %.3f.', acc.mape, coalesce(acc.r2, 0.0)),
  CASE WHEN an.n_anomalies > 0 THEN printf('%d anomalies were detected, %d of them need attention.', an.n_anomalies, an.n_high) END
) AS summary
FROM st, acc, an"""
