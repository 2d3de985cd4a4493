"""Validation checks; every check yields rows
``(check, column, status, n_bad, detail)`` with status passed / warning / error.

A check is a set of aggregates and the report rows made of their values, so checks that look at
single rows share one aggregate pass (partial + final).  ``validate_all`` reads its input once:
duplicates and gaps are comparisons with the row before in a stored, range-partitioned order, and
all checks are one aggregate over that table.  (Observed metrics would ride on the scan, too, but they
are accumulators: a task that runs again, or the sampling pass of a range partitioning, counts twice.)
Schema checks need no rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ordered as o

# ---- fixed values ---------------------------------------------------------
REQUIRED_COLUMNS = ["datetime", "load", "temperature", "humidity"]
OPTIONAL_COLUMNS = ["day_of_week", "is_holiday"]
RANGE_RULES = {"load": (0, 100000), "temperature": (-50, 60), "humidity": (0, 100),
               "hour": (0, 23), "day_of_week": (0, 6)}
DTYPE_RULES = {"datetime": ("timestamp", "timestamp_ntz"),
               "load": ("double", "float", "bigint", "int"),
               "temperature": ("double", "float", "bigint", "int"),
               "humidity": ("double", "float", "bigint", "int")}
MAX_MISSING_PCT = 10.0
MIN_ROWS = 100
MIN_RANGES_WARN = {"temperature": (-50, 60), "humidity": (0, 100)}
# ---------------------------------------------------------------------------

SCHEMA = "check string, column string, status string, n_bad bigint, detail string"


def _row(check: str, column: str | None, status: Column | str, n_bad: Column | int | None,
         detail: Column | str) -> Column:
    lit = lambda v: F.lit(v) if not isinstance(v, Column) else v
    return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                    lit(status).alias("status"), lit(n_bad).cast("bigint").alias("n_bad"),
                    lit(detail).cast("string").alias("detail"))


def _explode(agg: DataFrame, rows: list[Column]) -> DataFrame:
    if not rows:
        return agg.sparkSession.createDataFrame([], SCHEMA)
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _schema_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Results that the schema alone gives: no scan."""
    return df.sparkSession.createDataFrame(rows, SCHEMA)


@dataclass
class Check:
    """Aggregates over the checked table, and the report rows made of their values."""

    aggs: list[Column]
    rows: list[Column]


def _report(df: DataFrame, *checks: Check, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of all checks from one aggregate (a row of aggregates a series, with ``keys``)."""
    aggs, rows = [a for c in checks for a in c.aggs], [r for c in checks for r in c.rows]
    if not rows:
        return df.sparkSession.createDataFrame([], SCHEMA)
    agg = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    return agg.select(*keys, F.explode(F.array(*rows)).alias("_found")).select(*keys, "_found.*")


def _column_rows(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> list[tuple]:
    rows = [("columns", c, "passed", 0, "present") if c in df.columns else ("columns", c, "error", 1, "required column missing") for c in required]
    return rows + [("columns", c, "warning", 1, "optional column missing") for c in optional if c not in df.columns]


def validate_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS,
                     optional: Sequence[str] = OPTIONAL_COLUMNS) -> DataFrame:
    return _schema_rows(df, _column_rows(df, required, optional))


def _dtype_rows(df: DataFrame, rules: dict) -> list[tuple]:
    types, rows = dict(df.dtypes), []
    for c, allowed in rules.items():
        if c in types:
            ok = types[c] in allowed
            rows.append(("dtypes", c, "passed" if ok else "warning", 0 if ok else 1,
                         f"type {types[c]}" + ("" if ok else f", expected one of {list(allowed)}")))
    return rows


def validate_dtypes(df: DataFrame, rules: dict | None = None) -> DataFrame:
    return _schema_rows(df, _dtype_rows(df, rules or DTYPE_RULES))


def _ranges(df: DataFrame, rules: dict) -> Check:
    aggs, rows = [], []
    for c, (lo, hi) in rules.items():
        if c not in df.columns:
            continue
        x = F.col(c)
        aggs += [F.count(x).alias(f"n_{c}"), F.count_if((x < lo) | (x > hi)).alias(f"o_{c}"),
                 F.min(x).alias(f"mn_{c}"), F.max(x).alias(f"mx_{c}")]
        n, out = F.col(f"n_{c}"), F.col(f"o_{c}")
        status = F.when(n == 0, "warning").when(out > 0, "error").otherwise("passed")
        detail = (F.when(n == 0, F.lit("no valid data"))
                   .when(out > 0, F.format_string(f"%d values outside [{lo}, {hi}]", out))
                   .otherwise(F.format_string("range ok: [%s, %s]", F.col(f"mn_{c}").cast("string"),
                                              F.col(f"mx_{c}").cast("string"))))
        rows.append(_row("ranges", c, status, out, detail))
    return Check(aggs, rows)


def validate_ranges(df: DataFrame, rules: dict | None = None) -> DataFrame:
    return _report(df, _ranges(df, rules or RANGE_RULES))


def _missing(columns: Sequence[str], max_pct: float) -> Check:
    aggs, rows = [F.count(F.lit(1)).alias("n_rows")], []
    for c in columns:
        m = F.col(f"m_{c}")
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"m_{c}"))
        pct = m / F.col("n_rows") * 100
        status = F.when(m == 0, "passed").when(pct > max_pct, "error").otherwise("warning")
        detail = F.when(m == 0, F.lit("no missing values")).otherwise(F.format_string("%d missing (%.2f%%)", m, pct))
        rows.append(_row("missing", c, status, m, detail))
    return Check(aggs, rows)


def validate_missing(df: DataFrame, max_pct: float = MAX_MISSING_PCT) -> DataFrame:
    return _report(df, _missing(df.columns, max_pct))


def _key_duplicates(name: str, n: Column) -> Column:
    return _row("duplicates", name, F.when(n > 0, "error").otherwise("passed"), n, F.format_string("%d duplicate records on key", n))


def _row_duplicates(n: Column) -> Column:
    return _row("duplicates", None, F.when(n > 0, "warning").otherwise("passed"), n, F.format_string("%d fully duplicated rows", n))


def validate_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                        time_col: str = "datetime") -> DataFrame:
    subset = list(subset or ([time_col] if time_col in df.columns else []))
    more = lambda cols: df.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("d"))
    out = more(df.columns).select(_row_duplicates(F.col("d")).alias("r"))
    if subset:
        out = more(subset).select(_key_duplicates(",".join(subset), F.col("d")).alias("r")).unionByName(out)
    return out.select("r.*")


def _hours_since(time_col: str, before: Column) -> Column:
    return (F.unix_timestamp(F.col(time_col)) - F.unix_timestamp(before)) / 3600.0


def _gaps(time_col: str, limit: float) -> Check:
    """Over rows with ``_gap``, the hours since the row before."""
    n, largest = F.col("n_gaps"), F.col("largest_gap")
    return Check([F.count_if(F.col("_gap") > limit).alias("n_gaps"), F.max("_gap").alias("largest_gap")],
                 [_row("continuity", time_col, F.when(n > 0, "warning").otherwise("passed"), n,
                       F.when(n > 0, F.format_string("%d gaps, largest %.1f hours", n, largest)).otherwise(F.lit("continuous")))])


def validate_continuity(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
                        expected_hours: float = 1, max_gap_hours: float | None = None) -> DataFrame:
    """Gaps between consecutive times; with ``keys`` one row (with the key columns) a series."""
    keys = list(keys)
    lo = o.layout(df.select(*keys, time_col), time_col, keys, halo=1)
    d = lo.finish(lo.df.withColumn("_gap", _hours_since(time_col, F.lag(time_col, 1).over(lo.window))))
    return _report(d, _gaps(time_col, max_gap_hours or expected_hours * 2), keys=keys)


def _consistency(df: DataFrame, time_col: str) -> Check:
    cols = set(df.columns)
    aggs, rows = [], []

    def add(name: str, col: str, agg: str, bad: Column, text: str) -> None:
        n = F.col(agg)
        aggs.append(F.count_if(bad).alias(agg))
        rows.append(_row(f"consistency:{name}", col, F.when(n > 0, "warning").otherwise("passed"), n,
                         F.when(n > 0, F.format_string("%d rows: " + text, n)).otherwise(F.lit("consistent"))))
    if {"is_weekend", "is_holiday"} <= cols:
        add("weekend_holiday", "is_holiday", "c_weekend", F.col("is_weekend") & ~F.col("is_holiday"), "weekend rows not marked holiday")
    if {"hour", time_col} <= cols:
        add("hour_matches_time", "hour", "c_hour", F.col("hour") != F.hour(time_col), "hour differs from the time stamp")
    if {"day_of_week", time_col} <= cols:
        add("dow_matches_time", "day_of_week", "c_dow", F.col("day_of_week") != F.weekday(time_col), "day_of_week differs from the time stamp")
    return Check(aggs, rows)


def validate_consistency(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    return _report(df, _consistency(df, time_col))


def validate_all(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """All checks.  With a time column the input is read once: its rows are stored in the order of the time and
    the other columns, where a duplicate stands next to its like and a gap next to its end."""
    schema = _column_rows(df, REQUIRED_COLUMNS, OPTIONAL_COLUMNS) + _dtype_rows(df, DTYPE_RULES)
    checks = [Check([], [_row(*r) for r in schema]), _ranges(df, RANGE_RULES), _missing(df.columns, MAX_MISSING_PCT), _consistency(df, time_col)]
    if time_col not in df.columns:
        return _report(df, *checks).unionByName(validate_duplicates(df, time_col=time_col))
    lo = o.layout(o.with_row_index(df, [time_col, *[c for c in df.columns if c != time_col]]), time_col, halo=1, indexed=True)
    before = lambda c: F.lag(c, 1).over(lo.window)
    equal = lambda cols: reduce(Column.__and__, [F.col(c).eqNullSafe(before(c)) for c in cols])
    follows = before(F.lit(True)).isNotNull()
    d = lo.finish(lo.df.withColumns({"_gap": _hours_since(time_col, before(time_col)), "_same_time": follows & equal([time_col]), "_same_row": follows & equal(df.columns)}))
    twice = Check([F.count_if("_same_time").alias("n_same_time"), F.count_if("_same_row").alias("n_same_row")],
                  [_key_duplicates(time_col, F.col("n_same_time")), _row_duplicates(F.col("n_same_row"))])
    return _report(d, *checks, twice, _gaps(time_col, 2))


def validation_summary(report: DataFrame) -> DataFrame:
    """Counts per status and ``is_valid = (errors == 0)``."""
    return report.agg(F.count_if(F.col("status") == "passed").alias("passed"),
                      F.count_if(F.col("status") == "warning").alias("warnings"),
                      F.count_if(F.col("status") == "error").alias("errors")
                      ).withColumn("is_valid", F.col("errors") == 0)


def validate_minimum(df: DataFrame) -> DataFrame:
    """Minimum checks for loaded data: required columns, load >= 0, load
    not all null, temperature / humidity ranges (warnings), >= 100 rows."""
    missing = [c for c in ("datetime", "load") if c not in df.columns]
    if missing:
        return _schema_rows(df, [("minimum", c, "error", 1, "required column missing") for c in missing])
    aggs = [F.count(F.lit(1)).alias("n"), F.count("load").alias("nl"), F.min("load").alias("mn")]
    for c, (lo, hi) in MIN_RANGES_WARN.items():
        if c in df.columns:
            aggs.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"r_{c}"))
    agg = df.agg(*aggs)
    rows = [
        _row("minimum", "load", F.when(F.col("nl") == 0, "error").otherwise("passed"),
             F.when(F.col("nl") == 0, 1).otherwise(0), F.lit("load has values")),
        _row("minimum", "load", F.when(F.col("mn") < 0, "error").otherwise("passed"),
             F.when(F.col("mn") < 0, 1).otherwise(0), F.format_string("min load %s", F.col("mn").cast("string"))),
        _row("minimum", None, F.when(F.col("n") < MIN_ROWS, "error").otherwise("passed"),
             F.when(F.col("n") < MIN_ROWS, 1).otherwise(0), F.format_string("%d rows", F.col("n"))),
    ]
    for c, (lo, hi) in MIN_RANGES_WARN.items():
        if c in df.columns:
            rows.append(_row("minimum", c, F.when(F.col(f"r_{c}") > 0, "warning").otherwise("passed"),
                             F.col(f"r_{c}"), F.lit(f"range [{lo}, {hi}]")))
    return _explode(agg, rows)


def needs_fill(df: DataFrame, columns: Sequence[str] = ("temperature", "humidity")) -> DataFrame:
    """Per weather column: absent or holding nulls -> needs a fill."""
    present = [c for c in columns if c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    rows = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in present else F.col("_n")).cast("bigint")
                     .alias("n_missing"), F.lit(c not in present).alias("absent"),
                     ((F.col(c) > 0) if c in present else F.lit(True)).alias("needs_fill"))
            for c in columns]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
