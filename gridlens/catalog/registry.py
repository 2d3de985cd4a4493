"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the DuckDB oracle (omit for operators that SQL cannot express)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double / float column (after all arithmetic)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = F.round(F.col(f.name), digits)
            # fold -0.0 into 0.0 so both engines hash zeros alike
            cols.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql(ctes: str, body: str, doubles: list[str] | tuple = ()) -> str:
    """``WITH <ctes> , _r AS (<body>) SELECT * REPLACE (round(d, 6) ...) FROM _r``."""
    ctes = ctes.strip()
    head = f"WITH {ctes},\n_r AS ({body})" if ctes else f"WITH _r AS ({body})"
    if doubles:
        rep = ", ".join(f"(CASE WHEN round(CAST({d} AS DOUBLE), 6) = 0 THEN 0.0 "
                        f"ELSE round(CAST({d} AS DOUBLE), 6) END) AS {d}" for d in doubles)
        return f"{head}\nSELECT * REPLACE ({rep}) FROM _r"
    return f"{head}\nSELECT * FROM _r"
