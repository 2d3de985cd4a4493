"""Exact quantiles by distributed selection.

Spark's exact ``percentile`` merges every distinct value of a group in the final task; for
a group the size of a column that is unbounded.  A sort of the whole column is much more
than a few order statistics need.  Here the ranks of the wanted order statistics are looked
for in narrowing ranges of values.  A round cuts each open range at some of its values (a
mergeable sketch gives about ``CUTS`` of them), counts the rows at and between the cuts, and
keeps only the parts that hold a wanted rank.  A frequent value becomes a cut, and a
cut is a part of its own, so ties end the search instead of blocking it.  Ranges of at most
``RANGE_ROWS`` rows are counted value by value.  The sketch only chooses the cuts; all counts are
exact, so the result is, whatever it chose.

No row is sorted or stored, and what is shuffled are counts.  Between two order statistics
the value is interpolated linearly, as pandas ``quantile`` and SQL ``quantile_cont`` do.
``approx=True`` answers from the sketch alone."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a range whose values are counted one by one, in one task.
RANGE_ROWS = 200_000
CUTS = 256
#: Rows of a table of ranges or ranks up to which it is broadcast; beyond, it is joined.
BROADCAST_ROWS = 100_000


def _with(rows: DataFrame, small: DataFrame, keys: list[str], cond: Column) -> DataFrame:
    """Rows with the columns of ``small`` of their key (named ``_k0``, ``_k1``, ...) where ``cond`` holds."""
    for i, k in enumerate(keys):
        cond = F.col(k).eqNullSafe(F.col(f"_k{i}")) & cond
    if not keys or small.count() <= BROADCAST_ROWS:     # without keys there are two ranks a probability
        small = F.broadcast(small)
    return rows.join(small, cond).drop(*[f"_k{i}" for i in range(len(keys))])


def _named(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _values_at(vals: DataFrame, keys: list[str], ranks: DataFrame, largest: int) -> DataFrame:
    """(keys, _v, _first, _c): values that hold a wanted rank, the rank of their first row and their rows."""
    found, ranges = [], None        # ranges: _k.., _from, _to (open; null: unbounded), _below; None: all rows
    while largest > RANGE_ROWS:
        if ranges is None:
            inside = vals.select("*", F.lit(None).cast("double").alias("_from"), F.lit(None).cast("double").alias("_to"), F.lit(0).cast("long").alias("_below"))
        else:
            inside = _inside(vals, ranges, keys)
        one = [*keys, "_from", "_to", "_below"]
        cuts = cut_lineage(inside.groupBy(*one).agg(F.array_distinct(F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], 20 * CUTS)).alias("_s")))
        of = cuts.select(*_named(keys), F.col("_below").alias("_of"), "_s")
        # 2 i: between the cuts i - 1 and i, 2 i + 1: at cut i
        part = (2 * F.size(F.filter("_s", lambda s: s < F.col("_v"))) + F.array_contains("_s", F.col("_v")).cast("int")).alias("_i")
        counts = _with(inside, of, keys, F.col("_below") == F.col("_of")).groupBy(*one, "_s", part).agg(F.count(F.lit(1)).alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*one).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = counts.withColumn("_first", F.col("_below") + before)
        wanted = ranks.select(*_named(keys), "_want").distinct()
        kept = cut_lineage(_with(parts, wanted, keys, (F.col("_want") >= F.col("_first")) & (F.col("_want") < F.col("_first") + F.col("_c"))).drop("_want").distinct())
        at = F.col("_i") / 2
        found.append(kept.filter(F.col("_i") % 2 == 1).select(*keys, F.get("_s", F.floor(at).cast("int")).alias("_v"), "_first", "_c"))
        ranges = kept.filter(F.col("_i") % 2 == 0).select(
            *_named(keys), F.coalesce(F.get("_s", at.cast("int") - 1), F.col("_from")).alias("_from"), F.coalesce(F.get("_s", at.cast("int")), F.col("_to")).alias("_to"),
            F.col("_first").alias("_below"), "_c")
        largest = ranges.agg(F.max("_c")).first()[0] or 0
        if not largest:
            return reduce(DataFrame.unionByName, found)
    inside = vals.withColumn("_below", F.lit(0).cast("long")) if ranges is None else _inside(vals, ranges, keys)
    counts = inside.groupBy(*keys, "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_below").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found.append(counts.withColumn("_first", F.col("_below") + before).select(*keys, "_v", "_first", "_c"))
    return reduce(DataFrame.unionByName, found)


def _inside(vals: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    inner = (F.col("_from").isNull() | (F.col("_v") > F.col("_from"))) & (F.col("_to").isNull() | (F.col("_v") < F.col("_to")))
    return _with(vals, ranges.drop("_c"), keys, inner)


def quantiles(df: DataFrame, value_col: str, probs: Sequence[float], keys: Sequence[str] = (),
              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Long ``(keys, prob, quantile)`` of the non-null ``value_col``."""
    keys = list(keys)
    probs = [float(p) for p in probs]
    spark = df.sparkSession
    if approx:
        agg = df.groupBy(*keys).agg(F.percentile_approx(value_col, probs, accuracy).alias("_q"))
        return agg.select(*keys, F.posexplode("_q").alias("_i", "quantile")).select(
            *keys, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"), "quantile")
    vals = df.select(*keys, F.col(value_col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n = cut_lineage(vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0"))
    pos = n.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs]))).withColumn("_h", (F.col("_n") - 1) * F.col("prob"))
    pos = pos.select(*keys, "prob", (F.col("_h") - F.floor("_h")).alias("_f"),
                     F.explode(F.array_distinct(F.array(F.floor("_h").cast("long"), F.ceil("_h").cast("long")))).alias("_want"))
    values = _values_at(vals, keys, pos, n.agg(F.max("_n")).first()[0] or 0)
    wanted = pos.select(*_named(keys), "prob", "_f", "_want")
    met = _with(values, wanted, keys, (F.col("_want") >= F.col("_first")) & (F.col("_want") < F.col("_first") + F.col("_c")))
    at = met.groupBy(*keys, "prob").agg(F.min("_v").alias("_vlo"), F.max("_v").alias("_vhi"), F.first("_f").alias("_f"))
    between = F.col("_vlo") + F.col("_f") * (F.col("_vhi") - F.col("_vlo"))        # of equal infinities it would be no number
    return at.select(*keys, "prob", F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(between).alias("quantile"))


def quantile_columns(df: DataFrame, value_col: str, probs: dict[str, float], keys: Sequence[str] = (),
                     approx: bool = False) -> DataFrame:
    """Wide ``(keys, name1, name2, ...)`` — one column per named quantile."""
    keys = list(keys)
    long = quantiles(df, value_col, list(probs.values()), keys, approx)
    cols = [F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name) for name, p in probs.items()]
    if keys:
        return long.groupBy(*keys).agg(*cols)
    return long.agg(*cols)
