"""Ordered windows over long series without funnelling a series into one task.

A window ``ORDER BY time`` with no partition key plans to
``Exchange SinglePartition``; a window ``PARTITION BY series`` puts a hot
series into one task.  This module replaces both with a layout that keeps
every task bounded:

1. ``with_row_index`` — exact 0-based position of each row inside its series
   in time order.  The table is range-partitioned on ``(keys, order)`` (so a
   hot series is split across many partitions), sorted inside partitions,
   checkpointed to the shared checkpoint folder, and per-partition counts
   become offsets (a table with one row per (partition, series) pair).
2. ``Layout`` — rows are grouped into chunks of ``chunk`` consecutive rows;
   the last ``halo`` rows of each chunk are copied into the next chunk.  A
   window ``PARTITION BY (keys, _chunk) ORDER BY _idx`` is then exact for
   any look-back of at most ``halo`` rows (lags, rolling means).
3. Unbounded look-back (forward / backward fill, running sums) is computed
   per chunk and corrected with a one-row-per-chunk carry table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..session import cut_lineage

IDX = "_idx"
CHUNK = "_chunk"
HALO = "_halo"
_PID = "_pid"
_MID = "_mid"


def _key_cond(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column | None:
    cond = None
    for c in cols:
        term = left[c].eqNullSafe(right[c])
        cond = term if cond is None else cond & term
    return cond


def with_row_index(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                   idx: str = IDX, partitions: int | None = None,
                   checkpoint: bool = True) -> DataFrame:
    """Add ``idx`` = position of the row inside its series ordered by ``order``.

    Order columns should be unique inside a series for a deterministic
    result (time stamps of a regular series are)."""
    keys = list(keys)
    sort_cols = keys + list(order)
    # without an explicit count AQE may merge adjacent ranges to its target
    # size (order is kept: merged partitions are consecutive key ranges)
    ranged = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    ranged = (ranged.sortWithinPartitions(*sort_cols)
                .withColumn(_PID, F.spark_partition_id())
                .withColumn(_MID, F.monotonically_increasing_id()))
    if checkpoint:
        # fixes partition layout + ids; lineage cut into the shared folder
        ranged = cut_lineage(ranged)
    counts = ranged.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias("_n"),
                                              F.min(_MID).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, *keys, "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    if not keys:
        # one row per partition: size bounded by the partition count
        offsets = F.broadcast(offsets)
    o = offsets.alias("o")
    r = ranged.alias("r")
    cond = r[_PID] == o[_PID]
    kc = _key_cond(r, o, keys)
    if kc is not None:
        cond = cond & kc
    out = r.join(o, cond, "inner").select(
        "r.*", (F.col("o._off") + F.col("r." + _MID) - F.col("o._first")).alias(idx))
    return out.drop(_PID, _MID)


@dataclass
class Layout:
    """A series table laid out in chunks with halo copies.

    ``df`` holds original rows (``_halo = false``) plus halo copies; compute
    window columns with ``self.window`` and call ``finish`` to drop the
    copies and helper columns."""

    df: DataFrame
    keys: list
    chunk: int
    halo: int

    @property
    def window(self) -> Window:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(IDX)

    def finish(self, df: DataFrame, keep_index: bool = False) -> DataFrame:
        out = df.filter(~F.col(HALO)).drop(HALO, CHUNK)
        return out if keep_index else out.drop(IDX)

    def core(self) -> DataFrame:
        return self.df.filter(~F.col(HALO))


def layout(df: DataFrame, time_col: str = "datetime", keys: Sequence[str] = (),
           halo: int | None = None, chunk: int | None = None,
           indexed: bool = False) -> Layout:
    """Row-index ``df`` (unless ``indexed``) and add chunk / halo columns."""
    halo = DEFAULTS.halo_rows if halo is None else halo
    chunk = chunk or DEFAULTS.chunk_rows
    if chunk < halo:
        raise ValueError("chunk must be >= halo")
    keys = list(keys)
    base = df if indexed else with_row_index(df, [time_col], keys)
    own = base.withColumn(CHUNK, F.floor(F.col(IDX) / chunk)).withColumn(HALO, F.lit(False))
    parts = own
    if halo > 0:
        copies = (base.filter(F.pmod(F.col(IDX), F.lit(chunk)) >= chunk - halo)
                      .withColumn(CHUNK, F.floor(F.col(IDX) / chunk) + 1)
                      .withColumn(HALO, F.lit(True)))
        parts = own.unionByName(copies)
    return Layout(parts, keys, chunk, halo)


def carry_join(df: DataFrame, carry: DataFrame, keys: list) -> DataFrame:
    a, b = df.alias("a"), carry.alias("b")
    cond = F.col("a." + CHUNK) == F.col("b." + CHUNK)
    kc = _key_cond(a, b, keys)
    if kc is not None:
        cond = cond & kc
    extra = [c for c in carry.columns if c not in keys and c != CHUNK]
    return a.join(b, cond, "left").select("a.*", *[F.col("b." + c) for c in extra])


def fill_forward(core: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                 backward: bool = False, suffix: str = "") -> DataFrame:
    """Last (or next, with ``backward``) non-null value per column along
    ``_idx`` — exact across chunk borders through a carry table.

    ``core`` must carry ``_idx`` and ``_chunk`` and no halo copies."""
    keys = list(keys)
    if backward:
        w = Window.partitionBy(*keys, CHUNK).orderBy(IDX).rowsBetween(0, Window.unboundedFollowing)
        cw = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
        pick, pick_by = F.first, F.min_by
    else:
        w = Window.partitionBy(*keys, CHUNK).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
        cw = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        pick, pick_by = F.last, F.max_by
    aggs = [pick_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(IDX))).alias("_e_" + c)
            for c in cols]
    ends = core.groupBy(*keys, CHUNK).agg(*aggs)
    carry = ends.select(*keys, CHUNK, *[pick(F.col("_e_" + c), ignorenulls=True).over(cw)
                                        .alias("_c_" + c) for c in cols])
    out = carry_join(core, carry, keys)
    # one projection: a step per column would have the whole plan analysed again for each
    out = out.withColumns({c + suffix: F.coalesce(pick(F.col(c), ignorenulls=True).over(w), F.col("_c_" + c))
                           for c in cols})
    return out.drop(*["_c_" + c for c in cols])


def padded_layout(df: DataFrame, col: str, out_col: str, halo: int, time_col: str = "datetime",
                  keys: Sequence[str] = (), chunk: int | None = None, indexed: bool = False) -> Layout:
    """A layout whose rows also carry ``out_col``: the last non-null ``col`` up to the row,
    however far back (through the carry table, so not limited by chunk or halo)."""
    lo = layout(df, time_col, keys, halo=0, chunk=chunk, indexed=indexed)
    filled = fill_forward(lo.core(), [col], keys, suffix=out_col).withColumnRenamed(col + out_col, out_col)
    return layout(filled.drop(CHUNK, HALO), time_col, keys, halo=halo, chunk=chunk, indexed=True)


def running_sum(core: DataFrame, col: str, out_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Running sum of ``col`` along ``_idx`` (inclusive), exact across chunks."""
    keys = list(keys)
    w = Window.partitionBy(*keys, CHUNK).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    cw = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tot = core.groupBy(*keys, CHUNK).agg(F.sum(col).alias("_t"))
    carry = tot.select(*keys, CHUNK, F.coalesce(F.sum("_t").over(cw), F.lit(0)).alias("_c_sum"))
    out = carry_join(core, carry, keys)
    return out.withColumn(out_col, F.coalesce(F.sum(col).over(w), F.lit(0)) + F.col("_c_sum")).drop("_c_sum")
