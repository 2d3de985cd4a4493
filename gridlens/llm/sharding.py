"""Extendible hashing of documents into shards of bounded bytes, in DataFrame operations only.

The directory is indexed by the leading bits of a document's hash.  All
documents start in one bucket; only a bucket over the byte limit is split, on
its next bit, until each fits.  The sizes of all buckets of all depths come from
one histogram of fine cells, added up bit by bit, so a shard's depth is the
least at which it fits.  Cells that are still too large are refined by further
bits, and rows that are equal in id and text, which no bit parts, are cut into
runs that fit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut_lineage

HASH_BITS = 60            # 15 hexadecimal digits
SPARE_BITS = 6            # cells per expected shard: 2 to this power
BROADCAST_CELLS = 100_000  # directories up to this size (a few MB) are broadcast, larger ones joined by shuffle


def key_hash(id_col: Column, text: Column) -> Column:
    """60 bits of a hash of id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, 15), 16, 10).cast("long")


def _cell(bits: int) -> Column:
    return F.shiftright("_h", HASH_BITS - bits)


def _prefix(cell: Column, bits: int, depth: Column) -> Column:
    """The first ``depth`` of the cell's ``bits`` bits, as text."""
    return F.substring(F.lpad(F.bin(cell), bits, "0"), F.lit(1), depth) if bits else F.lit("")


def _directory(rows: DataFrame, bits: int, limit: int, start: int) -> DataFrame:
    """(cell, depth, _same) of each cell of ``bits`` bits: the least depth from ``start`` at which its
    bucket fits (or holds one row), null if none does; ``_same``: all rows of the cell have one hash."""
    cells = cut_lineage(rows.groupBy(_cell(bits).alias("_cell")).agg(
        F.sum("_bytes").alias("_bytes"), F.count("*").alias("_rows"), (F.min("_h") == F.max("_h")).alias("_same")))
    levels = cells.select("_cell", "_bytes", "_rows", F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("depth"))
    level = levels.withColumn("_bucket", F.expr(f"shiftright(_cell, {bits} - depth)"))
    fits = level.groupBy("depth", "_bucket").agg(F.sum("_bytes").alias("b"), F.sum("_rows").alias("r")).where((F.col("b") <= limit) | (F.col("r") <= 1))
    depth = level.select("_cell", "depth", "_bucket").join(fits.select("depth", "_bucket"), ["depth", "_bucket"]).groupBy("_cell").agg(F.min("depth").alias("depth"))
    return cells.select("_cell", "_same").join(depth, "_cell", "left")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The input's ``columns`` (all by default), n_bytes, shard, depth and oversize of each row.

    ``shard`` is the hash prefix of the row's bucket; the rows of a shard hold at most
    ``limit`` bytes of text, unless it has a single row that alone is larger
    (``oversize``).  Equal rows that no hash bit parts get prefix.partition.run.  A null
    text has 0 bytes; a null id is hashed as empty text; an empty table gives an empty
    one.  Input columns named like the new ones are replaced."""
    new = ["n_bytes", "shard", "depth", "oversize"]
    keep = [c for c in (columns or docs.columns) if c not in new]
    # the input's columns travel as one struct, so that none of them, whatever its name, meets those of the plan
    rows = docs.select(F.struct(*keep).alias("_row"), key_hash(F.col(id_col), F.col(text_col)).alias("_h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    narrow = rows.select("_h", "_bytes")
    total = narrow.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    done, start = [], 0
    while True:
        directory = cut_lineage(_directory(narrow, bits, limit, start))
        size = directory.count()
        small = F.broadcast if size <= BROADCAST_CELLS else lambda x: x
        placed = rows.join(small(directory), _cell(bits) == F.col("_cell"))
        done.append(placed.where(F.col("depth").isNotNull()).withColumn("shard", _prefix(F.col("_cell"), bits, F.col("depth"))))
        large = directory.where(F.col("depth").isNull())
        if not large.limit(1).count():
            break
        stuck = F.col("_same") if bits < HASH_BITS else F.lit(True)
        runs = placed.where(F.col("depth").isNull() & stuck).withColumn("_part", F.spark_partition_id())
        order = Window.partitionBy("_h", "_part").orderBy("_bytes")      # equal rows of one input partition
        runs = runs.withColumn("_run", F.floor((F.row_number().over(order) - 1) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("_bytes", F.lit(1))))))
        done.append(runs.withColumn("shard", F.concat_ws(".", _prefix(F.col("_cell"), bits, F.lit(bits)), F.col("_part"), F.col("_run")))
                    .withColumn("depth", F.lit(bits)).select(*done[0].columns))
        if bits >= HASH_BITS or not large.where(~F.col("_same")).limit(1).count():
            break
        rows = placed.where(F.col("depth").isNull() & ~F.col("_same")).select("_row", "_h", "_bytes")
        narrow, start, bits = rows.select("_h", "_bytes"), bits + 1, min(HASH_BITS, bits + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], F.col("_bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), (F.col("_bytes") > limit).alias("oversize"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each written by one task."""
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_sql(limit: int, columns: str = "doc_id", table: str = "documents", levels: int = 26) -> str:
    """The same shards in DuckDB, for tables whose shards end within ``levels`` bits."""
    return f"""
WITH rows AS (
  SELECT {columns}, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM {table}),
bucket AS (SELECT d, h >> ({HASH_BITS} - d) AS b, sum(n_bytes) AS size, count(*) AS n FROM rows, (SELECT unnest(range(0, {levels + 1})) AS d) GROUP BY 1, 2),
leaf AS (SELECT r.h, min(k.d) AS depth FROM (SELECT DISTINCT h FROM rows) r
         JOIN bucket k ON k.b = r.h >> ({HASH_BITS} - k.d) AND (k.size <= {limit} OR k.n <= 1) GROUP BY 1)
SELECT {columns}, CAST(n_bytes AS BIGINT) AS n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), {HASH_BITS}, '0'), 1, CAST(depth AS INTEGER)) END AS shard,
       CAST(depth AS INTEGER) AS depth, n_bytes > {limit} AS oversize
FROM rows JOIN leaf USING (h)"""
