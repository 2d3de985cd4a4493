"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents stand one after another in an order fixed by a hash of
their content, and their words are packed into blocks of a fixed length.  The
targets say how many words each source gives; a source gives its blocks epoch
by epoch, in each epoch in the order of a pseudorandom permutation of its block
indices, and the last slot only as many words as the target still wants.  All
slots of all sources are dealt to the output shards by one pseudorandom
permutation of the slots, so each shard's source counts are a multinomial draw
that is conditioned on the sources' totals.  Slots meet documents by a join on
source and block index.

The permutations are Feistel networks over a grid of a x b >= n cells; values
outside n walk on until they are inside, so no table of a permutation exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut_lineage, partitions, words_count

# Weights of the sources in order, repeating; share of all words; most times a source is taken.
WEIGHTS = [5, 2, 1]
SHARE = 1.5
MOST = 2.0

BLOCK_WORDS = 512
SHARD_SLOTS = 1024
PIECE = 1024             # slots that one row is expanded to at once
TASK_SLOTS = 1 << 20     # slots that one task makes, about
BUCKET_ROWS = 4000       # documents in one running sum, about


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """Image of x (0 <= x < n) under the pseudorandom permutation of 0..n-1 that ``seed`` names."""
    a = F.greatest(F.ceil(F.sqrt(n)), F.lit(1))
    b = F.ceil(n / a)

    def rounds(v: Column) -> Column:
        left, right = F.floor(v / b), F.pmod(v, b)
        state = F.struct(left.alias("l"), right.alias("r"))
        for i in range(0, 4, 2):
            state = F.transform(F.array(state), lambda s, i=i: F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(seed, F.lit(i), s["r"]), a), a).alias("l"), s["r"].alias("r")))[0]
            state = F.transform(F.array(state), lambda s, i=i: F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(seed, F.lit(i + 1), s["l"]), b), b).alias("r")))[0]
        return (state["l"] * b + state["r"]).cast("long")

    x = x.cast("long")
    first = F.transform(F.array(x), rounds)[0]
    walk = F.aggregate(F.sequence(F.lit(0).cast("long"), (a * b - n).cast("long")), first, lambda at, _: F.when(at < n, at).otherwise(rounds(at)))
    return F.transform(F.array(first), lambda y: F.when(y < n, y).otherwise(walk))[0]


def source_targets(sizes: DataFrame, weights=None, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) plus weight and target: all words times ``share`` dealt by weight,
    where a target stops at ``most`` times its source and the excess goes to the others.

    With the sources in order of size per weight, the level per unit of weight that the
    rest reaches when the first i are full is largest at the right i, so two running
    sums over the table of sources give it.  That table has one row a source."""
    weights = weights or WEIGHTS
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("source", "source_size", "weight", F.least(F.col("source_size") * most, F.col("level") * F.col("weight")).alias("target"))


def positions(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, h, size, start): words of each row and its first word's place in its
    source's sequence.  Running sums are two-level: inside buckets of a content hash, and
    over the bucket totals of a source, so no task sees a whole source."""
    rows = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                                   F.xxhash64(text_col).alias("h"), words_count(F.col(text_col)).alias("size")))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("doc_id", "source", "h", "size", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))


def slots(targets: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(source, epoch, block, words, shard, slot): every block that the mix takes, how many of its
    words (from its first), and its place in the output."""
    size, want = F.col("source_size"), F.round("target").cast("long")
    t = targets.where(size > 0).select(
        "source", size.alias("S"), F.ceil(size / block).alias("nb"), F.floor(want / size).alias("full"), F.pmod(want, size).alias("rest"),
        F.xxhash64(F.col("source").isNull(), "source", F.lit(seed)).alias("key"))
    t = t.withColumn("K", F.col("full") * F.col("nb") + F.ceil(F.col("rest") / block)).where(F.col("K") > 0)
    every, earlier = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("N", F.sum("K").over(every)).withColumn("offset", F.coalesce(F.sum("K").over(earlier), F.lit(0)))
    pieces = t.withColumn("piece", F.explode(F.expr(f"sequence(0L, (K - 1) div {PIECE})")))
    # dealt by number: the pieces are few bytes, and adaptive execution would put them all in one task
    total = t.agg(F.max("N")).first()[0] or 0
    pieces = pieces.repartition(max(partitions(t.sparkSession), -(-total // TASK_SLOTS)), "source", "piece")
    k = pieces.withColumn("k", F.explode(F.expr(f"sequence(piece * {PIECE}, least(K, (piece + 1) * {PIECE}) - 1)")))
    k = k.withColumn("epoch", F.floor(F.col("k") / F.col("nb"))).withColumn("at", F.pmod("k", "nb"))
    last = F.col("nb") - 1                              # the block that may be short ends each epoch
    k = k.withColumn("block", F.when(F.col("at") == last, last).otherwise(permuted(F.col("at"), last, F.xxhash64("key", "epoch"))))
    length = F.when(F.col("block") == last, F.col("S") - last * block).otherwise(F.lit(block))
    words = F.when(F.col("epoch") < F.col("full"), length).otherwise(F.least(length, F.col("rest") - F.col("at") * block))
    j = permuted(F.col("offset") + F.col("k"), F.col("N"), F.lit(seed))
    return k.select("source", "epoch", "block", words.alias("words"), j.alias("j")).where(F.col("words") > 0).select(
        "source", "epoch", "block", "words", F.floor(F.col("j") / shard_slots).alias("shard"), F.pmod("j", F.lit(shard_slots)).alias("slot"))


def _drawn(placed: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """(doc_id, source, h, start, epoch, shard, slot, from_word, to_word): what each slot takes of each row, in words of the row."""
    end = F.col("start") + F.col("size")
    spans = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    p = plan.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "words", "shard", "slot")
    # neither side may be broadcast: their sizes are estimated from the few rows that they are expanded from
    met = spans.hint("merge").join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    low, high = F.greatest("start", F.col("block") * block), F.least(end, F.col("block") * block + F.col("words"))
    return met.withColumn("low", low).withColumn("high", high).where(F.col("high") > F.col("low")).select(
        "doc_id", "source", "h", "start", "size", "epoch", "shard", "slot", (F.col("low") - F.col("start")).alias("from_word"), (F.col("high") - F.col("start")).alias("to_word"))


def _planned(docs, id_col, text_col, source_col, weights, share, most, block, shard_slots, seed):
    placed = cut_lineage(positions(docs, id_col, text_col, source_col))
    targets = cut_lineage(source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    return placed, targets, _drawn(placed, slots(targets, block, shard_slots, seed), block)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None,
               share: float = SHARE, most: float = MOST, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, size (words), source_size, target (its source's) and
    taken (words the mix takes of it, repeats counted).

    Each source's taken words add up to its rounded target.  A null text has 0 words;
    null is a source of its own, the last; rows of one id stay rows of their own; an
    empty table gives an empty one."""
    placed, targets, drawn = _planned(docs, id_col, text_col, source_col, weights, share, most, block, shard_slots, seed)
    taken = drawn.groupBy(F.col("source").alias("s"), F.col("start").alias("a")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("a")) & (F.col("size") > 0)
    t = targets.select(F.col("source").alias("ts"), "source_size", "target")
    return (placed.join(taken, same, "left").join(t, F.col("source").eqNullSafe(F.col("ts")), "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None,
                  share: float = SHARE, most: float = MOST, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The mixed documents, with the input's columns: one row for each epoch in which a
    document is drawn, with the words drawn then (the whole text if all are; else the
    drawn runs of words with the white space before each word, joined by a new line)."""
    _, _, drawn = _planned(docs, id_col, text_col, source_col, weights, share, most, block, shard_slots, seed)
    parts = drawn.groupBy("doc_id", "source", "h", "start", "size", "epoch").agg(        # as many as the text has blocks
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("runs"), F.sum(F.col("to_word") - F.col("from_word")).alias("n"))
    parts = parts.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("h").alias("t"), (F.col("n") == F.col("size")).alias("whole"), "runs")
    # the input's columns travel as one struct, so that none of them, whatever its name, meets those of the plan
    once = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("from"), F.xxhash64(text_col).alias("hash"))
    once = once.dropDuplicates(["id", "from", "hash"])
    met = parts.join(once, F.col("id").eqNullSafe(F.col("i")) & F.col("from").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("t")))
    given = F.col("row").getField(text_col)
    words = F.regexp_extract_all(given, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    runs = F.aggregate("runs", F.array().cast("array<struct<from_word:bigint,to_word:bigint>>"), lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["to_word"] == r["from_word"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["from_word"].alias("from_word"), r["to_word"].alias("to_word")))))
        .otherwise(F.concat(done, F.array(r))))
    cut = F.array_join(F.transform(F.transform(F.array(words), lambda w: F.transform(
        runs, lambda r: F.array_join(F.slice(w, (r["from_word"] + 1).cast("int"), (r["to_word"] - r["from_word"]).cast("int")), "")))[0], lambda t: t), "\n")
    text = F.when(F.col("whole"), given).otherwise(cut)
    out = [text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return met.select(*out)
