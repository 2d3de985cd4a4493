"""Trie of conversation prefixes by van Emde Boas recursion.

A conversation is a sequence of turns.  A trie of height h is cut at half depth: the upper
trie holds the first h/2 turns, and below each of its cut prefixes hangs a lower trie.  All
tries of one height are worked on together, as rows of one table.

*Naming.*  Blocks of ``BASE`` turns get a name (a digest); two neighbouring blocks give
the name of the block of double length, and so on up.  Then the cuts are named from the top
down: the prefix at the middle of a trie is named by the trie's root and the name of the
upper half's block.  A conversation of n turns is about n / BASE rows, which halve with each
level, so the work does not grow with the height, and a long conversation is many rows.
Inside a block, the names follow one by one.

*Grafting.*  Totals of subtrees are first summed inside tries of height ``BASE``.  Where two
heights are joined, the total of each lower trie's root is added to its ancestors in the
upper trie: a node is added to h/2 ancestors for every level whose cut it is, which
are about (nodes / 2) additions a level instead of one for every pair of a node and an ancestor.

Equal prefixes are told by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import Tables, cut_lineage, partitions

BASE = 4
LEAD = 9                    # a conversation opens with crc32 modulo LEAD turns of another one
FAMILY = 5
PIECE_ROWS = 1024           # turns of a conversation that meet under one key
PIECE_CHARS = 4096          # characters of a piece of a list of members
ROOT = b"\x00" * 16


def _name(tag: str, *parts: Column) -> Column:
    """16 bytes that name the parts, apart for each kind of node."""
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(tag).cast("binary"), *parts), 256), 1, 32))


def ordered_turns(convs: DataFrame, tables: Tables) -> DataFrame:
    """(c, at, token, bytes): the turns of each conversation by turn (null first), then role and text.

    Null role or text is empty.  Rows without conv_id belong to no conversation."""
    rows = convs.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("x")).where("c IS NOT NULL")
    ranged = rows.repartitionByRange("c", "t", "r", "x").sortWithinPartitions("c", "t", "r", "x")      # a hot conversation is many ranges
    token = _name("t", F.octet_length("r").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("r").cast("binary"), F.col("x").cast("binary"))
    held = tables.store(ranged.select("c", token.alias("token"), F.octet_length("x").cast("long").alias("bytes"),
                                      F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    parts = held.groupBy("p", "c").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("p").alias("pp"), F.col("c").alias("cc"), (before - F.col("first")).alias("shift"))
    return held.join(parts, (F.col("p") == F.col("pp")) & (F.col("c") == F.col("cc"))).select("c", (F.col("m") + F.col("shift")).alias("at"), "token", "bytes")


def rebuilt(turns: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like their family's first: (c, pos, token, bytes) and (c, len).

    c opens with the first h turns of c - c % 5 and goes on with its own after its first h,
    h = crc32(decimal c) % 9."""
    sizes = tables.store(turns.groupBy("c").agg(F.count("*").alias("n")))
    h = F.crc32(F.col("c").cast("string")) % LEAD
    of = sizes.select("c", "n", h.alias("h"), (F.col("c") - F.pmod("c", F.lit(FAMILY))).alias("s"))
    there = sizes.select(F.col("c").alias("s"), F.col("n").alias("sn"))
    plan = tables.store(of.join(there, "s", "left").withColumn("lead", F.least("h", F.coalesce("sn", F.lit(0)))))
    opening = turns.where(F.col("at") < LEAD - 1).select(F.col("c").alias("s"), "at", "token", "bytes")     # FAMILY conversations take it at most
    lead = plan.select("c", "s", "h").join(opening, "s").where("at < h").select("c", F.col("at").alias("pos"), "token", "bytes")
    piece = lambda at: F.floor(at / PIECE_ROWS)
    shifts = plan.select(F.col("c").alias("cc"), "h", "lead", F.explode(F.sequence(F.lit(0).cast("long"), piece(F.col("n") - 1))).alias("piece"))
    rest = turns.join(shifts, (F.col("c") == F.col("cc")) & (piece(F.col("at")) == F.col("piece"))).where("at >= h").select(
        "c", (F.col("at") - F.col("h") + F.col("lead")).alias("pos"), "token", "bytes")
    return lead.unionByName(rest), plan.select("c", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def prefixes(turns: DataFrame, lengths: DataFrame, tables: Tables) -> DataFrame:
    """(c, d, name, above, bytes, ends) for every prefix of d turns of every conversation.

    above: the name of the prefix one turn shorter, where it stands in the same block (else null);
    bytes: of the last turn's text; ends: the conversation has no more turns."""
    toks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token", "bytes"))), lambda x: F.struct(x["token"], x["bytes"]))    # BASE at most
    chunks = tables.store(turns.groupBy("c", F.floor(F.col("pos") / BASE).alias("blk")).agg(toks.alias("toks")))
    longest = lengths.agg(F.max("len")).first()[0] or 0
    whole = F.aggregate("toks", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["token"]))
    levels = [chunks.where(F.size("toks") == BASE).select("c", "blk", _name("b", whole).alias("block"), F.element_at("toks", -1)["bytes"].alias("last"))]
    while BASE << len(levels) <= longest:
        # two halves of the next block; names of blocks of other heights have another tag
        pair = F.array_sort(F.collect_list(F.struct("blk", "block", "last")))
        up = levels[-1].groupBy("c", F.floor(F.col("blk") / 2).alias("up")).agg(pair.alias("two")).where(F.size("two") == 2)
        levels.append(tables.store(up.select("c", F.col("up").alias("blk"), _name(f"b{len(levels)}", F.col("two")[0]["block"], F.col("two")[1]["block"]).alias("block"),
                                             F.col("two")[1]["last"].alias("last"))))
    roots = lengths.select("c", F.lit(0).cast("long").alias("blk"), F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("bytes"))
    for level in reversed(levels):
        # the upper half of each trie, whole: its last prefix is the root of a lower trie
        upper = level.where(F.col("blk") % 2 == 0).select(F.col("c").alias("cc"), (F.col("blk") / 2).cast("long").alias("bb"), "block", "last")
        both = F.array(F.struct((F.col("blk") * 2).alias("blk"), "name", "bytes"),
                       F.struct((F.col("blk") * 2 + 1).alias("blk"), _name("p", F.col("name"), F.col("block")).alias("name"), F.col("last").alias("bytes")))
        roots = roots.join(upper, (F.col("c") == F.col("cc")) & (F.col("blk") == F.col("bb")), "left").select(
            "c", F.inline(F.when(F.col("block").isNotNull(), both).otherwise(F.slice(both, 1, 1))))
    own = roots.join(chunks.select(F.col("c").alias("cc"), F.col("blk").alias("bb"), "toks"), (F.col("c") == F.col("cc")) & (F.col("blk") == F.col("bb")), "left")
    own = own.select("c", "blk", "name", "bytes", F.coalesce("toks", F.array().cast("array<struct<token:binary,bytes:bigint>>")).alias("toks"))
    node = "struct<i:int,name:binary,above:binary,bytes:bigint>"
    first = F.array(F.struct(F.lit(0).alias("i"), F.col("name"), F.lit(None).cast("binary").alias("above"), F.col("bytes"))).cast(f"array<{node}>")
    step = lambda a, x: F.concat(a, F.array(F.struct(F.size(a).alias("i"), _name("n", F.element_at(a, -1)["name"], x["token"]).alias("name"),
                                                     F.element_at(a, -1)["name"].alias("above"), x["bytes"].alias("bytes"))).cast(f"array<{node}>"))
    seen = own.select("c", "blk", F.size("toks").alias("size"), F.explode(F.aggregate(F.slice("toks", 1, BASE - 1), first, step)).alias("e"))
    return tables.store(seen.select("c", (F.col("blk") * BASE + F.col("e.i")).alias("d"), "e.name", "e.above", "e.bytes", ((F.col("size") < BASE) & (F.col("e.i") == F.col("size"))).alias("ends")))


def _added(totals: DataFrame, parts: DataFrame, tables: Tables) -> DataFrame:
    """Totals with the sums of the parts (c, d, leaves, saved, name) added to their nodes."""
    more = parts.groupBy(F.col("name").alias("to")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    return tables.store(totals.join(more, F.col("name") == F.col("to"), "left").select(
        "name", "conv_id", "depth", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))


def graft(nodes: DataFrame, names: DataFrame, tables: Tables) -> DataFrame:
    """(name, conv_id, depth, leaves, saved) summed over subtrees, from those of single nodes."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    path = names.select(F.col("c").alias("pc"), F.col("d").alias("pd"), "name")

    def onto(roots: DataFrame, top: Column, above: DataFrame) -> DataFrame:
        """Each root's totals, once for every ancestor from depth ``top`` on; the path is that of its least member."""
        far = roots.select("conv_id", "leaves", "saved", F.explode(F.sequence(top, F.col("depth") - 1)).alias("at"))
        return far.join(above, (F.col("conv_id") == F.col("pc")) & (F.col("at") == F.col("pd"))).select("name", "leaves", "saved")

    inside = nodes.where(F.col("depth") % BASE > 0)
    totals = _added(nodes, onto(inside, F.col("depth") - F.col("depth") % BASE, path), tables)
    half = BASE
    while half <= deepest:
        cut = totals.where(F.col("depth") % (2 * half) == half)
        totals = _added(totals, onto(cut, F.col("depth") - half, path.where(F.col("pd") % (2 * half) < half)), tables)
        half *= 2
    return totals


def member_digests(ends: DataFrame) -> DataFrame:
    """(name, sha): SHA-256 of the members' decimal ids, ascending, with commas between.

    A digest is a chain over the whole list.  Ranges of members, in order, first write pieces of
    text; then one task hashes a node's pieces as they come, a batch at a time."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size, done = None, None, [], 0, []

        def flush():
            if ids:
                done.append((node, first, ",".join(ids)))
        for batch in batches:
            for name, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node or size > PIECE_CHARS:
                    flush()
                    node, first, ids, size = name, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield rows(done)
            done.clear()
        flush()
        yield rows(done)

    def rows(found):
        cols = list(zip(*found)) if found else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["name", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["to", "sha"])
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = name, hashlib.sha256()
                sha.update(ids.encode())
            yield out()
            done.clear()
        if node is not None:
            done.append((node, sha.hexdigest()))
        yield out()

    pieces = ends.select("name", "c").repartitionByRange("name", "c").sortWithinPartitions("name", "c").mapInArrow(write, "name binary, first long, ids string")
    return pieces.repartition(partitions(ends.sparkSession), "name").sortWithinPartitions("name", "first").mapInArrow(digest, "to binary, sha string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per trie node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Members of a node are the rebuilt conversations that start with its turns, those without
    turns at the root included.  Turns order by turn (null first), then role and text, so that ties and
    repeated rows have one order; null role or text is empty.  Rows without conv_id form no
    conversation.  An empty table gives an empty result.  Other columns are left out."""
    tables = Tables(convs.sparkSession)
    turns = tables.store(ordered_turns(convs, tables))
    seqs, lengths = rebuilt(turns, tables)
    lengths = tables.store(lengths)
    names = prefixes(seqs, lengths, tables)
    nodes = tables.store(names.groupBy("name").agg(F.min("c").alias("conv_id"), F.first("d").alias("depth"), F.count("*").alias("n_convs"),
                                                   F.min("above").alias("above"), F.max("bytes").alias("bytes")))
    # the parent of a block's first prefix is the last one of the block before
    edge = nodes.where((F.col("depth") % BASE == 0) & (F.col("depth") > 0)).select(F.col("name").alias("of"), F.col("conv_id").alias("ec"), (F.col("depth") - 1).alias("ed"))
    edge = edge.join(names.where(F.col("d") % BASE == BASE - 1).select("c", "d", "name"), (F.col("ec") == F.col("c")) & (F.col("ed") == F.col("d"))).select("of", F.col("name").alias("last"))
    nodes = tables.store(nodes.join(edge, F.col("name") == F.col("of"), "left").select("name", "conv_id", "depth", "n_convs", "bytes", F.coalesce("above", "last").alias("parent")))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("k"))
    nodes = tables.store(nodes.join(children, F.col("name") == F.col("p"), "left").select("name", "conv_id", "depth", "n_convs", "bytes", "parent", F.coalesce("k", F.lit(0)).alias("n_children")))
    single = nodes.select("name", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = graft(single, names, tables).select(F.col("name").alias("t"), "leaves", "saved")
    up = nodes.select(F.col("name").alias("u"), F.col("conv_id").alias("parent_conv_id"))
    sha = member_digests(names.where("ends"))
    out = nodes.join(totals, F.col("name") == F.col("t")).join(up, F.col("parent") == F.col("u"), "left").join(sha, F.col("name") == F.col("to"), "left")
    out = cut_lineage(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                                 F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
    tables.clear()
    return out


def trie_sql() -> str:
    """The same rows in DuckDB."""
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ord(s)) AS BIGINT[])),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % {LEAD} AS h
  FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT crc.c, 0 AS part, t.i, r, x FROM crc JOIN t ON t.c = crc.c - ((crc.c % {FAMILY}) + {FAMILY}) % {FAMILY} AND t.i < h
  UNION ALL SELECT crc.c, 1, t.i, r, x FROM crc JOIN t ON t.c = crc.c AND t.i >= h),
seqs AS (SELECT crc.c, coalesce(list([r, x] ORDER BY part, i) FILTER (WHERE r IS NOT NULL), []) AS seq FROM crc LEFT JOIN turns USING (c) GROUP BY 1),
prefix AS (SELECT c, d, seq[1:d] AS pre, len(seq) = d AS ends FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM seqs)),
node AS (
  SELECT d, pre, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(pre[d][2]) END AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefix GROUP BY d, pre),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM node n LEFT JOIN node p ON p.d = n.d - 1 AND p.pre = n.pre[1:n.d - 1]),
kids AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT l.*, coalesce(k, 0) AS n_children FROM linked l LEFT JOIN kids ON kids.d = l.d AND kids.pre = l.pre),
under AS (SELECT a AS d, pre[1:a] AS pre, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
          FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1, 2)
SELECT conv_id, CAST(own.d AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM own JOIN under ON under.d = own.d AND under.pre = own.pre"""
