"""Merkle manifest of a table: parent-linked run rows, and proofs by a recursive query.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a language, by id, form a
tree: while several nodes remain, ``FAN`` consecutive ones are hashed to their parent.
What remains is the language's subroot; the subroots form the top tree in the same way,
and what remains there is the root.

A built level is stored as one row a run of siblings: its key (tree, level, block), the
children's digests side by side, and the link to the run that its own digest belongs to.
A proof is a climb of a recursive query: it starts with a leaf's digest (the tampered one,
where there is one), and each step joins the climbers with their runs, appends a row with
the siblings met there, folds them with the digest, and follows the link.

Positions come from a range partitioning, so a frequent language is many tasks.  A run near
the root is met by all leaves below it; it is stored once for every ``PER_COPY`` of them,
and the climbers are dealt over the copies, so no key of the join has more climbers.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.plans.ordered import with_row_index

from .frames import Tables, cut_lineage

FAN, PER_COPY = 8, 4096
TOP = -1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Trees up to which the table of trees is broadcast; beyond, it is joined.
BROADCAST_TREES = 10000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def digest(data: Column) -> Column:
    """32 bytes: SHA-256 of a text."""
    return F.unhex(F.sha2(data, 256))


def hex_text(digests: Column) -> Column:
    """Digests side by side as the hex text that is hashed."""
    return F.lower(F.hex(digests))


def leaf_digest(fields: list[Column]) -> Column:
    """H over the fields: ``-`` for null, else the byte count, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return digest(F.concat(*[part(c) for c in fields]))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


@dataclass
class Manifest:
    """leaves: tree, pos, doc_id, leaf, other (a second digest or null), up_tree, up_level, up_block, place, up_copies.
    runs: tree, level, block, salt, kids, and the same link.  trees: tree, lang, n, subroot.  root: hex, None without leaves."""

    leaves: DataFrame
    runs: DataFrame
    trees: DataFrame
    root: str | None
    tables: Tables


def _copies(leaves: Column) -> Column:
    return F.ceil(leaves / PER_COPY).cast("long")


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of the nodes (tree, pos, digest, leaves, n) of one level, with their digests."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])      # FAN at most
    g = nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("block")).agg(
        kids.alias("k"), F.sum("leaves").alias("leaves"), F.first("n").alias("below"))
    blob = F.aggregate("k", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return g.select("tree", F.lit(level).alias("level"), "block", blob.alias("kids"), "leaves", F.ceil(F.col("below") / FAN).cast("long").alias("n")).withColumn("digest", digest(hex_text(F.col("kids"))))


def _levels(nodes: DataFrame, tables: Tables) -> tuple[list[DataFrame], DataFrame | None]:
    """The runs of each level, and (tree, digest) of each tree's last node."""
    runs, last = [], None
    while True:
        ended = nodes.where("n = 1").select("tree", "digest")
        last = ended if last is None else last.unionByName(ended)
        nodes = nodes.where("n > 1")
        if not nodes.limit(1).count():
            return runs, last
        runs.append(tables.store(_runs(nodes, len(runs))))
        nodes = runs[-1].select("tree", F.col("block").alias("pos"), "digest", "leaves", "n")


def build(docs: DataFrame, other: Column | None = None, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> Manifest:
    """Build the manifest of ``docs``.  ``other``: a second text for the last of ``fields`` (null: the
    row is not changed), whose digest ``climb`` can fold in place of the leaf's.

    Leaves of a group ascend by id (null first), rows of one id by their digest; groups ascend by
    name (null first).  Columns that are not in ``fields`` are left out, whatever their names."""
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = docs.select(F.col(group_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("doc_id"),
                       leaf_digest([F.col(c) for c in fields]).alias("leaf"),
                       (F.lit(None).cast("binary") if other is None else F.when(other.isNotNull(), leaf_digest([*[F.col(c) for c in fields[:-1]], other]))).alias("other"))
    rows = tables.store(rows)
    placed = tables.store(with_row_index(rows, ["doc_id", "leaf"], ["lang"], "pos"))
    named = with_row_index(placed.groupBy("lang").agg(F.count("*").alias("n")), ["lang"], idx="tree")
    named = tables.store(named.withColumn("tree", F.col("tree").cast("long")))
    n_trees = named.count()
    small = F.broadcast if n_trees <= BROADCAST_TREES else lambda x: x
    leaves = tables.store(placed.alias("p").join(small(named.alias("t")), F.col("p.lang").eqNullSafe(F.col("t.lang"))).select(
        "tree", F.col("pos").cast("long").alias("pos"), "doc_id", "leaf", "other", "n"))

    levels, last = _levels(leaves.select("tree", "pos", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("leaves"), "n"), tables)
    subroots = tables.store(named.join(last, "tree").select("tree", "lang", "n", F.col("digest").alias("subroot")))
    tops, root = _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"),
                                         F.col("n").alias("leaves"), F.lit(n_trees).cast("long").alias("n")), tables)
    root = root.select(hex_text(F.col("digest"))).first()

    upper = None                                       # leaves below each top run: not to be told from its place
    for t in tops:
        t = t.select("level", "block", F.lit(TOP).cast("long").alias("tree"), "leaves")
        upper = t if upper is None else upper.unionByName(t)

    def above_top(frame: DataFrame, level: Column, node: Column) -> DataFrame:
        """Link each node of the top tree (its position on ``level``) to its run there, if any."""
        f = frame.withColumns({"_l": level.cast("int"), "_b": F.floor(node / FAN), "place": F.pmod(node, F.lit(FAN)).cast("int")})
        if upper is None:
            return f.withColumns({"up_tree": F.lit(None).cast("long"), "up_level": F.lit(None).cast("int"), "up_block": F.lit(None).cast("long"), "up_copies": F.lit(1).cast("long")}).drop("_l", "_b")
        u = upper.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("block").alias("up_block"), _copies(F.col("leaves")).alias("up_copies"))
        return f.join(u, (F.col("_l") == F.col("up_level")) & (F.col("_b") == F.col("up_block")), "left").drop("_l", "_b")

    links = tables.store(above_top(subroots, F.lit(0), F.col("tree")).select(
        F.col("tree").alias("of"), "n", F.struct("up_tree", "up_level", "up_block", "place", "up_copies").alias("top")))

    def linked(frame: DataFrame, level: int, node: str) -> DataFrame:
        """Link the nodes of ``level`` (0: leaves) of the trees to their runs, subroots to the top tree."""
        span, over = FAN ** level, FAN ** (level + 1)
        more, block = F.col("t.n") > span, F.floor(F.col(node) / FAN)
        inner = F.struct(F.col("tree").alias("up_tree"), F.lit(level).alias("up_level"), block.alias("up_block"), F.pmod(F.col(node), F.lit(FAN)).cast("int").alias("place"),
                         _copies(F.least(F.lit(over), F.col("t.n") - block * over)).alias("up_copies"))
        return frame.drop("n").join(small(links.alias("t")), F.col("tree") == F.col("t.of")).withColumn("up", F.when(more, inner).otherwise(F.col("t.top"))).select(*[c for c in frame.columns if c != "n"], "up.*")

    parts = [linked(r.select("tree", "level", "block", "kids", "leaves"), i + 1, "block") for i, r in enumerate(levels)]
    parts += [above_top(r.select("tree", "level", "block", "kids", "leaves"), F.lit(i + 1), F.col("block")) for i, r in enumerate(tops)]
    names = ["tree", "level", "block", "kids", "leaves", "up_tree", "up_level", "up_block", "place", "up_copies"]
    runs = None
    for p in parts:
        p = p.select(*names)
        runs = p if runs is None else runs.unionByName(p)
    if runs is None:
        runs = spark.createDataFrame([], "tree long, level int, block long, kids binary, leaves long, up_tree long, up_level int, up_block long, place int, up_copies long")
    runs = runs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("leaves")) - 1)))
    return Manifest(linked(leaves, 0, "pos"), tables.store(runs), subroots, root[0] if root else None, tables)


@contextmanager
def _all_rows(spark: SparkSession):
    """A recursion ends with an error at a million rows unless told otherwise."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before) if before is not None else spark.conf.unset(ROW_LIMIT)


CLIMB = """
WITH RECURSIVE climb (tree, pos, step, siblings, fold, run_tree, run_level, run_block, place, salt) AS (
  SELECT tree, pos, 0, CAST('' AS BINARY), coalesce(other, leaf), up_tree, up_level, up_block, place, pos % up_copies
  FROM {leaves}
  UNION ALL
  SELECT tree, pos, step, concat(older, younger),
         unhex(sha2(lower(hex(concat(older, fold, younger))), 256)), up_tree, up_level, up_block, place, pos % up_copies
  FROM (SELECT c.tree, c.pos, c.step + 1 AS step, c.fold,
               substring(r.kids, 1, 32 * c.place) AS older, substring(r.kids, 32 * c.place + 33) AS younger,
               r.up_tree, r.up_level, r.up_block, r.place, r.up_copies
        FROM climb c JOIN {runs} r ON r.tree = c.run_tree AND r.level = c.run_level AND r.block = c.run_block AND r.salt = c.salt))
SELECT tree, pos, step, siblings, fold FROM climb"""


def climb(m: Manifest) -> DataFrame:
    """(tree, pos, proof, folded) of each leaf: its siblings' digests, level by level and left to
    right, and the root (hex) that its ``other`` digest, else its own, folds to with them."""
    spark = m.leaves.sparkSession
    with _all_rows(spark):
        steps = m.tables.store(spark.sql(CLIMB, leaves=m.leaves.select("tree", "pos", "leaf", "other", "up_tree", "up_level", "up_block", "place", "up_copies"), runs=m.runs))
    way = steps.groupBy("tree", "pos").agg(F.array_sort(F.collect_list(F.struct("step", "siblings", "fold"))).alias("way"))      # a row a level
    return way.select("tree", "pos", F.aggregate("way", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["siblings"])).alias("proof"),
                      hex_text(F.element_at("way", -1)["fold"]).alias("folded"))


def verify(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Each row's proof is climbed with the row's digest, or where ``other`` is not null with that of
    the row with this text; ``verified`` tells whether the root comes out.  Null fields are
    hashed as ``-``, so that they differ from empty ones.  Rows without id come first in their
    language, rows without language form the first tree; repeated rows are leaves of their own.
    An empty table gives an empty result."""
    m = build(docs, other)
    small = F.broadcast if m.trees.count() <= BROADCAST_TREES else lambda x: x
    trees = m.trees.select(F.col("tree").alias("_t"), "subroot")
    out = m.leaves.select("tree", "pos", "doc_id", "leaf").join(climb(m), ["tree", "pos"]).join(small(trees), F.col("tree") == F.col("_t"))
    root = F.lit(m.root).cast("string")
    out = cut_lineage(out.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), root.alias("root"),
                                 F.sha2(hex_text(F.col("proof")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified")))
    m.tables.clear()
    return out


def tampered_text(id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> Column:
    """The text with A-Z lower-cased where ``every`` divides the CRC-32 of the decimal id; null
    where the row is left alone (also without id)."""
    return F.when(F.crc32(F.col(id_col).cast("string")) % every == 0, lowered(F.col(text_col)))


def manifest_sql(every: int = 3) -> str:
    """The same rows in DuckDB."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(c) for c in FIELDS[:-1]) + f", coalesce(strlen({text}) || ':' || {text}, '-')))"
    return f"""
WITH RECURSIVE crc AS (
  SELECT doc_id AS i, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ord(s)) AS BIGINT[])),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents)),
leaves AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf,
         CASE WHEN crc % {every} = 0 AND text IS NOT NULL THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents LEFT JOIN crc ON i = doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree (lang, level, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // {FAN}),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top (level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subs
  UNION ALL
  SELECT level + 1, pos // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // {FAN}),
heights AS (SELECT lang, max(level) AS height FROM tree GROUP BY lang),
nodes AS (
  SELECT t.lang, t.level, t.pos, t.h, FALSE AS upper FROM tree t WHERE t.n > 1
  UNION ALL SELECT NULL, level, pos, h, TRUE FROM top WHERE n > 1),
runs AS (SELECT lang, upper, level, pos // {FAN} AS run, list(h ORDER BY pos) AS kids FROM nodes GROUP BY ALL),
climb (doc_id, lang, doc_pos, step, level, upper, pos, fold, siblings) AS (
  SELECT p.doc_id, p.lang, p.pos, 0, 0, p.n = 1, CASE WHEN p.n = 1 THEN s.pos ELSE p.pos END, coalesce(other, leaf), ''
  FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT c.doc_id, c.lang, c.doc_pos, step + 1,
         CASE WHEN NOT c.upper AND c.level + 1 = g.height THEN 0 ELSE c.level + 1 END,
         c.upper OR c.level + 1 = g.height,
         CASE WHEN NOT c.upper AND c.level + 1 = g.height THEN s.pos ELSE c.pos // {FAN} END,
         sha256(concat(array_to_string(kids[1:c.pos % {FAN}], ''), fold, array_to_string(kids[c.pos % {FAN} + 2:], ''))),
         concat(array_to_string(kids[1:c.pos % {FAN}], ''), array_to_string(kids[c.pos % {FAN} + 2:], ''))
  FROM climb c JOIN runs r ON r.upper = c.upper AND r.level = c.level AND r.run = c.pos // {FAN} AND (c.upper OR r.lang IS NOT DISTINCT FROM c.lang)
  JOIN subs s ON s.lang IS NOT DISTINCT FROM c.lang JOIN heights g ON g.lang IS NOT DISTINCT FROM c.lang),
proofs AS (SELECT lang, doc_pos, string_agg(siblings, '' ORDER BY step) AS proof, arg_max(fold, step) AS folded FROM climb GROUP BY 1, 2),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed p JOIN proofs f ON f.lang IS NOT DISTINCT FROM p.lang AND f.doc_pos = p.pos JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang, root"""
