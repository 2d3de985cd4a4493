"""URL filters by path-template trees, in DataFrame operations only.

Every URL's path, with its digit runs written as ``#``, is a walk from the root
of its host's tree.  In a node with many children, a child of a small share is
a variable segment and becomes the wildcard ``*``.  A child whose labelled
verdicts do not differ from its node's, statistically, is merged with its like
siblings into ``+``.  Both steps run a second time over the templates of the
first run, so that branches below new wildcards meet.  A template is rejected by
its smoothed labelled purity: the share of blocked URLs among its labelled ones,
drawn to the share of the same path's template in the tree of all hosts, and
that in turn to the share of all URLs.  The labels are the verdicts of the rules
(and, if given, of a column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import Tables

# Fixed values: (verdict, host, path) of the rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

VARIABLE_CHILDREN = 12    # children from which a node's small ones are variable
VARIABLE_SHARE = 0.2      # of the node's URLs, below which a child is small
SIMILAR_Z = 2.0           # standard errors within which a child is like its node
SMOOTHING = 4.0           # labelled URLs that the wider template's share counts as
BLOCK_FROM = 0.5          # blocked share that rejects a template

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain of it and the path's start."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):      # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


PATH = ["scope", "p1", "p2"]     # a path of a tree: 128 bits of hash, as its steps, one row each, would else carry the path once a segment


def path_hash(path: Column) -> list[Column]:
    return [F.xxhash64(path).alias("p1"), F.xxhash64(F.lit(1), path).alias("p2")]


def _generalise(paths: DataFrame) -> DataFrame:
    """(scope, p1, p2, segments, n, labelled, blocked) with segments made more general by one run over the trees.

    A node is named by the exclusive or of its walk's hashed (depth, segment) pairs, a running
    aggregate over the steps of a path, so that a path costs as much as it is long."""
    steps = paths.select(*PATH, "n", "labelled", "blocked", F.posexplode("segments").alias("depth", "segment"))
    earlier = Window.partitionBy(*PATH).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("node", F.coalesce(F.bit_xor(F.xxhash64("depth", "segment")).over(earlier), F.lit(0).cast("long")))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    child = steps.groupBy("scope", "depth", "node", "segment").agg(*sums)
    node = child.groupBy("scope", "depth", "node").agg(
        F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    rate = F.col("all_blocked") / F.greatest(F.col("all_labelled"), F.lit(1))
    off = F.abs(F.col("blocked") - F.col("labelled") * rate)
    general = (F.when((F.col("children") >= VARIABLE_CHILDREN) & (F.col("n") < VARIABLE_SHARE * F.col("all_n")), "*")
               .when((F.col("children") > 1) & (off <= 0.5 + SIMILAR_Z * F.sqrt(F.col("labelled") * rate * (1 - rate))), "+")
               .otherwise(F.col("segment")))
    symbols = child.join(node, ["scope", "depth", "node"]).select("scope", "depth", "node", "segment", general.alias("symbol"))
    return (steps.join(symbols, ["scope", "depth", "node", "segment"]).groupBy(*PATH)
            .agg(F.sort_array(F.collect_list(F.struct("depth", "symbol"))).alias("walk"),   # as long as the path is deep
                 *[F.first(c).alias(c) for c in ("n", "labelled", "blocked")])
            .select(*PATH, F.transform("walk", lambda x: x["symbol"]).alias("segments"), "n", "labelled", "blocked"))


def templates(judged: DataFrame) -> DataFrame:
    """(host, p1, p2, template, purity) of each path shape (by ``path_hash``) of each host, from
    (host, shape, labelled verdict) rows; ``purity`` is the smoothed blocked share.  The trees are
    built once: their table is read by the templates of the hosts, of all hosts, and the sums."""
    n = F.count("*").alias("n")
    seen = judged.groupBy("host", "shape").agg(n, F.count("label").alias("labelled"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("blocked"))
    scoped = seen.select(F.explode(F.array(F.concat(F.lit("h:"), "host"), F.lit("all"))).alias("scope"), F.col("shape").alias("path"), "n", "labelled", "blocked")
    scoped = scoped.groupBy("scope", "path").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    trees = _generalise(_generalise(scoped.select("scope", *path_hash(F.col("path")), F.split("path", "/").alias("segments"), "n", "labelled", "blocked")))
    trees = Tables(judged.sparkSession).store(trees.select(*PATH, F.concat_ws("/", "segments").alias("template"), "labelled", "blocked"))
    sums = trees.groupBy("scope", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("blocked").alias("t_blocked"))
    known = trees.select(*PATH, "template").join(sums, ["scope", "template"])
    everything = seen.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("all_share"))           # one row
    wide = known.where(F.col("scope") == "all").select("p1", "p2", F.col("t_blocked").alias("w_blocked"), F.col("t_labelled").alias("w_labelled"))
    wide = wide.crossJoin(F.broadcast(everything)).select(
        "p1", "p2", ((F.col("w_blocked") + SMOOTHING * F.col("all_share")) / (F.col("w_labelled") + SMOOTHING)).alias("wide_share"))
    own = known.where(F.col("scope") != "all").join(wide, ["p1", "p2"])
    return own.select(F.substr("scope", F.lit(3)).alias("host"), "p1", "p2", "template",
                      ((F.col("t_blocked") + SMOOTHING * F.col("wide_share")) / (F.col("t_labelled") + SMOOTHING)).alias("purity"))


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    The verdict is that of the longest fitting rule; without one it is ``block`` where the
    template's purity is at least ``BLOCK_FROM``, else ``allow``.  ``label_col`` may name a
    column with ``allow``, ``block`` or null, which counts as a label where no rule fits.
    A null url has an empty host and path; a null id stays null; repeated rows give
    repeated rows; an empty table gives an empty one."""
    host, path = host_path(F.col(url_col))
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                        (F.col(label_col) if label_col else F.lit(None).cast("string")).alias("given"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    read = read.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), "given",
                       F.regexp_replace("path", "[0-9]+", "#").alias("shape"))
    judged = read.select("host", "shape", F.coalesce("says", "given").alias("label"))
    found = read.select("*", *path_hash(F.col("shape"))).join(templates(judged), ["host", "p1", "p2"], "left")
    return found.select("page_id", "host", "path", "rule",
                        F.coalesce("says", F.when(F.col("purity") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), "template", "purity")
