"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit where more than half of its shingles' hashes have it.  Two
fingerprints link when at most ``radius`` bits differ.  Equal fingerprints are one row; the
distinct ones are dealt into tiles by the population counts of their four quarters.  The
counts of two fingerprints differ, summed over the quarters, by no more than the
fingerprints do, so only tiles whose counts lie within the radius are compared: nothing
beyond them can link.  (The whole population count is the sum of the quarters' counts, so
every pair of tiles that it would skip is skipped, and many more.)

A tile of many fingerprints is cut into blocks of about ``BLOCK``; a pair of blocks is a
row with both blocks' numbers, compared by numpy's exclusive-or and bit counts.  A pair of
blocks returns a spanning forest of its links, fewer rows than it has fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import Tables, cut_lineage, id_text, partitions

SEED, BITS = 42, 64
QUARTERS, SIDE = 4, 17                  # population counts 0 to 16 of 16 bits: at most 17 ** 4 tiles
BLOCK = 1024                            # numbers of a block
STRIP = 256                             # rows of a block compared at once
PIECE = 1 << 20                         # bytes of text hashed at once


def _pieces(text: bytes, words: int) -> Iterator[list[bytes]]:
    """The words of a text, ``PIECE`` bytes at a time; each piece begins with the last words of the one before."""
    at, carry = 0, []
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end:end + 1].isspace():
            end += 1
        part = carry + text[at:end].split()
        yield part
        carry, at = part[len(part) - min(len(part), words - 1):], end


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, a piece at a time; a text with fewer words is one shingle."""
    met, few = False, []
    hash64 = xxhash.xxh64_intdigest
    for part in _pieces(text.lower(), words):                   # bytes: only A-Z change, split() knows only ASCII space
        if len(part) >= words:
            met = True
            yield np.array([hash64(b" ".join(g), SEED) for g in zip(*[part[i:] for i in range(words)])], dtype=np.uint64)
        else:
            few = part
    if not met and few:
        yield np.array([hash64(b" ".join(few), SEED)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit number; 0 for no words."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes((text or "").encode(), words):
        for at in range(0, len(h), 1 << 16):
            counts += bit_counts(h[at:at + (1 << 16)])
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
    return docs.mapInArrow(run, "doc_id long, fp long")


def _counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("int") for q in range(QUARTERS)]


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each opposite pair."""
    steps = range(-radius, radius + 1)
    return [d for d in itertools.product(steps, repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each node reaches by the links (a, b)."""
    label = np.arange(size)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of numbers, or within one (``right`` None)."""
    both = left if right is None else np.concatenate([left, right])
    off, other = (0, left) if right is None else (len(left), right)
    a = b = np.zeros(0, np.int64)
    for at in range(0, len(left), STRIP):
        i, j = np.nonzero(np.bitwise_count(left[at:at + STRIP, None] ^ other[None, :]) <= radius)
        if right is None:
            own = i + at < j
            i, j = i[own], j[own]
        if len(i):
            label = forest(len(both), np.concatenate([a, i + at]), np.concatenate([b, j + off]))
            a = np.flatnonzero(label != np.arange(len(both)))
            b = label[a]
    return both[a], both[b]


def tile_links(prints: DataFrame, radius: int, tables: Tables) -> DataFrame:
    """(a, b): forests of the links of the distinct fingerprints ``prints`` (fp)."""
    q = _counts(F.col("fp"))
    tile = sum((c * SIDE ** i for i, c in enumerate(q)), F.lit(0))
    tiled = prints.select("fp", tile.alias("tile"))
    sizes = tables.store(tiled.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = tiled.join(F.broadcast(sizes), "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), "fp")
    blocks = tables.store(dealt.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")))        # about BLOCK each, by the cut

    at = [F.floor(F.col("tile") / SIDE ** i) % SIDE for i in range(QUARTERS)]
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in neighbours(radius)])
    near = sizes.withColumn("d", F.explode(steps)).select("tile", "blocks", *[(a + F.col(f"d.d{i}")).cast("int").alias(f"q{i}") for i, a in enumerate(at)])
    inside = F.lit(True)
    for i in range(QUARTERS):
        inside = inside & F.col(f"q{i}").between(0, SIDE - 1)
    near = near.where(inside).select("tile", "blocks", sum((F.col(f"q{i}") * SIDE ** i for i in range(QUARTERS)), F.lit(0)).alias("other"))
    there = sizes.select(F.col("tile").alias("other"), F.col("blocks").alias("others"))
    pairs = near.join(F.broadcast(there), "other").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).where("tile != other or i <= j")
    left = blocks.select("tile", F.col("block").alias("i"), F.col("fps").alias("left"))
    right = blocks.select(F.col("tile").alias("other"), F.col("block").alias("j"), F.col("fps").alias("right"))
    same = (F.col("tile") == F.col("other")) & (F.col("i") == F.col("j"))
    rows = pairs.join(left, ["tile", "i"]).join(right, ["other", "j"]).select("left", F.when(~same, F.col("right")).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(c.values.to_numpy(), c.offsets.to_numpy(), c.is_valid().to_numpy(zero_copy_only=False)) for c in batch.columns]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for k in range(batch.num_rows):
                (lv, lo, _), (rv, ro, ok) = lists
                found.append(block_links(lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]] if ok[k] else None, radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found])) for s in (0, 1)], ["a", "b"])

    return tables.store(rows.repartition(partitions(prints.sparkSession)).mapInArrow(run, "a long, b long"))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Words are runs without ASCII white space, A-Z lower-cased.  A null text, or one without
    words, has fingerprint zero and links like any other.  A row without id takes part; its
    component_id is null if nothing it reaches has an id.  An empty table gives an empty one;
    other columns of the input are left out, whatever their names."""
    tables = Tables(docs.sparkSession)
    of = tables.store(fingerprints(id_text(docs, id_col, text_col), words))
    prints = tables.store(of.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(tile_links(prints.select("fp"), radius, tables), tables)
    placed = tables.store(prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    reach = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    comp = placed.join(reach, "label").select(F.col("fp").alias("of"), "component_id")
    out = cut_lineage(of.join(comp, F.col("fp") == F.col("of")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
    tables.clear()
    return out
