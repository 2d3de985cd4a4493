"""Benchmark decontamination by SimHash of item-sized windows.

A document's windows of as many words as a benchmark item are fingerprinted
with a SimHash of their weighted word shingles.  The items' fingerprints are
indexed by ``RADIUS`` + 1 blocks of bits: two fingerprints within the radius agree
in at least one block, so looking up a window's blocks finds every item within
the radius.  Candidates are verified by the exact weighted similarity of their
shingles: common over united weight, repeats counted; a shingle weighs as many
bytes as its words have.

Before a window is fingerprinted, its weight in shingles that occur in any item
must reach the threshold's share of its weight; where it doesn't, the
similarity with every item is below the threshold."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import id_text
from .textvec import ALNUM, flat, mix, shingles, slices, word_hashes

SHINGLE, SIMILARITY, BITS, RADIUS = 5, 0.8, 64, 20
BLOCK_BYTES = 4 << 20        # text of the benchmark items that one pass over the documents takes


def _weights(sizes: np.ndarray, width: int) -> np.ndarray:
    """Bytes of each run of ``width`` neighbouring words."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return sums[width:] - sums[:-width]


def simhash(hashes: np.ndarray, weights: np.ndarray) -> int:
    signs = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    return int.from_bytes(np.packbits(weights @ signs > 0).tobytes(), "big")


def _blocks(value: int) -> list[tuple[int, int]]:
    """(block, its bits) of the RADIUS + 1 blocks of a fingerprint."""
    cuts = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [(i, (value >> a) & ((1 << (b - a)) - 1)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def similarity(a: Counter, b: Counter, weight: dict[int, int]) -> float:
    common = sum(min(n, b[h]) * weight[h] for h, n in a.items() if h in b)
    union = sum(n * weight[h] for h, n in a.items()) + sum(n * weight[h] for h, n in b.items()) - common
    return common / union if union else 0.0


class Index:
    """Fingerprints and shingles of a block of items; sent to the tasks."""

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = flat(texts)
        hashes, rows, starts, ends = word_hashes(data, offsets, ALNUM)
        bounds = np.searchsorted(rows, np.arange(len(items) + 1))
        self.items = []                                    # (item id, words, shingle size, shingle counts, weight of each)
        self.by_length = defaultdict(lambda: defaultdict(list))
        known = defaultdict(set)
        self.owners = defaultdict(set)                     # shingle -> lengths of the items that have it
        for j, (item, _) in enumerate(items):
            a, b = bounds[j], bounds[j + 1]
            n = int(b - a)
            if not n:
                continue
            size = min(SHINGLE, n)
            sh = shingles(hashes[a:b], np.zeros(n, int), 1, size)[0]
            w = _weights((ends - starts)[a:b], size)
            at = len(self.items)
            print_ = simhash(sh, w)
            self.items.append((item, n, print_, Counter(sh.tolist()), dict(zip(sh.tolist(), w.tolist()))))
            known[size].update(sh.tolist())
            for h in sh.tolist():
                self.owners[h].add(n)
            for key in _blocks(print_):
                self.by_length[n][key].append(at)
        self.known = {size: np.array(sorted(s), np.uint64) for size, s in known.items()}
        self.owners, self.by_length = dict(self.owners), {n: dict(d) for n, d in self.by_length.items()}

    def scan(self, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item id, similarity, first word, words) of the best window of each row and item."""
        data, offsets = flat(texts)
        hashes, rows, starts, ends = word_hashes(data, offsets, ALNUM)
        if not len(hashes):
            return []
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        out = []
        for size, known in self.known.items():
            sh, sh_rows, first = shingles(hashes, rows, len(texts), size, short=False)
            place = np.minimum(np.searchsorted(known, sh), len(known) - 1)
            hit = known[place] == sh
            for row in np.unique(sh_rows[hit]).tolist():
                a, b = np.searchsorted(sh_rows, [row, row + 1])
                wa, wb = bounds[row], bounds[row + 1]
                found = self._row(size, sh[a:b], hit[a:b], _weights((ends - starts)[wa:wb], size))
                out += [(row, *f) for f in found]
        return out

    def _row(self, size: int, sh: np.ndarray, hit: np.ndarray, weight: np.ndarray) -> list[tuple[int, float, int, int]]:
        lengths = {n for h in set(sh[hit].tolist()) for n in self.owners[h] if min(SHINGLE, n) == size}
        total, known = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(weight * hit)])
        best: dict[int, tuple[float, int, int]] = {}
        for n in sorted(lengths):
            k = min(n - size + 1, len(sh))                 # a text that is shorter than the item is one window
            kept = np.flatnonzero(known[k:] - known[:-k] >= SIMILARITY * (total[k:] - total[:-k]) - 1e-9)
            for p in kept.tolist():
                part, w = sh[p:p + k], weight[p:p + k]
                value = simhash(part, w)
                index = self.by_length[n]
                near = {i for key in _blocks(value) for i in index.get(key, ()) if (self.items[i][2] ^ value).bit_count() <= RADIUS}
                if not near:
                    continue
                counts, weights = Counter(part.tolist()), dict(zip(part.tolist(), w.tolist()))
                for i in near:
                    item, _, _, other, other_weights = self.items[i]
                    s = similarity(counts, other, weights | other_weights)
                    if s >= SIMILARITY and (s, -p) > (best.get(i, (0.0, 0, 0))[0], -best.get(i, (0.0, 0, 0))[1]):
                        best[i] = (s, p, k + size - 1)
        return [(self.items[i][0], s, p, n) for i, (s, p, n) in sorted(best.items())]


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's items in blocks of bounded text, one index each."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()   # about BLOCK_BYTES of text
        yield Index(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document and item that are similar.

    Words are runs of ASCII letters, digits and other characters beyond ASCII, A-Z
    lower-cased.  A text shorter than an item is one window; items of fewer than five words
    are one shingle; texts and items without words match nothing; a null id stays null;
    repeated rows and items give repeated rows; empty tables give an empty one."""
    spark, rows = docs.sparkSession, id_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for index in _indexes(benchmark, item_col, item_text_col):
        def run(batches: Iterator[pa.RecordBatch], sent=spark.sparkContext.broadcast(index)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    found = sent.value.scan(batch.column(1).slice(a, b - a))
                    ids = batch.column(0).slice(a, b - a).to_pylist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                        pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are similar to no item; nothing is shuffled."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col):
        def run(batches: Iterator[pa.RecordBatch], sent=spark.sparkContext.broadcast(index)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(at)):
                    part = batch.slice(a, b - a)
                    clean = np.ones(b - a, bool)
                    clean[[f[0] for f in sent.value.scan(part.column(at))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
