"""Exact n-gram Jaccard join by parity sketches.

A text is the set of its word shingles; texts with equal sets are one class.  A
class's sketch has p words of 64 bits: each shingle is hashed to one of them and
XORed into it.  A shingle that only one of two sets has changes at most one
word, so the number of unequal words is at most the symmetric difference.  Sets
whose Jaccard similarity reaches the threshold differ in at most D shingles,
where D follows from their sizes.  So sizes are cut into bands, each band has
its p > D, and linked sets have at least p - D equal words.  The join is an
equi-join on (band, word index, word): a set joins its own band's sketches and,
as the larger partner, those of the band below.

A word that few shingles fell into says little and would gather unrelated sets.
So p has ``spare`` words more than needed, and words with fewer than ``least``
shingles (one or two) are left out: a pair still meets in a word that counts, unless both
sets have more than ``spare`` such light words.  Those few sets meet one another
under the next hash seed, and under the last seed no word is left out.

Sets that meet in a word form a group, and a group's least class is its centre.
Groups are not expanded into pairs: each class goes once to each centre that it
meets, so every candidate pair meets again in some centre's cell.  There, the
cell's sets are compared through an inverted index of their shingles, and the
verified links leave as a spanning forest, fewer than the cell has sets.  A cell
of many shingles is cut into blocks, and each pair of blocks is a task of its
own.  No pair of sets in a cell is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import Tables, cut_lineage, id_text, partitions
from .textvec import NOT_SPACE, distinct, flat, mix, shingles, slices, word_hashes

SEEDS = 4               # hash seeds; the last leaves no word out
CELL_SHINGLES = 1 << 20   # shingles of a block of a cell, about
BROADCAST_SETS = 200_000  # ids of candidate texts (a few MB) that are broadcast; more are joined by shuffle
ROW, FORWARD, DIGEST = 0, 1, 2
SCHEMA = "sig long, ref long, kind int, band int"


@dataclass(frozen=True)
class Sketches:
    """Bands of set sizes and their sketch lengths, for den * common >= num * united."""
    words: int
    num: int
    den: int

    def bands(self, most: int) -> np.ndarray:
        """Least size of each band, up to the one that holds ``most``: a partner is at most one band higher."""
        low = [1, 2]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, (low[-1] - 1) * self.den // self.num + 1))
        return np.array(low, np.int64)

    def lengths(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p, spare, least) of each band; p is 0 where linked sets are equal sets.

        ``spare`` is the number of light words, those with fewer than ``least`` shingles, that few
        of the band's smallest sets exceed (two deviations above the mean).  Light means empty or
        one shingle where that costs few spare words, else empty."""
        a = low[1:] - 1
        need = (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num) + 1
        p, spare, least = need.copy(), np.zeros_like(need), np.ones_like(need)
        for few in (1, 2):
            extra = np.zeros(len(need))
            for _ in range(4):                          # spare words make every word lighter
                mean = low[:-1] / (need + extra)
                light = np.exp(-mean) * (1 + mean * (few == 2)) * (need + extra)
                extra = np.floor(light + 2 * np.sqrt(light))
            use = (extra <= 0.2 * need + 1) | (few == 1)
            spare, least = np.where(use, extra, spare).astype(np.int64), np.where(use, few, least)
        return np.where(need > 1, need + spare, 0), spare, least


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row, ascending, the n + 1 bounds of the rows, and each row's class (0: empty)."""
    data, offsets = flat(texts)
    hashes, rows, _, _ = word_hashes(data, offsets, NOT_SPACE)
    h, r, _ = shingles(hashes, rows, len(texts), words)
    h, r = distinct(h, r)
    bounds = np.searchsorted(r, np.arange(len(texts) + 1))
    size = np.diff(bounds).astype(np.uint64)
    ref = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        ref[some] = mix(np.add.reduceat(mix(h), bounds[some]) ^ mix(size[some])) | np.uint64(1)
    return h, bounds, ref.view(np.int64)


def _signatures(sk: Sketches, h: np.ndarray, bounds: np.ndarray, at: np.ndarray, band: np.ndarray, group: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, task) of the sketch words that count, and the tasks with too many light words.

    Task i sketches set ``at[i]`` for band ``band[i]`` inside the group ``group[i]``."""
    low = sk.bands(int(np.diff(bounds).max(initial=1)) * sk.den // sk.num + 1)
    p_of, spare_of, least = sk.lengths(low)
    p, size = p_of[band], np.diff(bounds)[at]
    task = np.repeat(np.arange(len(at)), size)
    first = np.repeat(bounds[at] - (np.cumsum(size) - size), size)
    x = h[np.arange(len(task)) + first]
    if seed:
        x = mix(x ^ np.uint64(seed * 0x51ED270B9F1D))
    word = ((x >> np.uint64(32)) * p[task].astype(np.uint64)) >> np.uint64(32)
    if seed:
        order = np.lexsort((word, task))
        task, word, x = task[order], word[order], x[order]
    start = np.flatnonzero(np.append(True, (task[1:] != task[:-1]) | (word[1:] != word[:-1]))) if len(task) else np.zeros(0, int)
    parity = np.bitwise_xor.reduceat(mix(x), start) if len(start) else np.zeros(0, np.uint64)
    count = np.diff(np.append(start, len(task)))
    task, word = task[start], word[start]
    last = seed == SEEDS - 1
    if last:                                            # words without shingles count as well
        whole = np.repeat(np.arange(len(at)), p)
        index = np.arange(len(whole)) - np.repeat(np.cumsum(p) - p, p)
        value = np.zeros(len(whole), np.uint64)
        value[(np.cumsum(p) - p)[task] + word.astype(np.int64)] = parity
        task, word, parity = whole, index.astype(np.uint64), value
    else:
        heavy = count >= least[band][task]
        task, word, parity = task[heavy], word[heavy], parity[heavy]
    light = np.zeros(0, int) if last else np.flatnonzero(p - np.bincount(task, minlength=len(at)) > spare_of[band])
    where = mix(group.view(np.uint64)[task] ^ mix((band[task].astype(np.uint64) << np.uint64(34)) ^ (np.uint64(seed) << np.uint64(60)) ^ word))
    return mix(where ^ parity).view(np.int64), task, light


def _batch(sig, ref, kind, band) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(ref, pa.int64()), pa.array(kind, pa.int32()), pa.array(band, pa.int32())], ["sig", "ref", "kind", "band"])


def _rows(sk: Sketches, h, bounds, ref, at, band, group, seed) -> pa.RecordBatch:
    sig, task, light = _signatures(sk, h, bounds, at, band, group, seed)
    onward = mix(group.view(np.uint64)[light] ^ np.uint64(0xBAD + seed)).view(np.int64)
    return _batch(np.concatenate([sig, onward]), np.concatenate([ref[at[task]], ref[at[light]]]),
                  np.repeat([ROW, FORWARD], [len(sig), len(light)]), np.concatenate([band[task], band[light]]))


def _sketched(docs: DataFrame, sk: Sketches) -> DataFrame:
    """A digest row (sig: doc_id, ref: class, band: set size) of each document, and the sketch rows
    of each class, once a task however many copies the task reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                h, bounds, ref = shingle_sets(batch.column(1).slice(a, b - a), sk.words)
                size = np.diff(bounds)
                yield _batch(batch.column(0).slice(a, b - a), ref, np.full(b - a, DIGEST), size)
                new = np.flatnonzero([s > 0 and r not in seen and not seen.add(r) for r, s in zip(ref.tolist(), size.tolist())])
                low = sk.bands(int(size.max(initial=1)) * sk.den // sk.num + 1)
                own = np.searchsorted(low, size[new], "right") - 1
                at, band = np.concatenate([new, new]), np.concatenate([own, own - 1])
                use = (band >= 0) & (sk.lengths(low)[0][np.maximum(band, 0)] > 0)
                if use.any():
                    yield _rows(sk, h, bounds, ref, at[use], band[use], np.zeros(int(use.sum()), np.int64), 0)

    return id_text(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows whose signature several classes have, with ``rep``, the least of them; other kinds pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined, rep = None, False, 0              # the last sketch row, whether it is known to be in a group, its group's least class

        def out(t, keep, reps):
            return pa.RecordBatch.from_arrays([pa.array(t[c][keep], pa.int64()) for c in (0, 1)] + [pa.array(t[c][keep], pa.int32()) for c in (2, 3)] + [pa.array(reps[keep], pa.int64())],
                                              ["sig", "ref", "kind", "band", "rep"])
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(2).to_numpy()
            other = kind != ROW
            if other.any():
                part = batch.filter(pa.array(other))
                yield pa.RecordBatch.from_arrays([*part.columns, part.column(1)], ["sig", "ref", "kind", "band", "rep"])
            t = [c.to_numpy() for c in batch.filter(pa.array(~other)).columns]
            if held is not None:
                t = [np.concatenate([[x], c]) for x, c in zip(held, t)]
            if not len(t[0]):
                continue
            new = np.append(True, (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1]))
            t = [c[new] for c in t]
            same = t[0][1:] == t[0][:-1]
            before = np.append(joined if held is not None else False, same)
            start = np.flatnonzero(~np.append(False, same))
            reps = np.repeat(t[1][start], np.diff(np.append(start, len(t[0]))))
            if held is not None and joined:
                reps[:start[1] if len(start) > 1 else len(reps)] = rep
            member = before | np.append(same, False)
            yield out(t, np.append(member[:-1], False), reps)
            held, joined, rep = [c[-1] for c in t], bool(before[-1]), reps[-1]
        if held is not None and joined:
            yield out([np.array([x]) for x in held], np.array([True]), np.array([rep]))

    key = F.when(F.col("kind") == ROW, F.col("sig")).otherwise(F.xxhash64("ref", "sig"))
    dealt = rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions("sig", "ref")
    return dealt.mapInArrow(run, SCHEMA + ", rep long")


def _next_seed(tasks: DataFrame, texts: DataFrame, sk: Sketches, seed: int) -> DataFrame:
    """Sketch rows of tasks (sig: group, ref, band) under another seed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                h, bounds, ref = shingle_sets(part.column(2), sk.words)
                yield _rows(sk, h, bounds, ref, np.arange(b - a), part.column(1).to_numpy().astype(np.int64), part.column(0).to_numpy(), seed)

    return tasks.join(texts, "ref").select("sig", "band", "text").mapInArrow(run, SCHEMA)


def _forest(h: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, sk: Sketches) -> list[tuple[int, int]]:
    """Links between the sets ``left`` and ``right`` (all pairs, if they are the same), but none within what is joined already."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    index = np.isin(owner, right)
    order = np.flatnonzero(index)[np.argsort(h[index], kind="stable")]
    keys, members = h[order], owner[order]
    root = list(range(len(size)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    out = []
    for x in left.tolist():
        own = h[bounds[x]:bounds[x + 1]]
        a, b = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        n = b - a
        if not n.sum():
            continue
        met = members[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(met, minlength=len(size))
        for y in np.flatnonzero((common > 0) & (sk.den * common >= sk.num * (size[x] + size - common))).tolist():
            if y != x and top(x) != top(y):
                root[top(y)] = top(x)
                out.append((x, y))
    return out


def _links(groups: DataFrame, sizes: DataFrame, texts: DataFrame, sk: Sketches, tables: Tables) -> DataFrame:
    """Verified links (a, b) that join whatever the groups' links join."""
    met = tables.store(groups.where("ref != rep").select("rep", "ref").distinct())
    cells = met.unionByName(met.select("rep", F.col("rep").alias("ref")).distinct()).join(sizes, "ref")
    blocks = cells.groupBy("rep").agg(F.ceil(F.sum("n_shingles") / CELL_SHINGLES).alias("blocks"))
    placed = cells.join(blocks, "rep").withColumn("own", F.pmod(F.xxhash64("ref", "rep"), F.col("blocks")))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ref")
    rows = tasks.join(texts, "ref").select("rep", "i", "j", "own", "ref", "text")

    def cell(batches: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(batches).combine_chunks()
        texts_, refs = t.column(5).combine_chunks(), t.column(4).to_numpy()
        i, j, own = t.column(1)[0].as_py(), t.column(2)[0].as_py(), t.column(3).to_numpy()
        parts = [shingle_sets(texts_.slice(a, b - a), sk.words) for a, b in slices(texts_)]
        h = np.concatenate([p[0] for p in parts])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        return [(int(refs[x]), int(refs[y])) for x, y in _forest(h, bounds, np.flatnonzero(own == i), np.flatnonzero(own == j), sk)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[tuple[int, int]] = []

        def out():
            a, b = zip(*found) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            if held and [held[-1].column(c)[0].as_py() for c in range(3)] != key[0].tolist():
                found += cell(held)
                held = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
                held.append(batch.slice(a, b - a))
                if b < len(key):
                    found += cell(held)
                    held = []
            yield out()
        if held:
            found += cell(held)
        yield out()

    dealt = rows.repartition(partitions(groups.sparkSession), "rep", "i", "j").sortWithinPartitions("rep", "i", "j", "ref")
    return tables.store(dealt.mapInArrow(run, "a long, b long"))


def _candidate_texts(docs: DataFrame, digests: DataFrame, refs: DataFrame, sk: Sketches, tables: Tables) -> DataFrame:
    """(ref, text) of the candidate classes, from one document each."""
    one = tables.store(digests.join(refs, "ref", "left_semi").groupBy("ref").agg(F.min("doc_id").alias("i")))
    small = F.broadcast if one.count() <= BROADCAST_SETS else lambda x: x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:                           # ids can repeat: keep the text of the class
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(shingle_sets(part.column(1), sk.words)[2] == part.column(0).to_numpy()))

    met = id_text(docs, "doc_id", "text").join(small(one), F.col("doc_id").eqNullSafe(F.col("i"))).select("ref", "text")
    return tables.store(met.mapInArrow(run, "ref long, text string").dropDuplicates(["ref"]))


def similarity_components(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Words are runs without ASCII white space, A-Z lower-cased; two texts link when
    den * common >= num * united distinct shingles.  A text with fewer words than a shingle
    has its whole sequence as its one shingle.  A null or empty text has no shingle and
    links with nothing.  A row without id takes part in links; its component_id is null if
    nothing it reaches has an id.  Rows of one id with different texts are judged apart.
    An empty table gives an empty one."""
    sk, tables = Sketches(words, num, den), Tables(docs.sparkSession)
    docs = id_text(docs, id_col, text_col)
    found = tables.store(_grouped(_sketched(docs, sk)))
    tables.release()
    digests = found.where(F.col("kind") == DIGEST).select(F.col("sig").alias("doc_id"), "ref", F.col("band").alias("n_shingles"))
    groups, onward = found.where(F.col("kind") == ROW), found.where(F.col("kind") == FORWARD)
    members = digests.where("n_shingles > 0")
    refs = groups.select("ref").unionByName(onward.select("ref")).distinct()
    texts = _candidate_texts(docs, members, refs, sk, tables)

    def under_seeds(tasks: DataFrame, seed: int) -> DataFrame | None:
        """Groups of the tasks under this seed and, for sets with too many light words, those that follow."""
        out = None
        while seed < SEEDS and (size := tasks.count()):
            got = tables.store(_grouped(_next_seed(F.broadcast(tasks) if size <= BROADCAST_SETS else tasks, texts, sk, seed)))
            own = got.where(F.col("kind") == ROW)
            out = own if out is None else out.unionByName(own)
            tasks, seed = got.where(F.col("kind") == FORWARD).select("sig", "ref", "band"), seed + 1
        return out

    tables.release()
    more = under_seeds(onward.select("sig", "ref", "band"), 1)
    groups = (groups if more is None else groups.unionByName(more)).select("sig", "ref", "band", "rep")

    sizes = members.groupBy("ref").agg(F.first("n_shingles").alias("n_shingles"))
    labels = components(_links(groups, sizes, texts, sk, tables), tables)

    first = members.groupBy("ref").agg(F.min("doc_id").alias("least"))
    placed = first.join(labels, first["ref"] == labels["node"], "left").select("ref", "least", F.coalesce("label", "ref").alias("label"))
    reach = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    of = placed.join(reach, "label").select(F.col("ref").alias("r"), "component_id")
    out = cut_lineage(digests.join(of, F.col("ref") == F.col("r"), "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    tables.clear()
    return out


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, but of each group of linked texts only the row with
    the smallest id (of repeated rows with that id: one).  Rows without id or without
    shingles stay."""
    comps = similarity_components(docs, words, num, den, id_col, text_col)
    gone = cut_lineage(comps.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct())
    small = F.broadcast if gone.count() <= BROADCAST_SETS else lambda x: x
    kept = docs.join(small(gone), docs[id_col].cast("long") == gone["_gone"], "left_anti")
    twice = cut_lineage(comps.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice"))
    if not twice.limit(1).count():
        return kept
    small = F.broadcast if twice.count() <= BROADCAST_SETS else lambda x: x
    again = kept[id_col].cast("long") == twice["_twice"]
    repeated = kept.join(small(twice), again, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(small(twice), again, "left_anti").unionByName(repeated)
