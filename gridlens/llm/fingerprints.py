"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed to
a wide vector, and the text's fingerprint is the sum of these vectors, lane by
lane modulo a power of two.  So the order of paragraphs doesn't matter, and a
paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts.  ``WIDE`` 64-bit lanes (modulo 2**64) carry a hash of
the whole paragraph and settle equality.  ``SIGNS`` 32-bit lanes (modulo 2**32)
carry +1 or -1 for each phrase of the paragraph (up to ``PHRASE_WORDS`` words,
starting anew after a sentence end); products of two texts' lanes estimate how
many phrases they share, which gives the likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions
from .textvec import NOT_SPACE, flat, mix, prefix_hash, range_hash, words

WIDE, SIGNS, PHRASE_WORDS = 8, 256, 8
BLOCK_BYTES = 1 << 20
_EXPAND = mix(np.arange(1, SIGNS // 64 + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LINE = 10
_STOPS = np.isin(np.arange(256), [33, 46, 63])      # ! . ?


def _phrase_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags of the words that open a phrase: the first of a paragraph, one after a
    sentence end, or ``PHRASE_WORDS`` words after the last such word."""
    lines = np.concatenate([[0], np.cumsum(data == _LINE)])[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (rows[1:] != rows[:-1]) | (lines[1:] != lines[:-1]) | _STOPS[data[ends[:-1] - 1]]
    at = np.flatnonzero(opens)
    since = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    return opens | (since % PHRASE_WORDS == 0)


def vectors(texts: list[str]) -> np.ndarray:
    """Fingerprints, one row of bytes per text: WIDE * 8 + SIGNS * 4 bytes."""
    n = len(texts)
    wide = np.zeros((n, WIDE), np.uint64)
    signs = np.zeros((n, SIGNS), np.int64)
    digests, counts = [], []
    for t in texts:
        lines = t.encode().split(b"\n") if t else []
        counts.append(len(lines))
        digests += [hashlib.blake2b(x, digest_size=WIDE * 8).digest() for x in lines]
    if digests:
        lanes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, WIDE)
        counts = np.array(counts)
        some = np.flatnonzero(counts)
        wide[some] = np.add.reduceat(lanes, (np.cumsum(counts) - counts)[some], axis=0)
    data, offsets = flat(pa.array(texts, pa.large_string()))
    starts, ends = words(data, offsets, NOT_SPACE)
    if len(starts):
        rows = np.searchsorted(offsets, starts, "right") - 1
        at = np.flatnonzero(_phrase_starts(data, starts, ends, rows))
        last = np.append(at[1:], len(starts)) - 1
        hashes = range_hash(prefix_hash(data), starts[at], ends[last])
        for a in range(0, len(hashes), 1 << 15):      # 256 flags a phrase at once
            part, row = hashes[a:a + (1 << 15)], rows[at[a:a + (1 << 15)]]
            bits = np.unpackbits(mix(part[:, None] ^ _EXPAND[None, :]).view(np.uint8), axis=1)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(first, len(row)))
            signs[row[first]] += 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) - size[:, None]
    return np.concatenate([wide.astype("<u8").view(np.uint8), signs.astype("<i4").view(np.uint8)], axis=1)


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of texts a with the paragraphs of b inserted (or, with -1, deleted)."""
    cut = WIDE * 8
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    x, y = [np.ascontiguousarray(v[:, :cut]).view("<u8") for v in (a, b)]
    s, t = [np.ascontiguousarray(v[:, cut:]).view("<i4") for v in (a, b)]
    return np.concatenate([(x + y if sign > 0 else x - y).view(np.uint8), (s + t if sign > 0 else s - t).view(np.uint8)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated shared phrases over all phrases of both, 0 to 1; 1 for equal fingerprints."""
    cut = WIDE * 8
    s, t = [np.ascontiguousarray(v[:, cut:]).view("<i4").astype(np.float64) for v in (a, b)]
    both, union = (s * t).sum(1), (s * s).sum(1) + (t * t).sum(1) - (s * t).sum(1)
    out = np.clip(np.divide(both, union, out=np.zeros(len(a)), where=union > 0), 0, 1)
    out[(a == b).all(1)] = 1.0
    return out


def _chunk_of(null: np.ndarray, key: np.ndarray, bounds: np.ndarray, spread: int) -> np.ndarray:
    """Chunks in ascending order of (null, key): ids by the bounds, null ids behind them by text hash."""
    top = (key.astype(np.float64) + 2.0 ** 63) / 2.0 ** 64 * spread
    return np.where(null, len(bounds) + 1 + np.clip(top, 0, spread - 1).astype(np.int64), np.searchsorted(bounds, key, "right"))


def in_order(docs: DataFrame, id_col: str, text_col: str, chunks: int | None = None) -> DataFrame:
    """Documents dealt to partitions in chunks of neighbouring ids, sorted inside; each chunk
    ends with a copy (``halo``) of the first document of the next chunk, after the last
    chunk of the first.  Texts are shuffled once.  The driver only sees ``chunks`` bounds."""
    spark = docs.sparkSession
    chunks = chunks or 4 * partitions(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.xxhash64("text").alias("h"))
    keyed = keyed.select("doc_id", "text", "h", F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", "h").alias("k"))
    cuts = keyed.where(~F.col("missing")).agg(F.percentile_approx("k", [i / chunks for i in range(1, chunks)] or [0.5], 100 * chunks).alias("b")).first()["b"]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null, key = batch.column("missing").to_numpy(zero_copy_only=False), batch.column("k").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_chunk_of(null, key, bounds, chunks)), batch.column("k")], ["chunk", "k"])

    heads = sorted((r["chunk"], r["k"]) for r in keyed.select("missing", "k").mapInArrow(place, "chunk long, k long").groupBy("chunk").agg(F.min("k").alias("k")).collect())
    head = {c: k for c, k in heads}
    before = {c: heads[i - 1][0] for i, (c, _) in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null, key = batch.column("missing").to_numpy(zero_copy_only=False), batch.column("k").to_numpy()
            chunk = _chunk_of(null, key, bounds, chunks)
            first = np.flatnonzero(np.fromiter((head[c] == k for c, k in zip(chunk.tolist(), key.tolist())), bool, len(key)))
            rows = np.concatenate([np.arange(len(key)), first])
            at = np.concatenate([chunk, np.array([before[c] for c in chunk[first].tolist()], np.int64)])
            took = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.arange(len(rows)) >= len(key)), took.column("k"), took.column("h"), took.column("doc_id"), took.column("text")],
                                             ["chunk", "halo", "k", "h", "doc_id", "text"])

    dealt = keyed.mapInArrow(deal, "chunk long, halo boolean, k long, h long, doc_id long, text string")
    return dealt.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "halo", "k", "h", "text").select("halo", "doc_id", "text")


def _rows(ids: list, texts: list[str], halo: list[bool]) -> pa.RecordBatch:
    """Results of all rows but the last, which is only looked at as a next document."""
    own = vectors(texts)
    edited = [t[:len(t) - len(t) // 2] + nxt[:len(t) // 2] for t, nxt in zip(texts, texts[1:])]
    other = vectors(edited)
    keep = [i for i, x in enumerate(halo[:-1]) if not x]
    near_e, near_n = likeness(own[:-1], other), likeness(own[:-1], own[1:])
    return pa.RecordBatch.from_arrays([
        pa.array([ids[i] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
        pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
        pa.array([own[i].tobytes().hex() for i in keep], pa.string()), pa.array([other[i].tobytes().hex() for i in keep], pa.string()),
        pa.array(near_e[keep]), pa.array(near_n[keep])],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, whose second half comes from the next document.

    One row per input row.  The next document is the one with the next greater id;
    rows with one id are ordered by text hash, null ids come last, ordered by text hash,
    and after the last row comes the first (a single row is its own next).  A null text
    is empty; the fingerprint of an empty text is all zeros; an empty table gives an
    empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, halo, size = [], [], [], 0
        for batch in batches:
            for h, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids.append(i)
                texts.append(t)
                halo.append(h)
                size += len(t)
                if size > BLOCK_BYTES and len(ids) > 1:
                    yield _rows(ids, texts, halo)
                    ids, texts, halo, size = ids[-1:], texts[-1:], halo[-1:], len(t)
        if len(ids) > 1:
            yield _rows(ids, texts, halo)

    return in_order(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id and fingerprint, without any shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = vectors(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes().hex() for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")
