"""Vectorised text primitives shared by the Python-side operators.

Texts reach Python as Arrow string arrays.  Everything here works on the flat
UTF-8 buffer of a slice of such an array (a few MB at a time, see ``slices``),
so per-word Python objects are never built: words, shingles and k-mers are
numpy arrays of 64-bit hashes plus the row they belong to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20          # text bytes worked on at once
_PRIME = np.uint64(0x9E3779B97F4A7C15)          # odd, so invertible modulo 2**64
_PRIME_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but ASCII white space / ASCII letters, digits and all non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        grown = np.full(size, _PRIME, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
        grown[1:] = _PRIME_INV
        _inverse_powers = np.multiply.accumulate(grown)
    return _powers[:n], _inverse_powers[:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes of text (one row at least)."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, len(texts))
        a = b


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and the n + 1 offsets; null rows are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums, from which ``range_hash`` takes the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end); equal bytes have equal hashes anywhere."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``word_bytes``; runs never cross rows."""
    inside = word_bytes[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = False
    first[1:] = inside
    begin, end = inside & ~first[:-1], first.copy()
    end[:-1] &= ~inside
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts - 1]]
    begin[joined] = True
    end[joined] = True
    return np.flatnonzero(begin), np.flatnonzero(end)


def word_hashes(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word, lower-casing A-Z."""
    data = LOWER[data]
    starts, ends = words(data, offsets, word_bytes)
    hashes = range_hash(prefix_hash(data), starts, ends)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows, starts, ends


_ROLE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each run of ``size`` words of one row.  With ``short``, a
    row of fewer words has its whole word sequence as its one shingle."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    out_h, out_r, out_w = [], [], []
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total += hashes[j:n - size + 1 + j] * _ROLE[j % 64]
        at = np.flatnonzero(rows[:n - size + 1] == rows[size - 1:])
        out_h, out_r, out_w = [mix(total[at])], [rows[at]], [at]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            value = np.zeros(len(few), np.uint64)
            for j in range(size - 1):
                has = counts[few] > j
                value[has] += hashes[first[few[has]] + j] * _ROLE[j]
            out_h.append(mix(value ^ (counts[few].astype(np.uint64) * _PRIME)))
            out_r.append(few)
            out_w.append(first[few])
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_r), np.concatenate(out_w)


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row) pairs, ordered by row, then hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbouring values."""
    op = np.minimum if least else np.maximum
    done = 1
    while done * 2 <= width:
        values = op(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return op(values[:-rest], values[rest:]) if rest else values


def minimizers(sums: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-byte strings that have the least hash in some
    ``window``-byte string of a row.  Which ones these are depends on the window's
    bytes alone, so equal windows anywhere pick the same offsets."""
    n = len(sums) - 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - k + 1)
    hashes = range_hash(sums, at, at + k)
    width = window - k + 1
    least = sliding(hashes, width, True)                 # of the window that starts here
    lengths = np.diff(offsets)
    whole = np.zeros(len(least), bool)                   # windows inside one row
    for a, b in zip(offsets[:-1][lengths >= window].tolist(), offsets[1:][lengths >= window].tolist()):
        whole[a:b - window + 1] = True
    least[~whole] = 0
    padded = np.zeros(len(hashes) + width - 1, np.uint64)
    padded[width - 1:width - 1 + len(least)] = least
    most = sliding(padded, width, False)                 # of the windows that hold this k-mer
    picked = np.flatnonzero((most == hashes) & (most > 0))
    return picked, hashes[picked]
