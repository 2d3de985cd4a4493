import random
import re

import numpy as np
import xxhash

from gridlens.llm import simhash_tiles as st


def brute_print(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows, radius=2):
    fps = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                group[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, "%016x" % fps[i], min(ids) if ids else None))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def got(df):
    return key([(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()])


def test_fingerprint_is_the_majority_of_the_hashes(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one two", "A b\x0bC\x1cd é İ ſ", "x " * 5000,
             " ".join("w%d" % rng.randrange(40) for _ in range(3000))]
    for piece in (1 << 20, 7, 64):
        monkeypatch.setattr(st, "PIECE", piece)
        assert [st.fingerprint(t) % 2 ** 64 for t in texts] == [brute_print(t) for t in texts]


def test_neighbours_hold_every_difference_once():
    d = st.neighbours(2)
    assert len(d) == len(set(d)) == 21 and (0, 0, 0, 0) in d and (-1, 1, 0, 0) not in d and (1, -1, 0, 0) in d


def test_blocks_return_forests():
    rng = np.random.default_rng(0)
    base = rng.integers(-2 ** 62, 2 ** 62, 40)
    near = np.unique(np.concatenate([base, base ^ 1, base ^ 3, base ^ 12, base ^ 96]))
    a, b = st.block_links(near, None, 2)
    assert len(a) < len(near) and (np.bitwise_count((a ^ b)) <= 8).all()
    want = {(x, y) for x in near.tolist() for y in near.tolist() if x < y and bin((x ^ y) % 2 ** 64).count("1") <= 2}
    label = dict(zip(near.tolist(), range(len(near))))
    got_ = st.forest(len(near), np.array([label[x] for x in a.tolist()]), np.array([label[x] for x in b.tolist()]))
    full = st.forest(len(near), *[np.array([label[p[k]] for p in want]) for k in (0, 1)])
    assert (got_ == full).all()
    a2, b2 = st.block_links(near[:90], near[90:], 2)
    assert all((min(x, y), max(x, y)) for x, y in zip(a2.tolist(), b2.tolist()))


def test_components_against_brute_force(spark, docs, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    want = key(brute(rows))
    assert len({r[2] for r in want}) < len(rows)
    for block in (1024, 3):
        monkeypatch.setattr(st, "BLOCK", block)
        assert got(st.simhash_components(docs(rows, extra=True))) == want


def test_edges(spark, docs, edge_rows):
    assert got(st.simhash_components(docs(edge_rows, extra=True))) == key(brute(edge_rows))
    assert st.simhash_components(docs([])).collect() == []
    same = [(i, "equal text of many copies here") for i in range(500)] + [(None, "another text")] * 3
    assert got(st.simhash_components(docs(same))) == key(brute(same))
