import random
import re
from collections import Counter

import numpy as np

from gridlens.llm import decontaminate as dc

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def brute(text, items):
    """Best similarity of each item over all its windows, by words."""
    words, out = WORD.findall((text or "").encode().lower()), {}

    def bag(ws, k):
        return Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    for item, t in items:
        own = WORD.findall((t or "").encode().lower())
        k = min(5, len(own))
        if not own or len(words) < k:
            continue
        b = bag(own, k)
        for p in range(max(1, len(words) - len(own) + 1)):
            a = bag(words[p:p + len(own)], k)
            size = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
            s = size(a & b) / size(a | b)
            if s >= 0.8 and s > out.get(item, 0):
                out[item] = s
    return out


def test_equals_brute_force(spark, docs, edge_rows):
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "be", "gam", "delta", "eps"]) + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 15, 15, 30, 30, 55, 60])] + [(50, None), (51, ""), (52, "Ünï cödé 漢字 x y")]
    rows = list(edge_rows)
    for d in range(120):
        ws = [word() for _ in range(rng.randrange(80))]
        if d % 2:
            own = items[rng.randrange(10)][1].split()
            for _ in range(d % 4 and rng.randrange(2)):
                own[rng.randrange(len(own))] = word()
            if d % 3 == 0 and len(own) > 4:
                own.insert(rng.randrange(len(own)), word())
            ws[len(ws) // 2:len(ws) // 2] = own
        rows.append((100 + d, ", ".join(ws).upper() if d % 5 == 0 else " ".join(ws)))
    rows.append((500, " ".join(items[8][1].split()[:50])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.benchmark_hits(docs(rows, extra=True), bench).collect()
    want = {(i, item): s for i, t in [r[:2] for r in rows] for item, s in brute(t, items).items()}
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(s, 9) for k, s in want.items()} and len(want) > 12 and min(want.values()) < 1
    clean = dc.drop_contaminated(docs(rows), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t in [r[:2] for r in rows] if not brute(t, items))


def test_blocks_guarantee_the_radius():
    rng = random.Random(1)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), dc.RADIUS):
            b ^= 1 << bit
        assert set(dc._blocks(a)) & set(dc._blocks(b))


def test_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(3)
    far = 0
    for _ in range(3000):
        n = int(rng.integers(10, 60))
        common = rng.integers(0, 1 << 62, n).astype(np.uint64)
        other = rng.integers(0, 1 << 62, max(1, n // 8)).astype(np.uint64)          # similarity of about 0.8
        w = rng.integers(10, 30, n + len(other))
        a = dc.simhash(np.concatenate([common, other]), w)
        b = dc.simhash(np.concatenate([common, mixed := mix_(other)]), w)
        far += (a ^ b).bit_count() > dc.RADIUS
        assert len(mixed)
    assert far <= 15


def mix_(x):
    return x ^ np.uint64(0x5555555555)


def test_many_blocks_and_empty_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.benchmark_hits(docs([(i, "start " + t + " end") for i, t in items] + [(99, "clean text")]), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity, r.first_word) for r in got) == [(i, i, 1.0, 1) for i in range(20)]
    assert dc.benchmark_hits(docs([]), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.benchmark_hits(docs([(1, "a")]), none).count() == 0 and dc.drop_contaminated(docs([(1, "a")]), none).count() == 1
