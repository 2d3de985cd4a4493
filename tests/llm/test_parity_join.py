import random
import re

import numpy as np
import pytest

from gridlens.llm import parity_join as pj

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    bags = [sets(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = len(bags[i] & bags[j])
                if den * both >= num * (len(bags[i]) + len(bags[j]) - both):
                    comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(bags[i]), str(least.get(root(i)) if bags[i] else d)) for i, (d, _) in enumerate(rows))


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    rows, base = [], []
    passage = " ".join(word() for _ in range(50))
    for d in range(n):
        if base and rng.random() < 0.6:
            ws = rng.choice(base).split()
            for _ in range(rng.randrange(1 + len(ws) // 25)):
                at = rng.randrange(len(ws))
                ws[at:at + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            text = " ".join(ws).upper() if rng.random() < 0.2 else "\t".join(ws)
        else:
            text = " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 20, 40, 90, 200, 400])))
            if rng.random() < 0.3:
                text += " " + passage
        base.append(text)
        rows.append((1000 + d, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den,cell", [(4, 85, 100, 1 << 20), (5, 80, 100, 150)])
def test_equals_brute_force(spark, docs, edge_rows, monkeypatch, k, num, den, cell):
    monkeypatch.setattr(pj, "CELL_SHINGLES", cell)          # the small one cuts cells into many blocks
    rows = [r[:2] for r in edge_rows] + made(k, 260) + [(None, "w1 w2 w3 w4 w5 w6"), (7777, "w1 w2 w3 w4 w5 w6")]
    got = pj.similarity_components(docs(rows, extra=True).repartition(5), k, num, den).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, num, den)


def test_equal_words_bound_the_difference():
    rng = np.random.default_rng(1)
    sk = pj.Sketches(4, 85, 100)
    low = sk.bands(5000)
    p_of, spare, _ = sk.lengths(low)
    for i in range(len(low) - 1):
        a = int(low[i + 1]) - 1
        b = a * 100 // 85
        assert b < low[i + 2] if i + 2 < len(low) else True
        worst = max(x + y - 2 * c for x in (int(low[i]), a) for y in range(x, x * 100 // 85 + 1) for c in [-(-85 * (x + y) // 185)] if c <= x)
        assert p_of[i] == 0 and worst == 0 or p_of[i] - spare[i] > worst
    for n in (12, 60, 300, 900):                        # linked sets share a signature or are both passed on
        for _ in range(30):
            common = rng.integers(0, 1 << 63, n).astype(np.uint64)
            drop = rng.integers(0, n * 15 // 100 + 1)
            h = np.concatenate([np.sort(common), np.sort(common[drop:])])
            bounds = np.array([0, n, 2 * n - drop])
            bands = np.searchsorted(low, [n, n - drop], "right") - 1
            key = int(bands.min())
            for seed in range(pj.SEEDS):
                sig, task, light = pj._signatures(sk, h, bounds, np.array([0, 1]), np.array([key, key]), np.zeros(2, np.int64), seed)
                if set(sig[task == 0].tolist()) & set(sig[task == 1].tolist()):
                    break
                assert seed < pj.SEEDS - 1 and set(light.tolist()) == {0, 1}


def test_large_groups_of_copies_and_empty_table(spark, docs):
    text = " ".join("t%d" % i for i in range(120))
    rows = [(i, text) for i in range(300)] + [(1000 + i, text + f" x{i}") for i in range(200)] + [(5000, "alone in the world today")]
    got = pj.similarity_components(docs(rows).repartition(6), 4, 85, 100).collect()
    assert {r.component_id for r in got if r.doc_id < 5000} == {0} and len(got) == 501
    assert pj.similarity_components(docs([]), 4, 85, 100).count() == 0


def test_one_of_each_group_stays(spark, docs, edge_rows):
    rows = [r[:2] for r in edge_rows] + made(9, 120)
    df = docs(rows, extra=True)
    kept = pj.keep_one(df)
    assert kept.columns == df.columns
    want = {(d, c) for d, _, c in brute(rows, 5, 80, 100)}
    got = [str(r.doc_id) for r in kept.collect()]
    assert sorted(set(got)) == sorted({d for d, c in want if d == c or d == "None"}) and got.count("8") == 1
