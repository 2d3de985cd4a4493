import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridlens.llm.mixing import WEIGHTS, mix_counts, mix_documents, permuted, slots, source_targets

WORD = re.compile("[^\x20\x09-\x0D]+")


def fill(sizes):
    """Deal 150 % by weight; stop the full ones; deal their excess again, until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * w[s] / rest for s in names}
        above = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets_equal_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 500, "d": 20, "é": 3000, None: 7}, {"x": 5}, {"x": 10, "y": 10, "z": 0}, {chr(97 + i): (i * 37) % 91 for i in range(20)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 5, 7, 64, 97, 1000, 1021):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(11))).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_slots_cover_targets_and_shards_are_mixed(spark):
    t = spark.createDataFrame([("a", 5000, 7300.2), ("b", 900, 1800.0), ("c", 64, 31.0), (None, 0, 0.0)], "source string, source_size long, target double")
    got = slots(t, block=64, shard_slots=16).collect()
    words, times = defaultdict(int), Counter((r.source, r.block) for r in got)
    for r in got:
        words[r.source] += r.words
    assert dict(words) == {"a": 7300, "b": 1800, "c": 31} and max(times.values()) <= 2
    assert sorted((r.shard, r.slot) for r in got) == [(i // 16, i % 16) for i in range(len(got))]
    shares = [sum(r.source == "a" for r in got if r.shard == s) for s in range(len(got) // 16)]
    assert min(shares) >= 6 and max(shares) <= 16


def rows_for_mix(edge_rows):
    return [(*r, "edge") for r in edge_rows] + [(1000 + i, " ".join(f"w{i}_{j}" for j in range(i * 13 % 300)), [None, "a", "b", "c", "hot"][min(4, i % 9)]) for i in range(400)]


def test_counts(spark, docs, edge_rows):
    rows = rows_for_mix(edge_rows)
    got = mix_counts(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, by_target = fill(sizes), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target[(r.source_size, round(r.target, 3))] += r.taken
    assert {k: v for k, v in by_target.items()} == {(sizes[s], round(want[s], 3)): round(want[s]) for s in sizes}
    again = mix_counts(docs(list(reversed(rows))).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_counts(docs([])).count() == 0


def test_documents_hold_the_taken_words(spark, docs, edge_rows):
    rows = [r for r in rows_for_mix(edge_rows) if r[0] != 8]
    df = docs(rows)
    out = mix_documents(df, block=32)
    assert out.columns == df.columns
    taken = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        words = WORD.findall(r.text)
        taken[r.doc_id] += len(words)
        assert not Counter(words) - Counter(WORD.findall(texts[r.doc_id])) and r.n_chars == len(r.text)
    want = {r.doc_id: r.taken for r in mix_counts(df, block=32).collect() if r.taken}
    assert dict(taken) == want
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_come_back(spark, docs):
    from gridlens.llm.mixing import mix_documents
    from gridlens.llm.parity_join import keep_one
    from gridlens.llm.sharding import shard
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), f"s{i % 3}") for i in range(30)] + [(7, "tie " * 9, "s1")] * 3
    df = docs(rows, extra=True)
    odd = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for out in (mix_documents(df), keep_one(df), shard(df, 400)):
        kept = [c for c in odd if c not in ("n_bytes", "shard", "depth", "oversize")]
        assert out.count() > 0 and set(kept) <= set(out.columns)
        assert all(set(r) == {7} for r in out.select(*kept).distinct().collect())
