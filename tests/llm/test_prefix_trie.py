import hashlib
import random
import zlib

from gridlens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth long, c long"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda k: (k[0], k[1], k[2].encode(), k[3].encode()))] for c, v in convs.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def check(spark, rows):
    got = pt.prefix_trie(spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for n, t in got.dtypes if n != "ends_sha256")
    out = sorted([tuple(r) for r in got.collect()], key=lambda r: r[:2])
    assert out == brute(rows)
    return out


def test_lengths_around_the_cuts(spark):
    rng = random.Random(1)
    rows = []
    for c, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 63, 64, 65, 70]):
        for t in range(n):
            rows.append((c, t, "user" if t % 2 else "assistant", "same" if rng.random() < 0.9 else f"turn {rng.randrange(3)}"))
    rng.shuffle(rows)
    assert max(r[1] for r in check(spark, rows)) >= 64


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, 0, "user", "Ünï 漢字 😀"), (1, 0, "user", "b"), (1, 0, "assistant", "b"),
            (2, 1, "user", "x"), (2, 1, "user", "x"), (2, 1, "user", "x"), (3, None, "user", None), (3, 5, None, ""), (-7, 0, "user", "before"), (-10, 0, "user", "first"),
            (10, 0, "user", "long " * 50000), (12, 0, "user", "long " * 50000)]
    check(spark, rows)


def test_copies_share_their_path(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_CHARS", 20)
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(10)] + [(c, t, "user", f"own {c % 3} {t}") for c in range(400, 430) for t in range(6)]
    out = check(spark, rows)
    assert max(r[3] for r in out if r[1] == 8) >= 350


def test_one_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_ROWS", 16)
    rows = [(c, t, "user", str(t % 7)) for c, n in ((0, 300), (1, 260), (4, 5)) for t in range(n)]
    check(spark, rows)


def test_conversations_without_turns_and_empty_tables(spark):
    short = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:6]
    out = check(spark, [(c, 0, "user", "only turn") for c in short])
    assert out[0][1] == 0 and out[0][3] == len(short) and len(out) == 1
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
