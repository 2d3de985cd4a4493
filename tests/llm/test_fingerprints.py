import hashlib
import random

import numpy as np

from gridlens.llm import fingerprints as fp


def brute(rows):
    """(doc_id, n_chars, edited sha) in the documented order."""
    rows = [(i, t or "") for i, t in rows]
    out = []
    known = sorted([r for r in rows if r[0] is not None])
    assert len({i for i, _ in known}) == len(known)
    for j, (i, t) in enumerate(known):
        nxt = known[(j + 1) % len(known)][1]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return out


def test_multiset_properties():
    a, b, c = "one two three.", "four five six seven", "eight"
    v = fp.vectors(["\n".join(x) for x in ([a, b, c], [c, a, b], [a, b], [a, b, c, c])] + [c])
    assert (v[0] == v[1]).all() and (v[0] != v[2]).any() and (v[0] != v[3]).any()
    assert (fp.combine(v[2:3], v[4:5]) == v[0:1]).all()
    assert (fp.combine(v[3:4], v[4:5], -1) == v[0:1]).all()
    assert not fp.vectors([""]).any()


def test_likeness_follows_shared_phrases():
    rng = random.Random(1)
    sentence = lambda: " ".join("w%d" % rng.randrange(10 ** 6) for _ in range(8)) + "."
    for share in (0.0, 0.25, 0.5, 0.9):
        base = [sentence() for _ in range(200)]
        other = base[:int(200 * share)] + [sentence() for _ in range(200 - int(200 * share))]
        v = fp.vectors([" ".join(base), " ".join(other)])
        want = share / (2 - share)
        assert abs(fp.likeness(v[:1], v[1:])[0] - want) < 0.15
    v = fp.vectors(["same", "same", "", ""])
    assert fp.likeness(v[:1], v[1:2])[0] == 1.0 and fp.likeness(v[2:3], v[3:])[0] == 1.0


def test_edited_text_and_order(spark, docs):
    rng = random.Random(2)
    rows = [(i * 7 % 401, "".join(rng.choice("abc é漢😀\n. ") for _ in range(rng.randrange(300)))) for i in range(401)] + [(10 ** 12, "far"), (-5, None)]
    got = fp.fingerprint_edits(docs(rows, extra=True)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(brute(rows))
    texts = dict(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].fingerprint == fp.vectors([t or ""])[0].tobytes().hex() for i, t in texts.items())
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_one_row_empty_table_and_null_ids(spark, docs, edge_rows):
    one = fp.fingerprint_edits(docs([(3, "abcd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    assert fp.fingerprint_edits(docs([])).count() == 0
    rows = edge_rows + [(None, f"null {i % 5}") for i in range(50)]
    got = fp.fingerprint_edits(docs(rows)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 51
    assert len({r.fingerprint for r in got if r.doc_id in (8, 9)}) == 1


def test_plain_fingerprint_needs_no_shuffle(spark, docs):
    df = fp.fingerprint(docs([(1, "a"), (2, None)]))
    assert "Exchange" not in df._jdf.queryExecution().toString()
    assert {r.doc_id: r.fingerprint for r in df.collect()}[2] == "00" * (fp.WIDE * 8 + fp.SIGNS * 4)
    assert np.array_equal(fp.vectors(["x\ny"]), fp.vectors(["y\nx"]))


def test_long_repeats_do_not_wrap():
    half = "\n".join(["the same short line"] * 40000)
    v = fp.vectors([half, half[:len(half) // 2] + "\n" + "other words here. " * 3, "\n".join(["the same short line"] * 70000)])
    assert fp.likeness(v[:1], v[1:2])[0] > 0.4 and fp.likeness(v[:1], v[2:])[0] > 0.4
    assert (fp.combine(v[:1], v[:1]) == fp.vectors([half + "\n" + half])).all()
