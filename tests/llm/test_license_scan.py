import random
import re

from gridlens.llm.license_scan import BASE_PHRASES, TEMPLATES, Automaton, Scanner, license_scan

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for p, label in BASE_PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(8)]
    a = Automaton(templates)
    subs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(200):
        text = [rng.randrange(5) for _ in range(30)]
        state = length = 0
        for i, w in enumerate(text):
            state, length = a.step(state, length, w)
            want = next((n for n in range(i + 1, 0, -1) if tuple(text[i + 1 - n:i + 1]) in subs), 0)
            assert length == want
            if length:
                run = text[i + 1 - length:i + 1]
                ends = {(t, e) for t, row in enumerate(templates) for e in range(len(row)) if e + 1 >= length and row[e + 1 - length:e + 1] == run}
                assert set(a.ends[state]) == ends


def test_base_columns_equal_brute_force(spark, docs, edge_rows):
    rng = random.Random(5)
    bits = ["GNU", "general", "public", "license", "apache", "License", "CC", "by", "MIT", "x", "the", "CC-BY", "é", "cc by cc by"]
    rows = edge_rows + [(100 + i, " ".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(200)]
    got = license_scan(docs(rows, extra=True)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, r.base_labels) for r in got) == \
        sorted((i or -1, n, b, f or -1, la or -1, lab) for i, t in [x[:2] for x in rows] for n, b, f, la, lab in [brute(t)])
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_templates_found_with_small_edits(spark, docs):
    mit = next(t for x, t in TEMPLATES if x == "mit" and len(t) > 100)
    edited = mit.replace("documentation", "docs").replace("without limitation", "unlimited")
    rows = [(1, "intro words. " + mit + " tail"), (2, "a b c " + edited), (3, "Permission is hereby denied to any person"), (4, mit[:60])]
    got = {r.doc_id: r for r in license_scan(docs(rows)).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[1].spans[0].first_word == 2
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1
    assert got[3].labels == "" and got[4].labels == "" and 0 < got[4].score < 0.5


def test_long_repeats_and_empty_table(spark, docs):
    text = "released under the MIT license. " * 3000
    r = license_scan(docs([(1, text)])).collect()[0]
    assert (r.n_base, r.first_word, r.last_word, r.labels) == (3000, 3, 3 + 5 * 2999, "mit")
    assert license_scan(docs([])).count() == 0


def test_scanner_is_small():
    assert len(Scanner().automaton.next) < 3000
