import hashlib
import zlib

from gridlens.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def climb(levels, i, fold, proof):
    for nodes in levels:
        run = nodes[i // 8 * 8:i // 8 * 8 + 8]
        proof += run[:i % 8] + run[i % 8 + 1:]
        fold = h(*run[:i % 8], fold, *run[i % 8 + 1:])
        i //= 8
    return fold


def tree(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return levels, nodes[0]


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    none_first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted([r for r in rows if r[2] == lang], key=lambda r: (none_first(r[0]), leaf(r)))
        trees[lang] = (own, *tree([leaf(r) for r in own]))
    tops, root = tree([trees[lang][2] for lang in langs])
    out = []
    for j, lang in enumerate(langs):
        own, levels, sub = trees[lang]
        for i, r in enumerate(own):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            proof = []
            fold = climb(levels, i, leaf((*r[:4], lower(r[4]))) if bad else leaf(r), proof)
            fold = climb(tops, j, fold, proof)
            out.append((r[0], leaf(r), sub, root, h(*proof), fold, fold == root))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree long, pos long").select(
        "doc_id", "text", "lang", "source", "n_chars", "tree", "pos")
    got = merkle.verify(df, merkle.tampered_text())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out = key([tuple(r) for r in got.collect()])
    assert out == key(brute(rows))
    return out


def test_trees_of_several_sizes(spark):
    sizes = {"a": 1, "b": 8, "c": 9, "dé": 65, None: 3, "": 2, **{f"l{i}": 1 for i in range(6)}}
    rows = [(1000 * k + i, "s", lang, i, f"Text {i} of {lang}") for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    out = check(spark, rows)
    assert {r[6] for r in out} == {True, False}


def test_single_rows_and_empty_tables(spark):
    assert check(spark, [(5, None, "x", None, None)])[0][6]
    check(spark, [(i, "s", "x", 1, "AB") for i in range(70)])
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verify(empty, merkle.tampered_text()).collect() == []


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 3, "Abc"), (1, "", "x", 0, ""), (2, "s", "x", 1, None),
            (3, "s", "x", 5, "Ünï 漢字 😀 A-Z"), (4, "s", "x", 10 ** 6, "LONG text " * 100000), (6, "t", "x", 1, "tie"), (6, "s", "x", 1, "tie"), (6, "s", "x", 1, "tie")]
    check(spark, rows)


def test_hot_runs_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PER_COPY", 16)
    rows = [(i, "s", "x" if i % 4 else "y", 1, f"T{i}") for i in range(300)]
    check(spark, rows)
    m = merkle.build(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    for r in m.runs.groupBy("tree", "level", "block").agg({"salt": "max", "leaves": "max"}).collect():
        assert r["max(salt)"] + 1 == -(-r["max(leaves)"] // 16)
    m.tables.clear()


def test_recursion_row_limit_is_restored(spark):
    before = spark.conf.get(merkle.ROW_LIMIT)
    check(spark, [(i, "s", "x", 1, "AB") for i in range(9)])
    assert spark.conf.get(merkle.ROW_LIMIT) == before
