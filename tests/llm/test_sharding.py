import hashlib
from collections import defaultdict

from gridlens.llm.sharding import shard, write_shards


def brute(rows, limit):
    """Split one bucket after another until each fits."""
    rows = [(i, t, f"{int(hashlib.md5((('' if i is None else str(i)) + ':' + (t or '')).encode()).hexdigest()[:15], 16):060b}") for i, t in rows]
    out, todo = {}, [("", rows)]
    while todo:
        prefix, bucket = todo.pop()
        if sum(len((t or "").encode()) for _, t, _ in bucket) <= limit or len(bucket) <= 1:
            out.update({(i, t): prefix for i, t, _ in bucket})
        else:
            for bit in "01":
                todo.append((prefix + bit, [r for r in bucket if r[2].startswith(prefix + bit)]))
    return out


def test_equals_splitting_one_by_one(spark, docs, edge_rows):
    rows = [r for r in edge_rows if r[0] != 8] + [(100 + i, "é" * (i * 37 % 900)) for i in range(700)]
    for limit in (1000, 5000, 10 ** 9):
        got = shard(docs(rows, extra=True), limit).collect()
        want = brute(rows, limit)
        assert {(r.doc_id, r.text): r.shard for r in got} == want and len(got) == len(rows)
        assert all(r.depth == len(r.shard) and r.oversize == (r.n_bytes > limit) for r in got)


def test_equal_rows_are_cut_into_runs(spark, docs):
    rows = [(1, "x" * 100)] * 400 + [(i, "y" * 50) for i in range(2, 60)]
    got = shard(docs(rows).repartition(5), 1000).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.n_bytes
    assert max(size.values()) <= 1000 and len([s for s in size if "." in s]) <= 45


def test_empty_table_and_written_shards(spark, docs, tmp_path):
    assert shard(docs([]), 100).count() == 0
    df = shard(docs([(i, "text %d" % i) for i in range(100)]), 200)
    write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
