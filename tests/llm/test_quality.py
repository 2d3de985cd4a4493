import numpy as np
import pytest

from pyspark.sql import functions as F

from gridlens.llm.quality import _summed, _unlabelled, fit_logistic, keep_good, quality_scores, sigmoid


def made(rng, i):
    good = i % 4 != 0
    words = ["river", "stone", "walks", "under", "evening", "light", "quiet", "road", "letter", "garden"]
    if good:
        return " ".join(rng.choice(words, 60)) + ".\n" + " ".join(rng.choice(words, 40)) + "."
    return ("BUY!! " * 5 + " ".join(w.upper() + "!!" for w in rng.choice(words, 50)))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    return [(i, made(rng, i), "s%d" % (i % 3)) for i in range(900)]


def test_held_out_rows_are_told_apart(spark, docs, corpus, edge_rows):
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int")
    df = docs(corpus + [(10000 + (r[0] or 0), r[1]) for r in edge_rows], extra=True)
    got = quality_scores(df, labels, fit_rows=150, picks=20).collect()
    assert len(got) == len(corpus) + len(edge_rows)
    held = [r for r in got if 200 <= r.doc_id < 10000]
    assert np.mean([r.keep == (r.doc_id % 4 != 0) for r in held]) > 0.98
    assert all(0 <= v <= 1 for r in got for v in (r.text_score, r.meta_score, r.score))
    kept = keep_good(df, labels, fit_rows=150, picks=20)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)


def test_no_labels_one_class_and_empty_table(spark, docs, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = docs(corpus[:20] + [(None, None)])
    assert {r.score for r in quality_scores(df, none).collect()} == {0.5}
    bad = spark.createDataFrame([(i, 0) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert not any(r.keep for r in quality_scores(df, bad).collect())
    assert quality_scores(docs([]), none).count() == 0 and keep_good(docs([]), none).count() == 0


def test_calibration_is_near_the_truth():
    rng = np.random.default_rng(0)
    z = rng.normal(size=20000)
    y = (rng.random(20000) < sigmoid(2 * z - 1)).astype(float)
    slope, shift = fit_logistic(z[:, None], y)
    assert abs(slope - 2) < 0.1 and abs(shift + 1) < 0.1


def test_given_labels_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = labels.where("doc_id % 2 = 0")
    got = quality_scores(docs, few).join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality").collect()
    good = [r.keep for r in got if r.quality == 1]
    bad = [not r.keep for r in got if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.7


def test_pseudo_labels_come_from_each_unlabelled_text_once(spark, docs):
    """500 copies of one text, repeated rows, null ids and labelled rows beyond the sample."""
    rows = [(i, "the same text") for i in range(500)] + [(600 + i, f"text number {i}") for i in range(40)] + [(640, "twice"), (640, "twice"), (None, "none"), (None, "none")]
    df = docs(rows).selectExpr("doc_id as _id", "text as _text", "lang as _m0").withColumn("_h", F.xxhash64("_text"))
    labelled = spark.createDataFrame([(i,) for i in [0, 1, 600, 601]], "_id long")
    feats = _unlabelled(df, labelled, ["lang"])
    got = sorted(r["_k"] for r in feats.collect())
    assert got == [-2 ** 63, 2, *range(602, 641)]
    assert _summed(feats, 2, lambda t, m: np.array([len(t.dense), m.bucket.size])).tolist() == [41, 41]


def test_all_sure_texts_teach(spark, docs, corpus, monkeypatch):
    """No bound on the documents that pass on labels: each view hears of all sure ones."""
    from gridlens.llm import quality as Q
    seen, summed = [], Q._summed
    monkeypatch.setattr(Q, "_summed", lambda f, n, fn: seen.append((n, summed(f, n, fn))) or seen[-1][1])
    copies = [(5000 + i, corpus[4][1]) for i in range(450)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int")
    got = quality_scores(docs(corpus + copies), labels, fit_rows=150).collect()
    counts = np.array([v for n, v in seen if n == 4]).reshape(-1, 2, 2)      # round, view, class
    assert counts[-1].max() > 400 and counts[:, :, 0].max() <= 175 + 1, counts
    assert np.mean([r.keep == (r.doc_id % 4 != 0) for r in got if 200 <= r.doc_id < 5000]) > 0.98


def test_toxic_labels_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = quality_scores(docs, few).cache()
    got = scored.select("doc_id", F.col("toxic").alias("found")).join(held, "doc_id").collect()
    assert np.mean([r.found for r in got if r.toxic == 1]) > 0.4          # of 182 labels, 16 are toxic
    assert np.mean([not r.found for r in got if r.toxic == 0]) > 0.97
    kept = sorted(r.doc_id for r in keep_good(docs, few).select("doc_id").collect())
    assert kept == sorted(r.doc_id for r in scored.collect() if r.keep and not r.toxic)
