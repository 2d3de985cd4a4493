import re

import corpus_pipeline
from gridlens.llm.decontaminate import benchmark_hits
from gridlens.llm.mixing import mix_counts
from gridlens.llm.parity_join import similarity_components
from gridlens.llm.quality import quality_scores
from gridlens.llm.sharding import shard

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_on_what_the_one_before_kept(spark, tmp_path):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    names = docs.columns
    kept, outs = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, SF).write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(kept)
        assert i == 4 or kept.columns == names
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(outs[0]) == ids(quality_scores(docs, read("labels")).where("keep AND NOT toxic"))
    comps = similarity_components(outs[0], 5, 80, 100)
    assert ids(outs[1]) == ids(comps.where("doc_id = component_id")) and outs[1].count() == len(ids(outs[1]))
    assert ids(outs[2]) == ids(outs[1]) - ids(benchmark_hits(outs[1], read("benchmark")))
    words = {r.doc_id: r.taken for r in mix_counts(outs[2]).collect() if r.taken}
    got = {}
    for r in outs[3].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall("[^\x20\x09-\x0D]+", r.text))
    assert got == words
    assert sorted(map(str, outs[4].collect())) == sorted(map(str, shard(outs[3], corpus_pipeline.SHARD_BYTES).collect()))


def test_five_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} <= set(out.columns) and out.count() > 100
