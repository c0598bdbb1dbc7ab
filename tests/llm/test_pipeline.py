"""The pipeline's stages, each on its own input."""

import corpus_pipeline
from docgrain.llm import queries


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.read(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "mix", "pack"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        ids = {r[0] for r in out.select("doc_id").collect()}
        before = {r[0] for r in kept.select("doc_id").collect()}
        assert ids and ids <= before
        kept = out.cache()
    whole = {r.doc_id: r for r in docs.collect()}
    assert all(whole[r.doc_id] == r for r in kept.collect())
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert packed.where("piece = 0").count() == kept.count()
