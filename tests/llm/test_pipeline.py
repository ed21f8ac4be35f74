import corpus_pipeline
from tests.llm.corpus import frame


def test_stages_follow_one_another(spark):
    docs = frame(spark)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "").cache()
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, "")
    assert out.count() == before.count()
    assert all(r.n_tokens == len(r.ids) for r in out.collect())
