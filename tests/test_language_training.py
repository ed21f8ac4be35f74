"""Where the language model is trained."""

from tessella.llm import langid


def test_the_language_model_is_trained_in_a_task(spark, monkeypatch):
    rows = [(i, *(("the cat sat on the mat", "en") if i % 2 else ("der hund lief durch den wald", "de"))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs.limit(0)).languages == ()
    monkeypatch.setattr(langid, "train", None)  # the driver's; tasks import their own
    assert langid.fit(docs).languages == ("de", "en")
