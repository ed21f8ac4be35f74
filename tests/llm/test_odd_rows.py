"""Nulls in every column, blank texts, repeated rows, sources without words: through all registered queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing, queries
from tests.llm.corpus import SCHEMA, frame, prose, rows

import random


def odd_rows():
    rnd = random.Random(5)
    good = [(i, prose(rnd, 60), ("en", "de")[i % 2], f"s{i % 3}", None) for i in range(40)]
    odd = [(None, None, None, None, None), (None, "", "en", "s0", 0), (None, "two words", None, None, 9), (50, None, "en", "hollow", None), (51, "", "de", "hollow", 0), (52, " \n\t ", None, "hollow", 3), (53, None, None, None, None)]
    return good + odd + [good[0], good[0], odd[0], odd[3]]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(odd_rows(), SCHEMA).select("*", F.lit("x").alias("word"), F.lit(1).alias("n"), F.lit("y").alias("key"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, i % 2) for i in range(40)] + [(None, None, None), (3, None, None), (3, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows_pass_through_every_query(spark, odd_dir, name):
    n = 8 if name.startswith("op8_") else len(odd_rows())
    got = queries.QUERIES[name](spark, odd_dir).collect()
    if name == "op11_spelling_variants":
        assert len({r.word for r in got}) == len(got) > 0
    else:
        assert len(got) == n
    assert all(r.held_out is not None for r in got if "held_out" in r)


def test_odd_rows_pass_through_the_pipeline(spark, odd_dir):
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd_dir).collect()} <= {i for i, *_ in odd_rows()}


ONLY_EMPTY = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t", None, None, 2)]


def test_a_source_without_words_takes_none(spark):
    got = {r.doc_id: r for r in mixing.curriculum(frame(spark, [*rows(), (900, None, None, "hollow", None), (901, "", None, "hollow", 0)])).collect()}
    assert (got[900].target, got[900].taken, got[900].source_size, got[900].passes) == (0.0, 0, 0, [])
    assert sum(r.taken for r in got.values()) > 0
    assert [(r.target, r.taken) for r in mixing.curriculum(frame(spark, ONLY_EMPTY)).collect()] == [(0.0, 0)] * 3
    assert mixing.training_stream(frame(spark, ONLY_EMPTY)).count() == 0


@pytest.mark.parametrize("w0, w1", [(0.0, 2.0), (2.0, 0.0), (0.0, 0.0)])
def test_weights_that_begin_or_end_at_zero(spark, w0, w1):
    docs = frame(spark, [(i, prose(random.Random(i), 20), "en", "ab"[i % 2], None) for i in range(20)])
    schedule = spark.createDataFrame([("a", w0, w1), ("b", 1.0, 1.0)], "source string, w0 double, w1 double")
    got = mixing.curriculum(docs, schedule).collect()
    a = [r for r in got if r.source == "a"]
    if w0 + w1 == 0:
        assert all(r.target == 0 and r.taken == 0 and r.position is None for r in a)
        return
    assert all(r.target == 200 and r.taken == r.size == 20 for r in got)
    starts = sorted(r.position for r in a)
    shares = [k / 10 for k in range(10)]  # ten documents of 20 words lie evenly on the token axis
    want = [s**0.5 if w0 == 0 else 1 - (1 - s) ** 0.5 for s in shares]
    assert all(abs(x - y) < 1e-9 for x, y in zip(starts, want, strict=True))
    assert mixing.training_stream(docs, schedule).count() == 20
