"""Clashing names, changing row orders, very long texts, empty tables: results stay as defined."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing, ngram_join, quality, sharding, suffix_dedup, toxicity, vectors
from tests.llm.corpus import empty, frame, prose, rows

CLASHING = ["_id", "_size", "_words", "_kept", "_cut_id", "_gone", "_rest", "_crc", "_no", "_row_no", "row", "key", "id", "id_key", "gone", "size", "passes", "once", "rest", "copy", "shard", "slot", "h1", "words", "_language", "language", "n", "text_language"]


def clashing(docs):
    return docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING])


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = clashing(frame(spark))
    out = f(spark, docs, "")
    if stage == "bpe":
        assert out.count() == docs.count()
        return
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"mine {c}" for r in got for c in CLASHING)
    assert f(spark, clashing(empty(spark)), "").count() == 0


def test_operators_ignore_columns_of_any_name(spark, tmp_path):
    docs = clashing(frame(spark))
    assert quality.cascade(docs.drop("n")).count() == docs.count()
    assert sharding.interleave(docs).count() == docs.count()
    assert mixing.curriculum(docs).count() == docs.count()
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.doc_id, r.text or "", r._crc) for r in back.collect()) == sorted((i, t or "", "mine _crc") for i, t, *_ in rows())
    per = sharding.interleave(docs.drop("shard"), 3)
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in per.collect()}


def unstable(docs):
    """docs whose rows come in another order and other partitions whenever they are read."""

    def shuffled(batches):
        import os

        import pyarrow as pa

        rng = np.random.default_rng(int.from_bytes(os.urandom(8), "little"))
        for batch in batches:
            yield batch.take(pa.array(rng.permutation(len(batch))))

    return docs.repartition(3).mapInArrow(shuffled, docs.schema)


def test_results_do_not_hang_on_row_order(spark):
    docs = frame(spark).select("doc_id", "text")
    odd = unstable(docs)
    pairs = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert pairs(ngram_join.jaccard_groups(odd, 4, 85)) == pairs(ngram_join.jaccard_groups(docs, 4, 85))
    assert pairs(suffix_dedup.repeated_strings(odd)) == pairs(suffix_dedup.repeated_strings(docs))
    assert any(r[2] for r in pairs(suffix_dedup.repeated_strings(odd)))


def test_rows_alike_are_streamed_alike(spark):
    data = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "w x y z", "en", "s", 7), (2, "e f g", "en", "t", 5)] * 2
    runs = [sorted((r.doc_id, r.text) for r in mixing.training_stream(frame(spark, data).repartition(n)).collect()) for n in (1, 5, 7)]
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_order_of_rules_repeats(spark):
    docs = frame(spark)
    orders = [[r.name for r in quality.order_rules(docs.repartition(n), quality.default_rules())] for n in (1, 2, 3, 5, 8)]
    assert all(o == orders[0] for o in orders)
    loud = spark.createDataFrame([(i, "LOUD WORDS EVERYWHERE " * 3 + " ".join(f"A{i}X{k}" for k in range(30))) for i in range(40)], "doc_id long, text string")
    rules = quality.order_rules(loud, quality.default_rules())
    assert rules[0].name == "shouting"  # the only one that rejects any
    # Two rules reject the same rows: once the cheaper one has gone first, the dearer rejects nothing.
    same = F.col("n_words") > 0
    dear, cheap, rest = quality.Rule("dear", same, F.lit(50.0)), quality.Rule("cheap", same, F.lit(5.0)), quality.Rule("rest", F.col("n_words") > 10_000, F.lit(1.0))
    assert [r.name for r in quality.order_rules(loud, [dear, cheap, rest])][0] == "cheap"


def test_verdicts_row_by_row(spark):
    texts = [r[1] for r in rows()] + ["# " * 40 + prose(random.Random(1), 40), "one two three\n" * 9 + prose(random.Random(2), 60), "Loud! " * 3 + "! ? " * 40, "123 456 " * 30 + " ".join(map(str, range(40)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    failing = F.lit(False)
    for rule in quality.default_rules():
        failing |= F.coalesce(rule.fails, F.lit(False))
    want = {r.doc_id: not r.base and not r.bad for r in quality.features(docs).select("doc_id", quality.base_failed().alias("base"), failing.alias("bad")).collect()}
    got = {r.doc_id: r.kept for r in quality.cascade(docs).collect()}
    assert got == want and True in got.values() and False in got.values()


def test_a_very_long_text(spark):
    """One text of 5 MB (half a million words) beside short ones: whole, not cut."""
    docs = frame(spark).where("doc_id < 6").select("doc_id", "text")
    long = docs.limit(1).select(F.lit(900).cast("long").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500_000)), lambda i: F.concat(F.lit("w"), F.md5(i.cast("string")).substr(1, 8)))).alias("text"))
    both = docs.union(long)
    found = {r.doc_id: r for r in suffix_dedup.repeated_strings(both).collect()}
    assert found[900].n_bytes == 500_000 * 10 - 1 and found[900].n_removed == 0
    assert {r.doc_id: r.n_words for r in quality.features(both).collect()}[900] == 500_000
    assert {r.doc_id: r.size for r in mixing.curriculum(both.withColumn("source", F.lit("s"))).collect()}[900] == 500_000


def test_recall_of_a_grid_with_few_visits(spark):
    """Thousands of vectors, one label with most of them: cells by far outnumber visits."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 24))
    for i in range(0, 6000, 4):
        near = x[i] / np.linalg.norm(x[i])
        for k in (1, 2):
            noise = rng.standard_normal(24)
            noise -= noise @ near * near
            c = rng.uniform(0.93, 0.97)
            x[i + k] = c * near + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)
    label = np.where(np.arange(6000) // 4 % 8 < 6, "big", "small")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, total = np.zeros(6000, int), 0
    for a in range(0, 6000, 1000):
        hit = (unit[a : a + 1000] @ unit.T >= 0.93) & (label[a : a + 1000, None] == label)
        n[a : a + 1000] = hit.sum(1) - 1
    total = n.sum()
    data = [(i, v.astype(float).tolist(), str(la)) for i, (v, la) in enumerate(zip(x, label, strict=True))]
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string"), 0.93, cell_rows=16).collect()}
    assert all(got[i] <= n[i] for i in range(6000))
    recall = sum(got.values()) / total
    print(f"recall {recall:.4f} of {total} links")
    k = int(np.ceil(np.sqrt(4500 / 16)))
    index = vectors.MultiIndex.fit(unit, k, 0.93)
    assert index.visits < 0.5 * k * k and recall >= 0.9


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    ngram_join.jaccard_groups(frame(spark)).count()
    assert spark.conf.get(key) == before
    assert toxicity.TRAIN_ROWS > 0


def test_index_blocks_are_skipped_unread():
    """Sets that share rare tokens only late: their blocks can't reach the overlap."""
    homes = [np.array([i * 1000 + k for k in range(40)] + [7, 8, 9], np.uint64) for i in range(1, 400)]
    index = ngram_join.PositionIndex(homes)
    alike, other = homes[5], np.array([7, 8, 9, *range(900_000, 900_040)], np.uint64)
    x, h = ngram_join.links_between(homes, [alike, other], 80, index)
    assert (x.tolist(), h.tolist()) == ([0], [5])
    assert index.entries_read < 300  # lists of 7, 8 and 9 alone hold 1,197
