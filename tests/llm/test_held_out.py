"""Tests that a constant answer, or a table without links, can't pass."""

import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import queries
from tests.llm.corpus import frame, prose, rows
from tests.llm.test_duplicates import brute_repeats, groups, shingles

LARGE = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the test tables")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def area_under_curve(score, label):
    """The chance that a toxic document scores above a clean one, ties half."""
    score, label = np.asarray(score), np.asarray(label)
    above = (score[label == 1][:, None] > score[label == 0]).mean()
    return above + (score[label == 1][:, None] == score[label == 0]).mean() / 2


@needs_tables
def test_toxic_documents_of_the_held_out_fold(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect() if r.toxic is not None}
    got = {r.doc_id: r for r in queries.op4_toxicity_trees(spark, LARGE).collect()}
    fold = [i for i in labels if held(i) and i in got]
    toxic = np.array([labels[i] for i in fold])
    predicted = np.array([got[i].predicted for i in fold])
    assert toxic.sum() >= 50 and all(got[i].held_out for i in fold)
    assert area_under_curve([got[i].score for i in fold], toxic) >= 0.95
    assert predicted[toxic == 1].mean() >= 0.85 and predicted[toxic == 0].mean() <= 0.01
    assert area_under_curve([0.0] * len(fold), toxic) == 0.5


@needs_tables
def test_languages_of_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang").collect()
    got = {r.doc_id: r.lang_pred for r in queries.op7_language_softmax(spark, LARGE).collect()}
    fold = [r for r in docs if r.lang is not None and held(r.doc_id)]
    for lang in {r.lang for r in fold}:  # each by itself, so that no frequent one hides another
        mine = [r for r in fold if r.lang == lang]
        assert sum(got[r.doc_id] == lang for r in mine) >= 0.95 * len(mine), lang


def test_vector_query_on_a_table_with_links(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((900, 32))
    for i in range(0, 900, 3):  # a neighbour on either side of the threshold
        unit = x[i] / np.linalg.norm(x[i])
        for k, c in ((1, rng.uniform(0.932, 0.99)), (2, rng.uniform(0.88, 0.928))):
            noise = rng.standard_normal(32)
            noise -= noise @ unit * unit
            x[i + k] = rng.uniform(0.5, 3) * (c * unit + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise))
    x = x.astype(np.float32)
    label = [None if i % 50 == 9 else i // 3 % 4 for i in range(900)]
    data = [(i, v.tolist(), la) for i, (v, la) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    known = np.array([-1 if la is None else la for la in label])
    linked = (unit @ unit.T >= 0.93) & (known[:, None] == known) & (known >= 0)[:, None]
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in queries.op8_vector_multi_index(spark, str(tmp_path)).collect()}
    assert len(got) == 900 and linked.sum() > 500
    assert all(got[i].n_links <= linked[i].sum() for i in range(900))
    assert sum(r.n_links for r in got.values()) >= 0.9 * linked.sum()
    root = groups(900, list(zip(*np.nonzero(linked), strict=True)))
    assert all(got[i].component_id >= root[i] and got[i].kept == (got[i].component_id == i) for i in range(900))
    assert sum(got[i].component_id == root[i] for i in range(900)) >= 0.95 * 900


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Stage after stage as run() chains them: what each one gives for what the one before it gave."""
    rnd = random.Random(6)
    passage = prose(rnd, 70)
    data = [r for r in rows(3, 60) if r[0] < 100] + [(500 + i, f"{prose(rnd, 50)} {passage} {prose(rnd, 40)}", "en", "s1", None) for i in range(6)]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = {r.doc_id: r.text for r in docs.collect()}
    given = after["language_id"]
    ids = sorted(given)
    sets = [shingles(given[i], 5) for i in ids]
    linked = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = groups(len(ids), linked)
    assert after["ngram_jaccard"] == {i: given[i] for k, i in enumerate(ids) if root[k] == k} and len(after["ngram_jaccard"]) < len(given)
    want = brute_repeats(sorted(after["ngram_jaccard"].items()), 100)
    cut = {i: t if want[i][1] == 0 else want[i][4].decode("utf-8", "ignore") for i, t in after["ngram_jaccard"].items()}
    assert after["suffix_array"] == {i: t for i, t in cut.items() if want[i][1] == 0 or t.strip(" \t\n\v\f\r")}
    assert sum(n[1] > 0 for n in want.values()) >= 5
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} <= set(after["suffix_array"]) and whole
