"""Every registered query over the whole smallest tables: against its SQL, or against brute force."""

import hashlib
import math
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import bpe, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())


def ids_of(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(bpe.vocabulary_file(None, name))
    t.no_truncation()
    t.no_padding()
    return t, {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}


def test_bpe_query(spark, texts):
    t, ids = ids_of(texts, "byte_bpe_50k.json")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(x), digest(np.array(x, "<u4").tobytes()), digest(t.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    assert {tuple(r) for r in queries.op2_bpe_word_table(spark, DIR).collect()} == want


def test_token_file_query(spark, texts):
    _, ids = ids_of(texts, "word_bpe_49k.json")
    want, start = set(), 0
    for i in sorted(ids):
        x = np.array([*ids[i], 2], "<u4")
        want.add((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert {tuple(r) for r in queries.op9_token_wavelet(spark, DIR).collect()} == want


def test_model_queries_on_the_fold_they_never_saw(spark, duck):
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    toxic = dict(duck.sql("select doc_id, max(toxic) from labels where toxic is not null group by 1").fetchall())
    got = queries.op4_toxicity_trees(spark, DIR).collect()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)
    lang = dict(duck.sql("select doc_id, lang from documents where lang is not null").fetchall())
    got = queries.op7_language_softmax(spark, DIR).collect()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_vector_query_against_all_pairs(spark, duck):
    rows = duck.sql("select vec_id, embedding, label from embeddings").fetchall()
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label) & (label >= 0)[:, None]
    n = linked.sum(1) - (label >= 0)
    got = {r.vec_id: r for r in queries.op8_vector_multi_index(spark, DIR).collect()}
    assert len(got) == len(rows) and all(got[r[0]].n_links <= m for r, m in zip(rows, n, strict=True))
    assert sum(got[r[0]].n_links for r in rows) >= 0.9 * n.sum()


def test_pipeline_from_end_to_end(spark, texts):
    out = corpus_pipeline.run(spark, DIR).collect()
    t, _ = ids_of({}, "byte_bpe_50k.json")
    assert out and {r.doc_id for r in out} <= set(texts)
    assert all(r.n_tokens == len(r.ids) and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in out)
    for r in out:
        text = t.decode(r.ids, skip_special_tokens=False)
        assert hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
    assert {s for s, _ in corpus_pipeline.STAGES} == {"language_id", "ngram_jaccard", "suffix_array", "mixing", "bpe"}


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.read.parquet(f"{DIR}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
