import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, quality, token_files, toxicity
from tests.llm.corpus import empty, frame, rows


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_features_and_cascade(spark):
    texts = [r[1] for r in rows()] + ["a b c d e f g h i " * 9, "one line here\n" * 4 + "\n\nend", "### " * 30, "SHOUT! LOUD! " * 20]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.cascade(docs).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.cascade(empty(spark)).count() == 0


def test_rule_order_leaves_the_verdict(spark):
    docs = frame(spark)
    rules = quality.default_rules()
    a = {(r.doc_id, r.kept) for r in quality.cascade(docs, rules).select("doc_id", "kept").collect()}
    assert a == {(r.doc_id, r.kept) for r in quality.cascade(docs, rules[::-1]).select("doc_id", "kept").collect()}
    assert all(kept for i, kept in a if i in (0, 1, 5, 6) and len((rows()[i][1] or "").split()) >= 30)


@pytest.fixture(scope="module")
def vocabularies():
    return {n: bpe.vocabulary_file(None, n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def odd_texts(n=3000):
    rnd = random.Random(2)
    signs = [*"abcXYZ 's't!?.,<|>#0123éßÉÖñ\n\t \r\x1c\x85  Σς½ⅧİıǅŉΩ中́😀", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " the", "don't", "The,"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [r[1] or "" for r in rows()]


def test_words_encode_as_the_library_encodes_texts(vocabularies):
    from tokenizers import Tokenizer

    texts = odd_texts()
    for name, v in vocabularies.items():
        want = [e.ids for e in Tokenizer.from_str(v).encode_batch(texts, add_special_tokens=False)]
        encoder = bpe.PieceEncoder(v)
        if encoder.spaced:
            raw, off = bpe.bytes_of(pa.array(texts))
            begins = bpe.word_borders(raw, off)
            words = bpe.strings_from(raw, np.append(begins, len(raw)))
            n, ids = encoder.many(words)
            cut = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begins, off)]
        else:
            n, ids = token_files.BatchEncoder(v)(pa.array(texts))
            cut = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == want, name


def test_bpe_round_trip(spark, vocabularies):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabularies["byte_bpe_50k.json"])
    docs = frame(spark).withColumn("n_tokens", F.lit("clash"))
    want = []
    for i, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    got = bpe.encode(docs, vocabularies["byte_bpe_50k.json"], with_ids=True, with_decoded=True).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)
    assert all(r.decoded == (dict((i, x) for i, x, *_ in rows())[r.doc_id] or "") for r in got)
    assert bpe.encode(empty(spark), vocabularies["byte_bpe_50k.json"]).count() == 0
    same = spark.createDataFrame([(None, "a b")] * 50, "doc_id long, text string").repartition(5)
    assert bpe.encode(same, vocabularies["byte_bpe_50k.json"]).count() == 50


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(0).integers(0, 300, 3000)
    ids[::7] = 5
    m = token_files.WaveletMatrix(token_files.WaveletMatrix.build(ids, 9, np.arange(2), np.array([1000, 2000])).to_bytes())
    assert (m.decode() == ids).all() and [m.access(i) for i in range(0, 3000, 61)] == ids[::61].tolist()
    at = np.flatnonzero(ids == 5)
    assert [m.occurrence(5, k) for k in range(len(at))] == at.tolist() and m.occurrence(5, len(at)) == -1
    assert m.count(5, 100, 900) == ((at >= 100) & (at < 900)).sum() and m.count(511) == 0 and m.count(1 << 12) == 0
    none = token_files.WaveletMatrix(token_files.WaveletMatrix.build(np.zeros(0, int), 9, np.zeros(0, int), np.zeros(0, int)).to_bytes())
    assert len(none.decode()) == 0 and none.count(1) == 0
    with pytest.raises(IndexError):
        m.access(3000)


def test_wavelet_answers_open_few_blocks():
    ids = np.random.default_rng(1).integers(0, 500, 1_000_000)
    blob = token_files.WaveletMatrix.build(ids, 9, np.arange(1), np.array([len(ids)])).to_bytes()
    at = np.flatnonzero(ids == 77)
    for ask, want in ((lambda m: m.access(654_321), ids[654_321]), (lambda m: m.count(77, 1000, 900_000), ((at >= 1000) & (at < 900_000)).sum()), (lambda m: m.occurrence(77, 1500), at[1500])):
        m = token_files.WaveletMatrix(blob)
        assert ask(m) == want
        assert m.opened <= 3 * m.bits < m.bits * m.n_blocks


def test_token_files(spark, vocabularies):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabularies["word_bpe_49k.json"])
    data = [r for i, r in enumerate(rows()) if i < 50]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(frame(spark, data), vocabularies["word_bpe_49k.json"], 2, shard_tokens=700).collect()}
    at = 0
    for i, text, *_ in sorted(data, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(empty(spark), vocabularies["word_bpe_49k.json"], 2).count() == 0


LANGS = {"en": "the cat sat on that mat with which they were playing".split(), "de": "der hund und die katze sind nicht auf dem stuhl gewesen".split(), "fr": "le chat est sur la table avec les autres qui sont la".split()}


def speak(rnd, lang, n):
    return " ".join(rnd.choice(LANGS[lang]) for _ in range(n))


def test_language(spark):
    rnd = random.Random(0)
    data = [(i, speak(rnd, la, rnd.randint(4, 40)), la) for i, la in enumerate(rnd.choice(list(LANGS)) for _ in range(400))]
    docs = spark.createDataFrame([*data, (1000, None, "en"), (1001, "", None), (1002, "123 !!", "de")], "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == la for i, _, la in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert sum(got[i].rejected for i, *_ in data) <= 0.03 * len(data) and all(0 <= r.score <= 1 for r in got.values())
    parts = langid.scores(model, pa.array([d[1] for d in data]), group_bytes=50)
    assert np.allclose(parts, langid.scores(model, pa.array([d[1] for d in data])))
    nothing = langid.fit(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_toxicity(spark):
    rnd = random.Random(4)
    bad = ["dreck", "scumbag", "vermin"]
    data = []
    for i in range(600):
        words = speak(rnd, "en", rnd.randint(8, 60)).split()
        toxic = i % 5 == 0
        for _ in range(2 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        data.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (9000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("predicted", F.lit("x")), model).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert set(bad) <= set(model.lexicon.words)
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_isotonic_against_all_ways_to_cut():
    """The best non-decreasing step function, by trying every way to cut the points into steps."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        z, y, w = rng.integers(0, 6, 9).astype(float), rng.integers(0, 2, 9).astype(float), rng.integers(1, 4, 9).astype(float)
        points = np.unique(z)
        best = np.inf
        for cuts in range(1 << (len(points) - 1)):
            step = np.concatenate([[0], np.cumsum([cuts >> i & 1 for i in range(len(points) - 1)])])[np.searchsorted(points, z)]
            mean = np.bincount(step, w * y) / np.bincount(step, w)
            if (np.diff(mean) >= 0).all():
                best = min(best, (w * (y - mean[step]) ** 2).sum())
        x, v = toxicity.isotonic(z, y, w)
        assert (np.diff(v) >= 0).all() and abs((w * (y - np.interp(z, x, v)) ** 2).sum() - best) < 1e-9


def test_trees_against_every_split():
    """A tree of one split takes the best of all splits of all features."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (40, 3)).astype(float)
    g, h = rng.standard_normal(40), rng.uniform(0.5, 1, 40)
    edges = [np.unique(c) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    tree = toxicity.grow(bins, edges, g, h, 1)
    gains = {}
    for f in range(3):
        for e in edges[f]:
            left = x[:, f] <= e
            if min(h[left].sum(), h[~left].sum()) >= 1:
                gains[f, e] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
    assert (tree.feature[0], tree.cut[0]) == max(gains, key=gains.get)
    side = x[:, tree.feature[0]] > tree.cut[0]
    assert np.allclose(tree(x), [-g[side == s].sum() / (h[side == s].sum() + 1) for s in side])


def test_rare_labels_are_learned_within_the_bound(spark):
    rnd = random.Random(8)
    data = [(i, speak(rnd, "en", 20) + (" vermin dreck vermin" if i % 50 == 0 else ""), int(i % 50 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), max_rows=400)
    found = toxicity.score(docs, model).agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg("score")).first()
    assert found[0] >= 0.99 and found[1] < 0.1
    langs = [(i, speak(rnd, "en" if i % 100 else "de", 30), "en" if i % 100 else "de") for i in range(3000)]
    frame_ = spark.createDataFrame(langs, "doc_id long, text string, lang string")
    assert set(langid.fit(frame_, max_rows=60).languages) == {"en", "de"}
