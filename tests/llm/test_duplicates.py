import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import graph, ngram_join, suffix_array, suffix_dedup, vectors
from tessella.llm.common import Workspace
from tests.llm.corpus import empty, frame, prose, rows


def groups(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(3)
    linked = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    links = spark.createDataFrame(linked + [(None, 1)], "u long, v long").repartition(5)
    want = groups(400, linked)
    got = {r.node: r.component for r in graph.components(links, Workspace(spark, "test")).collect()}
    assert got == {i: want[i] for i in range(400) if want[i] != i}
    assert graph.components(links.where("false"), Workspace(spark, "test")).count() == 0


def shingles(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_jaccard_groups_are_exact(spark):
    rnd = random.Random(8)
    data = [(i, t) for i, t, *_ in rows()[:50]]
    base = prose(rnd, 120).split(" ")
    for i in range(60):  # a large group of near copies, some beyond the threshold
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(9)}"
        data.append((200 + i, " ".join(words)))
    docs = spark.createDataFrame(data + data[:2], "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    for k, percent in ((4, 85), (5, 80), (1, 50)):
        sets = [shingles(t, k) for _, t in data]
        linked = [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        root = groups(len(data), linked)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs, k, percent).collect()}
        assert got == {i: (len(s), data[r][0]) for (i, _), s, r in zip(data, sets, root, strict=True)}
    assert ngram_join.jaccard_groups(empty(spark)).count() == 0
    kept = {r.doc_id for r in ngram_join.one_of_each(frame(spark)).collect()}
    assert kept <= {r[0] for r in rows()} and 0 in kept and {100, 101, 102} <= kept


def test_links_between_blocks_are_exact():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 40, 80).astype(np.uint64)
    order = {int(t): i for i, t in enumerate(rnd.permutation(np.unique(np.concatenate([base, rnd.integers(0, 1 << 40, 400).astype(np.uint64)]))))}
    pool = np.array(list(order), np.uint64)
    sets = []
    for _ in range(50):
        s = set(rnd.choice(base, rnd.integers(60, 80), replace=False).tolist()) | set(rnd.choice(pool, rnd.integers(0, 12)).tolist())
        sets.append(np.array(sorted(s, key=order.get), np.uint64))
    x, h = ngram_join.links_between(sets[:30], sets, 80)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:30]) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    assert set(zip(x.tolist(), h.tolist(), strict=True)) == want


def test_suffix_sorter(monkeypatch):
    rng = np.random.default_rng(0)
    assert {(a - b) % 32 for a in suffix_array.difference_cover(32) for b in suffix_array.difference_cover(32)} == set(range(32))
    for bucket in (1 << 19, 40):
        monkeypatch.setattr(suffix_array, "BUCKET", bucket)
        base = rng.integers(97, 99, 400).astype(np.uint8)
        text = np.concatenate([base[a : a + rng.integers(50, 300)] for a in rng.integers(0, 300, 12)] + [np.full(150, 97, np.uint8)])
        asked = np.flatnonzero(rng.random(len(text) - 100) < 0.7)
        seen: dict = {}
        assert suffix_array.CoverSorter(text).repeats(asked, 100).tolist() == [seen.setdefault(text[i : i + 100].tobytes(), i) for i in asked]
        now, _ = suffix_array.CoverSorter(text).sort_bucket(asked)
        keys = [text[i : i + 128].tobytes() for i in now]
        assert keys == sorted(keys)


def brute_repeats(data, length):
    seen, out = {}, {}
    for i, t in sorted(data):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_repeated_strings_are_exact(spark, monkeypatch):
    data = [(i, t) for i, t, *_ in rows()[:50]] + [(300, "ab" * 400), (301, "ä" * 300), (302, "z" + "ab" * 60)]
    docs = spark.createDataFrame([*data, data[3]], "doc_id long, text string").withColumn("key", F.lit(0)).repartition(3)
    for length, chunk in ((100, 1 << 17), (100, 512), (40, 512)):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        want = brute_repeats(data, length)
        rows_ = suffix_dedup.repeated_strings(docs, length, with_text=True).collect()
        assert len(rows_) == len(data) + 1
        for r in rows_:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id], r.doc_id
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert suffix_dedup.repeated_strings(empty(spark)).count() == 0
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs.drop("key")).collect()}
    want = brute_repeats(data, 100)
    assert all(left[i] == (t if want[i][1] == 0 else want[i][4].decode("utf-8", "ignore")) for i, t in data if i in left)
    assert set(want) - set(left) <= {i for i in want if not want[i][4].strip()}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    for i in range(0, 300, 6):
        x[i + 1] = x[i] + 0.05 * rng.standard_normal(16)
        x[i + 2] = x[i]
    labels = [None if i % 50 == 49 else int(i // 6 % 3) for i in range(300)]
    data = [(i, v.astype(float).tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    data += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, [], 1), (405, [1.0], 1), (406, [2.0], 1), (None, x[0].tolist(), 0)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 0.93).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = [(a, b) for a in range(300) for b in range(a) if labels[a] is not None and labels[a] == labels[b] and unit[a] @ unit[b] >= 0.93]
    root = groups(300, linked)
    n = np.bincount([i for p in linked for i in p], minlength=300)
    found = sum(got[i].n_links for i in range(300))
    assert found >= 0.9 * n.sum() and all(got[i].n_links <= n[i] for i in range(300))
    assert sum(got[i].component_id == root[i] for i in range(300)) >= 290
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(400, 405))
    assert got[405].n_links == 1 and got[406].component_id == 405 and got[None].component_id is None
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.MultiIndex.fit(x, 6, 0.9)
    a, b = index.distances(x)
    cost = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    for n in (1, 5, 20):
        got = np.take_along_axis(cost, index.visited(x, n).astype(int), axis=1)
        assert np.allclose(got, np.sort(cost, axis=1)[:, :n])
