"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import spelling
from tests.llm.corpus import empty, frame, rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(data, one_in):
    found = Counter()
    for i, text, *_ in data:
        for run in RUN.findall(text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=2):
    out, form = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        out[w] = [form[w], None, n, len(close), counts[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abé"), (3, "a"), (4, "ab😀́")])
def test_variants_against_all_pairs(spark, seed, alphabet):
    rnd = random.Random(seed)
    counts = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 7))): rnd.choice([1, 2, 3, 4, 8, 16, 40, 1000]) for _ in range(150)}
    assert {tuple(r) for r in spelling.variants(table(spark, counts)).collect()} == brute(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "bbbbbb": 64, "bbbbbc": 64, "zzzzz": 5}
    got = {tuple(r) for r in spelling.variants(table(spark, counts)).collect()}
    assert got == brute(counts)
    assert {r[0]: r[2] for r in got}["aaaaa"] == "bbbbbb"


def test_words_of_texts(spark):
    data = [*rows(), (None, "Straße STRASSE ÀÖÿ×÷ abcdeF " * 9, None, None, None), (7, None, None, None, None)]
    for one_in in (97, 3):
        got = {tuple(r) for r in spelling.word_counts(frame(spark, data), damage_one_in=one_in).collect()}
        assert got == set(counted(data, one_in).items())
    plain = Counter(low(r) for _, t, *_ in data for r in RUN.findall(t or ""))
    assert {tuple(r) for r in spelling.word_counts(frame(spark, data)).collect()} == {(w, n) for w, n in plain.items() if len(w) >= 5 and n >= 3}
    counts = spelling.word_counts(frame(spark, data), damage_one_in=3)
    assert {tuple(r) for r in spelling.variants(counts).collect()} == brute(counted(data, 3))


def test_no_words(spark):
    assert spelling.variants(spelling.word_counts(empty(spark))).count() == 0


def test_a_very_long_word(spark):
    word = "".join(random.Random(3).choice("abcdefgh") for _ in range(200_000))
    counts = {word: 3, word[:1000] + "z" + word[1001:]: 9, word + "h": 4, "a" * 100_000: 3, "a" * 99_999: 6, "a" * 99_999 + "b": 12}
    got = {r.word: (r.n_near, r.form_n) for r in spelling.variants(table(spark, counts)).collect()}
    assert got == {w: v for w, v in zip(counts, [(2, 9), (1, None), (1, None), (2, 12), (2, 12), (2, None)], strict=True)}


def test_collisions_are_told_apart(spark, monkeypatch):
    """Keys of two bits: nearly all words share them, and only strings decide."""
    whole = spelling.deletion_keys

    def coarse(words):
        key, *rest = whole(words)
        return key % np.uint64(4), *rest

    monkeypatch.setattr(spelling, "deletion_keys", coarse)
    counts = {w: 3 + i % 5 * 4 for i, w in enumerate(["apple", "apples", "appel", "maple", "ample", "grape", "grapes", "drape", "table", "cable", "stable"])}
    assert {tuple(r) for r in spelling.variants(table(spark, counts)).collect()} == brute(counts)


def test_keys_of_equal_strings_are_equal():
    words = pa.array(["stone", "tone", "éa", "a", "😀b", "b"], pa.large_string())
    key, row, place, _ = spelling.deletion_keys(words)
    of = {(int(r), int(p)): int(k) for k, r, p in zip(key, row, place, strict=True)}
    assert of[0, 0] == of[1, -1] and of[2, 0] == of[3, -1] and of[4, 0] == of[5, -1] and of[0, 1] != of[1, -1]
