"""Licence scans against a search of every template at every place."""

import math
import random
import re

import pytest

from tessella.llm import licenses
from tests.llm.corpus import empty, frame, prose, rows

WORD = re.compile(licenses.WORD)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, templates=licenses.TEMPLATES):
    held = [set(words(t)) for t in texts]
    weight = {w: math.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) + 1 for t in templates for w in t.words}
    out = []
    for text in texts:
        have, matches = words(text), []
        for t in templates:
            for s in range(-len(t.words), len(have)):
                if all(s + p >= 0 and have[s + p : s + p + len(key)] == key for p, key in t.mandatory()):
                    share = sum(weight[w] for j, w in enumerate(t.words) if 0 <= s + j < len(have) and have[s + j] == w) / sum(weight[w] for w in t.words)
                    matches.append((t.label, t.base, s, round(share, 6)))
        base = [m[2] for m in matches if m[1]]
        label = lambda keep: ",".join(sorted({m[0] for m in matches if keep(m)}))
        out.append((len(have), len(base), min(base, default=None), max(base, default=None), label(lambda m: m[1]), label(lambda m: m[1] or m[3] >= 0.5), max((m[3] for m in matches), default=0.0), sorted(matches)))
    return out


def corpus():
    rnd = random.Random(9)
    texts = [t for _, t, *_ in rows()]
    for t in licenses.TEMPLATES:
        whole = t.words
        texts.append(" ".join(whole))
        texts.append(prose(rnd, 30) + "\n// " + " ".join(w.upper() if rnd.random() < 0.3 else w for w in whole) + ". " + prose(rnd, 30))
        changed = [w if rnd.random() < 0.8 else "other" for w in whole]
        texts.append(" ".join(changed) + ", " + " ".join(whole))
        texts.append(" ".join(whole[1:]))  # the beginning cut off
        texts.append("-".join(p for _, key in t.mandatory() for p in key))
    texts += ["MIT License mit license, MIT\n\nLICENSE", "MİT license", "general public license general public license", "apache licenseé", "Apache 2 License", "the apache license general  public_license", "license license mit license", "cc by cc by nc 4 0"]
    return texts


def test_scan_against_every_place(spark):
    texts = corpus()
    got = sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    want = brute(texts)
    for r, w, text in zip(got, want, texts, strict=True):
        mine = (*r[1:8], sorted((m.label, m.base, m.start, m.score) for m in r.matches))
        assert mine[:6] == w[:6] and mine[6] == pytest.approx(w[6], abs=1e-6), (text, mine, w)
        assert [m[:3] for m in mine[7]] == [m[:3] for m in w[7]], text
    assert {label for r in got for label in r.labels.split(",")} >= {t.label for t in licenses.TEMPLATES}


def test_rarity_counts_files_not_places(spark):
    texts = ["mit mit license", "license", None, ""]
    weight = licenses.rarity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert weight["mit"] == math.log(5 / 2) + 1 and weight["license"] == math.log(5 / 3) + 1 and weight["mozilla"] == math.log(5) + 1


def test_own_templates(spark):
    own = (licenses.Template("house", "keep this notice in all copies", ("keep this notice",)), licenses.Template("short", "notice", base=True))
    texts = ["Keep this notice in all copies!", "keep this notice", "this notice keep", None]
    got = sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own).collect())
    want = brute(texts, own)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got] == [w[:6] for w in want]
    assert [r.labels for r in got] == ["house,short", "house,short" if want[1][7][0][3] >= 0.5 else "short", "short", ""]
    with pytest.raises(ValueError):
        licenses.Template("bad", "one two", ("three",)).mandatory()


def test_rows_are_kept_as_they_are(spark):
    assert licenses.scan(empty(spark)).count() == 0
    data = [(None, None, None, None, None), (1, "MIT License", "en", "s", 1), (1, "MIT License", "en", "s", 1)]
    got = licenses.scan(frame(spark, data)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels, r.score) for r in got) == [(0, 0, 0, "", 0.0), (1, 2, 1, "mit", 1.0), (1, 2, 1, "mit", 1.0)]


def test_a_long_text_full_of_licences(spark):
    text = "mit license " * 200_000 + "apache license"
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("matches").collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (400_002, 200_001, 0, 400_000, "apache,mit")


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
