import random
from collections import Counter

import pytest

from tessella.operators import audit, uniqueness


def brute(rows, k):
    grams = []
    for _, text in rows:
        w = (text or "").lower().split()
        grams.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    owners = Counter(g for s in grams for g in s)
    return Counter((key, len(s), sum(owners[g] == 1 for g in s)) for (key, _), s in zip(rows, grams, strict=True))


@pytest.mark.parametrize("block_rows, k", [(2_000, 5), (3, 2)])
def test_unique_shares_against_all_texts(spark, monkeypatch, block_rows, k):
    monkeypatch.setattr(uniqueness, "BLOCK_ROWS", block_rows)
    rnd = random.Random(1)
    passage = "this passage stands in very many of all the texts there are "
    rows = [(i, passage * rnd.randint(0, 1) + " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a null key has words of its own here"), (5, "a repeated key"), (6, rows[6][1])]
    got = audit.unique_ratio(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text", k)
    assert Counter((r.id, r.shingles, r.unique) for r in got.collect()) == brute(rows, k)
    assert all(r.ratio == (round(r.unique / r.shingles, 4) if r.shingles else 0) and r.thin == (r.ratio < 0.3) for r in got.collect())
    assert audit.unique_ratio(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0
