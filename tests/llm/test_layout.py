import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.llm import mixing, sharding
from tests.llm.corpus import empty, frame, rows


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_shards_hold_all_rows_evenly_in_proportion(spark):
    got = sharding.interleave(frame(spark).withColumn("shard", F.lit("x")), 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted(r.position for r in got) == list(range(len(got)))
    per = defaultdict(Counter)
    for r in got:
        per[r.source][r.shard] += 1
    for source, c in per.items():
        share = sum(c.values()) / 5
        assert all(abs(c[s] - share) < 2 for s in range(5)), source


def test_slices_do_not_change_the_order(spark, monkeypatch):
    from tessella.llm import ranks

    whole = sorted(sharding.interleave(frame(spark), 3).collect())
    monkeypatch.setattr(sharding, "slices_for", lambda n: 7)
    assert sorted(sharding.interleave(frame(spark), 3).collect()) == whole
    assert ranks.slices_for(0) == 1


def test_empty_table(spark):
    assert sharding.interleave(empty(spark)).count() == 0
    assert mixing.curriculum(empty(spark)).count() == 0
    assert mixing.training_stream(empty(spark)).count() == 0


def test_written_shards(spark, tmp_path):
    sharding.write_shards(frame(spark), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows())


def water_filled(sizes, weights, cap=3.0):
    total, open_, left = sum(sizes.values()), dict(weights), float(sum(sizes.values()))
    out = {}
    while open_:
        rate = left / sum(open_.values())
        over = [s for s in open_ if rate * open_[s] > cap * sizes[s]]
        if not over:
            return out | {s: rate * w for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    assert total is not None
    return out


def test_targets_and_words_taken(spark):
    data = [*rows(), (500, "one two", None, "tiny", None), (501, "w " * 3000, None, "huge", None)]
    got = mixing.curriculum(frame(spark, data)).collect()
    sizes = Counter()
    for _, t, _, s, _ in data:
        sizes[s] += n_words(t)
    names = sorted((s for s in sizes if s is not None), key=str) + [None]
    want = water_filled(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.curriculum(frame(spark, data).repartition(7)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in again) == sorted((r.doc_id, r.size, r.taken) for r in got)


def test_positions_invert_the_integrated_schedule(spark):
    w0, w1 = F.lit(0.5), F.lit(1.5)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        t = spark.range(1).select(mixing.progress_at(F.lit(share), w0, w1).alias("t")).first().t
        assert abs((0.5 * t + t * t / 2) - share) < 1e-9


def test_training_stream_repeats_and_cuts(spark):
    data = [(i, t, la, s, c) for i, t, la, s, c in rows()[:50]]
    stream = mixing.training_stream(frame(spark, data)).collect()
    taken = {(r.doc_id, r.size): r.taken for r in mixing.curriculum(frame(spark, data)).collect()}
    seen = Counter()
    for r in stream:
        seen[r.doc_id] += n_words(r.text)
    assert all(seen[i] == taken[i, n_words(t)] for i, t, *_ in data)


def test_each_source_is_shared_out(spark):
    """Sources of very different sizes over 16 shards: every one within the stated bound of its share."""
    data = [(i, f"t{i}", "en", "big" if i % 3 else f"s{i % 8}", None) for i in range(800)]
    got = sharding.interleave(frame(spark, data), 16).collect()
    per = Counter((r.source, r.shard) for r in got)
    sizes = Counter(r.source for r in got)
    assert all(abs(per[s, k] - n / 16) <= 1 + n * len(sizes) / len(got) for s, n in sizes.items() for k in range(16))
    assert len(sizes) == 9 and min(sizes.values()) > 30
