"""Streams in several batches, rows out of order and late, against the batch answer."""

import random
from datetime import datetime, timedelta

import pytest

from tessella.operators import pages as web
from tessella.streaming import windows
from tessella.streaming.drift import drift_stream, drift_table

BEGIN = datetime(2024, 1, 1)
PAGES = "url string, captured_at timestamp, html string"
ROWS = "id long, user string, ts timestamp, v long"


def at(minutes):
    return BEGIN + timedelta(minutes=minutes)


def page(title, words=3):
    return f"<html><head><title>{title}</title></head><body><h1>x</h1>{'w ' * words}</body></html>"


def written(spark, path, batches, schema):
    """One file for each batch, the names in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/tmp{i}")
        (name,) = [f for f in (path / f"tmp{i}").iterdir() if f.suffix == ".parquet"]
        (path / "in").mkdir(exist_ok=True)
        target = path / "in" / f"{i:03d}.parquet"
        name.rename(target)
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path / "in")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_differences_between_snapshots(spark):
    one, two = page("t"), page("t2", 40)
    captures = spark.createDataFrame([("u", at(0), one), ("u", at(1), one), ("u", at(2), two), ("v", at(0), one), (None, at(0), one), ("u", None, one)], PAGES)
    assert [r[2:] for r in rows_of(drift_table(captures))] == [("title", "high", "t", "t2"), ("word_count", "medium", "5", "42")]
    shots = lambda h: web.snapshot(spark.createDataFrame([("u", h)], "url string, html string"))
    assert rows_of(web.drift(shots(one), shots(two)).select("element", "severity", "old", "new")) == [r[2:] for r in rows_of(drift_table(captures))]


def test_captures_out_of_order_give_the_batch_answer(spark, tmp_path):
    """Captures are shuffled within twenty minutes of each other, less than the watermark waits."""
    rnd = random.Random(2)
    captures = [(rnd.choice(["u", "u", "v", "w"]), at(i), page(rnd.choice("abc"), rnd.randint(0, 9))) for i in range(60)]
    captures += [("far", at(3), page("a")), ("far", at(50), page("b")), ("u", at(30), page("zz"))]  # quiet for longer than kept; twice at one moment
    captures.sort(key=lambda r: (r[1] - BEGIN).seconds / 60 + rnd.uniform(0, 20))
    closing = [("end", at(500), page("e"))]
    source = written(spark, tmp_path, [captures[:15], captures[15:16], captures[16:40], captures[40:], closing], PAGES)
    keep = timedelta(minutes=40)
    got, _ = windows.drained(drift_stream(windows.files_stream(spark, source, 1), "30 minutes", keep), "drift")
    want = drift_table(spark.createDataFrame(captures, PAGES), keep)
    assert rows_of(got) == rows_of(want) and got.count() > 20
    assert not [r for r in got.collect() if r.url == "far"]


def test_late_captures_are_left_out(spark, tmp_path):
    source = written(spark, tmp_path, [[("u", at(0), page("a")), ("u", at(100), page("b"))], [("u", at(101), page("b"))], [("u", at(50), page("late"))], [("u", at(300), page("c"))]], PAGES)
    got, _ = windows.drained(drift_stream(windows.files_stream(spark, source, 1), "10 minutes"), "drift")
    assert [(r.old, r.new) for r in got.collect()] == [("a", "b")]


def events(seed=1, n=200):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "a", "a", "b", None]), None if i % 50 == 7 else at(rnd.uniform(0, 600)), rnd.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("size, slide", [("1 hour", None), ("1 hour", "20 minutes")])
def test_windows_and_what_came_late(spark, tmp_path, size, slide):
    data = sorted((r for r in events() if r[2]), key=lambda r: r[2])
    late = [(900 + i, "a", at(m), 1) for i, m in enumerate((5, 65, 66, 200))]
    source = written(spark, tmp_path, [data[:100], data[100:], [(999, "z", at(900), 0)], late], ROWS)
    from pyspark.sql import functions as F

    totals = [F.sum("v").alias("v")]
    got, mark = windows.drained(windows.counted(windows.files_stream(spark, source, 1), "ts", "5 minutes", ["user"], totals, size, slide), "windows")
    assert datetime.fromisoformat(mark.rstrip("Z")) == at(895)
    whole = windows.counted(spark.createDataFrame(data, ROWS), "ts", "0 seconds", ["user"], totals, size, slide)
    assert rows_of(got) == rows_of(whole)
    everything = spark.read.schema(ROWS).parquet(source)
    missed = windows.late_counts(everything, got, mark, "ts", ["user"], size, slide)
    n = {(r.user, r.start): r.n_late for r in missed.collect()}
    assert sum(n.values()) == len(late) * (1 if slide is None else 3) and all(u == "a" for u, _ in n)
    closed = windows.counted(everything, "ts", "0 seconds", ["user"], [], size, slide).where(F.col("end") <= F.to_timestamp(F.lit(mark)))
    assert closed.agg(F.sum("n")).first()[0] == got.agg(F.sum("n")).first()[0] + sum(n.values())


def test_sessions_and_what_came_late(spark, tmp_path):
    data = sorted((r for r in events(3) if r[1] and r[2]), key=lambda r: r[2])
    source = written(spark, tmp_path, [data[:80], data[80:], [(999, "z", at(900), 0)], [(901, "q", at(3), 1), (902, "q", at(4), 1)]], ROWS)
    got, mark = windows.drained(windows.counted(windows.files_stream(spark, source, 1), "ts", "5 minutes", ["user"], [], gap="7 minutes"), "sessions")
    whole = windows.counted(spark.createDataFrame(data, ROWS), "ts", "0 seconds", ["user"], [], gap="7 minutes")
    assert rows_of(got) == rows_of(whole) and got.count() > 30
    missed = windows.late_rows(spark.read.schema(ROWS).parquet(source), got, mark, "ts", ["user"], "7 minutes")
    assert sorted(r.id for r in missed.collect()) == [901, 902]


def test_answers_within_a_bound(spark, tmp_path):
    asked = [(i, "u" if i % 3 else None, at(10 * i), i) for i in range(12)]
    answers = [(100 + i, "u", at(10 * i + d), d) for i, d in ((1, 0), (1, 3), (2, 9), (4, 4), (5, -1), (7, 6))]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    a = written(spark, tmp_path / "a", [asked[:6], asked[6:], [(999, "z", at(900), 0)]], ROWS)
    b = written(spark, tmp_path / "b", [answers[3:], answers[:3], [(998, "z", at(901), 0)]], ROWS)
    got, _ = windows.drained(windows.answered(windows.files_stream(spark, a, 1), windows.files_stream(spark, b, 1), ["user"], "ts", "ts", "5 minutes", "2 hours", how="left"), "answered")
    want = windows.answered(spark.createDataFrame(asked, ROWS), spark.createDataFrame(answers, ROWS), ["user"], "ts", "ts", "5 minutes", "", how="left")
    pairs = lambda df: sorted((r.id, r.answer_id) for r in df.where("id < 900 and user is not null").collect() if r.answer_id)
    assert pairs(got) == pairs(want) == [(1, 101), (1, 101), (4, 104)]
    alone = lambda df: {r.id for r in df.where("answer_id is null and id < 900").collect()}
    assert alone(got) == alone(want) and len(alone(want)) == 10


def test_rows_come_once(spark, tmp_path):
    data = [r for r in events(5, 60) if r[2]]
    source = written(spark, tmp_path, [data[:40], data[20:], data[:10]], ROWS)
    got, _ = windows.drained(windows.first_seen(windows.files_stream(spark, source, 1), ["id"], "ts", "100 hours"), "once")
    assert rows_of(got) == rows_of(spark.createDataFrame(data, ROWS))


def test_no_rows(spark, tmp_path):
    source = written(spark, tmp_path, [[]], ROWS)
    got, mark = windows.drained(windows.counted(windows.files_stream(spark, source), "ts", "5 minutes", [], [], "1 hour"), "none")
    assert got.count() == 0
    with pytest.raises(ValueError):
        windows.counted(spark.createDataFrame([], ROWS), "ts", "0 seconds", [], [])
