"""As-of and overlap joins against every pair of rows."""

import random
from datetime import date, datetime, timedelta

import pytest

from tessella.operators import temporal

L, R = "id long, k string, t long", "k string, t long, v long, w string"


def sides(seed, n=120, hot=False):
    rnd = random.Random(seed)
    key = lambda: "hot" if hot and rnd.random() < 0.8 else rnd.choice(["a", "b", None])
    time = lambda: None if rnd.random() < 0.05 else rnd.randint(-30, 60)
    left = [(i, key(), time()) for i in range(n)]
    right = [(key(), time(), rnd.choice([None, 1, 2, 3]), rnd.choice("xyz")) for _ in range(n)]
    return left + left[:3], right + right[:3]


def answer(row, right, forward, strict, within):
    _, k, t = row
    if k is None or t is None:
        return None, None
    sign = -1 if forward else 1
    near = [r for r in right if r[0] == k and r[1] is not None and (sign * r[1] < sign * t if strict else sign * r[1] <= sign * t)]
    if not near:
        return None, None
    at = max(sign * r[1] for r in near)
    if within is not None and sign * t - at > within:
        return None, None
    best = max((r for r in near if sign * r[1] == at), key=lambda r: (r[3], -1 if r[2] is None else r[2]))
    return best[2], best[3]


@pytest.mark.parametrize("slice_rows", [50_000, 5])
@pytest.mark.parametrize("forward, strict, within", [(False, False, None), (True, False, None), (False, True, 4), (True, True, None)])
def test_as_of(spark, monkeypatch, slice_rows, forward, strict, within):
    monkeypatch.setattr(temporal, "SLICE_ROWS", slice_rows)
    left, right = sides(3, hot=True)
    got = temporal.as_of(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["k"], "t", "t", ["v", "w"], tie=["w"], forward=forward, strict=strict, within=within)
    assert got.columns == ["id", "k", "t", "last_v", "last_w"]
    want = [(*r, *answer(r, right, forward, strict, within)) for r in left]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_as_of_without_rows(spark):
    left, right = sides(4)
    none = temporal.as_of(spark.createDataFrame([], L), spark.createDataFrame(right, R), ["k"], "t", "t", ["v"])
    assert none.count() == 0
    alone = temporal.as_of(spark.createDataFrame(left, L), spark.createDataFrame([], R), ["k"], "t", "t", ["v"])
    assert alone.count() == len(left) and alone.where("last_v is not null").count() == 0


def test_as_of_crowded_moments_and_times(spark, monkeypatch):
    """All of one key, most of them within one second, beside a date a year later."""
    monkeypatch.setattr(temporal, "SLICE_ROWS", 20)
    begin = datetime(2024, 1, 1)
    right = [("k", begin + timedelta(microseconds=37 * i), i) for i in range(300)] + [("k", begin + timedelta(days=365), 999)]
    left = [("k", begin + timedelta(microseconds=11 * i)) for i in range(900)] + [("k", begin - timedelta(days=1)), ("k", begin + timedelta(days=400))]
    got = temporal.as_of(spark.createDataFrame(left, "k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, v long"), ["k"], "t", "t", ["v"])
    want = sorted((t, max((v for _, s, v in right if s <= t), default=None)) for _, t in left)
    assert sorted((r.t, r.last_v) for r in got.collect()) == want
    dates = temporal.as_of(spark.createDataFrame([(date(2024, 1, 2),)], "t date"), spark.createDataFrame([(date(2024, 1, 1), 7)], "t date, v long"), [], "t", "t", ["v"])
    assert [tuple(r) for r in dates.collect()] == [(date(2024, 1, 2), 7)]


def spans(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        start = None if rnd.random() < 0.05 else rnd.randint(-200, 200)
        length = rnd.choice([0, -3, 1, 1, 2, 5, 17, 64, 65, 300, None])
        out.append((i, rnd.choice(["a", "a", "b", None]), start, None if length is None or start is None else start + length))
    return out + out[:2]


@pytest.mark.parametrize("on", [["k"], []])
def test_overlapping(spark, on):
    left, right = spans(1, 60), spans(2, 60)
    schema = "id long, k string, s long, e long"
    got = temporal.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), on, ("s", "e"), ("s", "e"))
    assert got.columns == ["id", "k", "s", "e", "other_id", "other_k", "other_s", "other_e"]
    end = lambda r: 10**9 if r[3] is None else r[3]
    right_span = lambda r: r[2] is not None and r[2] < end(r)
    want = [(*a, *b) for a in left for b in right if right_span(a) and right_span(b) and (not on or a[1] is not None and a[1] == b[1]) and a[2] < end(b) and b[2] < end(a)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_moments_within_spans(spark):
    begin = datetime(2024, 1, 1)
    moments = [(i, begin + timedelta(seconds=i)) for i in range(100)]
    found = [(0, begin + timedelta(seconds=3), begin + timedelta(seconds=10)), (1, begin + timedelta(seconds=90), None), (2, begin, begin)]
    got = temporal.overlapping(spark.createDataFrame(moments, "i long, t timestamp"), spark.createDataFrame(found, "n long, s timestamp, e timestamp"), [], ("t", None), ("s", "e"), "")
    assert sorted((r.i, r.n) for r in got.collect()) == [(i, 0) for i in range(3, 10)] + [(i, 1) for i in range(90, 100)]
    assert temporal.overlapping(spark.createDataFrame([], "i long, t timestamp"), spark.createDataFrame(found, "n long, s timestamp, e timestamp"), [], ("t", None), ("s", "e"), "").count() == 0


def test_overlap_makes_no_nested_loop(spark):
    schema = "id long, k string, s long, e long"
    plan = temporal.overlapping(spark.createDataFrame(spans(1, 50), schema), spark.createDataFrame(spans(2, 50), schema), [], ("s", "e"), ("s", "e"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
