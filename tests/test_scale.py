"""Sketches, samples, radius pairs, name searches, sparse vectors and cubes against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions.ranks import positions
from tessella.operators import audit, consistency, places, routing, sampling, sitemap, sketches, sparse


def profile_rows(n, seed=1):
    rnd = random.Random(seed)
    return [(str(rnd.randint(0, n)), rnd.choice(["", None, "1.5", "x", "2"]), str(rnd.gauss(0, 10)), str(rnd.random()) if i % 4 else "n/a") for i in range(n)]


def test_sketched_profiles_are_near_the_exact_ones(spark):
    n = 20_000
    rows = profile_rows(n)
    df = spark.createDataFrame([(i % 7, *r) for i, r in enumerate(rows)], "part int, id string, mixed string, gauss string, `some.share` string")
    got = {r.column: r for r in sketches.profiled(sketches.sketched(df, ["part"])).collect()}
    assert set(got) == {"id", "mixed", "gauss", "some.share"}
    for k, c in enumerate(("id", "mixed", "gauss", "some.share")):
        cells = [r[k] for r in rows]
        filled = [v for v in cells if v]
        assert (got[c]["count"], got[c].non_empty, got[c].empty) == (n, len(filled), n - len(filled))
        exact = len(set(filled))
        assert abs(got[c].distinct - exact) <= 0.05 * exact
    numbers = sorted(float(r[2]) for r in rows)
    g = got["gauss"]
    assert (g.type, g.min, g.max) == ("numeric", round(numbers[0], 4), round(numbers[-1], 4)) and g.mean == pytest.approx(sum(numbers) / n, abs=1e-4)
    for share, q in ((0.25, g.q1), (0.5, g.median), (0.75, g.q3)):
        assert abs(sum(x <= q for x in numbers) / n - share) < 0.02
    assert got["mixed"].type == "categorical" and got["mixed"].median is None and got["some.share"].type == "categorical"


def test_merging_sketches_in_any_order(spark):
    df = spark.createDataFrame([(i % 5, *r) for i, r in enumerate(profile_rows(500, 2))], "part int, a string, b string, c string, d string")
    parts = sketches.sketched(df, ["part"])
    once = sketches.profiled(parts).orderBy("column").collect()
    twice = sketches.profiled(sketches.merged(parts.where("part < 2")).unionByName(sketches.merged(parts.where("part >= 2")))).orderBy("column").collect()
    exact = lambda rows: [(r.column, r["count"], r.non_empty, r.type, r.min, r.max) for r in rows]
    assert exact(once) == exact(twice)
    assert all(a.distinct == pytest.approx(b.distinct, rel=0.03) and a.mean == pytest.approx(b.mean) for a, b in zip(once, twice, strict=True))
    assert sketches.profiled(sketches.sketched(df.limit(0), ["part"])).count() == 0


def test_only_new_files_are_read(spark, tmp_path):
    data, table, asked = tmp_path / "data", str(tmp_path / "sketches"), []

    def read(files):
        asked.append(len(files))
        return spark.read.schema("a string, b string").csv(files)

    def add(name, rows):
        data.mkdir(exist_ok=True)
        (data / name).write_text("".join(f"{a},{b}\n" for a, b in rows))

    def profile():
        found = sketches.refreshed(spark, str(data), table, read)
        return {r.column: (r["count"], r.distinct, r.max) for r in sketches.profiled(found).collect()}

    add("1.csv", [(i, "x") for i in range(50)])
    add("2.csv", [(i, "y") for i in range(50, 80)])
    assert profile() == {"a": (80, 80, 79.0), "b": (80, 2, None)}
    add("3.csv", [(i, "z") for i in range(70, 100)])
    assert profile() == {"a": (110, 100, 99.0), "b": (110, 3, None)}
    assert profile() == {"a": (110, 100, 99.0), "b": (110, 3, None)}
    (data / "2.csv").unlink()
    add("1.csv", [(1, "x"), (2, "x"), (7, "x")])  # changed
    assert profile() == {"a": (33, 33, 99.0), "b": (33, 2, None)}
    assert asked == [2, 1, 1]


def test_samples_of_exact_size(spark):
    data = [(i, "ab"[i % 3 == 0] if i % 10 else None, i) for i in range(200)]
    df = spark.createDataFrame(data, "id long, s string, v long")
    got = sampling.stratified(df, ["s"], 7, ["id"], seed=3)
    assert got.columns == df.columns
    per = Counter(r.s for r in got.collect())
    assert per == {"a": 7, "b": 7, None: 7}
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(got) == ids(sampling.stratified(df.repartition(9), ["s"], 7, ["id"], seed=3)) != ids(sampling.stratified(df, ["s"], 7, ["id"], seed=4))
    assert set(ids(got)) < set(ids(sampling.stratified(df, ["s"], 20, ["id"], seed=3)))
    assert Counter(r.s for r in sampling.stratified(df, ["s"], 5_000, ["id"]).collect()) == Counter(s for _, s, _ in data)
    assert sampling.stratified(df, [], 13, ["id"]).count() == 13 and sampling.stratified(df, ["s"], 0, ["id"]).count() == 0
    assert sampling.stratified(df.limit(0), ["s"], 5, ["id"]).count() == 0
    assert sampling.stratified(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "id long, s string"), ["s"], 5, ["id"]).count() == 3


def test_every_row_is_as_likely(spark):
    df = spark.range(30)
    drawn = Counter(r.id for seed in range(40) for r in sampling.stratified(df, [], 6, ["id"], seed).collect())
    assert sum(drawn.values()) == 240 and max(drawn.values()) <= 18 and len(drawn) == 30


def test_weights_draw_in_proportion(spark):
    heavy = spark.range(3000).withColumn("w", F.when(F.col("id") % 3 == 0, 10.0).otherwise(1.0))
    got = sampling.weighted(heavy, "w", 300, ["id"], seed=5).collect()
    share = sum(r.id % 3 == 0 for r in got) / len(got)
    assert len(got) == 300 and 0.75 < share < 0.9  # 10 in 12 for the first draws
    odd = spark.createDataFrame([(1, 0.0), (2, None), (3, float("nan")), (4, -1.0), (5, 1e-9), (6, float("inf"))], "id long, w double")
    assert sorted(r.id for r in sampling.weighted(odd, "w", 10, ["id"]).collect()) == [5, 6]
    assert [r.id for r in sampling.weighted(odd, "w", 1, ["id"]).collect()] == [6]


def haversine(p, q):
    (a, b), (c, d) = (map(math.radians, x) for x in (p, q))
    return 12742.0176 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


@pytest.mark.parametrize("km, block", [(50.0, 2_000), (900.0, 4), (9000.0, 2_000)])
def test_pairs_within_a_radius(spark, monkeypatch, km, block):
    monkeypatch.setattr(places, "BLOCK", block)
    rnd = random.Random(7)
    spots = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)]
    spots += [(89.99, 0.0), (89.99, 180.0), (90.0, 77.0), (-89.9, 10.0), (-89.9, -170.0), (0.1, 179.99), (0.1, -179.99), (0.1, 180.01), (51.5, 0.0), (51.5, 0.3)]
    spots += [(48 + i / 1000, 11.0) for i in range(15)]  # one crowded cell
    data = [(i, *p) for i, p in enumerate(spots)] + [(200, None, 1.0), (201, 1.0, float("nan")), (202, 91.0, 0.0)]
    df = spark.createDataFrame(data, "id long, lat double, lon double")
    got = {(r.id, r.other_id) for r in places.within(df, df, km).collect()}
    assert got == {(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if haversine(p, q) <= km}
    near = {r.id: r for r in places.competitors(df.union(df.limit(3)), "id", km).collect()}
    for i, p in enumerate(spots):
        others = sorted((round(haversine(p, q), 9), j) for j, q in enumerate(spots) if j != i and haversine(p, q) <= km)
        assert near[i].competitors == len(others)
        assert near[i].nearest_km == (pytest.approx(others[0][0], abs=1e-3) if others else None)
    assert near[200].competitors == 0 and places.within(df.limit(0), df, km).count() == 0
    with pytest.raises(ValueError):
        places.within(df, df, 30_000)


@pytest.mark.parametrize("km, crowd, piece", [(1.0, 100_000, 500_000), (400.0, 7, 50), (12_000.0, 40, 1)])
def test_competitors_are_counted_without_pairs(spark, monkeypatch, km, crowd, piece):
    def no_pairs(*_):
        raise AssertionError("as many rows as pairs")

    monkeypatch.setattr(places, "within", no_pairs)
    monkeypatch.setattr(places, "CROWD", crowd)
    rnd = random.Random(3)
    spots = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)] + [(90 - abs(rnd.gauss(0, 2)), rnd.uniform(-180, 180)) for _ in range(60)]
    spots += [(float(rnd.randint(-1, 1)), float(rnd.randint(178, 182))) for _ in range(60)] + [(48 + rnd.gauss(0, 0.01), 11.0) for _ in range(40)] + [(-90.0, 5.0), (-90.0, 5.0)]
    lat, lon = np.array(spots).T
    with np.errstate(all="ignore"):
        far = places._km(lat[:, None], lon[:, None], lat[None], lon[None])
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(900, 1.0, math.inf), (901, None, 1.0)], "id long, lat double, lon double")
    got = {r.id: (r.competitors, r.nearest) for r in places.competitors(df, "id", km).collect()}
    near = {i: sorted((far[i, j], j) for j in range(len(spots)) if j != i and far[i, j] <= km) for i in range(len(spots))}
    assert got == {i: (len(n), n[0][1] if n else None) for i, n in near.items()} | {900: (0, None), 901: (0, None)}
    # The work in a task, in pieces of any size: half of the rows met by all, and keys of another kind.
    monkeypatch.setattr(places, "PIECE", piece)
    keys = [f"k{i:03d}" for i in range(len(spots))]
    table = pa.table({"_key": keys, "_lat": lat, "_lon": lon})
    met = places._met(table.slice(0, 150), table, km).to_pylist()
    assert [(r["key"], r["n"] - 1, r["at"]) for r in met] == [(keys[i], len(n), keys[n[0][1]] if n else None) for i, n in list(near.items())[:150]]


def test_one_latitude_is_one_strip():
    line = places._Strips(np.zeros(50), np.arange(50.0), 7)  # else places far apart are each other's neighbours
    assert line.size.tolist() == [50]
    mixed = places._Strips(np.array([0.0, 1.0, 2.0, *[3.0] * 30, 4.0, 5.0]), np.arange(35.0), 5)
    assert list(zip(mixed.bottom, mixed.top, mixed.size, strict=True)) == [(0, 2, 3), (3, 3, 30), (4, 5, 2)]


def test_names_in_texts(spark, monkeypatch):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (91, "")]
    names = ["a", "ab", "abc", "éa", "a b", "zzz", "", "bca", "bca"]
    df, list_ = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    monkeypatch.setattr(routing, "HITS", 7)
    got = Counter(map(tuple, routing.found(df, "id", "text", list_).collect()))
    occurs = lambda t, n: sum(t.startswith(n, i) for i in range(len(t) + (not n)))
    assert got == Counter((i, n, occurs(t, n)) for i, t in texts if t is not None for n in set(names) if n in t)
    assert routing.found(df, "id", "text", list_.limit(0)).count() == 0 == routing.found(df.limit(0), "id", "text", list_).count()
    files = df.where("id < 90").select(F.col("id").cast("string").alias("path"), F.col("text").alias("content"))
    assert {tuple(r) for r in consistency.denied_names(files, list_).collect()} == {(str(i), n) for i, t in texts[:80] for n in set(names) if n in t}
    many = spark.range(30_000).select(F.concat(F.lit("name-"), F.col("id").cast("string")).alias("name"))  # more than could be tried one by one
    one = spark.createDataFrame([("f", "has name-29999 in it")], "path string, content string")
    assert {r.name for r in consistency.denied_names(one, many).collect()} == {"name-2", "name-29", "name-299", "name-2999", "name-29999"}
    monkeypatch.setattr(routing, "MOST_CHARS", 10)
    with pytest.raises(ValueError):
        routing.found(df, "id", "text", list_)


@pytest.mark.parametrize("part, step", [(3, 1), (4, 16), (8_000_000, 500_000)])
def test_names_are_found_in_parts_and_pieces(spark, monkeypatch, part, step):
    for constant, value in (("PART", part), ("STEP", step), ("HITS", 7)):
        monkeypatch.setattr(routing, constant, value, raising=False)
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choice("ab\u00e9\0\U0001f600 ") for _ in range(rnd.choice([0, 1, 3, 40, 90])))) for i in range(40)] + [(90, None), (91, "")]
    whole = [t for _, t in texts if t]
    names = {"", "a", "\0", "\0\0", "a\0", "\u00e9", "\U0001f600a", "zz", "a" * 200, *whole[:3], *(t[i : i + n] for t in whole for i, n in [(rnd.randint(0, 20), rnd.randint(1, 30))])}
    df, list_ = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    got = Counter(map(tuple, routing.found(df, "id", "text", list_).collect()))
    occurs = lambda t, n: sum(t.startswith(n, i) for i in range(len(t) + (not n)))
    assert got == Counter((i, n, occurs(t, n)) for i, t in texts if t is not None for n in names if n in t)


def test_lists_of_millions_of_names(spark):
    many = spark.range(3_500_000).select(F.lit(1).alias("rank"), F.concat(F.lit("name-"), F.col("id").cast("string")).alias("trigger"), F.lit("many").alias("route"))
    tasks = spark.createDataFrame([("t", "has NAME-3499999 in it"), ("u", "name-")], "task string, text string")
    assert {tuple(r) for r in routing.routed(tasks, many).collect()} == {("t", "many", "name-3499999", 7), ("u", "keep", None, 0)}


def test_tasks_are_routed_by_the_first_rule(spark):
    rules = spark.createDataFrame([(1, "auth", "review"), (1, "migrations", "review"), (2, "whole repository", "context"), (2, "verify", "review"), (2, "Verify all", "context"), (3, "", "never")], "rank int, trigger string, route string")
    tasks = [("a", "Edit src/AUTH/login and verify"), ("b", "read the Whole Repository"), ("c", "say hello"), ("d", "verify ALL of it"), ("e", None), (None, "auth")]
    got = {r.task: (r.route, r.trigger, r.triggers) for r in routing.routed(spark.createDataFrame(tasks, "task string, text string"), rules).collect()}
    assert got == {"a": ("review", "auth", 2), "b": ("context", "whole repository", 1), "c": ("keep", None, 0), "d": ("context", "Verify all", 2), "e": ("keep", None, 0), None: ("keep", None, 0)}


def test_sparse_vectors(spark):
    rnd = random.Random(4)
    cells = [(rnd.choice(["r1", "r2", None]), rnd.choice(["a", "b", "é", "Z", "c", None]), rnd.choice([1.0, 2.5, None])) for _ in range(60)]
    df = spark.createDataFrame(cells, "row string, feature string, value double")
    ids = sparse.feature_ids(df)
    order = sorted({f for _, f, _ in cells if f})
    assert {r.feature: r.id for r in ids.collect()} == {f: i for i, f in enumerate(order)}
    want = defaultdict(float)
    for r, f, v in cells:
        if f and v is not None:
            want[r, order.index(f)] += v
    for width in (65_536, 2):
        got = sparse.vectors(df, ids, width=width).collect()
        assert {(r.row, i): v for r in got for i, v in zip(r.indices, r["values"], strict=True)} == want
        assert all(r.indices == sorted(r.indices) and all(i // width == r.block for i in r.indices) for r in got)
    wide = spark.createDataFrame([("p", 1, 2.5), ("q", None, 0.0)], "page string, x int, y double")
    assert sorted(map(tuple, sparse.unpivoted(wide, "page").dropna().collect())) == [("p", "x", 1.0), ("p", "y", 2.5), ("q", "y", 0.0)]
    assert sparse.vectors(df.limit(0), ids).count() == 0 == sparse.feature_ids(df.limit(0)).count()


def test_positions(spark):
    values = [random.Random(2).choice([None, *range(50)]) for _ in range(120)]
    got = positions(spark.createDataFrame([(v,) for v in values], "v int"), "v").collect()
    assert sorted(r.position for r in got) == list(range(120))
    assert [r.v for r in sorted(got, key=lambda r: r.position)] == sorted(values, key=lambda v: (v is not None, v or 0))


def test_cube_counts_pages_once(spark):
    rows = [("s1", "high", "p1"), ("s1", "high", "p1"), ("s1", "low", "p1"), ("s2", "high", "p1"), ("s2", None, "p2"), (None, "low", "p3"), ("s1", "low", None)]
    got = {(r.site, r.severity, r.level): (r.n, r.pages) for r in audit.findings_cube(spark.createDataFrame(rows, "site string, severity string, page string"), ["site", "severity"], "page").collect()}
    want = {}
    for level in range(4):
        groups = defaultdict(list)
        for s, v, p in rows:
            groups[None if level & 2 else s, None if level & 1 else v, level].append(p)
        want |= {k: (len(v), len({p for p in v if p})) for k, v in groups.items()}
    assert got == want


def test_runs_are_chunked_as_their_urls_would_be(spark):
    ids = [5, 3, 3, 9, 0, 3, 7]  # 3 comes three times
    got = sitemap.chunked_runs(spark.createDataFrame([(p,) for p in ids], "page int"), "page", 4, size=6).collect()
    rows = sorted((r.position, r.page * 4 + r.k, r.chunk) for r in got)
    assert [i for _, i, _ in rows] == sorted(p * 4 + k for p in ids for k in range(4))
    assert [p for p, _, _ in rows] == list(range(28)) and all(c == p // 6 + 1 for p, _, c in rows)
    assert sitemap.chunked_runs(spark.range(3), "id", 0).count() == 0


def test_urls_of_runs_are_not_shuffled(spark):
    found = sitemap.chunked_runs(spark.range(50), "id", 4000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # what lies below the explosion is dealt out, nothing above


def test_keywords_that_share_few_urls_are_paired_by_sets(spark, monkeypatch):
    rnd = random.Random(3)
    held = {k: sorted(rnd.sample(range(25), rnd.randint(1, 9))) for k in range(120)}
    rows = [(k, 1 + i % 5, u) for k, urls in held.items() for i, u in enumerate(urls)]  # tied ranks: more URLs than the depth
    df = spark.createDataFrame(rows, "keyword long, rank int, url long")
    want = {(a, b, len(set(held[a]) & set(held[b]))) for a in held for b in held if a < b and len(set(held[a]) & set(held[b])) >= 3}
    for most, width in ((0, 1), (12, 2), (64, 3)):
        monkeypatch.setattr(audit, "MOST_SETS", most)
        assert len(audit._sets(df.groupBy("keyword").agg(F.collect_list("url").alias("urls")).where("size(urls) >= 3"), 3)[1]) == width
        for block in (1_000, 3):
            assert Counter(map(tuple, audit.keyword_clusters(df, 3, 5, block).collect())) == Counter(want)
