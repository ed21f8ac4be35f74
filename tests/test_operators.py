import colorsys
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.text import to_number, tokens
from tessella.operators import audit, color, consistency, jsonld, locale, pages, passages, profile, recommend, render, robots, sitemap
from tessella.plans import fixtures as X
from tessella.sources import readers, sinks


def test_group_count_ties_in_first_seen_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",), ("",)], "k string").coalesce(1)
    assert [(r.value, r.n) for r in profile.group_count(df, "k").collect()] == [("b", 2), ("a", 2), (None, 1), ("", 1)]
    assert {r.value for r in profile.group_count(df.withColumnRenamed("k", "password"), "password").collect()} == {"[redacted]"}
    assert "a" in {r.value for r in profile.group_count(df.withColumnRenamed("k", "password"), "password", True).collect()}


def test_top_values_ties_and_cut(spark):
    df = spark.createDataFrame([(v,) for v in "gfedcbaab"] + [(None,), ("",)], "k string").coalesce(1)
    top = sorted((r["rank"], r.value, r.n) for r in profile.top_values(df).collect())
    assert [t[1:] for t in top] == [("b", 2), ("a", 2), ("g", 1), ("f", 1), ("e", 1)]


def test_numbers(spark):
    cases = {"1,5": None, "1,234": 1234.0, " 2.5 ": 2.5, "1d": None, "1f": None, "1_000": 1000.0, "-1,234.5": -1234.5, "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.n for r in df.select("v", to_number("v").alias("n")).collect()} == cases


def test_profile_share_blank_columns_and_redaction(spark):
    rows = [("1", "", "5"), ("2", None, "6"), ("3", "", "7"), ("4", "", "8"), ("x", "", "9")]
    got = {r.column: r for r in profile.profile(spark.createDataFrame(rows, "a string, blank string, api_key string")).collect()}
    assert (got["a"].type, got["a"]["min"], got["a"]["max"], got["a"]["mean"]) == ("numeric", 1.0, 4.0, 2.5)
    assert (got["blank"].type, got["blank"].non_empty, got["blank"]["count"], got["blank"]["distinct"]) == ("categorical", 0, 5, 0)
    assert (got["api_key"].type, got["api_key"]["mean"]) == ("categorical", None)


def test_filters_and_selection_warn(spark):
    ask = profile.Report(filters=["a=1", "bad", "zz=1"], select="b, q, a", group_by="b")
    parts = profile.run(spark.createDataFrame([("1", "x"), ("1", "y"), (None, "x"), (" 1", "x")], "a string, b string"), ask)
    assert parts["rows"].first().rows == 2 and len(ask.warnings) == 3
    assert sorted((r.value, r.n) for r in parts["groups"].collect()) == [("x", 1), ("y", 1)]
    ask = profile.Report(select="none")
    assert profile.apply_select(spark.range(1), ask).columns == ["id"]


def test_drift_of_equal_snapshots_is_empty(spark):
    shots = pages.snapshot(spark.sql(X.HTML))
    assert pages.drift(shots, shots).count() == 0


def test_drift_null_blank_noise_and_escalation(spark):
    base = {k: "x" for k in pages.TRACKED} | {"schema_blocks": 1, "h2_count": 1, "word_count": 100}
    schema = "url string, " + ", ".join(f"{k} {'long' if k in ('schema_blocks', 'h2_count', 'word_count') else 'string'}" for k in pages.TRACKED)
    shot = lambda **c: spark.createDataFrame([("u", *(base | c).values())], schema)
    ask = lambda **c: {(r.element, r.severity) for r in pages.drift(shot(), shot(**c)).collect()}
    assert ask(title=None) == {("title", "high")} and ask(title="") == {("title", "high")}
    assert ask(word_count=114) == set() and ask(word_count=115) == {("word_count", "medium")} and ask(word_count=85) == {("word_count", "medium")}
    assert ask(meta_robots="NoIndex") == {("meta_robots", "critical")}
    assert {r.changed for r in pages.drift_summary(pages.drift(shot(), shot(title="a", h1="b"))).collect()} == {2}


def robots_by_hand(raw, bot):
    groups, run = [], False
    for line in raw.split("\n"):
        line = line.split("#")[0].rstrip()
        name, _, value = line.partition(":")
        if name.strip().lower() == "user-agent" and _:
            if not run:
                groups.append([set(), False, False])
            groups[-1][0].add(value.strip().lower())
            run = True
        else:
            run = False
            if groups and value.strip() == "/":
                groups[-1][1] |= name.strip().lower() == "disallow"
                groups[-1][2] |= name.strip().lower() == "allow"
    for who in (bot.lower(), "*"):
        for agents, deny, allow in groups:
            if who in agents:
                return deny and not allow
    return False


def test_robots_against_a_line_by_line_reading(spark):
    rnd = random.Random(1)
    lines = ["User-agent: *", "User-agent: GPTBot", "user-agent : ccbot # x", "Disallow: /", "Allow: /", "Disallow: /a", "", "# note", "Sitemap: x"]
    files = [(str(i), "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 9)))) for i in range(150)]
    got = robots.blocked(spark.createDataFrame(files, "site string, raw string")).collect()
    raw = dict(files)
    assert len(got) == 150 * 9 and all(r.blocked == robots_by_hand(raw[r.site], r.bot) for r in got)


def test_passages(spark):
    long = "word " * 121 + "1999"
    text = "Sales grew 12% in 2021 across all of the northern regions.\n\nThis one leans on what stood before it, 42 times over.\n \nToo short 1999\n\nNothing exact is said here although it is quite long.\n\n" + long
    rows = passages.scored(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("pos").collect()
    assert [(r.citable, r.issues) for r in rows] == [(True, []), (False, ["leans_on_context"]), (False, ["not_specific"]), (False, ["too_long"])]
    assert passages.page_score(spark.createDataFrame([(1, text), (2, "")], "id long, t string"), "id", "t").orderBy("id").collect()[0].citable_pct == 25


def test_language_codes(spark):
    cases = {"x-default": None, "X-Default": "language", "en": None, "EN-us": None, "en-USA": "region", "zz": "language", "en-GB-x": "segments", "": "language"}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", locale.code_fault("c").alias("f"))
    assert {r.c: r.f for r in df.collect()} == cases


def test_duplicates_count_each_repeat(spark):
    entries = spark.createDataFrame([("p", i, c, "https://a/") for i, c in enumerate(["en", "EN", "en", "de"])], "page string, pos int, hreflang string, href string")
    assert [r.fault for r in locale.entry_faults(entries).collect()] == ["duplicate"] * 2


def test_jsonld_lists_types_and_bad_text(spark):
    data = [(1, '[{"@context":"x","@type":["Person","Thing"],"name":"n"},{"@type":"Odd"}]'), (2, "{nope"), (3, '{"@context":"x","@type":[]}')]
    got = {(r.id, r.pos): r for r in jsonld.validate(spark.createDataFrame(data, "id int, json string")).collect()}
    assert got[1, 0].type == "Person" and got[1, 0].ok and got[1, 0].missing_recommended == ["url", "image", "sameAs", "jobTitle"]
    assert got[1, 1].warnings == ["no_context", "no_spec_for_type"] and got[1, 1].ok
    assert got[2, 0].warnings == ["invalid_json"] and not got[2, 0].ok
    assert got[3, 0].type is None


def test_sitemap_chunks_hold_all_urls_once(spark):
    urls = spark.range(1007).select(F.col("id").alias("idx"), F.concat(F.lit("https://a.test/?a&b="), "id").alias("url"))
    files = sitemap.documents(urls, "idx", 100, "2024-01-01").orderBy("chunk").collect()
    assert [f.n_urls for f in files] == [100] * 10 + [7] and all("&amp;" in f.xml and f.bytes == len(f.xml.encode()) for f in files)
    back = sitemap.validate(spark.createDataFrame([(f.chunk, f.xml) for f in files], "id long, xml string")).collect()
    assert sum(r.n for r in back) == 1007 and all(r.valid for r in back)
    index = sitemap.index(spark.createDataFrame([(1,), (2,)], "chunk long"), "map", base_url="https://a.test/").first()
    assert index.complete and index.xml.count("<sitemap>") == 2 and "https://a.test/map-2.xml" in index.xml


hexes = st.integers(0, 0xFFFFFF).map(lambda n: f"#{n:06x}")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(hexes, hexes), min_size=1, max_size=30))
def test_contrast_is_symmetric_and_at_least_one(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select(color.contrast(F.col("a"), F.col("b")).alias("x"), color.contrast(F.col("b"), F.col("a")).alias("y"))
    assert all(r.x == r.y and 1 <= r.x <= 21 for r in df.collect())


def test_hsl_as_the_standard_library_has_it(spark):
    rnd = random.Random(0)
    seeds = [(float(rnd.randint(-50, 800)), rnd.randint(0, 100) / 100, rnd.randint(0, 100) / 100) for _ in range(300)]
    got = spark.createDataFrame(seeds, "h double, s double, l double").select("h", "s", "l", color.hsl_to_hex(F.col("h"), F.col("s"), F.col("l")).alias("x")).collect()
    for r in got:
        want = [round(round(c * 255, 9)) for c in colorsys.hls_to_rgb((r.h % 360) / 360, r.l, r.s)]
        assert [int(r.x[i : i + 2], 16) for i in (1, 3, 5)] == want


def test_recommendation_ties_go_to_the_earlier_row(spark):
    fonts = spark.sql("SELECT * FROM (VALUES (0, 'n', 'modern clean', 'x'), (1, 'm', 'clean modern', 'x')) AS t(row_idx, name, mood, best_for)")
    asked = spark.sql(X.REQUESTS).withColumn("product", F.struct(F.lit("modern clean").alias("typography_mood")))
    assert {r.typography.name for r in recommend.pick_typography(asked, fonts).collect()} == {"n"}


def test_missing_libraries_fall_back(spark):
    r = recommend.compose(spark.sql(X.REQUESTS)).first()
    assert r.style_name == "minimal" and r.effects.radius == "6px" and len(r.checklist) == 5 and len(r.fallbacks) == 5


def test_paths(spark):
    known = {"a/b.css", "c.js"}
    cases = {"a/b.css": "OK", "./a/../c.js?v=1": "OK", "d.js": "MISSING", "../x": "UNSAFE", "a/../../x": "UNSAFE", "/etc/x": "UNSAFE", "C:\\x": "UNSAFE", "\\x": "UNSAFE", "https://x/": "REMOTE", "#top": "REMOTE", "?q": "REMOTE"}
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", render.path_status(F.col("url")).alias("status"), render.path_of(F.col("url")).alias("path"))
    assert {r.url: ("OK" if r.path in known else "MISSING") if r.status == "inside" else r.status.upper() for r in rows.collect()} == cases


@pytest.mark.parametrize("path", ["a", "a/b/../c", "./a//b/.", "..", "../..", "a/../..", "a/../../b/../c", "", ".", "a\\..\\b", "a/./../a"])
def test_plain_steps(spark, path):
    import posixpath

    assert spark.range(1).select(render.path_of(F.lit(path))).first()[0] == posixpath.normpath(path.replace("\\", "/"))


def test_bundle_notes(spark):
    def bundle(html, files, most=10):
        built = spark.createDataFrame([(1, html, files)], "id int, html string, files map<string,binary>")
        r = render.bundles(built, most).first()
        return r.bundle, r.notes

    html, notes = bundle('<script type="module" src="a.js" async></script><link rel=stylesheet href="x.css"><img src="big.png">', {"a.js": b"x()\n//# sourceMappingURL=q", "big.png": b"0" * 50})
    assert '<script type="module">' in html and "sourceMappingURL" not in html
    assert notes == ["missing css: x.css", "loading hints dropped: a.js", "large image: big.png"]
    html, notes = bundle("A<LINK href='s/../t.css?v' rel='stylesheet'>B<img alt='' src='i.JPG'/>C<img src=\"https://x/y.png\"><link rel=stylesheet><script src='../u.js'></script>D", {"t.css": "p{content:'<img src=\"i.JPG\">é'}".encode() + b"\xff", "i.JPG": b"jpg"})
    assert html == "A<style>\np{content:'<img src=\"i.JPG\">é'}\ufffd\n</style>B<img alt='' src='data:image/jpeg;base64,anBn'/>C<img src=\"https://x/y.png\"><link rel=stylesheet><script src='../u.js'></script>D"
    assert notes == ["unsafe js: ../u.js", "remote image: https://x/y.png"]
    assert bundle(None, {}) == (None, []) and bundle("plain", None) == ("plain", [])


def test_bundles_of_an_asset_table(spark):
    pages_ = spark.createDataFrame([(i, f'<img src="{i}.png"><img src="{i}.png">') for i in range(4)] + [(None, "x")], "id long, html string")
    assets = spark.createDataFrame([(i, f"{i}.png", str(i).encode()) for i in (0, 1, 1, 3)] + [(2, "0.png", b"0")], "id long, path string, content binary")
    got = {r.id: (r.bundle.count("base64"), r.notes) for r in render.bundled(pages_, assets).collect()}
    assert got == {0: (2, []), 1: (2, []), 2: (0, ["missing image: 2.png"] * 2), 3: (2, []), None: (0, [])}
    assert render.bundled(pages_.limit(0), assets).count() == 0


@pytest.fixture
def csv(tmp_path):
    def write(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    return write


def test_csv_headers_encodings_and_ragged_rows(spark, csv):
    table, header, warnings = readers.read_csv(spark, csv("a.csv", b"\xef\xbb\xbfa,b,a\n1,2,3\n4,5\n6,7,8,9\n"))
    assert header == ["a", "b", "a"] and warnings == ["duplicate column: a"]
    rows = table.collect()
    assert [(r.a, r.b) for r in rows] == [("3", "2"), (None, "5"), ("8", "7")] and readers.ragged(table).count() == 2
    table, _, _ = readers.read_csv(spark, csv("b.csv", "x\ncaf\xe9 \u20ac\n".encode("cp1252")))
    assert table.first().x == "café €"
    assert readers.read_library(spark, "/no/such.csv") is None


def test_url_lists_json_and_xml(spark, csv):
    path = csv("u.txt", b"# no\nhttps://a/ \n\n #kept\n")
    assert [r.url for r in readers.read_urls(spark, path).orderBy("idx").collect()] == ["https://a/", "#kept"]
    assert readers.read_json(spark, '[{"a":1},{"a":2}]').count() == 2
    assert readers.read_json(spark, csv("j.json", b'[{"a":1},\n{"a":2}]')).count() == 2
    assert readers.read_xml(spark, "<a/>").first().xml == "<a/>"
    assert readers.read_texts(spark, csv("t.txt", b"a\xffb")).first().content == "a\ufffdb"
    assert readers.read_assets(spark, csv("i.svg", b"<svg/>")).first().data_uri.startswith("data:image/svg+xml;base64,")
    assert readers.probe(spark, ["no-such-tool"], ["NO_SUCH"]).where("present").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "")], "k string, v string")
    assert [r.json for r in sinks.as_json(df).collect()] == ['{"k":"a","v":null}', '{"k":"b","v":""}']
    assert [r.line for r in sinks.as_lines(df).collect()] == ["k: a  v: (blank)", "k: b  v: (blank)"]
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_snapshot(df, str(tmp_path / "s"))
    sinks.write_texts(spark.createDataFrame([("x", "line 1\nline 2")], "n string, t string"), str(tmp_path / "t"), "t", "n")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_consistency_checks(spark):
    files = spark.createDataFrame([("a.md", "v1.2.3 and 2.0.0, `s/x.py`\nsecret name\n5/6 checks passed"), ("s/x.py", ""), ("s/y.py", "")], "path string, content string")
    assert [r.path for r in consistency.unrecorded(files, files).collect()] == ["s/y.py"]
    assert [r.version for r in consistency.stale_versions(files, "2.0.0").collect()] == ["1.2.3"]
    assert [(r.path, r.name) for r in consistency.denied_names(files, spark.createDataFrame([("secret",), ("none",)], "name string")).collect()] == [("a.md", "secret")]
    claims = spark.createDataFrame([("scripts", 2, "s/%"), ("docs", 3, "%.md")], "claim string, claimed int, `like` string")
    assert [(r.claim, r.actual) for r in consistency.wrong_counts(files, claims).collect()] == [("docs", 1)]
    assert [r.line_no for r in consistency.bare_lines(files, "^secret").collect()] == [2]
    assert not consistency.passed_checks(files).first().all_passed
    a = spark.createDataFrame([("p", "1"), ("q", "2")], "name string, v string")
    b = spark.createDataFrame([("p", "1"), ("r", "2")], "name string, v string")
    assert {r.name for r in consistency.unmatched_fields(a, b, "name", ["v"]).collect()} == {"q", "r"}


def test_comparisons(spark):
    sql = lambda q, cols: spark.sql(f"SELECT * FROM (VALUES {q}) AS t({cols})")
    cluster = sql("('c','p',true,0),('c','a',false,1),('c','b',false,2),('c','d',false,3)", "cluster,url,is_pillar,ord")
    matrix = {(r.source, r.target) for r in audit.link_matrix(cluster, 1).collect()}
    assert matrix == {("a", "p"), ("b", "p"), ("d", "p"), ("a", "b"), ("b", "d"), ("d", "a")}
    assert [r.item for r in audit.in_every(sql("('a','x'),('b','x'),('a','y')", "o,item"), "o", "item").collect()] == ["x"]
    assert {r.keyword: r.intent for r in audit.intents(sql("('buy shoes'),('best shoes'),('shoes')", "keyword")).collect()} == {"buy shoes": "transactional", "best shoes": "commercial", "shoes": "informational"}
    gate = audit.sitemap_gate(sql("('a'),('b'),('c'),('d'),('e')", "url"), sql("('a',200,null,'a'),('b',404,null,null),('c',200,'NOINDEX',null),('d',200,null,'x')", "url,status,meta_robots,canonical"))
    assert {r.url: r.reason for r in gate.collect()} == {"b": "status", "c": "noindex", "d": "canonical_elsewhere", "e": "not_fetched"}
    assert audit.page_type_mismatch(sql("('k','list'),('k','list'),('k','shop')", "keyword,page_type"), sql("('k','shop')", "keyword,target_type")).first().usual == "list"
    assert audit.persona_table(sql("('p','x',1.0),('p','y',3.0)", "page,persona,score"), ["x", "y"]).first().y == 3.0
    assert audit.backlinks(sql("('https://A.test/1','t','go'),('http://a.test/2','t','Go')", "source_url,target,anchor")).first().domains == 1
    assert audit.nap_mismatches(sql("('b','N','S 1','12-3'),('b','n','S-1','123'),('c','N','x','1'),('c','M','x','1')", "business,name,address,phone")).first().business == "c"
    over = audit.page_overrides(sql("('t','1'),('u','2')", "token,value"), sql("('p','t','9')", "page,token,value"))
    assert {(r.token, r.value) for r in over.collect()} == {("t", "9"), ("u", "2")}
    assert audit.feature_matrix(sql("('f','a'),('g','b')", "feature,product"), ["a", "b"]).where("a").first().feature == "f"
    assert audit.best_source(sql("(CAST(NULL AS STRING),'x'),(CAST(NULL AS STRING),NULL)", "t1,t2"), ["t1", "t2"]).where("tier = 't2'").count() == 1
    assert audit.local_grid(sql("('b','c1',1),('b','c2',9)", "business,cell,rank")).first().share == 0.5
    assert abs(spark.range(1).select(audit.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first().d - 20015.1) < 1
    canon = {r.url: r.canonical for r in audit.canonical_groups(sql("('https://a.test/p?x=1'),('https://A.test/p/'),('http://a.test/p')", "url")).collect()}
    assert set(canon.values()) == {"http://a.test/p"}
    assert [r.day for r in audit.active_touches(sql("('c',1),('c',5)", "contact,day"), sql("('c',3)", "contact,day")).collect()] == [1]
    assert [r.open for r in audit.complete(sql("('a','x',' tbd '),('b','x','y')", "id,f,g"), "id", ["f", "g"]).orderBy("id").collect()] == ["g", ""]
    assert audit.image_names(sql("('My Pic!','Hero Wide')", "title,preset")).first().file == "my-pic-hero-wide"
    assert audit.fix_time(sql("('a','high'),('b','high'),('c','low')", "code,severity"), {"high": 1.5}).where("severity = 'high'").first().hours == 3.0
    assert [r.k for r in audit.prioritised(sql("('a',1,2),('b',4,2),('c',1,0)", "k,impact,effort")).collect()] == ["c", "b", "a"]
    assert audit.dominant(sql("('#ABCDEF #abcdef; font-family: Arial, x')", "html")).where("kind = 'colour'").first().n == 2
    assert audit.cyclic_nodes(sql("('a','b'),('b','c')", "source,target")).count() == 0
    assert audit.links(sql("('https://a.test/x', '<a href=\"/y\">in</a><a href=\"https://b.test\"><b></b></a>')", "url,html")).where("internal").count() == 1


def test_tokens(spark):
    assert spark.sql("SELECT 'A-b' x, CAST(NULL AS STRING) y, 'B é c2' z").select(tokens("x", "y", "z").alias("t")).first().t == ["a", "b", "c2"]


def test_a_million_urls_stay_whatever_the_order(spark):
    urls = spark.range(1_000_000).select(F.xxhash64("id").alias("idx"), F.concat(F.lit("https://a.test/"), "id").alias("url"), F.lit(1).alias("slice"), F.lit(2).alias("n"))
    got = sitemap.chunked(urls.repartition(7), "idx").groupBy("chunk").agg(F.count("*").alias("rows"), F.min("position").alias("a"), F.max("position").alias("b"), F.min("idx").alias("low"), F.max("idx").alias("high")).orderBy("chunk").collect()
    assert [r.rows for r in got] == [50_000] * 20 and all((r.a, r.b) == ((r.chunk - 1) * 50_000, r.chunk * 50_000 - 1) for r in got)
    assert all(x.high < y.low for x, y in zip(got, got[1:]))
    held = sitemap.documents(urls.limit(120_000), "idx").select(F.explode(F.regexp_extract_all("xml", F.lit("<loc>([^<]*)"), F.lit(1))).alias("u"))
    assert held.agg(F.count("*"), F.count_distinct("u")).first() == (120_000, 120_000)


def test_keyword_clusters_against_all_pairs(spark):
    rnd = random.Random(4)
    lists = {f"k{i:03}": rnd.sample([f"u{j}" for j in range(25)], rnd.randint(1, 9)) + ["everywhere"] for i in range(80)}
    rows = [(k, r + 1, u) for k, us in lists.items() for r, u in enumerate(us)] + [("k000", 1, "everywhere"), (None, 1, "u1"), ("k001", 2, None)]
    results = spark.createDataFrame(rows, "keyword string, rank int, url string")
    for block in (1_000, 7):
        got = {(r.a, r.b): r.shared for r in audit.keyword_clusters(results, 3, 10, block).collect()}
        want = {(a, b): len(set(lists[a]) & set(lists[b])) for a in lists for b in lists if a < b}
        assert got == {p: n for p, n in want.items() if n >= 3}


def test_cluster_ids_of_a_long_chain(spark):
    pairs = [(f"w{i:03}", f"w{i + 1:03}") for i in range(60)] + [("y", "x"), ("z", "z"), (None, "a")]
    got = {r.keyword: r.cluster for r in audit.cluster_ids(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {f"w{i:03}": "w000" for i in range(61)} | {"x": "x", "y": "x"}
    assert audit.cluster_ids(spark.createDataFrame([], "a string, b string")).count() == 0


def test_files_are_read_whole_only_where_quotes_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,caf\xe9\n")
    (tmp_path / "b.csv").write_text('x,y\n1,"two\nlines"\n2,z\n')
    assert readers.shape_of(spark, str(tmp_path / "a.csv")) == ("iso-8859-1", False)
    assert readers.shape_of(spark, str(tmp_path / "b.csv")) == ("utf-8", True)
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "b.csv"))[0].select("x", "y").collect()] == [("1", "two\nlines"), ("2", "z")]
    assert readers.read_csv(spark, str(tmp_path / "a.csv"))[0].first().y == "café"


def test_tables_beside_every_row_have_a_checked_size(spark):
    from tessella.sources import staging

    assert staging.small_table(spark.range(10), "a list").count() == 10
    with pytest.raises(ValueError):
        audit.page_overrides(spark.range(staging.SMALL_ROWS + 1).selectExpr("cast(id as string) token", "'v' value"), spark.sql("select 'p' page, 't' token, 'v' value"))


def test_pages_that_come_and_go(spark):
    before, after = spark.createDataFrame([("a",), ("b",)], "url string"), spark.createDataFrame([("b",), ("c",)], "url string")
    assert {(r.url, r.severity) for r in pages.appeared(before, after).collect()} == {("a", "high"), ("c", "info")}


def test_designs_for_people_and_from_json(spark):
    from tessella.plans import fixtures as X
    from tessella.plans import registry

    view = recommend.human_view(registry._designs(spark).withColumn("typography", F.lit(None).cast("struct<heading_font:string,body_font:string>")), palette=False).orderBy("id").first().view
    assert view.startswith("DESIGN SYSTEM: Shop / retail") and "Style: bold" in view and "  [ ] " in view and "  ! " in view and X.REQUESTS
    design = readers.read_designs(spark, '[{"product_type":"p","palette":{"primary":"#000000"},"key_sections":["hero"]}]')
    assert "--primary:#000000;--secondary:#6954d4;" in render.pages(design).first().page


def test_intents_at_letters_beyond_ascii(spark):
    keywords = ["éprice", "topé", "bestéx", "prices", "x_deal", "BEST shoe", "beſt x", "aſign in b", "vſ", "order"]
    found = {r.keyword: r.intent for r in audit.intents(spark.createDataFrame([(k,) for k in keywords], "keyword string")).collect()}
    import duckdb  # its \\b knows ASCII only, and its (?i) the long s

    patterns = [("transactional", "buy|price|order|cheap|coupon|deal"), ("commercial", "best|top|review|vs|compare"), ("navigational", "login|sign in|website|official")]
    matches = lambda k, p: duckdb.execute("select regexp_matches(?, ?)", [k, rf"(?i)\b({p})\b"]).fetchall()[0][0]
    assert found == {k: next((name for name, p in patterns if matches(k, p)), "informational") for k in keywords}
    assert found["éprice"] == "transactional" and found["prices"] == "informational"
