"""Further queries: comparisons, consistency checks and the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import audit, color, consistency, jsonld, pages, recommend, render, robots
from tessella.plans import fixtures as X
from tessella.plans.registry import _builds, _designs, case, load, query
from tessella.sources import sinks


def values(rows: str, columns: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS t({columns})"


def _hex(h: str, s: str, light: str) -> str:
    """DuckDB: the closed form of HSL to hex."""

    def channel(n: int) -> str:
        k = f"((({n} + {h} / 30) % 12 + 12) % 12)"
        v = f"({light} - {s} * least({light}, 1 - {light}) * greatest(-1.0, least({k} - 3, 9 - {k}, 1.0)))"
        return f"lpad(lower(to_hex(CAST(round_even(round({v} * 255, 9), 0) AS BIGINT))), 2, '0')"

    return f"'#' || {channel(0)} || {channel(8)} || {channel(4)}"


@case("palette_colours", f"SELECT industry, {_hex('hue', 'sat', 'light')} AS primary_colour, {_hex('(hue + 28)', 'greatest(0.0, sat - 0.12)', 'least(0.92, light + 0.06)')} AS secondary, {_hex('(hue + 165)', 'least(0.95, sat + 0.10)', '0.55::DOUBLE')} AS accent FROM ({X.SEEDS})")
def palette_colours(spark, sf_dir):
    return color.palette(spark.sql(X.SEEDS)).select("industry", F.col("primary").alias("primary_colour"), "secondary", "accent")


@case("design_sections", values("(1, 'grid', 'hero|collection|reviews'), (2, 'column', 'story|about'), (3, 'hero', 'hero|features|cta'), (4, 'grid', 'hero|collection|reviews')", "id, pattern, sections"))
def design_sections(spark, sf_dir):
    return _designs(spark).select("id", "pattern", F.array_join("key_sections", "|").alias("sections"))


@case("style_effects", values("('minimal', '6px'), ('luxury-serif', '2px'), ('neo-brutalist', '0px'), ('soft-ui', '16px'), ('glassmorphism', '14px'), ('dark-tech', '8px'), ('claymorphism', '22px'), ('other', '8px')", "style, radius"))
def style_effects(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in [*recommend.EFFECTS, "other"]], "style string")
    return names.select("style", recommend.effects(F.col("style"))["radius"].alias("radius"))


@case("bundle_platforms", values("('webflow', true), ('ghl', true), ('wordpress', true), ('wix', true), ('framer', true), ('squarespace', true), ('carrd', true), ('generic', true)", "platform, fits"))
def bundle_platforms(spark, sf_dir):
    return render.platform_fit(render.bundles(_builds(spark))).select("platform", "fits")


@case("section_labels", values("('social-proof', 'Social proof', 'social-proof'), ('faq', 'FAQ', 'faq'), ('our story', 'Our Story', 'our-story'), ('a-b', 'A B', 'a-b')", "section, label, id"))
def section_labels(spark, sf_dir):
    return spark.sql(values("('social-proof'), ('faq'), ('our story'), ('a-b')", "section")).select("section", render.label(F.col("section")).alias("label"), render.section_id(F.col("section")).alias("id"))


_HOST = r"lower(regexp_extract({0}, '(?i)^https?://([^/?#:]+)', 1))"


@query("on_page_counts", rf"""WITH a AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')) AS tag FROM pages), h AS (SELECT url, nullif(regexp_extract(tag, '(?is)^<a\b[^>]*?\bhref=["'']([^"'']*)["'']', 1), '') AS href FROM a),
i AS (SELECT url, NOT regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:|^//') OR {_HOST.format('href')} = {_HOST.format('url')} AS internal FROM h), c AS (SELECT url, count(*) FILTER (internal) AS links_in, count(*) FILTER (NOT internal) AS links_out FROM i GROUP BY url)
SELECT url, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS BIGINT) AS headings, coalesce(links_in, 0) AS links_in, coalesce(links_out, 0) AS links_out FROM pages LEFT JOIN c USING (url)""")  # fmt: skip
def on_page_counts(spark, sf_dir):
    return audit.on_page(load(spark, sf_dir, "pages")).select("url", "headings", "links_in", "links_out")


@case("accessibility_counts", values("('https://x.test/1', 1, true), ('http://x.test/2', 0, false), ('https://x.test/3', 0, false)", "url, images_without_alt, has_lang"))
def accessibility_counts(spark, sf_dir):
    return audit.accessibility(spark.sql(X.HTML)).select("url", "images_without_alt", "has_lang")


@query("link_matrix", """WITH n AS (SELECT n_regionkey AS c, n_name, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS pillar, n_nationkey AS o FROM nation),
s AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY c) AS k FROM n WHERE NOT pillar)
SELECT s.n_name AS source, n.n_name AS target, 'pillar' AS kind FROM s JOIN n ON n.c = s.c AND n.pillar UNION ALL SELECT a.n_name, b.n_name, 'sibling' FROM s a JOIN s b ON a.c = b.c, (VALUES (1), (2)) AS t(step) WHERE step < a.k AND b.i = (a.i + step) % a.k""")  # fmt: skip
def link_matrix(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    rows = nation.join(first, "n_regionkey").select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("url"), (F.col("n_nationkey") == F.col("first")).alias("is_pillar"), F.col("n_nationkey").alias("ord"))
    return audit.link_matrix(rows, 2)


@query("in_every", "SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def in_every(spark, sf_dir):
    return audit.in_every(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@case("intents", values("('buy shoes', 'transactional'), ('best shoes', 'commercial'), ('shop login', 'navigational'), ('shoes', 'informational')", "keyword, intent"))
def intents(spark, sf_dir):
    return audit.intents(spark.sql(values("('buy shoes'), ('best shoes'), ('shop login'), ('shoes')", "keyword")))


@case("keyword_groups", values("('k1', 'k1'), ('k2', 'k1')", "keyword, cluster"))
def keyword_groups(spark, sf_dir):
    return audit.cluster_ids(audit.keyword_clusters(spark.sql(X.RESULTS), least=2))


@query("sitemap_gate", "SELECT url, CASE WHEN page_id % 5 = 0 THEN 'not_fetched' WHEN page_id % 7 = 0 THEN 'status' WHEN page_id % 3 = 0 THEN 'noindex' WHEN page_id % 2 = 0 THEN 'canonical_elsewhere' END AS reason FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0 OR page_id % 3 = 0 OR page_id % 2 = 0")
def sitemap_gate(spark, sf_dir):
    seen = load(spark, sf_dir, "pages").where("page_id % 5 <> 0").selectExpr("page_id", "url", "if(page_id % 7 = 0, 404, 200) AS status", "if(page_id % 3 = 0, 'NoIndex', null) AS meta_robots", "if(page_id % 2 = 0, 'https://other/', url) AS canonical")
    return audit.sitemap_gate(load(spark, sf_dir, "pages").select("page_id", "url"), seen, ("page_id", "url"))


@query("page_type_mismatch", "WITH c AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) SELECT p_brand AS keyword, p_type AS usual, 'none' AS target_type FROM c WHERE r = 1")
def page_type_mismatch(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword"), F.col("p_type").alias("page_type"))
    return audit.page_type_mismatch(part, part.select("keyword", F.lit("none").alias("target_type")).distinct())


@query("persona_table", "SELECT l_returnflag AS page, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1")
def persona_table(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("page"), F.col("l_linestatus").alias("persona"), F.col("l_quantity").alias("score"))
    return audit.persona_table(rows, ["F", "O"])


@query("backlinks", rf"SELECT CAST(page_id % 10 AS BIGINT) AS target, count(*) AS links, count(DISTINCT {_HOST.format('url')}) AS domains, count(DISTINCT lower(substr(url, 1, 12))) AS anchors FROM pages GROUP BY 1")
def backlinks(spark, sf_dir):
    return audit.backlinks(load(spark, sf_dir, "pages").select(F.col("url").alias("source_url"), (F.col("page_id") % 10).alias("target"), F.substring("url", 1, 12).alias("anchor")))


@case("nap_mismatches", values("('c', 2::BIGINT, 1::BIGINT, 1::BIGINT)", "business, names, addresses, phones"))
def nap_mismatches(spark, sf_dir):
    return audit.nap_mismatches(spark.sql(values("('b', 'N', 'S 1', '12-3'), ('b', 'n', 'S-1', '123'), ('c', 'N', 'x', '1'), ('c', 'M', 'x', '1')", "business, name, address, phone")))


@case("page_overrides", values("('p', 't', '9'), ('p', 'u', '2'), ('q', 't', '1'), ('q', 'u', '8')", "page, token, value"))
def page_overrides(spark, sf_dir):
    return audit.page_overrides(spark.sql(values("('t', '1'), ('u', '2')", "token, value")), spark.sql(values("('p', 't', '9'), ('q', 'u', '8')", "page, token, value")))


@query("feature_matrix", "SELECT l_linestatus AS feature, bool_or(l_returnflag = 'A') AS A, bool_or(l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def feature_matrix(spark, sf_dir):
    return audit.feature_matrix(load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("feature"), F.col("l_returnflag").alias("product")), ["A", "R"])


@query("best_source", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a' WHEN o_orderkey % 2 = 0 THEN 'b' END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 't1' WHEN o_orderkey % 2 = 0 THEN 't2' ELSE 'none' END AS tier FROM orders")
def best_source(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, 'a', null) AS t1", "if(o_orderkey % 2 = 0, 'b', null) AS t2")
    return audit.best_source(rows, ["t1", "t2"]).select("o_orderkey", "value", "tier")


@query("local_grid", "SELECT l_returnflag AS business, count(DISTINCT l_linenumber) AS cells, count(DISTINCT CASE WHEN l_quantity <= 3 THEN l_linenumber END) AS found, round(count(DISTINCT CASE WHEN l_quantity <= 3 THEN l_linenumber END) / (SELECT count(DISTINCT l_linenumber) FROM lineitem), 4) AS share FROM lineitem GROUP BY 1")
def local_grid(spark, sf_dir):
    return audit.local_grid(load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("business"), F.col("l_linenumber").alias("cell"), F.col("l_quantity").alias("rank")))


@query("distances", "SELECT a.page_id AS x, round(12742.0176 * asin(sqrt(pow(sin(radians(a.page_id % 90) / 2), 2))), 3) AS km FROM pages a")
def distances(spark, sf_dir):
    at = (F.col("page_id") % 90).cast("double")
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("x"), F.round(audit.distance_km(F.lit(0.0), F.lit(0.0), at, F.lit(0.0)), 3).alias("km"))


@query("canonical_groups", "WITH v AS (SELECT url FROM pages UNION ALL SELECT url || '?a=1' FROM pages UNION ALL SELECT url || '#x' FROM pages), k AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '(?i)^https?://', '') AS k FROM v) SELECT DISTINCT url, first_value(url) OVER (PARTITION BY lower(split_part(k, '/', 1)), substr(k, length(split_part(k, '/', 1)) + 1) ORDER BY length(url), url) AS canonical FROM k")
def canonical_groups(spark, sf_dir):
    url = load(spark, sf_dir, "pages").select("url")
    return audit.canonical_groups(url.union(url.select(F.concat("url", F.lit("?a=1")))).union(url.select(F.concat("url", F.lit("#x")))).distinct())


@query("active_touches", "WITH r AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o.o_custkey AS contact, o.o_orderdate AS day FROM orders o LEFT JOIN r USING (o_custkey) WHERE d IS NULL OR o.o_orderdate < d")
def active_touches(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contact"), F.col("o_orderdate").alias("day"), "o_orderstatus")
    return audit.active_touches(orders, orders.where("o_orderstatus = 'F'"))


@case("complete", values("('a', false, 'g'), ('b', true, ''), ('c', false, 'f,g')", "id, complete, open"))
def complete(spark, sf_dir):
    return audit.complete(spark.sql(values("('a', 'x', ' tbd '), ('b', 'x', 'y'), ('c', '', NULL)", "id, f, g")), "id", ["f", "g"])


@query("image_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS file FROM part")
def image_names(spark, sf_dir):
    return audit.image_names(load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("preset"))).select("p_partkey", "file")


@case("fix_time", f"SELECT severity, count(*) AS n, round(sum(CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 1.5 ELSE 0.0 END)::DOUBLE, 2) AS hours FROM ({X.FINDINGS}) GROUP BY severity")
def fix_time(spark, sf_dir):
    return audit.fix_time(spark.sql(X.FINDINGS), {"critical": 4.0, "high": 1.5})


@query("prioritised", "SELECT p_partkey, round(p_size / greatest(CAST(p_partkey % 5 AS DOUBLE), 0.1), 4) AS priority FROM part")
def prioritised(spark, sf_dir):
    return audit.prioritised(load(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size as double) AS impact", "p_partkey % 5 AS effort")).select("p_partkey", "priority")


@query("dominant", r"""WITH c AS (SELECT 'colour' AS kind, lower(unnest(regexp_extract_all(html || ' #AABBCC #aabbcc #112233', '(#[0-9a-fA-F]{6})\b', 1))) AS value FROM pages), n AS (SELECT kind, value, count(*) AS n FROM c GROUP BY ALL)
SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS r FROM n) WHERE r <= 2""")  # fmt: skip
def dominant(spark, sf_dir):
    marked = load(spark, sf_dir, "pages").select(F.concat("html", F.lit(" #AABBCC #aabbcc #112233")).alias("html"))
    return audit.dominant(marked, k=2).where("kind = 'colour'")


_FILES = values("('a.md', 'v1.2.3 and 2.0.0, `s/x.py`' || chr(10) || 'secret name' || chr(10) || '5/6 checks passed'), ('s/x.py', ''), ('s/y.py', '')", "path, content")


@case("unrecorded_files", values("('s/y.py')", "path"))
def unrecorded_files(spark, sf_dir):
    return consistency.unrecorded(spark.sql(_FILES), spark.sql(_FILES))


@case("stale_versions", values("('a.md', '1.2.3')", "path, version"))
def stale_versions(spark, sf_dir):
    return consistency.stale_versions(spark.sql(_FILES), "2.0.0")


@case("denied_names", values("('a.md', 'secret')", "path, name"))
def denied_names(spark, sf_dir):
    return consistency.denied_names(spark.sql(_FILES), spark.sql(values("('secret'), ('none')", "name")))


@case("wrong_counts", values("('docs', 3, 1::BIGINT)", "claim, claimed, actual"))
def wrong_counts(spark, sf_dir):
    return consistency.wrong_counts(spark.sql(_FILES), spark.sql(values("('scripts', 2, 's/%'), ('docs', 3, '%.md')", "claim, claimed, `like`")))


@case("bare_lines", values("('a.md', 2, 'secret name')", "path, line_no, line"))
def bare_lines(spark, sf_dir):
    return consistency.bare_lines(spark.sql(_FILES), "^secret")


@case("passed_checks", values("('a.md', 5, 6, false)", "path, passed, total, all_passed"))
def passed_checks(spark, sf_dir):
    return consistency.passed_checks(spark.sql(_FILES))


@query("unmatched_fields", "SELECT n_name, 'key' AS field, CAST(n_nationkey AS VARCHAR) AS \"left\", CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 1 AS VARCHAR) END AS \"right\" FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 AND n_nationkey % 2 = 1")
def unmatched_fields(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("key"))
    other = nation.where("key % 2 = 0 OR key % 3 <> 0").withColumn("key", F.when(F.col("key") % 2 == 0, F.col("key") + 1).otherwise(F.col("key")))
    return consistency.unmatched_fields(nation, other, "n_name", ["key"])


@case("jsonld_types", "SELECT * FROM (VALUES ('Organization', 2), ('LocalBusiness', 2), ('Article', 3), ('Product', 2), ('BreadcrumbList', 1), ('FAQPage', 1), ('Event', 3), ('Person', 1), ('WebSite', 2), ('Review', 3), ('VideoObject', 4)) AS t(type, n_required)")
def jsonld_types(spark, sf_dir):
    return jsonld.list_spec(spark).select("type", F.size(F.split("required", ", ")).alias("n_required"))


@case("llms_txt", values("('a', true, true, 5), ('b', true, false, 4), ('c', false, NULL, NULL)", "site, present, has_headings, length"))
def llms_txt(spark, sf_dir):
    return robots.llms_txt(spark.sql(values("('a', 'x' || chr(10) || '# y'), ('b', 'none'), ('c', CAST(NULL AS STRING))", "site, body")))


@case("robots_citation", "SELECT bot, kind FROM (VALUES ('GPTBot', 'training'), ('ClaudeBot', 'training'), ('Google-Extended', 'training'), ('CCBot', 'training'), ('OAI-SearchBot', 'retrieval'), ('Claude-SearchBot', 'retrieval'), ('PerplexityBot', 'retrieval')) AS t(bot, kind)")
def robots_citation(spark, sf_dir):
    return robots.blocked(spark.sql(X.ROBOTS), "citation").select("bot", "kind").distinct()


@case("audit_status", values("('a', false), ('b', true), ('c', false)", "url, failed"))
def audit_status(spark, sf_dir):
    return pages.audit_status(spark.sql(values("('a', 'x', NULL), ('b', NULL, 'timeout'), ('c', NULL, NULL)", "url, html, error")))


@query("json_report", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def json_report(spark, sf_dir):
    return sinks.as_json(load(spark, sf_dir, "region").select("r_regionkey", "r_name"))
