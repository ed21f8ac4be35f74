"""Every query by name, with its SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import audit, color, consistency, jsonld, locale, pages, passages, profile, recommend, render, robots, sitemap
from tessella.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Small literal cases, which tests run as they run queries; what they show is queried over whole tables too.
CASES: dict[str, Query] = {}
CASE_SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        CASES[name] = f
        if sql is not None:
            CASE_SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- passages

_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)</(p|div|li|h[1-6]|section|article)>', chr(10) || chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '^$', '', 'g')"""
_W = r"[\s\x0B\p{Z}\x85]"
_PASSAGES = rf"""parts AS (SELECT page_id, unnest(regexp_split_to_array({_TEXT}, '\n{_W}*\n')) AS raw, generate_subscripts(regexp_split_to_array({_TEXT}, '\n{_W}*\n'), 1) - 1 AS pos FROM pages),
p AS (SELECT page_id, pos, regexp_replace(raw, '^{_W}+|{_W}+$', '', 'g') AS passage FROM parts),
s AS (SELECT page_id, pos, passage, len(list_filter(regexp_split_to_array(passage, '{_W}+'), lambda w: w <> '')) AS words,
 greatest(1, len(regexp_extract_all(passage, '[.!?]+'))) AS sentences,
 regexp_matches(passage, '\p{{Nd}}{{4}}|\p{{Nd}}+%|\$\p{{Nd}}|\p{{Nd}}+\.\p{{Nd}}+|(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}{{2,}}([^\p{{L}}\p{{N}}_]|$)|(^|[^\p{{L}}\p{{N}}_])(per cent|percent)([^\p{{L}}\p{{N}}_]|$)') AS specific,
 NOT regexp_matches(passage, '(?i)^{_W}*(this|that|these|those|it|they|he|she|here|however|therefore|thus|also|additionally|furthermore)([^\p{{L}}\p{{N}}_]|$)') AS standalone
 FROM p WHERE length(passage) > 40)"""


@query("geo_passages", f"WITH {_PASSAGES} SELECT page_id, CAST(pos AS INTEGER) AS pos, words, sentences, specific, standalone, specific AND standalone AND words <= 120 AS citable FROM s")
def geo_passages(spark, sf_dir):
    return passages.scored(load(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "pos", "words", "sentences", "specific", "standalone", "citable")


@query("geo_page_score", f"""WITH {_PASSAGES}, a AS (SELECT page_id, count(*) AS passages, count(*) FILTER (specific AND standalone AND words <= 120) AS citable, sum(words) AS words FROM s GROUP BY page_id)
SELECT pages.page_id, coalesce(passages, 0) AS passages, coalesce(citable, 0) AS citable, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(CASE WHEN passages > 0 THEN round_even(100.0::DOUBLE * citable / passages, 0) ELSE 0 END AS BIGINT) AS citable_pct FROM pages LEFT JOIN a USING (page_id)""")  # fmt: skip
def geo_page_score(spark, sf_dir):
    return passages.page_score(load(spark, sf_dir, "pages"), "page_id", "html")


@query("geo_weak_top10", f"""WITH {_PASSAGES}, w AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM s WHERE NOT (specific AND standalone AND words <= 120))
SELECT page_id, CAST(rank AS INTEGER) AS rank, substr(passage, 1, 80) AS preview, words, sentences, array_to_string(list_filter([CASE WHEN NOT specific THEN 'not_specific' END, CASE WHEN NOT standalone THEN 'leans_on_context' END, CASE WHEN words > 120 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS issues FROM w WHERE rank <= 10""")  # fmt: skip
def geo_weak_top10(spark, sf_dir):
    return passages.weak(load(spark, sf_dir, "pages"), "page_id", "html")


@query("geo_ld_blocks", "SELECT page_id, CAST(CASE WHEN contains(html, '<') THEN len(regexp_extract_all(html, '(?i)application/ld\\+json')) ELSE 0 END AS BIGINT) AS ld_blocks FROM pages")
def geo_ld_blocks(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", passages.ld_blocks("html").cast("long").alias("ld_blocks"))


# --- tables of strings


def _unpivot(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, rid FROM (SELECT *, row_number() OVER () AS rid FROM {table})" for c in columns)


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
_NUM = r"TRY_CAST(CASE WHEN regexp_matches(trim(value), '^-?\d{1,3}(,\d{3})+(\.\d+)?$') THEN replace(trim(value), ',', '') ELSE trim(value) END AS DOUBLE)"


@query("csv_profile_numeric", f"""WITH c AS ({_unpivot('customer', _CUSTOMER)}), n AS (SELECT "column", value, {_NUM} AS x FROM c),
a AS (SELECT "column", count(*) AS "count", count(nullif(value, '')) AS non_empty, count(DISTINCT nullif(value, '')) AS "distinct", count(x) AS parsed, min(x) AS lo, max(x) AS hi, avg(x) AS av FROM n GROUP BY 1)
SELECT "column", "count", non_empty, "count" - non_empty AS empty, "distinct", CASE WHEN num THEN 'numeric' ELSE 'categorical' END AS type, CASE WHEN num THEN round(lo, 4) END AS min, CASE WHEN num THEN round(hi, 4) END AS max, CASE WHEN num THEN round(av, 4) END AS mean
FROM (SELECT *, non_empty > 0 AND parsed >= ceil(0.8 * non_empty) AS num FROM a)""")  # fmt: skip
def csv_profile_numeric(spark, sf_dir):
    return profile.profile(load(spark, sf_dir, "customer").select(*_CUSTOMER))


@query("csv_top_values", f"""WITH c AS ({_unpivot('customer', ['c_nationkey', 'c_mktsegment'])}), g AS (SELECT "column", value, count(*) AS n, min(rid) AS f FROM c WHERE value <> '' GROUP BY 1, 2)
SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) AS r FROM g) WHERE r <= 5""")  # fmt: skip
def csv_top_values(spark, sf_dir):
    return profile.top_values(load(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")).select("column", "value", "n")


@query("csv_group_count", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def csv_group_count(spark, sf_dir):
    return profile.group_count(load(spark, sf_dir, "events").select("event_type"), "event_type")


@query("csv_filter_select", "SELECT c_mktsegment, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def csv_filter_select(spark, sf_dir):
    ask = profile.Report(filters=["c_mktsegment = BUILDING", "nothing", "no_such=1"], select="c_mktsegment, c_name, no_such")
    table = load(spark, sf_dir, "customer")
    return profile.apply_select(profile.apply_filters(table, ask), ask)


@query("csv_redacted", "SELECT '[redacted]' AS value, count(*) AS n FROM customer GROUP BY c_nationkey")
def csv_redacted(spark, sf_dir):
    return profile.group_count(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("auth_code")), "auth_code")


@query("csv_report_rows", "SELECT count(*) AS rows, CAST(2 AS INTEGER) AS columns FROM customer WHERE c_mktsegment = 'BUILDING'")
def csv_report_rows(spark, sf_dir):
    return profile.run(load(spark, sf_dir, "customer"), profile.Report(filters=["c_mktsegment=BUILDING"], select="c_name,c_mktsegment"))["rows"]


@query("csv_profile_lineitem", f"""WITH c AS ({_unpivot('lineitem', ['l_quantity', 'l_returnflag', 'l_linestatus'])}), n AS (SELECT "column", value, {_NUM} AS x FROM c)
SELECT "column", count(*) AS "count", count(DISTINCT value) AS "distinct", round(min(x), 4) AS min, round(max(x), 4) AS max FROM n GROUP BY 1""")  # fmt: skip
def csv_profile_lineitem(spark, sf_dir):
    return profile.profile(load(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")).select("column", "count", "distinct", "min", "max")


# --- pages

_FIND = "nullif(regexp_replace(regexp_extract(html, '(?is){0}', 1), '^\\s+|\\s+$', '', 'g'), '')"


def _found(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"CASE WHEN regexp_matches(html, '(?is){p}') THEN regexp_replace(regexp_extract(html, '(?is){p}', 1), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') END"


def _n(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"CAST(len(regexp_extract_all(html, '(?i){p}')) AS BIGINT)"


_WORDS = rf"CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '{_W}+'), lambda w: w <> '')) AS BIGINT)"
_SNAP = f"""SELECT url, {_found(pages.TITLE)} AS title, {_found(pages.meta('description'))} AS meta_description, {_found('<h1[^>]*>(.*?)</h1>')} AS h1, {_found(pages.CANONICAL)} AS canonical,
{_found(pages.meta('robots'))} AS meta_robots, {_found(pages.meta('og:title', 'property'))} AS og_title, {_found(pages.meta('og:description', 'property'))} AS og_description, {_found(pages.meta('og:image', 'property'))} AS og_image,
{_n('application/ld[+]json')} AS schema_blocks, {_n('<h2[\\s>]')} AS h2_count, {_WORDS} AS word_count FROM """


@query("page_snapshot", _SNAP + "pages")
def page_snapshot(spark, sf_dir):
    return pages.snapshot(load(spark, sf_dir, "pages"))


@case("page_snapshot_fixture", _SNAP + f"({X.HTML})")
def page_snapshot_fixture(spark, sf_dir):
    return pages.snapshot(spark.sql(X.HTML))


@query("word_count", f"SELECT page_id, {_WORDS} AS words FROM pages")
def word_count(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", pages.word_count("html").alias("words"))


def _findings_sql(source: str) -> str:
    blank = lambda c: f"({c} IS NULL OR {c} = '')"
    checks = [
        ("https", "CASE WHEN NOT coalesce(regexp_matches(url, '(?i)^\\s*https:'), false) THEN 'critical' END"),
        ("title", f"CASE WHEN {blank('title')} THEN 'critical' WHEN length(title) > 60 THEN 'medium' ELSE 'info' END"),
        ("meta_description", f"CASE WHEN {blank('descr')} THEN 'high' WHEN length(descr) NOT BETWEEN 50 AND 165 THEN 'medium' ELSE 'info' END"),
        ("h1", "CASE WHEN h1 = 0 THEN 'high' WHEN h1 > 1 THEN 'medium' ELSE 'info' END"),
        ("canonical", f"CASE WHEN {blank('canonical')} THEN 'medium' ELSE 'info' END"),
        ("meta_robots", f"CASE WHEN {blank('robots')} THEN NULL WHEN contains(lower(robots), 'noindex') THEN 'critical' ELSE 'info' END"),
        ("viewport", "CASE WHEN regexp_matches(html, '(?i)<meta[^>]+name=[\"'']viewport[\"'']') THEN 'info' ELSE 'high' END"),
        ("lang", f"CASE WHEN {blank('lang')} THEN 'medium' ELSE 'info' END"),
        ("json_ld", "CASE WHEN ld = 0 THEN 'high' ELSE 'info' END"),
        ("image_alt", "CASE WHEN len(imgs) = 0 THEN NULL WHEN len(list_filter(imgs, lambda i: NOT regexp_matches(i, '(?i)\\balt='))) > 0 THEN 'medium' ELSE 'info' END"),
        ("mixed_content", "CASE WHEN regexp_matches(html, '(src|href)=[\"'']http://') THEN 'high' END"),
    ]
    body = " UNION ALL ".join(f"SELECT url, '{code}' AS code, {expr} AS severity FROM f" for code, expr in checks)
    return f"""WITH f AS (SELECT url, html, {_found(pages.TITLE)} AS title, {_found(pages.meta('description'))} AS descr, {_found(pages.meta('robots'))} AS robots, {_found(pages.CANONICAL)} AS canonical,
{_found("<html[^>]*" + chr(92) + "blang=[" + chr(34) + "'](.*?)[" + chr(34) + "']")} AS lang, {_n('<h1[\\s>]')} AS h1, {_n('<script[^>]+type=["' + "'" + ']application/ld[+]json["' + "'" + ']')} AS ld, regexp_extract_all(html, '(?i)<img\\b[^>]*>') AS imgs FROM {source})
SELECT url, code, severity FROM ({body}) WHERE severity IS NOT NULL"""


@query("tech_findings", _findings_sql("pages"))
def tech_findings(spark, sf_dir):
    return pages.findings(load(spark, sf_dir, "pages")).select("url", "code", "severity")


@case("tech_findings_fixture", _findings_sql(f"({X.HTML})"))
def tech_findings_fixture(spark, sf_dir):
    return pages.findings(spark.sql(X.HTML)).select("url", "code", "severity")


@query("tech_severity_counts", f"SELECT code, severity, count(*) AS n FROM ({_findings_sql('pages')}) GROUP BY ALL")
def tech_severity_counts(spark, sf_dir):
    return pages.severity_counts(pages.findings(load(spark, sf_dir, "pages")))


_HEADERS = """SELECT * FROM (VALUES ('u1', 'referrer-policy,content-security-policy'), ('u2', ''), ('u3', 'strict-transport-security,content-security-policy,x-content-type-options,referrer-policy')) AS t(url, names)"""


@case("security_headers", f"""WITH h AS (SELECT url, string_split(names, ',') AS n FROM ({_HEADERS})), k AS (SELECT * FROM (VALUES (1, 'strict-transport-security', 'HSTS'), (2, 'content-security-policy', 'CSP'), (3, 'x-content-type-options', 'X-Content-Type-Options'), (4, 'referrer-policy', 'Referrer-Policy')) AS k(i, name, label))
SELECT url, CASE WHEN list_contains(n, name) THEN 'info' ELSE 'medium' END AS severity, string_agg(label, ', ' ORDER BY i) AS headers FROM h, k GROUP BY ALL""")  # fmt: skip
def security_headers(spark, sf_dir):
    sent = F.map_from_entries(F.transform(F.filter(F.split("names", ","), lambda n: n != ""), lambda n: F.struct(n, F.lit("x"))))
    return pages.header_findings(spark.sql(_HEADERS).select("url", sent.alias("headers")))


_MUTATED = "SELECT url, CASE WHEN page_id % 3 = 0 THEN replace(html, '<h2', '<h3') WHEN page_id % 3 = 1 THEN replace(html, '<title>', '<title>New ') ELSE html END AS html FROM pages"


@query("drift_diff", f"""WITH b AS ({_SNAP}pages), a AS ({_SNAP}({_MUTATED}))
SELECT b.url, 'title' AS element, 'high' AS severity, b.title AS old, a.title AS new FROM a JOIN b USING (url) WHERE a.title IS DISTINCT FROM b.title
UNION ALL SELECT b.url, 'h2_count', 'low', CAST(b.h2_count AS VARCHAR), CAST(a.h2_count AS VARCHAR) FROM a JOIN b USING (url) WHERE a.h2_count <> b.h2_count
UNION ALL SELECT b.url, 'word_count', 'medium', CAST(b.word_count AS VARCHAR), CAST(a.word_count AS VARCHAR) FROM a JOIN b USING (url) WHERE a.word_count <> b.word_count AND NOT (b.word_count <> 0 AND abs(a.word_count - b.word_count) / greatest(1, b.word_count) < 0.15)""")  # fmt: skip
def drift_diff(spark, sf_dir):
    load(spark, sf_dir, "pages").createOrReplaceTempView("_pages")
    after = spark.sql(_MUTATED.replace("FROM pages", "FROM _pages"))
    return pages.drift(pages.snapshot(load(spark, sf_dir, "pages")), pages.snapshot(after)).select("url", "element", "severity", "old", "new")


@query("drift_severity", f"SELECT url, count(*) AS changed, CASE min(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst FROM ({ORACLE_SQL['drift_diff']}) GROUP BY url")
def drift_severity(spark, sf_dir):
    return pages.drift_summary(drift_diff(spark, sf_dir))


@query("https_check", "SELECT url FROM pages WHERE NOT regexp_matches(url, '(?i)^https:')")
def https_check(spark, sf_dir):
    return pages.findings(load(spark, sf_dir, "pages")).where("code = 'https'").select("url")


# --- sitemaps


@query("sitemap_url_filter", "SELECT page_id AS idx, url FROM pages WHERE regexp_matches(url, '(?i)^https?:')")
def sitemap_url_filter(spark, sf_dir):
    return sitemap.kept_urls(load(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url"))


@query("sitemap_chunks", "SELECT page_id AS idx, url, row_number() OVER (ORDER BY page_id) - 1 AS position, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 40) + 1 AS BIGINT) AS chunk FROM pages")
def sitemap_chunks(spark, sf_dir):
    urls = load(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url")
    return sitemap.chunked(urls, "idx", 40).select("idx", "url", "position", F.col("chunk").cast("long").alias("chunk"))


_ESC = "replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("sitemap_xml", f"""WITH c AS (SELECT page_id, url, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 100) + 1 AS BIGINT) AS chunk FROM pages WHERE regexp_matches(url, '(?i)^https?:'))
SELECT chunk, count(*) AS n_urls, '{sitemap.HEAD.strip()}' || chr(10) || '<urlset xmlns="{sitemap.NAMESPACE}">' || chr(10) || string_agg('  <url>' || chr(10) || '    <loc>' || {_ESC} || '</loc>' || chr(10) || '  </url>' || chr(10), '' ORDER BY page_id) || '</urlset>' || chr(10) AS xml FROM c GROUP BY chunk""")  # fmt: skip
def sitemap_xml(spark, sf_dir):
    urls = load(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url")
    return sitemap.documents(urls, "idx", 100).select(F.col("chunk").cast("long").alias("chunk"), "n_urls", "xml")


@query("sitemap_rejected", "SELECT count(*) AS n_bad, min_by(url, page_id) AS first_bad FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/' || url ELSE url END AS url FROM pages) WHERE NOT regexp_matches(url, '(?i)^https?:')")
def sitemap_rejected(spark, sf_dir):
    urls = load(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.expr("if(page_id % 7 = 0, '/' || url, url)").alias("url"))
    return sitemap.rejected(urls)


@case("sitemap_validate", """SELECT * FROM (VALUES (1, 'urlset', 2, 1, false, 'relative_urls', ''), (2, 'sitemapindex', 1, 0, true, '', ''), (3, 'urlset', 0, 0, false, 'no_entries', 'namespace'), (4, NULL, 0, 0, false, 'malformed', ''), (5, 'feed', 0, 0, false, 'unexpected_root', 'namespace'), (6, NULL, 0, 0, false, 'malformed', '')) AS t(id, root, n, n_relative, valid, errors, warnings)""")
def sitemap_validate(spark, sf_dir):
    return sitemap.validate(spark.sql(X.SITEMAPS))


# --- robots, languages, structured data


@case("robots_policy", """SELECT * FROM (VALUES ('a', 'blocks_training', 'Bytespider,CCBot,ClaudeBot,GPTBot,Google-Extended', true), ('b', 'blocks_training', 'CCBot,GPTBot', false), ('c', 'blocks_training', 'ClaudeBot', false), ('d', 'silent', '', false), ('e', 'silent', '', false), ('f', 'mentions_only', 'GPTBot', false)) AS t(site, policy, bots, has_sitemap)""")
def robots_policy(spark, sf_dir):
    return robots.policy(spark.sql(X.ROBOTS))


@case("robots_groups", r"""WITH l AS (SELECT site, i AS pos, regexp_replace(regexp_replace(string_split(raw, chr(10))[i], '#.*$', ''), '\s+$', '') AS line FROM (""" + X.ROBOTS + r""") r, range(1, 20) t(i) WHERE i <= len(string_split(raw, chr(10)))),
a AS (SELECT *, regexp_matches(line, '(?i)^\s*user-agent\s*:') AS is_a FROM l), b AS (SELECT *, is_a AND NOT coalesce(lag(is_a) OVER (PARTITION BY site ORDER BY pos), false) AS begins FROM a),
g AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY site ORDER BY pos) AS group_id FROM b)
SELECT site, CAST(group_id AS BIGINT) AS group_id, string_agg(DISTINCT CASE WHEN is_a THEN lower(trim(regexp_extract(line, '^[^:]*:(.*)$', 1))) END, ',' ORDER BY CASE WHEN is_a THEN lower(trim(regexp_extract(line, '^[^:]*:(.*)$', 1))) END) AS agents,
 bool_or(regexp_matches(line, '(?i)^\s*disallow\s*:\s*/\s*$')) AND NOT bool_or(regexp_matches(line, '(?i)^\s*allow\s*:\s*/\s*$')) AS blocks_root FROM g WHERE group_id > 0 GROUP BY site, group_id""")  # fmt: skip
def robots_groups(spark, sf_dir):
    return robots.groups(spark.sql(X.ROBOTS)).withColumn("agents", F.array_join("agents", ","))


@case("hreflang_faults", """SELECT * FROM (VALUES ('https://a.test/en', 3, 'DE', 'relative_href'), ('https://a.test/en', 3, 'DE', 'duplicate'), ('https://a.test/de', 1, 'en-UK1', 'bad_region'), ('https://a.test/fr', 0, 'fr-FR-x', 'bad_segments'), ('https://a.test/fr', 1, 'qq', 'bad_language')) AS t(page, pos, code, fault)""")
def hreflang_faults(spark, sf_dir):
    return locale.entry_faults(spark.sql(X.HREFLANG))


@case("hreflang_validate", f"""WITH e AS ({X.HREFLANG}), f AS (SELECT page, count(*) AS n, bool_or(hreflang = 'x-default') AS has_x_default, bool_or(href = page) AS has_self FROM e GROUP BY page),
x AS (SELECT * FROM (VALUES ('https://a.test/en', 2), ('https://a.test/de', 1), ('https://a.test/fr', 2)) AS t(page, faults))
SELECT page, n, CAST(faults + CASE WHEN has_self THEN 0 ELSE 1 END AS BIGINT) AS errors, faults = 0 AND has_self AS valid, has_x_default, has_self FROM f JOIN x USING (page)""")  # fmt: skip
def hreflang_validate(spark, sf_dir):
    entries = spark.sql(X.HREFLANG)
    return locale.validate(entries, entries.select("page", F.col("page").alias("self_url")).distinct())


@case("hreflang_reciprocity", f"""WITH e AS ({X.HREFLANG}), l AS (SELECT DISTINCT page, href FROM e WHERE href <> page)
SELECT page, href FROM l WHERE href IN (SELECT page FROM e) AND NOT EXISTS (SELECT 1 FROM l b WHERE b.page = l.href AND b.href = l.page)""")  # fmt: skip
def hreflang_reciprocity(spark, sf_dir):
    entries = spark.sql(X.HREFLANG)
    return locale.not_reciprocal(entries, entries.select("page", F.col("page").alias("self_url")).distinct())


@case("hreflang_tags", f"""SELECT page, pos, '<link rel="alternate" hreflang="' || hreflang || '" href="' || href || '" />' AS tag FROM ({X.HREFLANG})""")
def hreflang_tags(spark, sf_dir):
    return locale.tags(spark.sql(X.HREFLANG).withColumnRenamed("hreflang", "code"))


@case("jsonld_validate", """SELECT * FROM (VALUES (1, 'Article', '', 'image,dateModified,publisher', 'see_note', true), (2, 'Article', 'headline,author,datePublished', 'image,dateModified,publisher', 'see_note', false), (3, 'Event', 'location', 'endDate,offers,performer,image,eventStatus', 'no_context', false), (4, 'Person', '', 'url,image,sameAs,jobTitle', '', true), (5, 'Product', 'image', 'description,brand,offers,aggregateRating,review,sku,gtin', 'see_note', false)) AS t(id, type, missing_required, missing_recommended, warnings, ok)""")
def jsonld_validate(spark, sf_dir):
    found = jsonld.validate(spark.sql(X.JSONLD))
    return found.select("id", "type", *[F.array_join(c, ",").alias(c) for c in ("missing_required", "missing_recommended", "warnings")], "ok")


@case("jsonld_missing", """SELECT id, CAST(0 AS INTEGER) AS pos, type, unnest(string_split(r, ',')) AS property, 'required' AS kind FROM (VALUES (2, 'Article', 'headline,author,datePublished'), (3, 'Event', 'location'), (5, 'Product', 'image')) AS t(id, type, r)
UNION ALL SELECT id, CAST(0 AS INTEGER), type, unnest(string_split(r, ',')), 'recommended' FROM (VALUES (1, 'Article', 'image,dateModified,publisher'), (2, 'Article', 'image,dateModified,publisher'), (3, 'Event', 'endDate,offers,performer,image,eventStatus'), (4, 'Person', 'url,image,sameAs,jobTitle'), (5, 'Product', 'description,brand,offers,aggregateRating,review,sku,gtin')) AS t(id, type, r)""")  # fmt: skip
def jsonld_missing(spark, sf_dir):
    return jsonld.missing(spark.sql(X.JSONLD))


@case("jsonld_id_resolution", """SELECT * FROM (VALUES ('p1', '#me'), ('p3', '#you')) AS t(url, ref)""")
def jsonld_id_resolution(spark, sf_dir):
    return jsonld.unresolved_ids(spark.sql(X.IDS))


@case("jsonld_generate", """SELECT 'Person' AS type, '{"@context":"https://schema.org","@type":"Robot","name":"N"}' AS json""")
def jsonld_generate(spark, sf_dir):
    return jsonld.generate(spark.sql("""SELECT 'Person' AS type, map('@type', 'Robot', 'name', 'N') AS data""")).select("type", "json")


# --- colours and recommendation

_LIN = "(CASE WHEN {0} <= 0.03928 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)"


def _lum(c: str) -> str:
    channel = [f"(CAST('0x' || substr({c}, {i}, 2) AS INTEGER) / 255.0::DOUBLE)" for i in (2, 4, 6)]
    return " + ".join(f"{w} * {_LIN.format(x)}" for w, x in zip(("0.2126::DOUBLE", "0.7152::DOUBLE", "0.0722::DOUBLE"), channel, strict=True))


_PAIRS = "SELECT * FROM (VALUES ('#ffffff', '#000000'), ('#336699', '#ffffff'), ('#111418', '#2c61dd'), ('#0a0a0a', '#0b0b0b')) AS t(a, b)"


@case("palette_contrast", f"SELECT a, b, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 2) AS contrast FROM (SELECT a, b, {_lum('a')} AS x, {_lum('b')} AS y FROM ({_PAIRS}))")
def palette_contrast(spark, sf_dir):
    return spark.sql(_PAIRS).select("a", "b", color.contrast(F.col("a"), F.col("b")).alias("contrast"))


@case("palette_derived")
def palette_derived(spark, sf_dir):
    return color.palette(spark.sql(X.SEEDS))


def _designs(spark: SparkSession) -> DataFrame:
    return recommend.compose(spark.sql(X.REQUESTS), spark.sql(X.PRODUCTS), spark.sql(X.STYLES), spark.sql(X.PALETTES))


@case("design_pick", """SELECT * FROM (VALUES (1, 'shop', true, 'bold', true, 'sun', true, 'popups|quiet'), (2, 'journal', true, 'plain', false, 'ink', true, 'ads|popups|noise'), (3, 'landing', false, 'plain', true, 'ink', false, 'clutter|slow|noise'), (4, 'shop', true, 'soft glass', true, 'sun', true, 'popups|print')) AS t(id, product, product_matched, style, style_matched, palette, palette_matched, avoided)""")
def design_pick(spark, sf_dir):
    return _designs(spark).select("id", F.col("product.product_type").alias("product"), "product_matched", F.col("style_name").alias("style"), "style_matched", F.col("palette.name").alias("palette"), "palette_matched", F.array_join("anti_patterns", "|").alias("avoided"))


@case("design_fallbacks")
def design_fallbacks(spark, sf_dir):
    return recommend.compose(spark.sql(X.REQUESTS)).select("id", "pattern", "style_name", F.col("effects.radius").alias("radius"), F.array_join("key_sections", ",").alias("sections"), F.size("checklist").alias("checks"), F.array_join("fallbacks", ",").alias("fallbacks"))


_DESIGN = """SELECT 'Shop & Co' AS product_type, named_struct('primary', '#112233', 'secondary', CAST(NULL AS STRING), 'accent', '', 'bg', '#ffffff', 'surface', CAST(NULL AS STRING), 'text', '#000000', 'on_primary', '#ffffff', 'success', CAST(NULL AS STRING), 'warning', CAST(NULL AS STRING), 'error', CAST(NULL AS STRING)) AS palette,
named_struct('heading_font', 'Open Sans', 'body_font', CAST(NULL AS STRING)) AS typography, named_struct('radius', '8px', 'motion', '1s') AS effects, array('hero', 'features', 'cta', 'our story') AS key_sections"""


@case("token_css", """SELECT ':root {' || chr(10) || '  --color-primary: #112233;' || chr(10) || '  --color-bg: #ffffff;' || chr(10) || '  --color-text: #000000;' || chr(10) || '  --color-on-primary: #ffffff;' || chr(10) || '  --font-heading: "Open Sans", serif;' || chr(10) || '  --radius: 8px;' || chr(10) || '}' || chr(10) AS css""")
def token_css(spark, sf_dir):
    return render.token_sheets(spark.sql(_DESIGN)).select("css")


@case("token_sheets")
def token_sheets(spark, sf_dir):
    return render.token_sheets(spark.sql(_DESIGN)).select("scss", "tailwind", "json")


@case("render_page")
def render_page(spark, sf_dir):
    return render.pages(spark.sql(_DESIGN)).select("product_type", "page")


def _builds(spark: SparkSession) -> DataFrame:
    html = '<link rel="stylesheet" href="s.css"><script src="a.js" defer></script><img src="../x.png"><img src="p.png"><img src="https://r.test/i.png" srcset="x">'
    return spark.createDataFrame([("b1", html, {"s.css": b"p{}", "a.js": b"go()\n//# sourceMappingURL=a.map", "p.png": b"\x89PNG"})], "id string, html string, files map<string,binary>")


@case("portable_inline")
def portable_inline(spark, sf_dir):
    return render.unhandled(render.bundles(_builds(spark))).select("id", "bundle", F.array_join("notes", "|").alias("notes"), F.array_join("references", ",").alias("references"))


@case("platform_fit")
def platform_fit(spark, sf_dir):
    return render.platform_fit(render.bundles(_builds(spark)))


# --- scores and comparisons


@case("audit_score", f"""SELECT site, round(sum(w * score) / sum(w), 2) AS score, count(*) AS specialists FROM (SELECT site, CAST(score AS DOUBLE) AS score, CASE specialist WHEN 'technical' THEN 30 WHEN 'content' THEN 30 WHEN 'schema' THEN 15 WHEN 'media' THEN 10 WHEN 'ai' THEN 15 END AS w FROM ({X.LINKS})) WHERE w IS NOT NULL GROUP BY site""")
def audit_score(spark, sf_dir):
    return audit.health_score(spark.sql(X.LINKS).withColumn("score", F.col("score").cast("double")))


@case("qa_verdict", f"SELECT site, CASE WHEN bool_or(severity = 'critical') THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({X.FINDINGS}) GROUP BY site")
def qa_verdict(spark, sf_dir):
    return audit.qa_verdict(spark.sql(X.FINDINGS))


@case("merged_findings", f"SELECT site, code, CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 5 END) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'info' END AS severity, 2 * count(*) AS n FROM ({X.FINDINGS}) GROUP BY site, code")
def merged_findings(spark, sf_dir):
    return audit.merged_findings(spark.sql(X.FINDINGS), spark.sql(X.FINDINGS))


@case("white_space", f"SELECT dimension, CAST(max(score) AS DOUBLE) AS best FROM ({X.SCORES}) GROUP BY dimension HAVING max(score) < 3")
def white_space(spark, sf_dir):
    return audit.white_space(spark.sql(X.SCORES).withColumn("score", F.col("score").cast("double")))


@case("keyword_clusters", f"SELECT x.keyword AS a, y.keyword AS b, count(*) AS shared FROM ({X.RESULTS}) x JOIN ({X.RESULTS}) y ON x.url = y.url AND x.keyword < y.keyword WHERE x.rank <= 10 AND y.rank <= 10 GROUP BY ALL HAVING count(*) >= 2")
def keyword_clusters(spark, sf_dir):
    return audit.keyword_clusters(spark.sql(X.RESULTS), least=2)


_GRAMS = """w AS (SELECT page_id, list_filter(regexp_split_to_array(lower(html), '[\\s\\x0B\\p{Z}\\x85]+'), lambda t: t <> '') AS w FROM pages), g AS (SELECT DISTINCT page_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, range(1, 100000) t(i) WHERE i <= len(w) - 4)"""


@query("unique_content_ratio", f"""WITH {_GRAMS}, o AS (SELECT g, count(*) AS n FROM g GROUP BY g), a AS (SELECT page_id, count(*) AS shingles, count(*) FILTER (n = 1) AS uniq FROM g JOIN o USING (g) GROUP BY page_id)
SELECT page_id, coalesce(shingles, 0) AS shingles, coalesce(uniq, 0) AS "unique", CASE WHEN shingles > 0 THEN round(uniq / shingles, 4) ELSE 0 END AS ratio, CASE WHEN shingles > 0 THEN round(uniq / shingles, 4) ELSE 0 END < 0.3 AS thin FROM pages LEFT JOIN a USING (page_id)""")  # fmt: skip
def unique_content_ratio(spark, sf_dir):
    return audit.unique_ratio(load(spark, sf_dir, "pages"), "page_id", "html")


@query("label_gap", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_gap(spark, sf_dir):
    return audit.not_covered(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), ["doc_id"])


@query("section_stats", rf"""WITH s AS (SELECT role AS heading, conv_id AS page, len(list_filter(regexp_split_to_array(text, '{_W}+'), lambda w: w <> '')) AS words FROM conversations)
SELECT lower(heading) AS heading, count(DISTINCT page) AS pages, round(avg(words), 2) AS avg_words, CAST(min(words) AS BIGINT) AS min_words, CAST(max(words) AS BIGINT) AS max_words FROM s GROUP BY 1""")  # fmt: skip
def section_stats(spark, sf_dir):
    return audit.section_stats(load(spark, sf_dir, "conversations").select(F.col("role").alias("heading"), F.col("conv_id").alias("page"), "text"))


@query("readability", rf"""WITH r AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{_W}+'), lambda w: w <> '')) AS BIGINT) AS words, CAST(greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS BIGINT) AS sentences FROM documents)
SELECT doc_id, words, sentences, round(words / sentences, 2) AS words_per_sentence, words < 300 AS thin FROM r""")  # fmt: skip
def readability(spark, sf_dir):
    return audit.readability(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("heading_jumps", r"""WITH h AS (SELECT url, regexp_extract_all(html, '(?i)<h([1-6])[\s>]', 1) AS l FROM pages), p AS (SELECT url, i - 1 AS pos, CAST(l[i] AS INTEGER) AS level, CAST(l[i - 1] AS INTEGER) AS before FROM h, range(2, 10000) t(i) WHERE i <= len(l))
SELECT url, CAST(pos AS INTEGER) AS pos, level, before FROM p WHERE level > before + 1""")  # fmt: skip
def heading_jumps(spark, sf_dir):
    return audit.heading_jumps(load(spark, sf_dir, "pages"))


@query("on_page_links")
def on_page_links(spark, sf_dir):
    return audit.on_page(load(spark, sf_dir, "pages"))


@case("image_inventory", "SELECT * FROM (VALUES ('https://x.test/1', 0, 'a.png', false, 0.0::DOUBLE), ('https://x.test/1', 1, 'b.webp', true, 1.0::DOUBLE), ('http://x.test/2', 0, 'c.jpg', true, 0.25::DOUBLE)) AS t(url, pos, src, has_alt, score)")
def image_inventory(spark, sf_dir):
    return audit.images(spark.sql(X.HTML)).select("url", "pos", "src", "has_alt", "score")


@case("accessibility")
def accessibility(spark, sf_dir):
    return audit.accessibility(spark.sql(X.HTML))


@query("broken_links", "SELECT url, status FROM (SELECT url, CAST(CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN NULL ELSE 200 END AS INTEGER) AS status FROM pages) GROUP BY ALL HAVING status IS NULL OR status >= 400")
def broken_links(spark, sf_dir):
    return audit.broken_links(load(spark, sf_dir, "pages").selectExpr("url", "case when page_id % 11 = 0 then 404 when page_id % 13 = 0 then null else 200 end as status"))


@query("overdue_tasks", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 365 AS expires, CAST(o_orderdate AS DATE) + 365 < DATE '1996-01-01' AND o_orderstatus <> 'F' AS overdue FROM orders")
def overdue_tasks(spark, sf_dir):
    tasks = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderdate as completed", "case when o_orderstatus = 'F' then 'Complete' else 'open' end as status")
    return audit.overdue(tasks, F.to_date(F.lit("1996-01-01"))).select("o_orderkey", "expires", "overdue")


@query("metric_change", "SELECT user_id AS page, period, clicks, lag(clicks) OVER (PARTITION BY user_id ORDER BY period) AS before, clicks - lag(clicks) OVER (PARTITION BY user_id ORDER BY period) AS change FROM (SELECT user_id, CAST(ts AS DATE) AS period, count(*) AS clicks FROM events GROUP BY ALL)")
def metric_change(spark, sf_dir):
    daily = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page"), F.to_date("ts").alias("period")).agg(F.count("*").alias("clicks"))
    return audit.metric_change(daily)


@case("dangling_references", "SELECT 'a.md' AS path, 'scripts/x/none.py' AS ref")
def dangling_references(spark, sf_dir):
    files = spark.createDataFrame([("a.md", "see scripts/x/one.py and scripts\\x\\none.py"), ("scripts/x/one.py", "")], "path string, content string")
    return consistency.dangling_references(files)


@case("cyclic_nodes", "SELECT * FROM (VALUES ('b'), ('c'), ('d')) AS t(node)")
def cyclic_nodes(spark, sf_dir):
    edges = spark.sql("SELECT * FROM (VALUES ('a', 'b'), ('b', 'c'), ('c', 'd'), ('d', 'b')) AS t(source, target)")
    return audit.cyclic_nodes(edges).where("node <> 'a'")


from tessella.plans import derived, more, nested, scaled, streams, tabled, timed  # noqa: E402, F401  register further queries
