"""Operators of pages, sites, schemas, colours and checks over whole tables; their small literal cases
are in the other modules. The SQL derives the same input and computes the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.ranks import positions
from tessella.operators import audit, color, consistency, jsonld, locale, pages, profile, recommend, render, robots, sitemap
from tessella.operators.profile import Report
from tessella.plans import fixtures as X
from tessella.plans.derived import _FILES, _FONTS, _LOCALES, _files, _locales, _tokens
from tessella.plans.more import _hex
from tessella.plans.registry import ORACLE_SQL, _lum, load, query
from tessella.sources import readers, sinks
from tessella.sources.staging import folder


def _view(spark, sf_dir, sql: str, *tables: str):
    """A query whose tables are those of the folder."""
    for t in tables:
        load(spark, sf_dir, t).createOrReplaceTempView(f"_tabled_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM _tabled_{t}").replace(f"JOIN {t}", f"JOIN _tabled_{t}")
    return spark.sql(sql)


# --- responses and files of every page's site

_SENT = ", ".join(f"({i}, '{h}', '{label}')" for i, (h, label) in enumerate(pages.SECURITY_HEADERS.items()))


@query("headers_of_pages", f"""WITH h AS (SELECT * FROM (VALUES {_SENT}) AS h(i, header, label)), b AS (SELECT url, i, label, (page_id >> i) % 2 = 1 AS sent FROM pages, h)
SELECT url, CASE WHEN sent THEN 'info' ELSE 'medium' END AS severity, string_agg(label, ', ' ORDER BY i) AS headers FROM b GROUP BY ALL""")  # fmt: skip
def headers_of_pages(spark, sf_dir):
    names = [F.when(F.shiftright("page_id", i) % 2 == 1, F.lit(h)) for i, h in enumerate(pages.SECURITY_HEADERS)]
    sent = F.array_compact(F.array(*names))
    return pages.header_findings(load(spark, sf_dir, "pages").select("url", F.map_from_arrays(sent, sent).alias("headers")))


_RESPONSES = "SELECT url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END AS html, CASE WHEN page_id % 2 = 0 THEN 'timeout' END AS error FROM pages"


@query("failed_pages", f"SELECT url, html IS NULL AND error IS NOT NULL AS failed FROM ({_RESPONSES})")
def failed_pages(spark, sf_dir):
    return pages.audit_status(_view(spark, sf_dir, _RESPONSES, "pages"))


_LLMS = "SELECT url AS site, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '# ' || url || chr(10) || '- a' WHEN 3 THEN url ELSE 'x' || chr(10) || '## ' || url END AS body FROM pages"


@query("llms_of_pages", f"SELECT site, coalesce(body, '') <> '' AS present, CASE WHEN body <> '' THEN starts_with(body, '#') OR contains(body, chr(10) || '#') END AS has_headings, CASE WHEN body <> '' THEN CAST(length(body) AS INTEGER) END AS length FROM ({_LLMS})")
def llms_of_pages(spark, sf_dir):
    return robots.llms_txt(_view(spark, sf_dir, _LLMS, "pages"))


_XML = f"""SELECT page_id AS id, CASE page_id % 7 WHEN 0 THEN '<?xml version="1.0"?>' || chr(10) || '<urlset xmlns="{sitemap.NAMESPACE}"><url><loc>https://x.test/' || CAST(page_id AS {{0}}) || '</loc></url><url><loc>/rel</loc></url></urlset>'
WHEN 1 THEN '<sitemapindex xmlns="{sitemap.NAMESPACE}"><!-- c --><sitemap><loc>https://x.test/a</loc></sitemap></sitemapindex>' WHEN 2 THEN '<urlset><url><loc>https://x.test/a</loc></url></urlset>' WHEN 3 THEN '<urlset><url>'
WHEN 4 THEN '<s:urlset xmlns:s="{sitemap.NAMESPACE}"><s:url><s:loc>https://x.test/a</s:loc></s:url></s:urlset>' WHEN 5 THEN '<feed xmlns="http://www.w3.org/2005/Atom"></feed>' ELSE '<sitemapindex xmlns="{sitemap.NAMESPACE}"></sitemapindex>' END AS xml FROM pages"""


@query("sitemap_faults_pages", """SELECT page_id AS id, root, n, n_relative, errors = '' AS valid, errors, warnings FROM pages JOIN (VALUES (0, 'urlset', 2, 1, 'relative_urls', ''), (1, 'sitemapindex', 1, 0, '', ''), (2, 'urlset', 0, 0, 'no_entries', 'namespace'), (3, NULL, 0, 0, 'malformed', ''), (4, 'urlset', 1, 0, '', ''), (5, 'feed', 0, 0, 'unexpected_root', 'namespace'), (6, 'sitemapindex', 0, 0, 'no_entries', '')) AS v(kind, root, n, n_relative, errors, warnings) ON page_id % 7 = kind""")
def sitemap_faults_pages(spark, sf_dir):
    return sitemap.validate(_view(spark, sf_dir, _XML.format("STRING"), "pages"))


@query("sitemap_sizes", f"""WITH u AS (SELECT url, (row_number() OVER (ORDER BY page_id) - 1) // 40 + 1 AS chunk FROM pages WHERE url LIKE 'http%'), c AS (SELECT chunk, count(*) AS n_urls, CAST(sum(octet_length(encode(replace(replace(url, '&', '&amp;'), '''', '&apos;')))) AS BIGINT) AS chars FROM u GROUP BY chunk)
SELECT chunk, n_urls, chars + n_urls * {len('  <url>') + len('    <loc></loc>') + len('  </url>') + 3} + {len(sitemap.HEAD) + len(sitemap.NAMESPACE) + len('<urlset xmlns="">') + 1 + len('</urlset>') + 1} AS bytes, bytes > 4500 AS too_large FROM c""")  # fmt: skip
def sitemap_sizes(spark, sf_dir):
    urls = load(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url")
    return sitemap.documents(urls, size=40, max_bytes=4_500).select("chunk", "n_urls", "bytes", "too_large")


# --- languages and structured data

@query("hreflang_tags_pages", f"""SELECT page, CAST(pos AS INTEGER) AS pos, '<link rel="alternate" hreflang="' || hreflang || '" href="' || href || '" />' AS tag FROM ({_LOCALES.format('VARCHAR')}, range(0, 5) t(k))""")
def hreflang_tags_pages(spark, sf_dir):
    entries = _locales(spark, sf_dir).withColumnRenamed("hreflang", "code")
    return locale.tags(entries.select("page", F.col("pos").cast("int").alias("pos"), "code", "href"))


#: Each page lists itself, one that lists it in turn, and one that doesn't or that no one knows.
_ALTERNATES = "SELECT p.url AS page, q.url AS href FROM pages p JOIN pages q ON q.page_id = p.page_id OR q.page_id = p.page_id + CASE WHEN p.page_id % 2 = 0 THEN 1 ELSE -1 END OR q.page_id = p.page_id + 3 AND p.page_id % 5 = 0 UNION ALL SELECT url, 'https://elsewhere.test/' FROM pages WHERE page_id % 7 = 0"


@query("hreflang_one_way", f"WITH a AS ({_ALTERNATES}) SELECT DISTINCT page, href FROM a WHERE href <> page AND href IN (SELECT url FROM pages) AND NOT EXISTS (SELECT 1 FROM a b WHERE b.page = a.href AND b.href = a.page)")
def hreflang_one_way(spark, sf_dir):
    one = load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page"))
    steps = F.array(F.lit(0), F.when(F.col("page_id") % 2 == 0, 1).otherwise(-1), F.when(F.col("page_id") % 5 == 0, 3).otherwise(0))
    listed = one.select("page", "page_id", F.explode(F.array_distinct(steps)).alias("step")).select("page", (F.col("page_id") + F.col("step")).alias("to")).join(one.select(F.col("page_id").alias("to"), F.col("page").alias("href")), "to").select("page", "href")
    entries = listed.union(one.where("page_id % 7 = 0").select("page", F.lit("https://elsewhere.test/")))
    return locale.not_reciprocal(entries, one.select("page", F.col("page").alias("self_url")))


@query("jsonld_generated_documents", """SELECT doc_id AS id, '{"@context":"' || CASE WHEN doc_id % 5 = 0 THEN 'https://own.test' ELSE 'https://schema.org' END || '","@type":"' || CASE WHEN doc_id % 3 = 0 THEN 'Thing' ELSE 'Article' END || '","headline":"' || coalesce(lang, '-') || '","wordCount":"' || CAST(n_chars AS VARCHAR) || '"}' AS json FROM documents""")
def jsonld_generated_documents(spark, sf_dir):
    from_docs = F.create_map(F.lit("headline"), F.coalesce("lang", F.lit("-")), F.lit("wordCount"), F.col("n_chars").cast("string"))
    own = F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("@context"), F.lit("https://own.test"))).otherwise(F.create_map().cast("map<string,string>"))
    own_type = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("@type"), F.lit("Thing"))).otherwise(F.create_map().cast("map<string,string>"))
    made = jsonld.generate(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("Article").alias("type"), F.map_concat(own, own_type, from_docs).alias("data")))
    # Members have no order: read back and written in one.
    fields = F.from_json("json", "`@context` string, `@type` string, headline string, wordCount string")
    return made.select("id", F.to_json(fields).alias("json"))


@query("jsonld_unresolved_documents", """WITH d AS (SELECT doc_id, '#d' || CAST(doc_id * 3 % 2000 AS VARCHAR) AS ref FROM documents) SELECT doc_id AS id, ref FROM d WHERE ref NOT IN (SELECT '#d' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 4 > 0) GROUP BY ALL""")
def jsonld_unresolved_documents(spark, sf_dir):
    sql = """SELECT doc_id AS id, '[' || CASE WHEN doc_id % 4 > 0 THEN '{"@id":"#d' || CAST(doc_id AS STRING) || '","name":"n"},' ELSE '' END || '{"about":{"@id":"#d' || CAST(doc_id * 3 % 2000 AS STRING) || '"}}]' AS json FROM documents"""
    return jsonld.unresolved_ids(_view(spark, sf_dir, sql, "documents"), "id")


# --- colours, effects and sections of every part

_SEEDS = "SELECT p_partkey AS id, p_brand AS industry, lower(p_type) || '-' || CAST(p_size AS {0}) AS mood, p_partkey * 7 % 360 AS hue, (30 + p_size) / CAST(100 AS DOUBLE) AS sat, (25 + p_partkey % 45) / CAST(100 AS DOUBLE) AS light FROM part"
_NINE = {"primary": ("hue", "sat", "light"), "secondary": ("(hue + 28)", "greatest(0.0, sat - 0.12)", "least(0.92, light + 0.06)"), "accent": ("(hue + 165)", "least(0.95, sat + 0.10)", "0.55::DOUBLE"), "bg": ("hue", "0.16::DOUBLE", "0.985::DOUBLE"), "surface": ("hue", "0.14::DOUBLE", "0.955::DOUBLE"), "text": ("hue", "0.22::DOUBLE", "0.16::DOUBLE"), "success": ("145", "0.55::DOUBLE", "0.40::DOUBLE"), "warning": ("38", "0.85::DOUBLE", "0.50::DOUBLE"), "error": ("2", "0.70::DOUBLE", "0.48::DOUBLE")}


def _ratio(a: str, b: str) -> str:
    return f"round((greatest({_lum(a)}, {_lum(b)}) + 0.05) / (least({_lum(a)}, {_lum(b)}) + 0.05), 2)"


_MADE = ", ".join(f'{_hex(*x)} AS "{c}"' for c, x in _NINE.items())


@query("palettes_of_parts", f"""WITH s AS ({_SEEDS.format('VARCHAR')}), c AS (SELECT *, {_MADE} FROM s), r AS (SELECT *, {_ratio('"text"', 'bg')} AS text_on_bg_contrast, {_ratio('"primary"', 'bg')} AS primary_on_bg_contrast, {_ratio("'#ffffff'", '"primary"')} AS w, {_ratio("'#111418'", '"primary"')} AS d FROM c)
SELECT id, {', '.join(f'"{c}"' for c in _NINE)}, text_on_bg_contrast, primary_on_bg_contrast, CASE WHEN w >= d THEN '#ffffff' ELSE '#111418' END AS on_primary, greatest(w, d) AS on_primary_contrast, CASE WHEN text_on_bg_contrast >= 4.5 THEN 'pass' ELSE 'fail' END AS aa_body_text, industry || '-' || mood AS name, industry || ';' || split_part(mood, '-', 1) || ';light;generated' AS tags FROM r""")  # fmt: skip
def palettes_of_parts(spark, sf_dir):
    found = color.palette(_view(spark, sf_dir, _SEEDS.format("STRING"), "part"))
    return found.drop("industry", "mood", "hue", "sat", "light")


_STYLES = [*recommend.EFFECTS, "unheard-of"]
_STYLE = "CASE p_partkey % {0} {1} END".format(len(_STYLES), " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STYLES)))


@query("effects_of_parts", f"WITH s AS (SELECT p_partkey, {_STYLE} AS style FROM part), e AS (SELECT * FROM (VALUES {', '.join(str((n, *e)) for n, e in recommend.EFFECTS.items())}) AS e(name, radius, shadow, motion)) SELECT p_partkey, coalesce(radius, '{recommend.DEFAULT_EFFECT[0]}') AS radius, coalesce(shadow, '{recommend.DEFAULT_EFFECT[1]}') AS shadow, coalesce(motion, '{recommend.DEFAULT_EFFECT[2]}') AS motion FROM s LEFT JOIN e ON style = name")
def effects_of_parts(spark, sf_dir):
    rows = _view(spark, sf_dir, f"SELECT p_partkey, {_STYLE} AS style FROM part", "part")
    return rows.select("p_partkey", F.inline(F.array(recommend.effects(F.col("style")))))


_SECTION = "CASE p_partkey % 5 WHEN 0 THEN 'faq' WHEN 1 THEN 'social-proof' WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN p_name || ' & \"co\"' ELSE 'cta' END"


@query("section_labels_parts", f"""WITH s AS (SELECT p_partkey, {_SECTION} AS s FROM part) SELECT p_partkey, CASE s WHEN 'social-proof' THEN 'Social proof' WHEN 'faq' THEN 'FAQ' WHEN 'cta' THEN 'Call to action' ELSE array_to_string(list_transform(string_split(replace(s, '-', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') END AS label,
replace(replace(replace(s, ' ', '-'), '&', '&amp;'), '"', '&quot;') AS id FROM s""")  # fmt: skip
def section_labels_parts(spark, sf_dir):
    rows = _view(spark, sf_dir, f"SELECT p_partkey, {_SECTION} AS s FROM part", "part")
    return rows.select("p_partkey", render.label(F.col("s")).alias("label"), render.section_id(F.col("s")).alias("id"))


_BUNDLE = """SELECT page_id AS id, html || CASE WHEN page_id % 2 = 0 THEN '<style>a{background:url(img/a.png)}</style>' ELSE '<style>a{background:url(data:x)}</style>' END || CASE WHEN page_id % 3 = 0 THEN '<img srcset="a.png 2x">' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<source src=a>' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '<link rel="icon" href="f.ico">' ELSE '<link rel="preload">' END AS bundle FROM pages"""


@query("unhandled_references", "SELECT page_id AS id, array_to_string(list_filter([CASE WHEN page_id % 2 = 0 THEN 'css_url' END, CASE WHEN page_id % 3 = 0 THEN 'srcset' END, CASE WHEN page_id % 5 = 0 THEN 'source' END, CASE WHEN page_id % 7 = 0 THEN 'icon' END], lambda x: x IS NOT NULL), ',') AS \"references\" FROM pages")
def unhandled_references(spark, sf_dir):
    return render.unhandled(_view(spark, sf_dir, _BUNDLE, "pages")).select("id", F.array_join("references", ",").alias("references"))


# --- files of every document

@query("unrecorded_documents", f"WITH f AS ({_FILES.format('VARCHAR')}) SELECT path FROM f WHERE path LIKE '%.py' AND path NOT IN (SELECT 'scripts/d' || CAST(doc_id AS VARCHAR) || '.py' FROM documents WHERE doc_id % 3 > 0)")
def unrecorded_documents(spark, sf_dir):
    ledger = load(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.format_string("| `scripts/d%d.py` | done, see `docs/x.md` |", "doc_id").alias("content"))
    return consistency.unrecorded(_files(spark, sf_dir), ledger)


@query("bare_lines_documents", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(no AS INTEGER) AS line_no, line FROM l WHERE regexp_matches(line, '^[A-Z][^ ]* [^ ]*$')")
def bare_lines_documents(spark, sf_dir):
    files = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return consistency.bare_lines(files, "^[A-Z][^ ]* [^ ]*$")


_REPORTS = "SELECT 'r' || CAST(o_orderkey AS {0}) AS path, 'run 1: 0/9 checks passed' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 7 AS {0}) || '/6 checks passed' ELSE 'no result' END AS content FROM orders WHERE o_orderkey % 4 > 0"


@query("passed_checks_orders", f"WITH r AS ({_REPORTS.format('VARCHAR')}), p AS (SELECT path, regexp_extract_all(content, '(\\d+/\\d+) checks passed', 1)[-1] AS last FROM r), n AS (SELECT path, CAST(split_part(last, '/', 1) AS INTEGER) AS passed, CAST(split_part(last, '/', 2) AS INTEGER) AS total FROM p) SELECT *, passed = total AS all_passed FROM n")
def passed_checks_orders(spark, sf_dir):
    return consistency.passed_checks(_view(spark, sf_dir, _REPORTS.format("STRING"), "orders"))


# --- scores, verdicts and merged findings of every host

_HOST = "split_part(url, '/', 3)"
_SCORES = f"SELECT {_HOST} AS site, CASE page_id % 6 WHEN 0 THEN 'technical' WHEN 1 THEN 'content' WHEN 2 THEN 'schema' WHEN 3 THEN 'media' WHEN 4 THEN 'ai' ELSE 'unknown' END AS specialist, CAST(CASE WHEN page_id % 9 > 0 THEN length(html) % 101 END AS DOUBLE) AS score FROM pages"


@query("health_of_hosts", f"SELECT site, round(sum(w * score) / sum(w), 2) AS score, count(*) AS specialists FROM (SELECT site, score, CASE specialist WHEN 'technical' THEN 30 WHEN 'content' THEN 30 WHEN 'schema' THEN 15 WHEN 'media' THEN 10 WHEN 'ai' THEN 15 END AS w FROM ({_SCORES})) WHERE w IS NOT NULL AND score IS NOT NULL GROUP BY site")
def health_of_hosts(spark, sf_dir):
    return audit.health_score(_view(spark, sf_dir, _SCORES, "pages"))


_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"
_BY_HOST = f"SELECT {_HOST} AS site, code, severity FROM ({ORACLE_SQL['tech_findings']})"
_NOTED = f"SELECT {_HOST} AS site, CASE WHEN page_id % 2 = 0 THEN 'title' ELSE 'speed' END AS code, CASE page_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'info' ELSE 'medium' END AS severity FROM pages"


def _findings(spark, sf_dir):
    found = pages.findings(load(spark, sf_dir, "pages"))
    return found.select(F.element_at(F.split("url", "/"), 3).alias("site"), "code", "severity")


@query("merged_findings_hosts", f"WITH b AS ({_BY_HOST} UNION ALL {_NOTED}) SELECT site, code, ['critical', 'high', 'medium', 'low', 'info'][min({_RANK})] AS severity, count(*) AS n FROM b GROUP BY site, code")
def merged_findings_hosts(spark, sf_dir):
    return audit.merged_findings(_findings(spark, sf_dir), _view(spark, sf_dir, _NOTED, "pages"))


@query("verdict_of_hosts", f"WITH b AS (SELECT site, severity FROM ({_NOTED}) WHERE code = 'speed' OR severity <> 'critical' UNION ALL SELECT site, severity FROM ({_NOTED}) WHERE severity = 'critical' AND length(site) % 2 = 0) SELECT site, CASE WHEN bool_or(severity = 'critical') THEN 'FAIL' ELSE 'PASS' END AS verdict FROM b GROUP BY site")
def verdict_of_hosts(spark, sf_dir):
    noted = _view(spark, sf_dir, _NOTED, "pages")
    return audit.qa_verdict(noted.where("code = 'speed' or severity <> 'critical' or length(site) % 2 = 0"))


@query("fix_time_pages", f"SELECT severity, count(*) AS n, round(sum(CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 2.5 WHEN 'medium' THEN 0.75 ELSE 0 END)::DOUBLE, 2) AS hours FROM ({_BY_HOST}) GROUP BY severity")
def fix_time_pages(spark, sf_dir):
    return audit.fix_time(_findings(spark, sf_dir), {"critical": 4.0, "high": 2.5, "medium": 0.75})


@query("white_space_parts", "SELECT p_name || ' ' || CAST(l_linenumber AS VARCHAR) AS dimension, CAST(max(l_quantity / 10) AS DOUBLE) AS best FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING max(l_quantity / 10) < 4.9")
def white_space_parts(spark, sf_dir):
    rows = _view(spark, sf_dir, "SELECT l_suppkey AS competitor, p_name || ' ' || CAST(l_linenumber AS STRING) AS dimension, CAST(l_quantity / 10 AS DOUBLE) AS score FROM lineitem JOIN part ON l_partkey = p_partkey", "lineitem", "part")
    return audit.white_space(rows, 4.9)


@query("overrides_customers", """WITH m AS (SELECT 'nation ' || CAST(n_nationkey AS VARCHAR) AS token, n_name AS value FROM nation), o AS (SELECT c_custkey AS page, 'nation ' || CAST(c_nationkey AS VARCHAR) AS token, c_name AS value FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey AS page, m.token, coalesce(o.value, m.value) AS value FROM customer CROSS JOIN m LEFT JOIN o ON o.page = c_custkey AND o.token = m.token""")  # fmt: skip
def overrides_customers(spark, sf_dir):
    own = _view(spark, sf_dir, "SELECT c_custkey AS page, 'nation ' || CAST(c_nationkey AS STRING) AS token, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS value FROM customer", "customer")
    return audit.page_overrides(_view(spark, sf_dir, "SELECT 'nation ' || CAST(n_nationkey AS STRING) AS token, n_name AS value FROM nation", "nation"), own)


@query("complete_documents", "SELECT doc_id, lang IS NOT NULL AND upper(source) <> 'TBD' AND coalesce(trim(note), '') <> '' AND upper(trim(coalesce(note, ''))) <> 'TBD' AS complete, array_to_string(list_filter([CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN coalesce(trim(note), '') IN ('', 'tbd') THEN 'note' END], lambda x: x IS NOT NULL), ',') AS open FROM (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN lang END AS lang, coalesce(source, 's') AS source, CASE doc_id % 4 WHEN 0 THEN ' tbd ' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'n' END AS note FROM documents)")
def complete_documents(spark, sf_dir):
    rows = _view(spark, sf_dir, "SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN lang END AS lang, coalesce(source, 's') AS source, CASE doc_id % 4 WHEN 0 THEN ' tbd ' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'n' END AS note FROM documents", "documents")
    return audit.complete(rows, "doc_id", ["lang", "source", "note"])


_IMAGES = """SELECT url, html || '<img src="p' || CAST(page_id AS {0}) || CASE WHEN page_id % 2 = 0 THEN '.webp"' ELSE '.jpg"' END || CASE WHEN page_id % 3 = 0 THEN ' alt="x"' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN ' width="1" height="2"' ELSE ' width="1"' END || CASE WHEN page_id % 7 = 0 THEN ' loading="lazy">' ELSE '>' END AS html FROM pages"""


@query("images_of_pages", """SELECT url, 'p' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '.webp' ELSE '.jpg' END AS src, page_id % 3 = 0 AS has_alt, page_id % 5 = 0 AS has_size, page_id % 7 = 0 AS lazy, page_id % 2 = 0 AS modern, (CAST(page_id % 2 = 0 AS INT) + CAST(page_id % 3 = 0 AS INT) + CAST(page_id % 5 = 0 AS INT) + CAST(page_id % 7 = 0 AS INT)) / 4.0::DOUBLE AS score FROM pages""")
def images_of_pages(spark, sf_dir):
    return audit.images(_view(spark, sf_dir, _IMAGES.format("STRING"), "pages")).drop("pos")


@query("cycles_of_documents", """WITH RECURSIVE e AS (SELECT doc_id AS s, doc_id * 7 % 611 AS t FROM documents WHERE doc_id % 97 > 0), r(a, b) AS (SELECT s, t FROM e UNION SELECT a, t FROM r JOIN e ON b = s), c AS (SELECT a FROM r WHERE a = b)
SELECT b AS node FROM r WHERE a IN (SELECT a FROM c) GROUP BY b UNION SELECT a FROM c""")  # fmt: skip
def cycles_of_documents(spark, sf_dir):
    edges = load(spark, sf_dir, "documents").where("doc_id % 97 > 0").select(F.col("doc_id").alias("source"), (F.col("doc_id") * 7 % 611).alias("target"))
    return audit.cyclic_nodes(edges)


# --- drift, sorted and escalated

_NOINDEX = "SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN replace(html, '<head>', '<head><meta name=\"robots\" content=\"NoIndex, follow\">') WHEN page_id % 4 = 1 THEN replace(html, '<head>', '<head><meta name=\"robots\" content=\"index\">') ELSE html END AS html FROM pages"


@query("robots_drift", "SELECT url, 'meta_robots' AS element, 'critical' AS severity, CAST(NULL AS VARCHAR) AS old, CASE WHEN page_id % 4 = 0 THEN 'NoIndex, follow' ELSE 'index' END AS new FROM pages WHERE page_id % 4 < 2")
def robots_drift(spark, sf_dir):
    before, after = load(spark, sf_dir, "pages"), _view(spark, sf_dir, _NOINDEX, "pages")
    keys = ("page_id", "url")
    return pages.drift(pages.snapshot(before, keys=keys), pages.snapshot(after, keys=keys), keys).select("url", "element", "severity", "old", "new")


@query("drift_in_order", f"""WITH d AS (SELECT *, CASE element WHEN 'title' THEN 0 WHEN 'h2_count' THEN 9 ELSE 10 END AS ord FROM ({ORACLE_SQL['drift_diff']})) SELECT url, element, severity, row_number() OVER (ORDER BY encode(url), {_RANK}, ord) - 1 AS position FROM d""")
def drift_in_order(spark, sf_dir):
    before = load(spark, sf_dir, "pages")
    after = _view(spark, sf_dir, "SELECT url, CASE WHEN page_id % 3 = 0 THEN replace(html, '<h2', '<h3') WHEN page_id % 3 = 1 THEN replace(html, '<title>', '<title>New ') ELSE html END AS html FROM pages", "pages")
    ordered = pages.by_severity(pages.drift(pages.snapshot(before), pages.snapshot(after)))
    return positions(ordered.withColumn("at", F.monotonically_increasing_id()), "at").select("url", "element", "severity", "position")


# --- files written, filtered and read back

@query("csv_filtered_export", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def csv_filtered_export(spark, sf_dir):
    whole, part = folder(spark, "csv"), folder(spark, "part")
    sinks.write_csv(load(spark, sf_dir, "customer"), whole)
    report = Report(filters=["c_mktsegment=BUILDING"], select="c_custkey,c_name")
    rows, _, _ = readers.read_csv(spark, whole)
    sinks.write_csv(profile.apply_select(profile.apply_filters(rows, report), report), part)
    return readers.read_csv(spark, part)[0].select("c_custkey", "c_name")


@query("csv_repeated_headers", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS name, 'name' AS repeated FROM customer")
def csv_repeated_headers(spark, sf_dir):
    path = folder(spark, "csv")
    lines = load(spark, sf_dir, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("value"))
    header = spark.createDataFrame([("id,name,name",)], "value string")
    header.union(lines).coalesce(1).write.text(path)  # a file has its header first
    rows, names, _ = readers.read_csv(spark, path)
    return rows.select("id", "name", F.lit(",".join(profile.duplicate_headers(names))).alias("repeated"))


# --- keywords, listings and designs

_KEYWORDS = "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Buy ' WHEN 1 THEN 'best ' WHEN 2 THEN 'sign in ' WHEN 3 THEN 'reviews ' WHEN 4 THEN 'official price ' ELSE '' END || substr(text, 1, 30) AS keyword FROM documents"


@query("intents_documents", rf"""SELECT doc_id, CASE WHEN regexp_matches(keyword, '(?i)\b(buy|price|order|cheap|coupon|deal)\b') THEN 'transactional' WHEN regexp_matches(keyword, '(?i)\b(best|top|review|vs|compare)\b') THEN 'commercial' WHEN regexp_matches(keyword, '(?i)\b(login|sign in|website|official)\b') THEN 'navigational' ELSE 'informational' END AS intent FROM ({_KEYWORDS})""")
def intents_documents(spark, sf_dir):
    return audit.intents(_view(spark, sf_dir, _KEYWORDS, "documents")).select("doc_id", "intent")


_PAIRS = "SELECT 'k' || CAST(doc_id AS {0}) AS a, 'k' || CAST(doc_id + 1 + doc_id % 13 AS {0}) AS b FROM documents WHERE doc_id % 3 = 0"


@query("keyword_groups_documents", f"WITH RECURSIVE p AS ({_PAIRS.format('VARCHAR')}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS keyword, min(least(a, b)) AS cluster FROM r GROUP BY a")
def keyword_groups_documents(spark, sf_dir):
    return audit.cluster_ids(_view(spark, sf_dir, _PAIRS.format("STRING"), "documents"))


@query("nap_mismatches_customers", r"""WITH l AS (SELECT c_custkey % 400 AS business, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE 'shop-co' END AS name, CASE c_custkey % 5 WHEN 0 THEN '123' WHEN 1 THEN '123' WHEN 2 THEN '9' END AS phone FROM customer)
SELECT business, count(DISTINCT name) AS names, 1::BIGINT AS addresses, count(DISTINCT phone) AS phones FROM l GROUP BY business HAVING count(DISTINCT name) > 1 OR count(DISTINCT phone) > 1""")  # fmt: skip
def nap_mismatches_customers(spark, sf_dir):
    sql = "SELECT c_custkey % 400 AS business, CASE c_custkey % 3 WHEN 0 THEN 'Other' WHEN 1 THEN 'Shop & Co.' ELSE 'shop co' END AS name, '1 Main St.' AS address, CASE c_custkey % 5 WHEN 0 THEN '+1 (2) 3' WHEN 1 THEN '123' WHEN 2 THEN '9' END AS phone FROM customer"
    return audit.nap_mismatches(_view(spark, sf_dir, sql, "customer"))


_WISHES = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Shop' WHEN 1 THEN 'journal' WHEN 2 THEN c_mktsegment WHEN 3 THEN '' END AS product_type, CASE c_custkey % 4 WHEN 0 THEN 'retail' WHEN 1 THEN 'Media' WHEN 2 THEN 'zzz' END AS industry,
CASE c_custkey % 11 WHEN 0 THEN 'soft glass, big' WHEN 1 THEN 'vivid sales' WHEN 2 THEN 'quiet paper print' WHEN 3 THEN 'reading' WHEN 4 THEN 'soft modern' WHEN 5 THEN 'Apps hero' ELSE c_name END AS keywords FROM customer"""
_SPLIT = "list_filter(list_transform(regexp_split_to_array(coalesce({0}, ''), '[;,]'), lambda t: trim(t)), lambda t: t <> '')"


def _scored(name: str, q: str, words: str, extra: str = "") -> str:
    """CTE with the row of a library of largest overlap for each request, the earlier one on ties."""
    return f"{name} AS (SELECT * FROM (SELECT w.id, l.*, len(list_intersect({q}, {words})) {extra} AS score FROM w, {name}_lib l) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, row_idx) = 1)"


@query("designs_of_customers", f"""WITH product_lib AS ({X.PRODUCTS}), style_lib AS ({X.STYLES}), palette_lib AS ({X.PALETTES}), w AS ({_WISHES}),
{_scored('product', _tokens('w.product_type', 'w.industry', 'w.keywords'), _tokens('l.product_type', 'l.industry', 'l.notes', 'l.key_sections', 'l.recommended_style'))},
p AS (SELECT w.id, w.product_type, w.industry, w.keywords, e.row_idx IS NOT NULL OR s.score > 0 AS product_matched, coalesce(e.row_idx, CASE WHEN s.score > 0 THEN s.row_idx END, 0) AS pid FROM w LEFT JOIN product_lib e ON lower(e.product_type) = lower(coalesce(w.product_type, '')) JOIN product s ON s.id = w.id),
q AS (SELECT p.*, l.recommended_pattern, l.recommended_style, l.palette_mood, l.typography_mood, l.key_sections, l.anti_patterns FROM p JOIN product_lib l ON l.row_idx = pid),
named AS (SELECT q.id, l.row_idx, l.style FROM q, style_lib l WHERE len(list_intersect({_tokens('l.style')}, {_tokens('q.keywords')})) = len({_tokens('l.style')}) AND lower(l.style) <> lower(q.recommended_style) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY len({_tokens('l.style')}) DESC, l.row_idx) = 1),
loose AS (SELECT * FROM (SELECT q.id, l.row_idx, len(list_intersect({_tokens('q.keywords', 'q.palette_mood', 'q.typography_mood', 'q.recommended_style')}, {_tokens('l.style', 'l.mood_tags', 'l.characteristics', 'l.best_for', 'l.summary')})) - CASE WHEN len(list_intersect({_tokens('q.keywords', 'q.palette_mood', 'q.typography_mood', 'q.recommended_style')}, {_tokens('l.avoid_for')})) > 0 THEN 2 ELSE 0 END AS score FROM q, style_lib l) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, row_idx) = 1),
s AS (SELECT q.*, d.row_idx IS NOT NULL OR o.score > 0 AS style_matched, CASE WHEN d.row_idx IS NOT NULL THEN n.style END AS style_override, coalesce(CASE WHEN d.row_idx IS NOT NULL THEN n.row_idx END, d.row_idx, CASE WHEN o.score > 0 THEN o.row_idx END, 0) AS sid FROM q LEFT JOIN style_lib d ON lower(d.style) = lower(q.recommended_style) LEFT JOIN named n ON n.id = q.id JOIN loose o ON o.id = q.id),
c AS (SELECT * FROM (SELECT s.id, l.name, len(list_intersect({_tokens('s.industry', 's.palette_mood', 's.keywords')}, {_tokens('l.industry', 'l.mood', 'l.tags', 'l.name')})) AS hits, hits + CASE WHEN l.aa_body_text = 'pass' THEN 1 ELSE 0 END AS score, l.row_idx FROM s, palette_lib l) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, row_idx) = 1)
SELECT s.id, s.recommended_pattern AS pattern, l.style, style_override, c.name AS palette, array_to_string({_SPLIT.format('s.key_sections')}, '|') AS sections,
array_to_string(list_concat({_SPLIT.format('s.anti_patterns')}, list_filter({_SPLIT.format('l.avoid_for')}, lambda t: NOT list_contains({_SPLIT.format('s.anti_patterns')}, t))), '|') AS anti_patterns,
array_to_string(list_filter(['no_fonts_library', 'no_rules_library', CASE WHEN NOT product_matched THEN 'product_not_matched' END, CASE WHEN NOT style_matched THEN 'style_not_matched' END, CASE WHEN c.hits = 0 THEN 'palette_not_matched' END, 'style_overridden_by_' || style_override], lambda t: t IS NOT NULL), '|') AS fallbacks
FROM s JOIN style_lib l ON l.row_idx = sid JOIN c ON c.id = s.id""")  # fmt: skip
def designs_of_customers(spark, sf_dir):
    made = recommend.compose(_view(spark, sf_dir, _WISHES, "customer"), spark.sql(X.PRODUCTS), spark.sql(X.STYLES), spark.sql(X.PALETTES))
    lists = [F.array_join(c, "|").alias(name) for c, name in (("key_sections", "sections"), ("anti_patterns", "anti_patterns"), ("fallbacks", "fallbacks"))]
    return made.select("id", "pattern", F.col("style.style").alias("style"), "style_override", F.col("palette.name").alias("palette"), *lists)


@query("rendered_customers")
def rendered_customers(spark, sf_dir):
    """A page for each customer's design, of our own template; no SQL, its parts are queried above."""
    colours = spark.sql(X.PALETTES).withColumns({c: F.lit(None).cast("string") for c in render.DEFAULT_COLOURS if c != "name"})
    made = recommend.compose(_view(spark, sf_dir, _WISHES, "customer"), spark.sql(X.PRODUCTS), spark.sql(X.STYLES), colours, spark.sql(_FONTS).selectExpr("*", "name as heading_font", "best_for as body_font"))
    return render.pages(made).select("id", "page")
