"""Queries over the elements of whole pages, to which links, forms and cards were added that vary by page."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import markup
from tessella.plans.registry import load, query

_ADDED = """SELECT url, page_id, replace(replace(html, '</article>',
 '<aside><p>see <a href="/s"><b>this</b></a><a href="/e"> </a></aside><a name="x">no link</a>' || CASE WHEN page_id % 2 = 0 THEN '<a href="/r">more<br>text</a>' ELSE '' END
 || '<form><label>Name <input name="in"></label><label for="x' || CAST(page_id % 3 AS {0}) || '">X</label><input id="x0" name="x0"><select id="x1" name="x1"></select><textarea name="t"' || CASE WHEN page_id % 5 = 0 THEN ' title="T"' ELSE '' END || '></textarea><input type="hidden" name="h"></form></article>'),
 '</head>', '<!-- <meta name="twitter:card" content="old"> --><meta name="twitter:card" content="' || CASE WHEN page_id % 2 = 0 THEN 'summary' ELSE 'summary_large_image' END || '">' || CASE WHEN page_id % 3 = 0 THEN '<meta content="og &amp; more" property="og:title">' ELSE '' END
 || CASE WHEN page_id % 4 = 0 THEN '<meta name="twitter:title" content="' || CAST(page_id AS {0}) || '">' ELSE '' END || '</head>') AS html FROM pages"""


def _elements(spark, sf_dir):
    load(spark, sf_dir, "pages").createOrReplaceTempView("_added_pages")
    rows = spark.sql(_ADDED.format("STRING").replace("FROM pages", "FROM _added_pages"))
    return markup.elements(rows.select(F.struct("page_id", "url").alias("page"), "html"), "page")  # URLs may repeat


@query("links_by_region", """WITH n AS (SELECT url, page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*</nav>'), '<a href')) AS n, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*</nav>'), '<a href="[^"]*">\\s*</a>')) AS e FROM pages)
SELECT url, 'nav' AS region, n AS links, e AS empty FROM n WHERE n > 0 UNION ALL SELECT url, 'aside', 2, 1 FROM n UNION ALL SELECT url, 'article', 1, 0 FROM n WHERE page_id % 2 = 0""")  # fmt: skip
def links_by_region(spark, sf_dir):
    return markup.links_by_region(_elements(spark, sf_dir), "page").select("page.url", "region", "links", "empty")


@query("unlabelled_controls", """SELECT url, 'input' AS tag, 'x0' AS name FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT url, 'select', 'x1' FROM pages WHERE page_id % 3 <> 1 UNION ALL SELECT url, 'textarea', 't' FROM pages WHERE page_id % 5 <> 0""")
def unlabelled_controls(spark, sf_dir):
    return markup.unlabelled(_elements(spark, sf_dir), "page").select("page.url", "tag", "name")


@query("social_cards", """WITH c AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN 'summary' ELSE 'summary_large_image' END AS card, CASE WHEN page_id % 4 = 0 THEN CAST(page_id AS VARCHAR) WHEN page_id % 3 = 0 THEN 'og & more' END AS title FROM pages)
SELECT url, card, title, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS image, CASE WHEN title IS NULL THEN 'title,' ELSE '' END || 'description,image' AS missing FROM c""")  # fmt: skip
def social_cards(spark, sf_dir):
    return markup.social_cards(_elements(spark, sf_dir), "page").select("page.url", "card", "title", "description", "image", "missing")


@query("paragraphs_by_path", "SELECT split_part(url, '/', 3) AS host, sum(len(regexp_extract_all(html, '<p[ >]')))::BIGINT AS paragraphs, sum(len(regexp_extract_all(html, '<li[ >]')))::BIGINT AS items FROM pages GROUP BY 1")
def paragraphs_by_path(spark, sf_dir):
    found = markup.elements(load(spark, sf_dir, "pages"))
    host = F.element_at(F.split("url", "/"), 3).alias("host")
    return found.groupBy(host).agg(F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("path").endswith("/nav/ul/") & (F.col("tag") == "li")).alias("items"))
