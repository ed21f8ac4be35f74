"""Sitemaps: filter URLs, cut into files, render and validate XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ranks import positions
from tessella.functions.text import absolute, xml_escaped

# URLs and bytes a file may hold, and the namespace of the format.
MAX_URLS, MAX_BYTES = 50_000, 50 * 1024 * 1024
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
#: URLs that a task counts out of runs, about.
RUN_URLS = 4_000_000
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def kept_urls(urls: DataFrame) -> DataFrame:
    """http and https URLs, repeats included."""
    return urls.where(absolute("url"))


def rejected(urls: DataFrame, order: str = "idx") -> DataFrame:
    """(n_bad, first_bad) of the others."""
    return urls.where(~absolute("url")).agg(F.count("*").alias("n_bad"), F.min_by("url", order).alias("first_bad"))


def chunked(urls: DataFrame, order: str = "idx", size: int = MAX_URLS) -> DataFrame:
    """urls with position (from 0, in `order`) and chunk (from 1); every row once.

    Ranks are counted per range of the order (see positions); no task sees all URLs.
    """
    return positions(urls, order).withColumn("chunk", F.floor(F.col("position") / size) + 1)


def chunked_runs(pages: DataFrame, order: str, n: int, size: int = MAX_URLS) -> DataFrame:
    """pages with k (0 to n - 1), position and chunk of n URLs each, which in the order of all follow one
    another from page to page.

    Only pages are ranked, dealt out and stored; their URLs are counted out where they lie, and no
    URL is shuffled. Pages of equal order take turns, URL by URL. No n gives no URLs.
    """
    ranked = positions(pages, order)
    alike = ranked.groupBy(F.col(order).alias("_of")).agg(F.min("position").alias("_first"), F.count("*").alias("_copies"))
    tasks = ranked.count() * n // RUN_URLS + 1
    placed = ranked.join(alike, F.col(order).eqNullSafe(F.col("_of"))).repartition(tasks)  # a few pages are many URLs
    urls = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")))
    position = F.col("_first") * n + F.col("k") * F.col("_copies") + F.col("position") - F.col("_first")
    return urls.withColumn("position", position).withColumn("chunk", F.floor(F.col("position") / size) + 1).drop("_of", "_first", "_copies")


def entry(tag: str, url: str | Column, lastmod: str | None = None) -> Column:
    stamp = F.lit(f"    <lastmod>{lastmod}</lastmod>\n" if lastmod else "")
    return F.concat(F.lit(f"  <{tag}>\n    <loc>"), xml_escaped(url), F.lit("</loc>\n"), stamp, F.lit(f"  </{tag}>\n"))


def documents(urls: DataFrame, order: str = "idx", size: int = MAX_URLS, lastmod: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(chunk, n_urls, bytes, too_large, xml): a file for each chunk of at most `size` URLs; too_large above max_bytes."""
    rows = chunked(kept_urls(urls), order, size).withColumn("line", entry("url", "url", lastmod))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "")
    files = rows.groupBy("chunk").agg(F.count("*").alias("n_urls"), body.alias("body"))
    xml = F.concat(F.lit(f'{HEAD}<urlset xmlns="{NAMESPACE}">\n'), "body", F.lit("</urlset>\n"))
    return files.select("chunk", "n_urls", xml.alias("xml")).withColumn("bytes", F.octet_length("xml").cast("long")).withColumn("too_large", F.col("bytes") > max_bytes)


def index(files: DataFrame, stem: str, extension: str = ".xml", base_url: str = "", lastmod: str | None = None) -> DataFrame:
    """(xml, complete): the index of files (chunk); complete says whether its entries are absolute."""
    base = base_url.rstrip("/") + "/" if base_url else ""
    name = F.concat(F.lit(base + stem + "-"), F.col("chunk").cast("string"), F.lit(extension))
    lines = files.select("chunk", entry("sitemap", name, lastmod).alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "line"))), lambda s: s["line"]), "")
    return lines.agg(F.concat(F.lit(f'{HEAD}<sitemapindex xmlns="{NAMESPACE}">\n'), body, F.lit("</sitemapindex>\n")).alias("xml")).withColumn("complete", F.lit(bool(base_url)))


def validate(files: DataFrame, key: str = "id", xml: str = "xml", max_urls: int = MAX_URLS) -> DataFrame:
    """(key, root, n, n_relative, valid, errors, warnings).

    n counts loc elements; in a urlset those of the 0.9 namespace only. Errors:
    malformed, unexpected_root, too_many, relative_urls, no_entries. Warnings: namespace, too_large.
    """
    text = F.regexp_replace(xml, r"(?s)^\s*<\?xml[^>]*\?>|<!--.*?-->", "")
    opening = F.regexp_extract(text, r"(?s)^\s*<([^\s/>]+)([^>]*)>", 1)
    root = F.regexp_extract(opening, r"([^:]*)$", 1)
    space = F.regexp_extract(text, r"""(?s)^\s*<[^>]*\bxmlns(?::[\w.-]+)?\s*=\s*["']([^"']*)["']""", 1)
    good = F.coalesce(F.expr(f"try_cast(xpath_boolean(if({_closed(xml)}, {xml}, '<x/>'), '/*[local-name() != \"x\"]') as boolean)"), F.lit(False))
    locs = F.expr(f"xpath(if({_closed(xml)}, {xml}, '<x/>'), '//*[local-name()=\"loc\"]/text()')")
    found = F.when(space == NAMESPACE, locs).otherwise(F.array().cast("array<string>"))
    rows = files.select(key, F.when(good, root).alias("root"), found.alias("locs"), space.alias("space"), F.octet_length(xml).alias("bytes"))
    relative = F.size(F.filter("locs", lambda u: ~absolute(u)))
    is_set, is_index = F.col("root") == "urlset", F.col("root") == "sitemapindex"
    errors = F.array_compact(F.array(
        F.when(F.col("root").isNull(), F.lit("malformed")),
        F.when(~is_set & ~is_index, F.lit("unexpected_root")),
        F.when(is_set & (F.size("locs") > max_urls), F.lit("too_many")),
        F.when(is_set & (relative > 0), F.lit("relative_urls")),
        F.when((is_set | is_index) & (F.size("locs") == 0), F.lit("no_entries")),
    ))
    warnings = F.array_compact(F.array(F.when(F.col("root").isNotNull() & (F.col("space") != NAMESPACE), F.lit("namespace")), F.when(F.col("bytes") > MAX_BYTES, F.lit("too_large"))))
    return rows.select(key, "root", F.size("locs").alias("n"), F.when(is_set, relative).otherwise(0).alias("n_relative"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"))


def _closed(xml: str) -> str:
    """SQL: whether opening and closing tags are as many, the test before Spark's XML functions, which fail on the rest."""
    clean = f"regexp_replace({xml}, '(?s)<[?].*?[?]>|<!--.*?-->', '')"
    opened = f"regexp_count({clean}, '<[A-Za-z][^<>]*[^/<>]>|<[A-Za-z]>')"
    return f"({xml} is not null and {opened} > 0 and {opened} = regexp_count({clean}, '</[A-Za-z][^<>]*>') and not {clean} rlike '&(?!(amp|lt|gt|quot|apos|#[0-9]+);)' and regexp_count({clean}, '<') = regexp_count({clean}, '>'))"
