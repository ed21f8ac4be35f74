"""Quotable passages: split a page or text, score each passage, sum up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import col, count_matches, has, n_words, strip, without_scripts, without_tags

# What makes a passage specific, and openings that lean on what stood before.
SPECIFIC = r"(?U)(\d{4}|\d+%|\$\d|\d+\.\d+|\b\d{2,}\b|\bper cent\b|\bpercent\b)"
DEPENDENT = r"(?iU)^\s*(this|that|these|those|it|they|he|she|here|however|therefore|thus|also|additionally|furthermore)\b"
SHORTEST, LONGEST, PREVIEW, WEAK = 40, 120, 80, 10


def plain_text(html: str | Column) -> Column:
    """Text of HTML, block ends as blank lines; what holds no '<' stays as it is."""
    blocks = F.regexp_replace(without_scripts(html), r"(?i)</(p|div|li|h[1-6]|section|article)>", "\n\n")
    return F.when(col(html).contains("<"), F.replace(without_tags(blocks), F.lit("&nbsp;"), F.lit(" "))).otherwise(col(html))


def ld_blocks(html: str | Column) -> Column:
    return F.when(col(html).contains("<"), count_matches(html, r"application/ld\+json")).otherwise(F.lit(0))


def _split(text: str | Column) -> Column:
    """Array of (pos, passage): stretches between blank lines, stripped, of over 40 characters."""
    parts = F.transform(F.split(plain_text(text), r"(?U)\n\s*\n"), lambda raw, i: F.struct(i.alias("pos"), strip(raw).alias("passage")))
    return F.filter(parts, lambda p: F.length(p["passage"]) > SHORTEST)


def _words(p: Column) -> Column:
    return n_words(p).alias("words")


def passages(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, passage): stretches between blank lines, stripped, of over 40 characters."""
    return pages.select(key, F.inline(_split(text)))


def scored(pages: DataFrame, key: str, text: str) -> DataFrame:
    """passages with words, sentences, specific, standalone, citable, issues and preview.

    Citable: specific, understood alone, and at most 120 words; no least length.
    """
    rows = passages(pages, key, text).withColumns({
        "words": n_words("passage"),
        "sentences": F.greatest(F.lit(1), F.regexp_count("passage", F.lit("[.!?]+"))).cast("long"),
        "specific": has("passage", SPECIFIC),
        "standalone": ~has("passage", DEPENDENT),
    })
    issues = F.array_compact(F.array(F.when(~F.col("specific"), F.lit("not_specific")), F.when(~F.col("standalone"), F.lit("leans_on_context")), F.when(F.col("words") > LONGEST, F.lit("too_long"))))
    return rows.withColumns({"citable": F.col("specific") & F.col("standalone") & (F.col("words") <= LONGEST), "issues": issues, "preview": F.substring("passage", 1, PREVIEW)})


def page_score(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, passages, citable, words, citable_pct), a row for each page: percent rounded half to
    even, 0 without passages. A page is scored within its own row; nothing is shuffled."""
    per = F.transform(_split(text), lambda p: F.struct(_words(p["passage"]), (has(p["passage"], SPECIFIC) & ~has(p["passage"], DEPENDENT)).alias("sound")))
    rows = pages.select(key, F.coalesce(per, F.array().cast("array<struct<words:bigint,sound:boolean>>")).alias("found"))
    citable = F.size(F.filter("found", lambda p: p["sound"] & (p["words"] <= LONGEST))).cast("long")
    rows = rows.select(key, F.size("found").cast("long").alias("passages"), citable.alias("citable"), F.aggregate("found", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("words"))
    percent = F.when(F.col("passages") > 0, F.bround(100.0 * F.col("citable") / F.col("passages"), 0)).otherwise(0.0)
    return rows.select(key, "passages", "citable", "words", percent.cast("long").alias("citable_pct"))


def weak(pages: DataFrame, key: str, text: str, k: int = WEAK) -> DataFrame:
    """(key, rank, preview, words, sentences, issues): the first k passages of each page, in its
    order, that are not citable. Within the page's own row; nothing is shuffled."""

    def judged(p: Column) -> Column:
        passage = p["passage"]
        return F.struct(passage.alias("passage"), _words(passage), (~has(passage, SPECIFIC)).alias("vague"), has(passage, DEPENDENT).alias("leaning"))

    rows = pages.select(key, F.transform(_split(text), judged).alias("found"))
    bad = F.filter("found", lambda p: p["vague"] | p["leaning"] | (p["words"] > LONGEST))
    rows = rows.select(key, F.posexplode(F.slice(bad, 1, k)).alias("pos", "p"))
    issues = F.concat_ws(",", F.when(F.col("p.vague"), F.lit("not_specific")), F.when(F.col("p.leaning"), F.lit("leans_on_context")), F.when(F.col("p.words") > LONGEST, F.lit("too_long")))
    sentences = F.greatest(F.lit(1), F.regexp_count("p.passage", F.lit("[.!?]+"))).cast("long")
    return rows.select(key, (F.col("pos") + 1).alias("rank"), F.substring("p.passage", 1, PREVIEW).alias("preview"), F.col("p.words").alias("words"), sentences.alias("sentences"), issues.alias("issues"))
