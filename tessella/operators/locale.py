"""Language annotations: validity of codes, checks of a page's set, tags, reciprocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the language codes that count as valid.
LANGUAGES = [
    "aa", "ab", "af", "am", "ar", "as", "az", "be", "bg", "bn", "bs", "ca", "cs", "cy", "da", "de",
    "el", "en", "es", "et", "eu", "fa", "fi", "fr", "ga", "gl", "gu", "he", "hi", "hr", "hu", "hy",
    "id", "is", "it", "ja", "ka", "kk", "km", "kn", "ko", "lt", "lv", "mk", "ml", "mr", "ms", "mt",
    "nb", "ne", "nl", "no", "pa", "pl", "ps", "pt", "ro", "ru", "sk", "sl", "sq", "sr", "sv", "sw",
    "ta", "te", "th", "tl", "tr", "uk", "ur", "vi", "zh",
]


def code_fault(code: str | Column) -> Column:
    """Why a code is invalid (language, region, segments), or null if it is valid."""
    c = F.col(code) if isinstance(code, str) else code
    parts = F.split(c, "-", -1)
    known = F.array_contains(F.array(*map(F.lit, LANGUAGES)), F.lower(F.get(parts, F.lit(0))))
    return F.when(c == "x-default", F.lit(None).cast("string")).when(~known, "language").when((F.size(parts) == 2) & ~F.regexp_like(F.upper(F.get(parts, F.lit(1))), F.lit("^[A-Z]{2}$")), "region").when(F.size(parts) > 2, "segments")


def entry_faults(entries: DataFrame) -> DataFrame:
    """(page, pos, code, fault) from entries (page, pos, hreflang, href): bad code, href that is
    not absolute (an empty one passes), and each repeat of a code, in any case. Where entries share
    a pos, the later spelling in code-point order is the repeat."""
    e = entries.withColumns({"hreflang": F.coalesce("hreflang", F.lit("")), "href": F.coalesce("href", F.lit(""))})
    nth = F.row_number().over(Window.partitionBy("page", F.lower("hreflang")).orderBy("pos", "hreflang"))
    faults = F.array_compact(F.array(
        F.concat(F.lit("bad_"), code_fault("hreflang")),
        F.when((F.col("href") != "") & ~F.regexp_like("href", F.lit("^https?://")), F.lit("relative_href")),
        F.when(F.col("nth") > 1, F.lit("duplicate")),
    ))
    return e.withColumn("nth", nth).select("page", "pos", F.col("hreflang").alias("code"), F.explode(faults).alias("fault"))


def validate(entries: DataFrame, selves: DataFrame | None = None) -> DataFrame:
    """(page, n, errors, valid, has_x_default, has_self); selves (page, self_url) is optional.

    A page is valid without errors; lacking its own URL is an error where it is known.
    Reciprocity is a check of its own, over all pages.
    """
    per = entries.groupBy("page").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("hreflang") == "x-default"), F.lit(False)).alias("has_x_default"))
    faults = entry_faults(entries).groupBy("page").agg(F.count("*").alias("faults"))
    out = per.join(faults, "page", "left")
    own = F.lit(None).cast("boolean")
    if selves is not None:
        listed = entries.join(selves, "page").where("href = self_url").select("page").distinct().withColumn("listed", F.lit(True))
        out = out.join(selves.select("page", F.lit(True).alias("asked")), "page", "left").join(listed, "page", "left")
        own = F.when(F.col("asked"), F.coalesce("listed", F.lit(False)))
    out = out.withColumn("has_self", own).withColumn("errors", F.coalesce("faults", F.lit(0)) + F.when(~F.col("has_self"), 1).otherwise(0))
    return out.select("page", "n", "errors", (F.col("errors") == 0).alias("valid"), "has_x_default", "has_self")


def tags(locales: DataFrame) -> DataFrame:
    """(page, pos, tag) from (page, pos, code, href); bad codes give a tag too, nothing is escaped."""
    return locales.select("page", "pos", F.format_string('<link rel="alternate" hreflang="%s" href="%s" />', "code", "href").alias("tag"))


def not_reciprocal(entries: DataFrame, selves: DataFrame) -> DataFrame:
    """(page, href) of alternates that are known pages and don't list this page's URL in turn."""
    links = entries.join(selves, "page").select("page", "self_url", "href").where("href <> self_url").distinct()
    known = links.join(selves.select(F.col("self_url").alias("href")).distinct(), "href", "left_semi")
    back = links.select(F.col("self_url").alias("_from"), F.col("href").alias("_to"))
    return known.join(back, (F.col("href") == F.col("_from")) & (F.col("self_url") == F.col("_to")), "left_anti").select("page", "href")
