"""Column helpers over text and HTML. All stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def first_match(c: str | Column, pattern: str) -> Column:
    """Group 1 of the first match, stripped; null where nothing matches (not '')."""
    return F.when(F.regexp_like(col(c), F.lit(f"(?is){pattern}")), strip(F.regexp_extract(col(c), f"(?is){pattern}", 1)))


def count_matches(c: str | Column, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(f"(?i){pattern}")).cast("long")


def has(c: str | Column, pattern: str) -> Column:
    return F.regexp_like(col(c), F.lit(pattern))


def without_scripts(html: str | Column) -> Column:
    return F.regexp_replace(col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")


def without_tags(html: str | Column) -> Column:
    return F.regexp_replace(col(html), r"(?s)<[^>]+>", " ")


def words(c: str | Column) -> Column:
    """White-space separated words (Unicode white space), as an array."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def n_words(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit(r"(?U)\S+")).cast("long")


def tokens(*cs: str | Column) -> Column:
    """Distinct lower-cased runs of a-z and 0-9 over all columns; null counts as empty."""
    joined = F.concat_ws(" ", *[col(c) for c in cs])
    return F.array_distinct(F.filter(F.split(F.lower(joined), "[^a-z0-9]+"), lambda t: t != ""))


def listed(*cs: str | Column) -> Column:
    """Items of ;- or ,-separated cells, trimmed, in order, without blanks and repeats."""
    parts = [F.split(F.coalesce(col(c), F.lit("")), "[;,]") for c in cs]
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), strip), lambda t: t != ""))


def to_number(c: str | Column) -> Column:
    """A double, or null. Commas count only as thousands separators (1,234.5 but not 1,5);
    Java's type suffixes (1d, 1f) don't count, digits may be grouped by underscores."""
    s = strip(c)
    s = F.when(F.regexp_like(s, F.lit(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    s = F.regexp_replace(s, r"(?<=\d)_(?=\d)", "")
    return F.when(~F.regexp_like(s, F.lit(r"(?i)[\d.][df]$")), s.try_cast("double"))


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def xml_escaped(c: str | Column) -> Column:
    out = col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def absolute(url: str | Column) -> Column:
    """Whether a URL's scheme is http or https, in any case."""
    return F.coalesce(F.regexp_like(col(url), F.lit(r"(?i)^\s*https?:")), F.lit(False))
