"""Structured data (JSON-LD): validation against a table of types, generation, id references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each type, the properties it must and should have.
SPEC = {
    "Organization": (["name", "url"], ["logo", "sameAs", "contactPoint"]),
    "LocalBusiness": (["name", "address"], ["telephone", "geo", "openingHoursSpecification", "priceRange", "image", "url"]),
    "Article": (["headline", "author", "datePublished"], ["image", "dateModified", "publisher"]),
    "Product": (["name", "image"], ["description", "brand", "offers", "aggregateRating", "review", "sku", "gtin"]),
    "BreadcrumbList": (["itemListElement"], []),
    "FAQPage": (["mainEntity"], []),
    "Event": (["name", "startDate", "location"], ["endDate", "offers", "performer", "image", "eventStatus"]),
    "Person": (["name"], ["url", "image", "sameAs", "jobTitle"]),
    "WebSite": (["name", "url"], ["potentialAction"]),
    "Review": (["itemReviewed", "reviewRating", "author"], ["datePublished", "publisher"]),
    "VideoObject": (["name", "description", "thumbnailUrl", "uploadDate"], ["duration", "contentUrl", "embedUrl"]),
}
# Types that come with a note, and those whose rich results are deprecated.
NOTED = ("Article", "Product", "BreadcrumbList", "WebSite")
DEPRECATED = ("FAQPage",)
CONTEXT = "https://schema.org"


def spec_table(spark: SparkSession) -> DataFrame:
    """(type, property, kind) of every required and recommended property."""
    rows = [(t, p, k) for t, both in SPEC.items() for k, names in zip(("required", "recommended"), both, strict=True) for p in names]
    return spark.createDataFrame(rows, "type string, property string, kind string")


def _spec_map(kind: int) -> Column:
    return F.create_map(*[x for t, both in SPEC.items() for x in (F.lit(t), F.array(*map(F.lit, both[kind])) if both[kind] else F.array().cast("array<string>"))])


def blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """(url, pos, json) of the JSON-LD scripts in pages."""
    pattern = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
    return pages.select("url", F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "json"))


def parsed(objects: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, v, fields, type), a row per object of a cell, which holds one or a list of them;
    text that isn't JSON gives a row without v. A list of types stands for its first."""
    v = F.try_parse_json(json)
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    rows = objects.select(key, F.posexplode_outer(listed).alias("pos", "v")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    rows = rows.withColumn("fields", F.try_variant_get("v", "$", "map<string,string>"))
    kind = F.coalesce(F.try_variant_get("v", '$["@type"][0]', "string"), F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get("v", '$["@type"]', "variant")).startswith("ARRAY"), F.lit(False)), F.try_variant_get("v", '$["@type"]', "string")))
    return rows.withColumn("type", kind)


def validate(objects: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """(key, pos, type, missing_required, missing_recommended, warnings, ok), a row per object.

    A cell holds one object or a list of them; text that isn't JSON gives one row with
    the warning invalid_json. A required property counts as missing if absent, null,
    '', [] or {}; 0 and false are values. A recommended one only if absent. A list of
    types stands for its first. Types without a spec only get a warning.
    """
    rows = parsed(objects, key, json)
    value = lambda p: F.try_element_at("fields", p)
    known = F.array_contains(F.array(*map(F.lit, SPEC)), F.col("type"))
    required = F.coalesce(F.try_element_at(_spec_map(0), F.col("type")), F.array().cast("array<string>"))
    recommended = F.coalesce(F.try_element_at(_spec_map(1), F.col("type")), F.array().cast("array<string>"))
    absent = lambda p: ~F.coalesce(F.map_contains_key("fields", p), F.lit(False))
    hollow = lambda p: absent(p) | value(p).isNull() | value(p).isin("", "[]", "{}")
    named = lambda *types: F.coalesce(F.col("type").isin(*types), F.lit(False))
    warnings = F.array_compact(F.array(
        F.when(F.col("v").isNull(), F.lit("invalid_json")),
        F.when(F.col("v").isNotNull() & (absent(F.lit("@context")) | F.coalesce(value(F.lit("@context")).isin("", "[]", "{}"), F.lit(True))), F.lit("no_context")),
        F.when(F.col("v").isNotNull() & ~F.coalesce(known, F.lit(False)), F.lit("no_spec_for_type")),
        F.when(named(*DEPRECATED), F.lit("deprecated_rich_result")),
        F.when(named(*NOTED), F.lit("see_note")),
    ))
    out = rows.withColumns({"missing_required": F.filter(required, hollow), "missing_recommended": F.filter(recommended, absent), "warnings": warnings})
    return out.select(key, "pos", "type", "missing_required", "missing_recommended", "warnings", (F.col("v").isNotNull() & (F.size("missing_required") == 0)).alias("ok"))


def missing(objects: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """(key, pos, type, property, kind) of each property an object lacks, a row for each: an
    anti-join with the spec table. Cells and types are read as `validate` reads them."""
    rows = parsed(objects, key, json).select(key, "pos", "type", "fields")
    wanted = rows.join(F.broadcast(spec_table(objects.sparkSession)), "type").select(key, "pos", "type", "property", "kind")  # a fixed table of some 60 rows
    has = rows.select(F.col(key).alias("has_key"), F.col("pos").alias("has_pos"), F.explode("fields").alias("name", "value"))
    hollow = (F.col("kind") == "required") & F.coalesce(F.col("value").isin("", "[]", "{}"), F.lit(True))
    same = F.col(key).eqNullSafe(F.col("has_key")) & (F.col("pos") == F.col("has_pos")) & (F.col("property") == F.col("name"))
    return wanted.join(has, same & ~hollow, "left_anti")


def generate(items: DataFrame, type_col: str = "type", data_col: str = "data") -> DataFrame:
    """items with json: context and type, then the data (a map), which may override both."""
    base = F.create_map(F.lit("@context"), F.lit(CONTEXT), F.lit("@type"), F.col(type_col))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(F.col(data_col), k))
    return items.withColumn("json", F.to_json(F.map_concat(kept, F.col(data_col))))


def unresolved_ids(objects: DataFrame, key: str = "url", json: str = "json") -> DataFrame:
    """(key, ref) of {"@id": ref} references that no object of any page defines.

    An object that has more than its @id defines it. Ids are compared as written.
    """
    nodes = objects.select(key, F.explode(F.regexp_extract_all(json, F.lit(r"\{([^{}]*\"@id\"[^{}]*)\}"), F.lit(1))).alias("node"))
    nodes = nodes.select(key, F.regexp_extract("node", r'"@id"\s*:\s*"([^"]*)"', 1).alias("ref"), F.regexp_like("node", F.lit(r'^\s*"@id"\s*:\s*"[^"]*"\s*$')).alias("bare"))
    whole = objects.select(F.try_variant_get(F.try_parse_json(json), '$["@id"]', "string").alias("ref"), F.size(F.map_keys(F.try_variant_get(F.try_parse_json(json), "$", "map<string,string>"))).alias("n")).where("n > 1").select("ref")
    defined = nodes.where("not bare").select("ref").union(whole)
    return nodes.where("bare").select(key, "ref").distinct().join(defined, "ref", "left_anti").select(key, "ref")


def list_spec(spark: SparkSession) -> DataFrame:
    """(type, required, recommended) as text."""
    return spark.createDataFrame([(t, ", ".join(r), ", ".join(c)) for t, (r, c) in SPEC.items()], "type string, required string, recommended string")
