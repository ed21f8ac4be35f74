"""Design recommendation: each request against small libraries, by token overlap.

Libraries (products, styles, palettes, fonts, rules) are tables with row_idx, their file
order; on equal scores the earlier row wins. A library of at most SMALL_ROWS rows
travels to every request as one array, so requests, however many, are never shuffled;
the bound is checked when the array is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import listed, tokens
from tessella.sources.staging import small_table, spread

# Corner radius, shadow and motion of the styles that have their own, and of the rest.
EFFECTS = {
    "minimal": ("6px", "subtle (0 1px 2px rgba(0,0,0,.06))", "150ms ease-out"),
    "luxury-serif": ("2px", "none / hairline border", "400ms ease"),
    "neo-brutalist": ("0px", "hard offset (4px 4px 0 #000)", "120ms steps"),
    "soft-ui": ("16px", "soft (0 8px 24px rgba(0,0,0,.08))", "250ms ease-in-out"),
    "glassmorphism": ("14px", "blur + glow", "300ms ease"),
    "dark-tech": ("8px", "glow accent", "180ms ease-out"),
    "claymorphism": ("22px", "puffy dual-tone", "300ms spring"),
}
DEFAULT_EFFECT = ("8px", "medium (0 4px 12px rgba(0,0,0,.08))", "200ms ease-out")
PATTERN, SECTIONS, STYLE = "hero-centric", "hero;value;social-proof;features;cta", "minimal"
# What is checked before delivery where no rules are on file.
CHECKLIST = [
    "One primary CTA per view",
    "Value proposition visible without scrolling",
    "Body text contrast >= 4.5:1",
    "Tap targets >= 44x44 px",
    "LCP < 2.5s, CLS < 0.1, INP < 200ms",
]


def library(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One row with `lib`: all rows in order, each with its cells and token sets (by name in fields)."""
    rows = small_table(rows, "a library")
    sets = [tokens(*columns).alias(name) for name, columns in fields.items()]
    return rows.agg(F.sort_array(F.collect_list(F.struct("row_idx", F.struct(*[c for c in rows.columns if c != "row_idx"]).alias("row"), *sets))).alias("lib"))


def beside(requests: DataFrame, lib: DataFrame, name: str) -> DataFrame:
    """requests, each with the library's array."""
    return requests.join(F.broadcast(lib.select(F.col("lib").alias(name))), how="cross")  # one row


def best(lib: str, score, least: int | None = 0) -> Column:
    """The entry of highest score, the earlier one on ties; null unless it exceeds `least`."""
    scored = F.transform(F.col(lib), lambda e: F.struct(score(e).alias("s"), (-e["row_idx"]).alias("o"), e["row"].alias("row")))
    top = F.array_max(F.transform(scored, lambda t: F.struct(t["s"], t["o"])))
    hit = F.get(F.filter(scored, lambda t: (t["s"] == top["s"]) & (t["o"] == top["o"])), F.lit(0))
    return hit if least is None else F.when(hit["s"] > least, hit)


def shared(query: Column, entry_tokens: Column) -> Column:
    return F.size(F.array_intersect(query, entry_tokens))


def first_row(lib: str) -> Column:
    return F.get(F.col(lib), F.lit(0))["row"]


def pick_product(requests: DataFrame, products: DataFrame) -> DataFrame:
    """requests with product (struct) and product_matched: an equal type (any case), else the
    largest overlap of type, industry and keywords with five fields, else the first row, unmatched."""
    lib = library(products, {"words": ["product_type", "industry", "notes", "key_sections", "recommended_style"]})
    rows = beside(requests, lib, "_lib").withColumn("_q", tokens("product_type", "industry", "keywords"))
    exact = F.get(F.filter("_lib", lambda e: F.lower(e["row"]["product_type"]) == F.lower(F.coalesce("product_type", F.lit("")))), F.lit(0))["row"]
    rows = rows.withColumn("_hit", F.coalesce(exact, best("_lib", lambda e: shared(F.col("_q"), e["words"]))["row"]))
    return rows.withColumn("product", F.coalesce("_hit", first_row("_lib"))).withColumn("product_matched", F.col("_hit").isNotNull()).drop("_lib", "_q", "_hit")


def pick_style(requests: DataFrame, styles: DataFrame) -> DataFrame:
    """requests (with product) with style, style_matched and style_override.

    If the product's style is on file it holds, unless the keywords hold every word of
    another style's name; the longest such name wins. Otherwise the largest overlap
    wins, less 2 if a word to avoid is asked for.
    """
    lib = library(styles, {"named": ["style"], "words": ["style", "mood_tags", "characteristics", "best_for", "summary"], "avoid": ["avoid_for"]})
    rows = beside(requests, lib, "_lib").withColumns({"_k": tokens("keywords"), "_want": F.lower(F.coalesce(F.col("product.recommended_style"), F.lit("")))})
    rows = rows.withColumn("_all", tokens("keywords", "product.palette_mood", "product.typography_mood", "product.recommended_style"))
    default = F.get(F.filter("_lib", lambda e: F.lower(e["row"]["style"]) == F.col("_want")), F.lit(0))["row"]
    rows = rows.withColumn("_default", default)
    meant = lambda e: (F.size(F.array_except(e["named"], F.col("_k"))) == 0) & (F.lower(e["row"]["style"]) != F.col("_want"))
    named = best("_lib", lambda e: F.when(meant(e), F.size(e["named"])).otherwise(0))["row"]
    loose = best("_lib", lambda e: shared(F.col("_all"), e["words"]) - F.when(shared(F.col("_all"), e["avoid"]) > 0, 2).otherwise(0))["row"]
    rows = rows.withColumn("_named", F.when(F.col("_default").isNotNull(), named)).withColumn("_loose", F.when(F.col("_default").isNull(), loose))
    hit = F.coalesce("_named", "_default", "_loose")
    rows = rows.withColumns({"style": F.coalesce(hit, first_row("_lib")), "style_matched": hit.isNotNull(), "style_override": F.col("_named.style")})
    return rows.drop("_lib", "_k", "_want", "_all", "_default", "_named", "_loose")


def pick_palette(requests: DataFrame, palettes: DataFrame) -> DataFrame:
    """requests with palette and palette_matched: overlap, and 1 more for passing body contrast."""
    lib = library(palettes, {"words": ["industry", "mood", "tags", "name"]})
    rows = beside(requests, lib, "_lib").withColumn("_q", tokens("industry", "product.palette_mood", "keywords"))
    rows = rows.withColumn("palette", best("_lib", lambda e: shared(F.col("_q"), e["words"]) + F.when(e["row"]["aa_body_text"] == "pass", 1).otherwise(0), None)["row"])
    matched = shared(F.col("_q"), tokens("palette.industry", "palette.mood", "palette.tags", "palette.name")) > 0
    return rows.withColumn("palette_matched", matched).drop("_lib", "_q")


def pick_typography(requests: DataFrame, fonts: DataFrame) -> DataFrame:
    """requests with typography and typography_matched."""
    lib = library(fonts, {"words": ["mood", "best_for", "name"]})
    rows = beside(requests, lib, "_lib").withColumn("_q", tokens("product.typography_mood", "product_type", "keywords"))
    rows = rows.withColumn("_hit", best("_lib", lambda e: shared(F.col("_q"), e["words"]))["row"])
    return rows.withColumns({"typography": F.coalesce("_hit", first_row("_lib")), "typography_matched": F.col("_hit").isNotNull()}).drop("_lib", "_q", "_hit")


def effects(style: Column) -> Column:
    as_struct = lambda e: F.struct(*[F.lit(v).alias(k) for k, v in zip(("radius", "shadow", "motion"), e, strict=True)])
    known = F.create_map(*[x for name, e in EFFECTS.items() for x in (F.lit(name), as_struct(e))])
    return F.coalesce(F.try_element_at(known, style), as_struct(DEFAULT_EFFECT))


def checklist(rules: DataFrame | None, requests: DataFrame) -> DataFrame:
    """requests with checklist: rules of priority critical or high in file order, or the fixed five."""
    if rules is None:
        return requests.withColumn("checklist", F.array(*map(F.lit, CHECKLIST)))
    one = small_table(rules, "a list of rules").where(F.col("priority").isin("critical", "high")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "rule"))), lambda s: s["rule"]).alias("lib"))
    return beside(requests, one, "checklist")


#: Requests that one task sets beside the libraries.
REQUESTS = 5_000


def compose(requests: DataFrame, products: DataFrame | None = None, styles: DataFrame | None = None, palettes: DataFrame | None = None, fonts: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """requests (product_type, industry, keywords) with pattern, style, palette, typography,
    effects, key_sections, anti_patterns, checklist and fallbacks. A missing library falls
    back on defaults and says so."""
    product = "struct<recommended_pattern:string,recommended_style:string,palette_mood:string,typography_mood:string,key_sections:string,anti_patterns:string>"
    none = lambda kind: F.lit(None).cast(kind)
    requests = spread(requests, REQUESTS)
    rows = pick_product(requests, products) if products is not None else requests.withColumns({"product": none(product), "product_matched": none("boolean")})
    rows = pick_style(rows, styles) if styles is not None else rows.withColumns({"style": none("struct<style:string,summary:string,avoid_for:string>"), "style_matched": none("boolean"), "style_override": none("string")})
    rows = pick_palette(rows, palettes) if palettes is not None else rows.withColumns({"palette": none("struct<name:string>"), "palette_matched": none("boolean")})
    rows = pick_typography(rows, fonts) if fonts is not None else rows.withColumns({"typography": none("struct<name:string>"), "typography_matched": none("boolean")})
    given = {"styles": styles, "palettes": palettes, "fonts": fonts, "rules": rules, "products": products}
    said = [F.lit(f"no_{k}_library") for k, v in given.items() if v is None]
    said += [F.when(~F.col(f"{k}_matched"), F.lit(f"{k}_not_matched")) for k in ("product", "style", "palette", "typography")]
    said.append(F.when(F.col("style_override").isNotNull(), F.concat(F.lit("style_overridden_by_"), "style_override")))
    name = F.coalesce("style.style", "product.recommended_style", F.lit(STYLE))
    rows = rows.withColumns({
        "style_name": name,
        "pattern": F.coalesce("product.recommended_pattern", F.lit(PATTERN)),
        "effects": effects(name),
        "key_sections": F.filter(F.transform(F.split(F.coalesce("product.key_sections", F.lit(SECTIONS)), "[;,]"), lambda s: F.trim(s)), lambda s: s != ""),
        "anti_patterns": listed("product.anti_patterns", "style.avoid_for"),
        "fallbacks": F.array_compact(F.array(*said)),
    })
    return checklist(rules, rows)


def human_view(designs: DataFrame, palette: bool = True, typography: bool = True) -> DataFrame:
    """designs (as compose gives them) with view: the design as lines of text for people.

    Parts that are null are left out; palette and typography say whether the design has
    the columns of those libraries.
    """
    f = F.col
    lines = [
        F.concat(F.lit("DESIGN SYSTEM: "), F.coalesce("product_type", F.lit("")), F.lit(" / "), F.coalesce("industry", F.lit(""))),
        F.concat(F.lit("Pattern: "), f("pattern")),
        F.concat(F.lit("Style: "), f("style_name"), F.coalesce(F.concat(F.lit(", "), f("style.summary")), F.lit(""))),
        F.concat(F.lit("Palette: "), f("palette.name")),
        *([F.concat_ws("  ", *[F.concat(F.lit(f"  {c} "), f(f"palette.{c}")) for c in ("primary", "secondary", "accent", "bg", "surface", "text")])] if palette else []),
        *([F.concat(F.lit("Type: "), f("typography.heading_font"), F.lit(" / "), f("typography.body_font"))] if typography else []),
        F.concat(F.lit("Effects: radius "), f("effects.radius"), F.lit(" | shadow "), f("effects.shadow"), F.lit(" | motion "), f("effects.motion")),
        F.concat(F.lit("Sections: "), F.array_join("key_sections", ", ")),
        F.when(F.size("anti_patterns") > 0, F.concat(F.lit("Avoid: "), F.array_join("anti_patterns", ", "))),
    ]
    listed_ = lambda c, mark: F.transform(c, lambda x: F.concat(F.lit(mark), x))
    whole = F.concat(F.array_compact(F.array(*lines)), listed_("checklist", "  [ ] "), listed_("fallbacks", "  ! "))
    return designs.withColumn("view", F.array_join(whole, "\n"))
