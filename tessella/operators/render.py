"""Token sheets, pages and single-file bundles from design results."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import has

# Colours that become tokens, in order; section labels; what platforms take, in bytes.
COLOURS = ["primary", "secondary", "accent", "bg", "surface", "text", "on_primary", "success", "warning", "error"]
LABELS = {"social-proof": "Social proof", "faq": "FAQ", "cta": "Call to action"}
CARD_SECTIONS = ["features", "services", "collection"]
LIMITS = {"wordpress": None, "ghl": 5_000_000, "webflow": 50_000, "wix": None, "framer": None, "squarespace": None, "carrd": None, "generic": None}
IMAGE_BYTES = 200_000
# Colours of a page whose palette leaves them open.
DEFAULT_COLOURS = {"primary": "#2c61dd", "secondary": "#6954d4", "accent": "#ea832e", "bg": "#ffffff", "surface": "#f4f5f7", "text": "#1a1d24", "on_primary": "#ffffff"}


def colour_pairs(palette: str = "palette") -> Column:
    """Array of (name, value) of the colours that are set, names with hyphens."""
    pairs = F.array(*[F.struct(F.lit(c.replace("_", "-")).alias("name"), F.col(f"{palette}.{c}").alias("value")) for c in COLOURS])
    return F.filter(pairs, lambda p: F.coalesce(p["value"] != "", F.lit(False)))


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def token_sheets(designs: DataFrame) -> DataFrame:
    """designs (palette, typography, effects structs) with css, scss, tailwind and json texts.

    Unset colours, fonts and radii are left out; tailwind falls back on its own defaults.
    """
    pairs, heading, body, radius = colour_pairs(), _filled("typography.heading_font"), _filled("typography.body_font"), _filled("effects.radius")
    lines = lambda fmt: F.array_join(F.transform(pairs, lambda p: F.format_string(fmt, p["name"], p["value"])), "")
    maybe = lambda fmt, c: F.when(c.isNotNull(), F.format_string(fmt, c)).otherwise("")
    css = F.concat(F.lit(":root {\n"), lines("  --color-%s: %s;\n"), maybe('  --font-heading: "%s", serif;\n', heading), maybe('  --font-body: "%s", system-ui, sans-serif;\n', body), maybe("  --radius: %s;\n", radius), F.lit("}\n"))
    scss = F.concat(lines("$color-%s: %s;\n"), maybe('$font-heading: "%s", serif;\n', heading), maybe('$font-body: "%s", system-ui, sans-serif;\n', body), maybe("$radius: %s;\n", radius))
    entries = F.array_join(F.transform(pairs, lambda p: F.format_string('        "%s": "%s"', p["name"], p["value"])), ",\n")
    tailwind = F.concat(
        F.lit("module.exports = {\n  theme: {\n    extend: {\n      colors: {\n"), entries,
        F.lit("\n      },\n      fontFamily: {\n        heading: ['\""), F.coalesce(heading, F.lit("ui-serif")), F.lit("\"', 'serif'],\n        body: ['\""),
        F.coalesce(body, F.lit("ui-sans-serif")), F.lit("\"', 'system-ui', 'sans-serif']\n      },\n      borderRadius: { DEFAULT: \""), F.coalesce(radius, F.lit("0.5rem")), F.lit('" }\n    }\n  }\n};\n'),
    )
    valued = lambda c: F.when(c.isNotNull(), F.struct(c.alias("value")))
    colours = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["name"], F.struct(p["value"].alias("value")))))
    json = F.to_json(F.struct(colours.alias("color"), F.struct(valued(heading).alias("heading"), valued(body).alias("body")).alias("font"), F.struct(valued(radius).alias("base")).alias("radius")))
    return designs.withColumns({"css": css, "scss": scss, "tailwind": tailwind, "json": json})


def escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def section_id(s: Column) -> Column:
    return escaped(F.replace(s, F.lit(" "), F.lit("-")))


def label(s: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, s), F.initcap(F.replace(s, F.lit("-"), F.lit(" "))))


def font_link(typography: str = "typography") -> Column:
    fonts = F.array_distinct(F.array_compact(F.array(_filled(f"{typography}.heading_font"), _filled(f"{typography}.body_font"))))
    families = F.array_join(F.transform(fonts, lambda f: F.concat(F.lit("family="), F.replace(f, F.lit(" "), F.lit("+")), F.lit(":wght@400;600;700"))), "&")
    link = F.concat(F.lit('<link rel="stylesheet" href="https://fonts.googleapis.com/css2?'), families, F.lit('&display=swap">'))
    return F.when(F.size(fonts) > 0, link).otherwise("")


def section_html(s: Column) -> Column:
    """The hero is part of the page head; a call to action is a band, some sections are three cards."""
    title = escaped(label(s))
    head = F.concat(F.lit('<section id="'), section_id(s), F.lit('"><h2>'), title, F.lit("</h2>"))
    cards = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("<article><h3>"), title, F.lit(" "), i.cast("string"), F.lit("</h3></article>"))), "")
    return F.when(s == "hero", "").when(s == "cta", F.concat(head, F.lit('<a class="button" href="#hero">Start</a></section>'))).when(s.isin(*CARD_SECTIONS), F.concat(head, cards, F.lit("</section>"))).otherwise(F.concat(head, F.lit("<p></p></section>")))


def pages(designs: DataFrame) -> DataFrame:
    """designs with page: one HTML document of our own plain template; open colours, fonts, radius
    and motion get defaults."""
    sections = F.when(F.size("key_sections") > 0, F.col("key_sections")).otherwise(F.array(*map(F.lit, ("hero", "features", "cta"))))
    rest = F.filter(sections, lambda s: s != "hero")
    nav = F.array_join(F.transform(rest, lambda s: F.concat(F.lit('<a href="#'), section_id(s), F.lit('">'), escaped(label(s)), F.lit("</a>"))), "\n")
    body = F.array_join(F.transform(rest, section_html), "\n")
    colours = F.concat(*[F.concat(F.lit(f"--{c.replace('_', '-')}:"), F.coalesce(_filled(f"palette.{c}"), F.lit(default)), F.lit(";")) for c, default in DEFAULT_COLOURS.items()])
    style = F.concat(F.lit("<style>:root{"), colours, F.lit("--radius:"), F.coalesce(_filled("effects.radius"), F.lit("8px")), F.lit(";--motion:"), F.coalesce(_filled("effects.motion"), F.lit("200ms ease-out")), F.lit("}body{margin:0;background:var(--bg);color:var(--text);font-family:"), F.coalesce(_filled("typography.body_font"), F.lit("system-ui")), F.lit("}h1,h2,h3{font-family:"), F.coalesce(_filled("typography.heading_font"), F.lit("system-ui")), F.lit("}.button{background:var(--primary);color:var(--on-primary);border-radius:var(--radius)}</style>"))
    title = escaped(F.coalesce(_filled("product_type"), F.lit("Landing page")))
    page = F.concat_ws("\n", F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">'), F.concat(F.lit("<title>"), title, F.lit("</title>")), font_link(), style, F.lit("</head>\n<body>\n<nav>"), nav, F.lit('</nav>\n<main>\n<section id="hero"><h1></h1></section>'), body, F.lit("</main>\n</body>\n</html>"))
    return designs.withColumn("page", page)


# Beginnings of references that lead out of a build, and what is inlined, in the order of its notes.
REMOTE = ("http://", "https://", "//", "data:", "mailto:", "tel:", "#")
KINDS = {
    "css": r"""<link[^>]*rel=["']?stylesheet["']?[^>]*>""",
    "js": r"""<script[^>]*\ssrc=["'][^"']+["'][^>]*>\s*</script>""",
    "image": r"""<img[^>]*\ssrc=["'][^"']+["'][^>]*>""",
}
ANY_KIND = f"(?i){'|'.join(KINDS.values())}"
TARGET = {"css": r"""(?i)href=["']([^"']+)["']""", "js": r"""(?i)\ssrc=["']([^"']+)["']""", "image": r"""(?i)\ssrc=["']([^"']+)["']"""}
IMAGE_TYPES = {ending: kind for ending, kind in mimetypes.types_map.items() if kind.startswith("image/")}


def path_of(url: Column) -> Column:
    """A reference without query and fragment, in plain steps from the build's root: `.` and empty steps are
    dropped, `..` takes back the step before it, and stays where there is none."""
    steps = F.split(F.replace(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("\\"), F.lit("/")), "/")
    back = lambda taken: F.slice(taken, 1, F.greatest(F.size(taken) - 1, F.lit(0)))
    inner = lambda taken: (F.size(taken) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), taken), -1) != "..")
    walk = lambda taken, step: F.when(step.isin("", "."), taken).when((step == "..") & inner(taken), back(taken)).otherwise(F.array_append(taken, step))
    return F.coalesce(F.nullif(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"), F.lit("")), F.lit("."))


def path_status(url: Column) -> Column:
    """remote, unsafe (an absolute path, a drive letter, a climb out of the build) or inside."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    remote = (path == "") | F.regexp_like(url, F.lit("^(" + "|".join(re.escape(r) for r in REMOTE) + ")"))
    out = F.regexp_like(path, F.lit(r"^([/\\]|[A-Za-z]:)")) | F.regexp_like(path_of(url), F.lit(r"^\.\.(/|$)"))
    return F.when(remote, "remote").when(out, "unsafe").otherwise("inside")


def references(pages_: DataFrame, key: str = "id", html: str = "html") -> DataFrame:
    """(key, pos, tag, kind, url, status, path): the style sheets, scripts and images that a page asks for."""
    tags = pages_.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(html, F.lit(ANY_KIND), F.lit(0))).alias("pos", "tag"))
    kind = F.when(F.lower("tag").startswith("<link"), "css").when(F.lower("tag").startswith("<script"), "js").otherwise("image")
    rows = tags.withColumn("kind", kind)
    url = F.coalesce(*[F.when(F.col("kind") == k, F.nullif(F.regexp_extract("tag", p, 1), F.lit(""))) for k, p in TARGET.items()])
    rows = rows.withColumn("url", url)
    return rows.select("key", "pos", "tag", "kind", "url", path_status(F.col("url")).alias("status"), path_of(F.col("url")).alias("path"))


def _inlined(image_bytes: int) -> tuple[Column, Column]:
    """(what stands in place of a reference's tag, the note on it or null), by its columns and `content`."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    here = F.col("content").isNotNull() & (F.col("status") == "inside")
    small = F.octet_length("content") <= image_bytes
    code = F.regexp_replace(text, r"//[#@]\s*sourceMappingURL=.*", "")
    module = F.when(F.regexp_like("tag", F.lit(r"""(?i)type=["']module["']""")), ' type="module"').otherwise("")
    ending = F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair]), ending), F.lit("image/png"))
    data = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content"))
    made = F.when(~here, F.col("tag")).when(F.col("kind") == "css", F.concat(F.lit("<style>\n"), text, F.lit("\n</style>")))
    made = made.when(F.col("kind") == "js", F.concat(F.lit("<script"), module, F.lit(">\n"), code, F.lit("\n</script>")))
    made = made.when(small, F.replace(F.col("tag"), F.col("url"), data)).otherwise(F.col("tag"))
    hints = F.regexp_like(F.regexp_replace("tag", r"""(?i)\ssrc=["'][^"']+["']""", ""), F.lit(r"(?i)\b(async|defer|nomodule)\b"))
    absent = F.when(F.col("status") == "inside", "missing").otherwise(F.col("status"))
    note = F.when(~here, F.concat_ws("", absent, F.lit(" "), "kind", F.lit(": "), "url"))
    note = note.when((F.col("kind") == "js") & hints, F.concat(F.lit("loading hints dropped: "), "url"))
    note = note.when((F.col("kind") == "image") & ~small, F.concat(F.lit("large image: "), "url"))
    return made, F.when(F.col("url").isNotNull(), note)


def bundled(pages_: DataFrame, assets: DataFrame, image_bytes: int = IMAGE_BYTES) -> DataFrame:
    """pages (id, html) with bundle, the page with its style sheets, scripts and small images inside, and
    notes on what was not, by kind and place. assets: (id, path, content), the files of each build.

    References are rows that meet their files by id and path; what is found is spliced into the page
    once, between the pieces that the same pattern leaves of it. Only the page's own tags are
    replaced, not what inlined files hold. Ids tell pages apart; a null page stays null; of files
    with equal paths one is taken. Shuffled: references, files asked for, pages.
    """
    files = assets.select(F.col("id").alias("of"), F.col("path").alias("file"), "content").dropDuplicates(["of", "file"])
    asked = references(pages_)
    rows = asked.join(files, F.col("key").eqNullSafe(F.col("of")) & (F.col("path") == F.col("file")), "left")
    made, note = _inlined(image_bytes)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = rows.select("key", F.struct("pos", made.alias("made")).alias("put"), F.struct(order.alias("order"), "pos", note.alias("note")).alias("said"))
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_list("put")).alias("puts"), F.sort_array(F.collect_list("said")).alias("said"))
    out = pages_.join(whole, pages_["id"].eqNullSafe(F.col("key")), "left")
    pieces = F.split("html", ANY_KIND, -1)
    spliced = F.zip_with(pieces, F.coalesce(F.col("puts.made"), F.array().cast("array<string>")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    notes = F.filter(F.col("said.note"), lambda n: n.isNotNull())
    return out.select(*[pages_[c] for c in pages_.columns], F.array_join(spliced, "").alias("bundle"), F.coalesce(notes, F.array().cast("array<string>")).alias("notes"))


def bundles(builds: DataFrame, image_bytes: int = IMAGE_BYTES) -> DataFrame:
    """builds (id, html, files: map of path to binary) with bundle and notes; see bundled."""
    assets = builds.select("id", F.explode("files").alias("path", "content"))
    return bundled(builds, assets, image_bytes)


def unhandled(bundled: DataFrame, html: str = "bundle") -> DataFrame:
    """bundled with references: which kinds of reference are still outside the file."""
    checks = {"css_url": r"""(?i)url\(\s*["']?(?!data:|https?:|//|#)""", "srcset": r"(?i)\bsrcset=", "source": r"(?i)<source\b", "icon": r"""(?i)<link[^>]*rel=["'](?:icon|apple-touch-icon|manifest)"""}
    return bundled.withColumn("references", F.array_compact(F.array(*[F.when(has(html, p), F.lit(k)) for k, p in checks.items()])))


def platform_fit(bundled: DataFrame, html: str = "bundle", key: str = "id") -> DataFrame:
    """(key, platform, bytes, fits) of each file on each of the fixed platforms."""
    limits = F.array(*[F.struct(F.lit(k).alias("platform"), F.lit(v).cast("long").alias("most")) for k, v in LIMITS.items()])
    rows = bundled.select(key, F.octet_length(html).cast("long").alias("bytes"), F.inline(limits))
    return rows.select(key, "platform", "bytes", (F.col("most").isNull() | (F.col("bytes") <= F.col("most"))).alias("fits"))
