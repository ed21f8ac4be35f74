"""Elements of HTML with their nesting, as rows: a table function that each page is joined with.

Patterns can't tell what lies within what. The function goes over a page's tags once, keeps
the open elements, and gives a row for each element; everything after that is Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, with raw text, and which open ones a new one ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in BLOCKS}
#: An element that a new one doesn't end across.
WALLS = frozenset("ul ol dl table select button div section article nav main header footer form aside blockquote body".split())
#: Elements whose text is kept.
SPOKEN = frozenset("a button h1 h2 h3 h4 h5 h6 label legend option title".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
ROW = "pos int, tag string, parent int, path string, attributes map<string,string>, text string"


def elements_of(html: str) -> list[tuple]:
    """(pos, tag, parent, path, attributes, text) of a page's elements in the order they open.

    path: the open elements around it from the outermost, as `/html/body/`; parent: the pos of
    the last of them, null at the top. Names of elements and attributes are lower-cased; of equal attributes the
    first holds, one without a value has ''. text: what is written inside, within whatever
    elements, white space folded, for SPOKEN ones, else null.
    """
    rows: list[list] = []
    open_: list[int] = []
    spoken: list[tuple[int, list[str]]] = []  # open elements whose text is kept, with what they hold

    def close(depth: int) -> None:
        while len(open_) > depth:
            done = open_.pop()
            if spoken and spoken[-1][0] == done:
                _, parts = spoken.pop()
                rows[done][5] = " ".join(unescape("".join(parts)).split())

    def say(text: str) -> None:
        for _, parts in spoken:
            parts.append(text)

    at = 0
    while (m := TAG.search(html, at)) is not None:
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if rows[open_[k]][1] == tag), None)
            if depth is not None:
                close(depth)
            continue
        ended = ENDS.get(tag, ())
        for k in range(len(open_) - 1, -1, -1):
            name = rows[open_[k]][1]
            if name in ended:
                close(k)
            elif name in WALLS:
                break
        attributes: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(m[3]):
            attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        parent = open_[-1] if open_ else None
        path = "/" if parent is None else f"{rows[parent][3]}{rows[parent][1]}/"
        rows.append([len(rows), tag, parent, path, list(attributes.items()), None])
        if tag in VOID or m[3].endswith("/") and tag not in RAW:
            continue
        open_.append(len(rows) - 1)
        if tag in SPOKEN:
            spoken.append((len(rows) - 1, []))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            say(html[at : end.start() if end else len(html)] if tag in SPOKEN else "")
            at = end.end() if end else len(html)
            close(len(open_) - 1)
    say(html[at:])
    close(0)
    return rows


@F.udtf(returnType=ROW, useArrow=True)
class Elements:
    """The elements of a page, sent back in Arrow batches; none of a null one. (Spark has no lateral join
    with functions that take whole arrays.)"""

    def eval(self, html: str) -> Iterator[tuple]:
        for row in elements_of(html or ""):
            row[4] = dict(row[4])
            yield tuple(row)


def elements(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, tag, parent, path, attributes, text): a row for each element of each page.

    A lateral join with the table function: pages stay where they are, and nothing is shuffled. Null and empty
    pages have no elements, repeated ones repeat theirs. Broken markup gives what can be told: an
    end tag without a start is passed over, what is left open ends with the page.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(html).cast("string").alias("_html"))
    found = rows.lateralJoin(Elements(F.col("_html").outer()))
    return found.select(F.col("_key").alias(key), "pos", "tag", "parent", "path", "attributes", "text")


def _attribute(name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("attributes", F.lit(name))), F.lit(""))


def unlabelled(found: DataFrame, key: str = "url") -> DataFrame:
    """(key, pos, tag, name) of form controls of `elements` without a name for readers: no label around them,
    none pointing at their id on the same page, no aria-label, aria-labelledby or title."""
    kind = F.lower(F.coalesce(_attribute("type"), F.lit("text")))
    controls = found.where(F.col("tag").isin("input", "select", "textarea") & ~kind.isin("hidden", "submit", "button", "reset", "image"))
    bare = controls.where(~F.col("path").contains("/label/") & F.coalesce(*[_attribute(a) for a in ("aria-label", "aria-labelledby", "title")]).isNull())
    bare = bare.select(key, "pos", "tag", _attribute("name").alias("name"), _attribute("id").alias("_id"))
    points = found.where("tag = 'label'").select(F.col(key).alias("_of"), _attribute("for").alias("_for")).dropna().distinct()
    return bare.join(points, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_id") == F.col("_for")), "left_anti").drop("_id")


#: Regions of a page, by the innermost of these elements around a link.
REGIONS = ("nav", "header", "footer", "aside", "main", "article")


def links_by_region(found: DataFrame, key: str = "url") -> DataFrame:
    """(key, region, links, empty): links with a target in each region of a page, and how many of them say nothing."""
    region = F.regexp_extract("path", rf".*/({'|'.join(REGIONS)})/", 1)
    links = found.where("tag = 'a'").where(F.try_element_at("attributes", F.lit("href")).isNotNull())
    return links.groupBy(key, F.coalesce(F.nullif(region, F.lit("")), F.lit("page")).alias("region")).agg(F.count("*").alias("links"), F.count_if(F.col("text") == "").alias("empty"))


def social_cards(found: DataFrame, key: str = "url") -> DataFrame:
    """(key, card, title, description, image, missing): what a shared page shows, from twitter:* metas and
    where these lack from og:* ones; missing lists, comma-joined, what neither gives. Pages without elements give no row."""
    name = F.lower(F.coalesce(_attribute("name"), _attribute("property")))
    meta = lambda n: F.min_by(F.when((F.col("tag") == "meta") & (name == n), _attribute("content")), F.when((F.col("tag") == "meta") & (name == n) & _attribute("content").isNotNull(), F.col("pos")))
    parts = ("title", "description", "image")
    got = found.groupBy(key).agg(F.coalesce(meta("twitter:card"), F.lit("")).alias("card"), *[F.coalesce(meta(f"twitter:{p}"), meta(f"og:{p}")).alias(p) for p in parts])
    return got.withColumn("missing", F.concat_ws(",", *[F.when(F.col(p).isNull(), p) for p in parts]))
