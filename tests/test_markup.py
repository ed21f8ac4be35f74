from tessella.operators import markup


def at(html):
    return [(t, p, x) for _, t, _, p, _, x in markup.elements_of(html)]


def test_nesting():
    html = "<html><body><nav><ul><li><a href=/x>One</a><li><a href='/y'>Two <b>bold</b></a></ul></nav><p>a<p>b<div>c</div><label>Name <input name=n></label><br/>t</body></html>"
    assert at(html) == [
        ("html", "/", None), ("body", "/html/", None), ("nav", "/html/body/", None), ("ul", "/html/body/nav/", None),
        ("li", "/html/body/nav/ul/", None), ("a", "/html/body/nav/ul/li/", "One"), ("li", "/html/body/nav/ul/", None), ("a", "/html/body/nav/ul/li/", "Two bold"), ("b", "/html/body/nav/ul/li/a/", None),
        ("p", "/html/body/", None), ("p", "/html/body/", None), ("div", "/html/body/", None), ("label", "/html/body/", "Name"), ("input", "/html/body/label/", None), ("br", "/html/body/", None),
    ]


def test_raw_text_comments_and_broken_markup():
    assert at("<script>if (a < b) x('<a href=1>')</script><a>t</a>") == [("script", "/", None), ("a", "/", "t")]
    assert at("<title>a &amp; <b>b</title><!-- <a> --><a>x") == [("title", "/", "a & <b>b"), ("a", "/", "x")]
    assert at("</div><div><span>x</div><i>") == [("div", "/", None), ("span", "/div/", None), ("i", "/", None)]
    assert at("a < b <3 <!-- open <a>") == [] == at("") == at("<a href='unclosed")
    (row,) = markup.elements_of("""<IMG Alt="a > b" SRC=x.png alt='two' hidden data-x='"'>""")
    assert row[1] == "img" and dict(row[4]) == {"alt": "a > b", "src": "x.png", "hidden": "", "data-x": '"'}
    assert [r[2] for r in markup.elements_of("<div><p><b>x</b></p></div>")] == [None, 0, 1]
    deep = markup.elements_of("<i>" * 300)
    assert len(deep) == 300 and deep[-1][3].count("i/") == 299


PAGES = [
    ("u", """<nav><a href=1>x</a><a href=2></a></nav><main><article><a href=3>y</a></article><a href=4>z</a><a>none</a></main><footer><nav><a href=5>t</a></nav></footer><a href=6>w</a>"""),
    ("f", """<form><label>A <input name=a></label><label for=b>B</label><input id=b name=b><input id=c name=c><input type=hidden><textarea name=d title=D></textarea><select name=e aria-label=" "></select></form>"""),
    ("g", """<label for=c>C</label><meta name="twitter:card" content="summary"><meta property="og:title" content="T"><meta name="twitter:title" content=""><meta name="Twitter:Image" content="i.png"><meta property="og:image" content="j.png">"""),
    ("n", None),
    ("e", ""),
]


def test_tables_of_pages(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    found = markup.elements(pages)
    assert found.where("url = 'u'").count() == 12 and not found.where("url in ('n', 'e')").count()
    assert {tuple(r) for r in markup.unlabelled(found).select("url", "tag", "name").collect()} == {("f", "input", "c"), ("f", "select", "e")}
    assert {tuple(r) for r in markup.links_by_region(found).collect()} == {("u", "nav", 3, 1), ("u", "article", 1, 0), ("u", "main", 1, 0), ("u", "page", 1, 0)}
    cards = {r.url: tuple(r)[1:] for r in markup.social_cards(found).collect()}
    assert cards["g"] == ("summary", "T", None, "i.png", "description") and cards["u"] == ("", None, None, None, "title,description,image")
    twice = markup.elements(pages.union(pages).repartition(3))
    assert twice.count() == 2 * found.count()
    assert markup.elements(pages.limit(0)).count() == 0
