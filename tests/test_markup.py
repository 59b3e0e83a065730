"""The stream of tags, metadata and JSON-LD by built-in functions, against the tree and plain JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import links, markup, structured
from pagemill.functions.article import authors, canonical, meta_language, named_content, open_graph, page_title, publish_date, tags
from pagemill.functions.htmltree import parse
from pagemill.operators import metadata
from pagemill.operators import structured_data as sd

EVENTS = """<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":{"@type":"MusicEvent","name":"E","eventStatus":"https://schema.org/EventCancelled",
"location":[{"name":"L","address":{"streetAddress":"S","postalCode":15}}],"offers":{"price":15,"priceCurrency":"EUR"},"performer":["P"],"organizer":{"name":"O"}}}]}</script>
<SCRIPT data-x='<b>' TYPE='Application/LD+JSON'>{bad</script><script type="application/ld+json">{"@type":"DanceEvent","name":"no"}</script><!-- <script type="application/ld+json">{"@type":"Event"}</script> -->"""


def script(value) -> str:
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def some_json(r: random.Random, depth: int):
    """A value whose members have the names that count, in odd shapes."""
    kind = r.randrange(9) if depth else r.randrange(3)
    if kind == 0:
        return r.choice(["Event", "festival", "NewsArticle", "thing", " x ", "", "a, b,,c", "https://schema.org/EventPostponed"])
    if kind == 1:
        return r.choice([15, 1.5, 0, -3, 100.0, 12345678901, 0.25])
    if kind == 2:
        return r.choice([None, True, False, "Report"])
    if kind < 5:
        return [some_json(r, depth - 1) for _ in range(r.randrange(4))]
    names = ["@type", "@graph", "itemListElement", "item", "name", "url", "location", "address", "offers", "price", "performer", "organizer", "image", "headline", "articleBody", "author", "keywords", "streetAddress", "startDate", "eventStatus", "datePublished", "postalCode"]
    out = {n: some_json(r, depth - 1) for n in r.sample(names, r.randrange(1, 8))}
    if r.random() < 0.5:
        out["@type"] = r.choice(["Event", ["Thing", ["Festival"]], "NewsArticle", "article"])
    return out


def test_records_as_a_walk_of_the_tree_finds_them(spark):
    r = random.Random(11)
    pages = [EVENTS, "", "<p>none</p>", script("[1,2]"), script('{"@type":"Event"} x'), script('{"@type":"Event"}{"@type":"Event"}'), script('{"@type":"Event"}] ['), script(" \n"), script([[[[{"@type": [["event"]], "name": [["n"]]}]]]])]
    pages += ["".join(script(some_json(r, 6)) for _ in range(r.randrange(1, 4))) for _ in range(250)]
    table = spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got, articles = {}, {a.page_id: a for a in sd.page_articles(table).collect()}
    for e in sd.page_events(table).collect():
        got.setdefault(e.page_id, []).append(e)
    found = 0
    for i, p in enumerate(pages):
        want = structured.events(parse(p), f"u{i}")
        mine = [{k: v for k, v in e.asDict(recursive=True).items() if k != "page_id"} for e in got.get(i, [])]
        assert mine == want, p
        found += len(want)
        article = structured.article(parse(p))
        a = articles.get(i)
        assert ({k: v for k, v in a.asDict().items() if k != "page_id"} if a else None) == article, p
    assert found > 100 and len(articles) > 50


def test_events_without_python_and_without_a_page(spark):
    table = spark.createDataFrame([(1, "u", EVENTS)], "page_id long, url string, html string")
    plan = sd.page_events(table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("InArrow|InPandas|EvalPython|PythonUDF|Exchange", plan)
    assert sd.page_events(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="no page for u"):
        sd.page_events(spark.createDataFrame([(1, "u", None)], table.schema)).collect()


@pytest.mark.parametrize(("number", "text"), [("1e21", "1e+21"), ("1.5e-7", "1.5e-7"), ("1e3", "1000"), ("15.50", "15.5"), ("-0.000001", "-0.000001"), ("0", "0"), ("100", "100"), ("123456789012345680000", "123456789012345680000")])
def test_numbers_as_scripts_write_them(spark, number, text):
    table = spark.createDataFrame([(1, "u", script(f'{{"@type":"Event","name":{number}}}'))], "page_id long, url string, html string")
    assert sd.page_events(table).first().title == text


def test_stream(spark):
    page = "<!doctype html><p CLASS=a class=b title='x &amp; y&copy=1 &copyz'>a &lt;b&eacute;&#8364;&#x80;&#0;&#xD800; &amp b &nosuch; <!-- <b> --><title>T &amp; <b></title><br/>x < y</ p></p><style>p{}</style >"
    got = [(e.tag, e.close, e.attrs, e.text) for e in spark.range(1).select(F.explode(markup.stream(F.lit(page))).alias("e")).select("e.*").collect()]
    assert got[0] == ("p", False, {"class": "a", "title": "x & y&copy=1 &copyz"}, None)
    assert got[1] == ("#text", False, None, "a <bé€€�� & b &nosuch; ")
    assert got[2:4] == [("title", False, {}, "T & <b>"), ("br", False, {}, None)]
    assert "".join(t for tag, _, _, t in got[4:-2] if tag == "#text") == "x < y"
    assert got[-2:] == [("p", True, None, None), ("style", False, {}, "p{}")]


HEADS = (
    '<html lang="EN-us"><head><title>Site | Some words - example.org</title><meta property="og:site_name" content="Site"><meta property="og:image" content="/a.png"><meta property="og:image:width" content="300">'
    '<meta name="description" content=" d "><link rel="apple-touch-icon" href="/i"><link rel="canonical" href="/c"></head><body><a rel="tag">x</a><a rel="tag">x</a><div itemprop="author"><i itemprop="name">A B</i></div>',
    '<head><title>| a &amp; b »</title><meta http-equiv="Content-Language" content="de-AT"><meta name="OriginalPublicationDate"><time itemprop="datePublished" datetime="2002"></time><link rel=canonical href="http://other.org/x y">',
    '<meta name=lang content=fr><meta property="og:title" content="A.org: T"><time itemprop="datePublished" datetime="2002">x</time><a href="/tag/q">one <b>two</b></a><a href="/topic/z">three<a href="/tags/">four</a>',
    '<meta name="headline" content="Head : "><link rel="canonical" href="../up/./x"><span itemprop="author name">C <b>D</b></span><div itemprop=author><div><div itemprop=name>E</div></div>F</div><p itemprop="author">none</p>',
    '<html lang="x"><title></title><meta property="rnews:datePublished" content="2001"><meta property="article:published_time" content="2003"><link rel="canonical" href="//cdn.org/p?q#f"><link rel="shortcut icon">',
    "", "<p>plain</p>",
)


@pytest.mark.parametrize("url", ["https://example.org:81/q/r", "http://www.A.org", "", "no url"])
def test_metadata_as_the_tree_gives_it(spark, url):
    table = spark.createDataFrame([(i, url, h) for i, h in enumerate(HEADS)], "page_id long, url string, html string")
    got = {r.page_id: r for r in metadata.page_metadata(table).collect()}
    assert len(got) == len(HEADS)
    for i, h in enumerate(HEADS):
        root, r = parse(h), got[i]
        graph = open_graph(root)
        assert (r.opengraph, r.publishDate, r.lang) == (graph, publish_date(root), meta_language(root))
        assert (r.domain, r.title) == (links.host_of(url), page_title(root, graph, links.host_of(url)))
        assert (r.canonical, r.favicon) == (canonical(root, url), next((n.attrs.get("href") for n in root.matching("rel", "icon", "link")), None) or "")
        assert (r.description, r.keywords) == (named_content(root, "description"), named_content(root, "keywords"))
        assert (r.tags, r.authors) == (tags(root), authors(root))


def test_resolve(spark):
    bases = ["https://h.example.org:8443/a/b?c#d", "http://h.org:80", "bad"]
    hrefs = ["x", "/x", "//o.org/p", "//o.org", "?q", "#f", "", "../x", "../../../x", "./", "..", "http://O.org:80/A/../b", "https://o.org", "mailto:a@b", "a b/é", "x?y=a b", " /t\n", "javascript:1"]
    table = spark.createDataFrame([(h, b) for h in hrefs for b in bases], "h string, b string")
    for r in table.select("h", "b", links.resolve(F.col("h"), F.col("b")).alias("r")).collect():
        if r.h != "":
            assert r.r == ("http://o.org/b" if ".." in r.h and "O.org" in r.h else links.resolved(r.h, r.b)), (r.h, r.b)


def test_hosts_as_browsers_read_them(spark):
    want = {"http://exa_mple.example.org/x": "exa_mple.example.org", "HTTP://A.Org:80": "a.org", "https://u:p@h.org/": "h.org", "http://[::1]/x": "[::1]", "http://h.org/a b": "h.org", "http://münchen.example/": "münchen.example", "x": None, "http:///p": None, "http://a b/": None, None: None}
    table = spark.createDataFrame([(k,) for k in want], "u string")
    assert {r.u: r.h for r in table.select("u", links.host(F.col("u")).alias("h")).collect()} == want
