import pytest

from pagemill.functions import structured
from pagemill.functions.article import ArticleOptions, clean_title, extract, publish_date
from pagemill.functions.htmltree import parse
from pagemill.functions.links import host_of, resolved
from pagemill.functions.stopwords import count_words, short_lists

PARA = "<p>this is what we all have been in and of the which they will not</p>"
LONG = PARA * 6


def test_main_text_and_links():
    page = f'<html lang="en"><body><div id="nav"><a href="/a">a</a></div><div><h1>Head</h1>{LONG}<p>with a <a href="/x">link</a> of the best that we have</p></div><div id="footer">{PARA}</div></body></html>'
    a = extract(page, "https://www.example.org/p")
    assert a["cleanedText"].count("this is what we all") == 6
    assert "with a link of the best" in a["cleanedText"]
    assert a["links"] == ["/x"]
    assert a["domain"] == "www.example.org"


def test_metadata():
    head = (
        '<html lang="EN-us"><head><title>Site | Some words - example.org</title><meta property="og:site_name" content="Site"><meta property="og:image" content="/a.png">'
        '<meta property="og:image:width" content="300"><meta name="description" content=" d "><link rel="apple-touch-icon" href="/i"><link rel="canonical" href="/c"></head>'
    )
    a = extract(head + '<body><a rel="tag">x</a><a rel="tag">x</a><div itemprop="author"><i itemprop="name">A B</i></div></body></html>', "https://example.org:81/q")
    assert a["opengraph"] == {"site_name": "Site", "image": "300"}
    assert a["title"] == "Some words"
    assert (a["lang"], a["description"], a["favicon"], a["canonical"]) == ("en", "d", "/i", "https://example.org/c")
    assert (a["tags"], a["authors"]) == (["x"], ["A B"])


def test_publish_date_does_not_fall_through():
    assert publish_date(parse('<meta property="article:published_time"><meta name="OriginalPublicationDate" content="2001">')) is None
    assert publish_date(parse('<time itemprop="datePublished" datetime="2002">')) == "2002"


@pytest.mark.parametrize(("title", "site", "domain", "clean"), [("a - b", None, None, "a - b"), ("- a |", None, None, "a"), ("Site: a Site", "Site", None, "a Site"), ("A.org a", None, "a.org", "a"), ("", None, None, "")])
def test_clean_title(title, site, domain, clean):
    assert clean_title(title, site, domain) == clean


def test_json_ld_wins_only_over_thin_text():
    script = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","NewsArticle"],"headline":" H ","articleBody":"B","keywords":"a, b,,","author":[{"name":"N"},"M"]}]}</script>'
    thin = extract(f"<html><head><title>Loading</title>{script}</head><body></body></html>")
    assert (thin["title"], thin["cleanedText"], thin["tags"], thin["authors"], thin["fromJsonLd"]) == ("H", "B", ["a", "b"], ["N", "M"], True)
    assert not extract(f"<html><head>{script}</head><body><div>{LONG}</div></body></html>")["fromJsonLd"]
    assert not extract(f"<html><head>{script}</head></html>", options=ArticleOptions(json_ld_fallback=False))["fromJsonLd"]


def test_events():
    page = """<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":{"@type":"MusicEvent","name":"E","eventStatus":"https://schema.org/EventCancelled",
    "location":[{"name":"L","address":{"streetAddress":"S","postalCode":15}}],"offers":{"price":15,"priceCurrency":"EUR"},"performer":["P"],"organizer":{"name":"O"}}}]}</script>
    <script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"DanceEvent","name":"no"}</script>"""
    (e,) = structured.events(parse(page), "u")
    assert (e["title"], e["eventStatus"], e["organizer"], e["performers"]) == ("E", "cancelled", "O", ["P"])
    assert e["location"] == {"name": "L", "address": "S, 15", "url": None}
    assert e["offers"] == [{"price": "15", "priceCurrency": "EUR", "url": None}]


def test_videos_and_tweets():
    page = f'<div>{LONG}<iframe width="5" src="//youtube.com/x"></iframe><object><param name="movie" value="http://vimeo.com/1"><embed src="http://vimeo.com/1"></object><video src="youtube"></video><blockquote class="twitter-tweet"><p>t</p></blockquote></div>'
    a = extract(page)
    assert [(m["embedType"], m["provider"], m["src"]) for m in a["movies"]] == [("iframe", "youtube", "//youtube.com/x"), ("object", "vimeo", "http://vimeo.com/1")]
    assert a["movies"][0]["embedCode"] == '<iframe width="5" src="//youtube.com/x"/>'
    assert len(a["tweets"]) == 1


def test_lead_image():
    sizes = {"http://h.org/big.jpg": (9000, 400, 300), "http://h.org/b2.jpg": (9000, 900, 800), "http://h.org/banner.jpg": (9000, 900, 100)}
    page = f'<meta property="og:image" content="/o.png"><div>{LONG}<img src="/banner.jpg"><img src="/x.gif"><img src="big.jpg"><img src="/b2.jpg"></div>'
    image = extract(page, "http://h.org/p/", ArticleOptions(pictures=lambda u: sizes.get(u.replace("/p/", "/"))))["image"]
    assert (image["url"], image["type"], image["confidence"]) == ("http://h.org/b2.jpg", "bigimage", 50)
    assert extract(page, "http://h.org/p", ArticleOptions(pictures=lambda u: None))["image"]["type"] == "opengraph"
    known = extract(f'<div id="big_photo"><img src="/k.jpg"></div><div>{LONG}</div>', "http://h.org/p", ArticleOptions(pictures=lambda u: None))["image"]
    assert (known["url"], known["type"], known["confidence"]) == ("http://h.org/k.jpg", "known", 90)


@pytest.mark.parametrize("page", ["", "<", "<p>", "&", "<html></html>", "<table><td><p>", None and ""])
def test_odd_pages(page):
    assert extract(page or "")["cleanedText"] == ""


def test_stop_words():
    en = short_lists()["en"]
    assert (count_words("The cat, and  the dog.", en).stop_words, count_words("The cat, and  the dog.", en).words) == (3, 6)
    assert count_words("", en).words == 0
    assert count_words("a b", frozenset(["x", "y"]), "korean").stop_words == 4
    assert count_words("ab, c", frozenset([","]), "arabic").stop_words == 1


def test_urls():
    assert host_of("HTTP://www.A.com:80/x") == "www.a.com"
    assert host_of("mailto:x") is None
    assert resolved("../b?c", "http://a.org/x/y") == "http://a.org/b?c"
    assert resolved("//c.org", "https://a.org/") == "https://c.org/"
    assert resolved("javascript:x", "https://a.org/") is None
