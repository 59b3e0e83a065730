"""What a page says about itself, from its stream of tags: one projection of built-in functions, no tree and no Python.

A page without the markup in question gives the empty string, an empty list or map, and null for the language, the domain
and the date; so does an empty page.  Pages whose html is null give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links, markup
from ..functions.article import DATE_MARKS, TITLE_ENDS
from ..functions.markup import attribute_of, bound, elements, having

# Parts of addresses that tag pages have.
TAG_ADDRESSES = ("/tag/", "/tags/", "/topic/", "?keyword=")


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def open_graph(stream: Column) -> Column:
    """og: properties by what stands between the first two colons; of repeated names the last counts."""
    metas = F.filter(elements(stream, "meta"), lambda t: F.coalesce(F.startswith(attribute_of(t, "property"), F.lit("og:")) & (attribute_of(t, "content") != ""), F.lit(False)))
    entries = F.reverse(F.transform(metas, lambda t: F.struct(F.get(F.split(attribute_of(t, "property"), ":"), F.lit(1)).alias("k"), attribute_of(t, "content").alias("v"))))
    last = bound(entries, lambda es: bound(F.transform(es, lambda x: x["k"]), lambda names: F.filter(es, lambda e, i: F.array_position(names, e["k"]) == i + 1)))
    return F.map_from_entries(F.reverse(last))


def publish_date(stream: Column) -> Column:
    """The date at the first mark that occurs, even if that is without one."""
    out = None
    for attribute, value, where in DATE_MARKS:
        found = having(stream, attribute, value)
        out = F.when(F.size(found) > 0, attribute_of(_first(found), where)) if out is None else out.when(F.size(found) > 0, attribute_of(_first(found), where))
    return out


def language(stream: Column) -> Column:
    """Two letters: of the html tag's lang, or else of the two meta tags that may name it."""
    metas = elements(stream, "meta")
    by_header, by_name = having(metas, "http-equiv", "content-language"), having(metas, "name", "lang")
    own = attribute_of(_first(elements(stream, "html")), "lang")
    said = F.when(own.isNotNull(), own).when(F.size(by_header) > 0, attribute_of(_first(by_header), "content")).when(F.size(by_name) > 0, attribute_of(_first(by_name), "content"))
    return F.lower(F.nullif(F.regexp_extract(F.substring(said, 1, 2), "^([A-Za-z]{2})$", 1), F.lit("")))


def named_content(stream: Column, name: str) -> Column:
    """Trimmed content of the first meta tag of exactly that name."""
    found = F.filter(elements(stream, "meta"), lambda t: F.coalesce(attribute_of(t, "name") == name, F.lit(False)))
    return F.coalesce(markup.trimmed(attribute_of(_first(found), "content")), F.lit(""))


def favicon(stream: Column) -> Column:
    return F.coalesce(attribute_of(_first(having(elements(stream, "link"), "rel", "icon")), "href"), F.lit(""))


def canonical(stream: Column, url: Column) -> Column:
    """The canonical link, from the root of the page's host where it is relative; else the page's own address."""

    def of(p: Column) -> Column:
        href, at = p["href"], p["url"]
        root = F.concat(links.scheme(at), F.lit("://"), links.host(at), F.lit("/"))
        whole = links.scheme(href).isin("http", "https") & links.host(href).isNotNull()
        return F.when(F.coalesce(at, F.lit("")) == "", at).when(F.coalesce(href, F.lit("")) == "", at).when(whole, href).otherwise(F.coalesce(links.resolve(href, root), href))

    href = markup.trimmed(attribute_of(_first(having(elements(stream, "link"), "rel", "canonical")), "href"))
    return bound(F.struct(href.alias("href"), url.alias("url")), of)


def tags(stream: Column) -> Column:
    """Texts of links marked as tags, or else of links to tag pages; distinct, in order."""
    anchors = elements(stream, "a")
    marked = F.filter(anchors, lambda t: F.coalesce(attribute_of(t, "rel") == "tag", F.lit(False)))
    linked = F.filter(anchors, lambda t: F.coalesce(F.exists(F.array(*[F.lit(x) for x in TAG_ADDRESSES]), lambda x: F.contains(attribute_of(t, "href"), x)), F.lit(False)))
    texts = F.transform(F.when(F.size(marked) > 0, marked).otherwise(linked), lambda t: _link_text(stream, t))
    return F.array_distinct(F.filter(texts, lambda t: t != ""))


def _link_text(stream: Column, link: Column) -> Column:
    """Text up to the link's end, or to the next link, as links don't nest."""
    rest = F.slice(stream, link["at"] + 2, F.size(stream))
    end = F.coalesce(_first(F.filter(rest, lambda t: t["tag"] == "a"))["at"], F.size(stream))
    inside = F.filter(F.slice(rest, 1, end - link["at"] - 1), lambda t: t["text"].isNotNull())
    return markup.squeezed(F.array_join(F.transform(inside, lambda t: t["text"]), " "))


def authors(stream: Column) -> Column:
    """Text of the first name within (or on) each element marked as author; distinct, in order."""

    def name(t: Column) -> Column:
        inside = F.slice(stream, t["at"] + 1, markup.end_of(stream, t) - t["at"])
        first = _first(having(inside, "itemprop", "name"))
        return F.when(first.isNotNull(), markup.text_within(stream, first))

    return F.array_distinct(F.filter(F.transform(having(stream, "itemprop", "author"), name), lambda n: n.isNotNull()))


def _without(text: Column, part: Column) -> Column:
    """Text without the first place of part, any case, and trimmed."""
    at = F.position(F.lower(part), F.lower(text))
    return F.when((F.coalesce(part, F.lit("")) != "") & (at > 0), markup.trimmed(F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part))))).otherwise(text)


def clean_title(title: Column, site: Column, domain: Column) -> Column:
    """A title without the site's name, the domain and a splitter at either end."""
    at = F.position(site, title)
    bare = F.when((F.coalesce(site, F.lit("")) != "") & (at > 0), markup.trimmed(F.concat(F.substr(title, F.lit(1), at - 1), F.substr(title, at + F.length(site))))).otherwise(title)
    words = F.filter(F.split(markup.squeezed(_without(bare, domain)), " "), lambda w: w != "")
    words = F.when(F.get(words, F.lit(0)).isin(*TITLE_ENDS), F.slice(words, 2, 2**30)).otherwise(words)
    words = F.when(F.try_element_at(words, F.lit(-1)).isin(*TITLE_ENDS), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    return F.array_join(words, " ")


def said_title(stream: Column, graph: Column) -> Column:
    """The title as the page gives it: og:title, else the first headline, else the title tag's text."""
    headline = having(elements(stream, "meta"), "name", "headline")
    shown = _first(elements(stream, "title"))["text"]
    own = F.try_element_at(graph, F.lit("title"))
    return F.when(own.isNotNull(), own).when(F.size(headline) > 0, F.coalesce(attribute_of(_first(headline), "content"), F.lit(""))).otherwise(F.coalesce(markup.squeezed(shown), F.lit("")))


def page_metadata(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, title, domain, lang, description, keywords, favicon, canonical, opengraph, publishDate, tags, authors of each page with html."""
    # The stream is null where html is.  Filtered behind a generator: else Spark works out html, however it is made, in the filter as well.
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("address"), F.explode_outer(F.array(markup.stream(F.col(body)))).alias("stream")).filter("stream IS NOT NULL")
    rows = rows.withColumns({"opengraph": open_graph(F.col("stream")), "domain": links.host(F.col("address"))})
    s = F.col("stream")
    return rows.select(
        F.col("key").alias(key), clean_title(said_title(s, F.col("opengraph")), F.try_element_at("opengraph", F.lit("site_name")), F.col("domain")).alias("title"), "domain", language(s).alias("lang"),
        named_content(s, "description").alias("description"), named_content(s, "keywords").alias("keywords"), favicon(s).alias("favicon"), canonical(s, F.col("address")).alias("canonical"),
        "opengraph", publish_date(s).alias("publishDate"), tags(s).alias("tags"), authors(s).alias("authors"),
    )
