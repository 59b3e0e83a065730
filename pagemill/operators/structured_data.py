"""schema.org articles and events of pages on VARIANT: scripts, records and fields by built-in functions alone.

A page's scripts become an array of variants and the records in them an array of maps, in the order in which a walk from the
top meets them.  All is one projection and an explode, so a page is never shuffled and no rows are gathered.

Broken scripts are left out, as are those with text behind their value and, unless spark.sql.variant.allowDuplicateKeys is
set, those that name a member twice.  Pages without records give no events and a null article.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links, markup
from ..functions.markup import bound
from ..functions.structured import ARTICLE_TYPES, EVENT_TYPES, PLACE_PARTS
from . import metadata

_VARIANTS = "array<variant>"
_MEMBERS = "map<string,variant>"


def _items(value: Column) -> Column:
    """The items of an array, null for anything else."""
    return value.try_cast(_VARIANTS)


def _members(value: Column) -> Column:
    """The members of an object, null for anything else."""
    return value.try_cast(_MEMBERS)


def _member(record: Column, name: str) -> Column:
    return F.try_element_at(record, F.lit(name))


def parsed(raw: Column) -> Column:
    """The variant of a whole JSON text.  The parser stops behind the first value, so a mark that must follow it is parsed along."""
    read = F.struct(F.md5(raw).alias("mark"), raw.alias("raw"))
    both = bound(read, lambda r: F.struct(r["mark"].alias("mark"), F.try_parse_json(F.concat(F.lit("["), r["raw"], F.lit(',"'), r["mark"], F.lit('"]'))).alias("value")))

    def whole(b: Column) -> Column:
        ends = F.try_variant_get(b["value"], F.lit("$[1]"), "string") == b["mark"]
        return F.when(ends & F.try_variant_get(b["value"], F.lit("$[2]"), "variant").isNull(), F.try_variant_get(b["value"], F.lit("$[0]"), "variant"))

    return bound(both, whole)


def json_scripts(page: Column) -> Column:
    """Contents of a page's JSON-LD scripts that are not blank, as text, in order."""
    scripts = markup.having(markup.contents(page, "script"), "type", r"^application/ld\+json\z")
    return F.filter(F.transform(scripts, lambda s: s["text"]), lambda t: markup.trimmed_left(t) != "")


def records(scripts: Column, lists: tuple[str, ...], objects: tuple[str, ...] = (), wanted: Callable[[Column], Column] = lambda members: F.lit(True)) -> Column:
    """The objects of JSON texts whose members are wanted, through arrays, the members named in lists (arrays only) and in objects (arrays and objects).

    Levels are taken one after another; each value has a path, and paths in order give the order of a walk from the top: an
    object before what it holds.  There are no more levels than opening brackets in a text, which bounds the steps.  Members and
    items are copies of what a value holds, so each value is opened once: objects is false for a member that counts as an array only.
    """
    kind = "array<struct<path:array<int>,objects:boolean,value:variant>>"

    def child(path: Column, place: Column, whole: bool, value: Column) -> Column:
        return F.struct(F.concat(path, F.array(place.cast("int"))).alias("path"), F.lit(whole).alias("objects"), value.alias("value"))

    def held(node: Column) -> Column:
        inner = F.array(*[child(node["path"], F.lit(i), name in objects, _member(node["members"], name)) for i, name in enumerate(lists + objects)])
        return F.when(node["members"].isNotNull(), F.filter(inner, lambda c: c["value"].isNotNull())).otherwise(F.transform(node["items"], lambda v, i: child(node["path"], i, True, v)))

    top = F.transform(scripts, lambda s, i: F.struct(F.array(i).alias("path"), F.lit(True).alias("objects"), parsed(s).alias("value")))
    start = F.struct(F.array().cast("array<struct<path:array<int>,value:map<string,variant>>>").alias("seen"), F.filter(top, lambda n: n["value"].isNotNull()).cast(kind).alias("open"))

    def opened(n: Column) -> Column:
        return F.struct(n["path"].alias("path"), F.when(n["objects"], _members(n["value"])).alias("members"), _items(n["value"]).alias("items"))

    def level(s: Column, _: Column) -> Column:
        def step(met: Column) -> Column:
            records_met = F.transform(F.filter(met, lambda n: n["members"].isNotNull() & wanted(n["members"])), lambda n: F.struct(n["path"].alias("path"), n["members"].alias("value")))
            return F.struct(F.concat(s["seen"], records_met).alias("seen"), F.flatten(F.filter(F.transform(met, held), lambda h: h.isNotNull())).cast(kind).alias("open"))

        return bound(F.transform(s["open"], opened), step)

    def taken(s: Column, levels: Column) -> Column:
        return F.reduce(F.array_repeat(F.lit(0), levels), s, lambda s, x: F.when(done(s), s).otherwise(level(s, x)))

    def done(s: Column) -> Column:
        return F.coalesce(F.size(s["open"]), F.lit(0)) == 0

    # Brackets are counted only where some levels, which nearly all texts end within, are not enough.
    most = F.coalesce(F.array_max(F.transform(scripts, lambda s: F.regexp_count(s, F.lit(r"[\[{]")))), F.lit(0))
    seen = F.reduce(F.array(F.lit(False), F.lit(True)), start, lambda s, more: taken(s, F.when(done(s), 0).when(more, most).otherwise(12)))["seen"]
    ordered = F.array_sort(seen, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return F.transform(ordered, lambda n: n["value"])


def _leaves(value: Column) -> Column:
    """A value as an array; an array's items with the arrays among them opened, in order."""

    def opened(values: Column) -> Column:
        return F.flatten(F.transform(values, lambda v: F.coalesce(_items(v), F.array(v))))

    def of(v: Column) -> Column:
        nested = F.exists(_items(v), lambda i: _items(i).isNotNull())
        inner = F.reduce(F.array_repeat(F.lit(0), F.regexp_count(F.to_json(v), F.lit(r"\["))), _items(v), lambda s, _: opened(s))
        return F.when(v.isNull(), F.array().cast(_VARIANTS)).when(_items(v).isNull(), F.array(v)).when(nested, inner).otherwise(_items(v))

    return bound(value, of)


def _plain_kind(v: Column) -> Column:
    """The type of a string, number or truth value; null for arrays and objects."""
    return F.schema_of_variant(F.when(_items(v).isNull() & _members(v).isNull(), v))


def _string(value: Column) -> Column:
    """A string as it stands; null for anything else."""
    return bound(value, lambda v: F.when(_plain_kind(v) == "STRING", v.try_cast("string")))


def _written(number: Column) -> Column:
    """A number as scripts write it."""
    far = (F.abs(number) >= 1e21) | ((F.abs(number) < 1e-6) & (number != 0))
    digits = F.regexp_replace(F.regexp_replace(F.lower(number.cast("string")), r"\.0(?=e)", ""), r"e(?=\d)", "e+")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string").try_cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(far, digits).otherwise(plain)


def _said(value: Column, numbers: bool = False) -> Column:
    """A string that is not blank, trimmed; with numbers, also a number as scripts write it."""

    def of(known: Column) -> Column:
        v, kind = known["v"], known["kind"]
        text = F.when(kind == "STRING", bound(markup.trimmed(v.try_cast("string")), lambda t: F.when(t != "", t)))
        return F.when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), bound(v.try_cast("double"), _written)).otherwise(text) if numbers else text

    return bound(bound(value, lambda v: F.struct(v.alias("v"), _plain_kind(v).alias("kind"))), of)


def _is_type(value: Column, known: frozenset[str]) -> Column:
    return F.exists(_leaves(value), lambda v: F.coalesce(F.lower(_string(v)).isin(sorted(known)), F.lit(False)))


def _names(value: Column) -> Column:
    """Names in a string, an object or an array of them."""
    each = F.transform(_leaves(value), lambda v: F.coalesce(_string(v), _string(_member(_members(v), "name"))))
    return F.filter(each, lambda n: n.isNotNull())


def _first_item(value: Column) -> Column:
    """The first item of an array, of that item where it is an array again, and so on; anything else as it is."""

    def of(v: Column) -> Column:
        depth = F.coalesce(F.regexp_count(F.to_json(v), F.lit(r"\[")), F.lit(0))
        deep = F.reduce(F.array_repeat(F.lit(0), depth), v, lambda s, _: F.when(_items(s).isNotNull(), F.get(_items(s), F.lit(0))).otherwise(s))
        return F.when(_items(v).isNull(), v).otherwise(deep)

    return bound(value, of)


def _picture(value: Column) -> Column:
    return bound(_first_item(value), lambda v: F.coalesce(_string(v), _string(_member(_members(v), "url"))))


def _keywords(value: Column) -> Column:
    def of(v: Column) -> Column:
        listed = F.filter(F.transform(_items(v), _string), lambda k: k.isNotNull())
        cut = F.filter(F.transform(F.split(_string(v), ","), markup.trimmed), lambda k: k != "")
        return F.coalesce(listed, cut, F.array().cast("array<string>"))

    return bound(value, of)


def _address(value: Column) -> Column:
    def of(v: Column) -> Column:
        parts = bound(_members(v), lambda m: F.array(*[_said(_member(m, k), True) for k in PLACE_PARTS]))
        return F.when(_members(v).isNotNull(), F.nullif(F.array_join(parts, ", "), F.lit(""))).otherwise(_string(v))

    return bound(value, of)


def _location(value: Column) -> Column:
    none = F.lit(None).cast("string")

    def of(v: Column) -> Column:
        named = bound(_members(v), lambda m: F.struct(_said(_member(m, "name"), True).alias("name"), _address(_member(m, "address")).alias("address"), _said(_member(m, "url"), True).alias("url")))
        known = bound(named, lambda n: F.when(F.coalesce(n["name"], n["address"], n["url"]).isNotNull(), n))
        return F.when(_plain_kind(v) == "STRING", F.struct(v.try_cast("string").alias("name"), none.alias("address"), none.alias("url"))).otherwise(known)

    return bound(_first_item(value), of)


def _offers(value: Column) -> Column:
    each = bound(value, lambda v: F.filter(F.transform(F.coalesce(_items(v), F.array(v)), _members), lambda m: m.isNotNull()))
    return F.transform(each, lambda m: F.struct(*[_said(_member(m, k), True).alias(k) for k in ("price", "priceCurrency", "url")]))


def _status(value: Column) -> Column:
    last = F.element_at(F.split(_said(value, True), "/"), -1)
    return F.nullif(F.lower(F.regexp_replace(last, "^Event", "")), F.lit(""))


def page_events(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row per schema.org event of each page, of all its scripts; pages without html (a failed fetch) raise when they are read."""
    page = F.when(F.col(body).isNull(), F.raise_error(F.concat(F.lit("no page for "), F.coalesce(F.col(url), F.lit("?")))).cast("string")).otherwise(F.col(body))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("address"), json_scripts(page).alias("scripts"))
    # The outer form, as for the other Spark adds a filter that works all records out a second time.
    found = rows.select("key", "address", F.explode_outer(records(F.col("scripts"), ("@graph", "itemListElement"), ("item",), lambda r: _is_type(_member(r, "@type"), EVENT_TYPES))).alias("r")).filter("r IS NOT NULL")
    r = F.col("r")
    said = {new: _said(_member(r, old), True) for new, old in (("title", "name"), ("description", "description"), ("startDate", "startDate"), ("endDate", "endDate"), ("url", "url"))}
    return found.select(
        F.col("key").alias(key), said["title"].alias("title"), said["description"].alias("description"), said["startDate"].alias("startDate"), said["endDate"].alias("endDate"),
        _status(_member(r, "eventStatus")).alias("eventStatus"), _location(_member(r, "location")).alias("location"), _picture(_member(r, "image")).alias("imageUrl"), said["url"].alias("url"),
        F.get(_names(_member(r, "organizer")), F.lit(0)).alias("organizer"), _names(_member(r, "performer")).alias("performers"), _offers(_member(r, "offers")).alias("offers"), F.col("address").alias("sourceUrl"),
    )


def article_record(page: Column) -> Column:
    """The members of a page's first schema.org article, null without one."""
    return F.get(bound(json_scripts(page), lambda s: records(s, ("@graph",), wanted=lambda r: _is_type(_member(r, "@type"), ARTICLE_TYPES))), F.lit(0))


def article_fields(record: Column) -> Column:
    """The fields of an article's record; null for a null record."""
    return F.when(
        record.isNotNull(),
        F.struct(
            F.coalesce(_said(_member(record, "headline")), _said(_member(record, "name"))).alias("title"),
            _said(_member(record, "articleBody")).alias("text"),
            _said(_member(record, "description")).alias("description"),
            _names(_member(record, "author")).alias("authors"),
            F.coalesce(_said(_member(record, "datePublished")), _said(_member(record, "dateCreated"))).alias("publishDate"),
            _keywords(_member(record, "keywords")).alias("tags"),
            _picture(_member(record, "image")).alias("imageUrl"),
        ),
    )


def page_articles(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """key and the fields of the first article record of each page that has one."""
    one = bound(article_record(F.col(body)), lambda r: F.filter(F.array(article_fields(r)), lambda a: a.isNotNull()))
    found = pages.select(F.col(key).alias("key"), F.explode_outer(one).alias("a")).filter("a IS NOT NULL")
    return found.select(F.col("key").alias(key), "a.*")


def thin_articles(pages: DataFrame, least_text: int = 250, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Articles of pages that show fewer than least_text characters, as pages do whose text is put in by scripts.

    There the first article record with a text wins wherever it says something: title, text, description, authors, date and tags; else stands
    what the page says about itself.  cleanedText is null where there is some text on the page but no record with one: such a page needs the whole extraction,
    as do those that show more.
    """

    def visible(stream: Column) -> Column:
        shown = F.filter(stream, lambda t: (t["tag"] == markup.TEXT) & (markup.squeezed(t["text"]) != ""))
        return F.length(markup.squeezed(F.array_join(F.transform(shown, lambda t: t["text"]), " ")))

    # Filtered behind a generator: else Spark works out html and its stream, from where they are made, in the filter as well.
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("address"), F.col(body).alias("html"))
    read = bound(markup.stream(F.col("html")), lambda s: F.struct(s.alias("stream"), visible(s).alias("shown")))
    rows = rows.select("key", "address", "html", F.explode_outer(F.array(read)).alias("p")).select("key", "address", "html", "p.*").filter(F.col("shown") < least_text)
    rows = rows.withColumns({"graph": metadata.open_graph(F.col("stream")), "domain": links.host(F.col("address")), "r": article_record(F.col("html"))})
    s = F.col("stream")
    own = F.struct(
        metadata.clean_title(metadata.said_title(s, F.col("graph")), F.try_element_at("graph", F.lit("site_name")), F.col("domain")).alias("title"), metadata.named_content(s, "description").alias("description"),
        metadata.publish_date(s).alias("publishDate"), metadata.authors(s).alias("authors"), metadata.tags(s).alias("tags"),
    )
    rows = rows.select("key", "address", "shown", own.alias("own"), article_fields(F.col("r")).alias("said")).withColumn("wins", F.col("said.text").isNotNull())

    def either(name: str, fits: Column) -> Column:
        return F.when(F.col("wins") & fits, F.col(f"said.{name}")).otherwise(F.col(f"own.{name}")).alias(name)

    return rows.select(
        F.col("key").alias(key), *[either(n, F.col(f"said.{n}").isNotNull()) for n in ("title", "description", "publishDate")], *[either(n, F.size(f"said.{n}") > 0) for n in ("authors", "tags")],
        F.when(F.col("wins"), F.col("said.text")).when(F.col("shown") == 0, "").alias("cleanedText"), F.col("said.imageUrl").alias("imageUrl"), F.col("wins").alias("fromJsonLd"),
    )
