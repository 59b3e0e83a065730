"""HTML as a stream of tags by built-in functions: one pass of one pattern, no tree and no Python.

stream() gives an array of (at, tag, close, attrs, text): opening and closing tags and runs of text in document order.
Script, style, title and the like are one entry with their content in text; comments and declarations are left out.  That
is enough for head markup, scripts and elements found by their attributes; where elements end implicitly, html_nodes()
has the tree.  Character references are replaced in text and attributes.  A null page gives null, an empty one no entries.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT = "#text"
#: White space as browsers' scripts trim it.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_ENCLOSED = "script|style|title|textarea|xmp|iframe|noembed|noframes"
_INSIDE = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_TAG = (
    r"(?is)<!--(?:[^-]++|-(?!-!?>))*+(?:--!?>|\z)"
    rf"|<({_ENCLOSED})(?=[\s/>]){_INSIDE}>[^<]*+(?:<(?!/\1[\s/>])[^<]*+)*+(?:</\1[^>]*+>?)?"
    rf"|</?[a-z]{_INSIDE}>|</?[a-z][^>]*+>"
)
_TOKEN = _TAG + r"|<[!?/][^>]*+>|[^<]++|<"
_ATTRIBUTE = r"""(?s)([^\s=/>"'][^\s=/>]*+|["'][^\s=/>]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?"""
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _looked_up(name: Column, entries: dict[str, str]) -> Column:
    """What entries has for a name, null where it has none: a search in one constant text, which plans carry lightly."""
    table = F.lit("\n" + "".join(f"{k}\t{v}\n" for k, v in entries.items() if "\n" not in v and "\t" not in v))
    at = F.position(F.concat(F.lit("\n"), name, F.lit("\t")), table)
    return F.when(at > 0, F.substring_index(F.substr(table, at + F.length(name) + 2, F.lit(3)), "\n", 1))


def _character(number: Column) -> Column:
    """The character of a code point as pages mean it: Windows signs for 0x80 to 0x9F, U+FFFD for what is none."""
    windows = {str(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    known = _looked_up(number.cast("string"), {k: v for k, v in windows.items() if v})
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    none = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(none, F.lit("�")).otherwise(F.coalesce(known, plain))


def unescaped(text: Column, attribute: bool = False) -> Column:
    """Text with its character references replaced; in attributes a name without a semicolon counts only before a sign."""
    table = html.entities.html5
    order = [k for k in _COMMON if k in table] + [k for k in table if k not in _COMMON]
    old = "|".join(sorted((k for k in table if not k.endswith(";")), key=len, reverse=True))
    head = rf"^&(?:#[xX][0-9a-fA-F]++;?|#[0-9]++;?|[A-Za-z][A-Za-z0-9]*+;|(?:{old}){'(?![=A-Za-z0-9])' if attribute else ''})"

    def one(piece: Column) -> Column:
        return bound(F.regexp_extract(piece, head, 0), lambda said: meant(piece, said))

    def meant(piece: Column, said: Column) -> Column:
        digits = F.regexp_extract(said, "^&#[xX]?([0-9a-fA-F]+)", 1)
        base = F.when(said.rlike("^&#[xX]"), 16).otherwise(10)
        number = F.when(F.length(digits) > 9, F.lit(2**31)).when(base == 16, F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))
        sign = F.when(F.startswith(said, F.lit("&#")), _character(number)).otherwise(_looked_up(F.substr(said, F.lit(2)), {k: table[k] for k in order}))
        return F.when((said == "") | sign.isNull(), piece).otherwise(F.concat(sign, F.substr(piece, F.length(said) + 1)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


def attributes(tag: Column) -> Column:
    """Attributes of an opening tag by lower-cased name; of repeated names the first counts."""
    each = bound(F.regexp_extract(tag, r"(?s)^<[A-Za-z][^\s/>]*+(.*)>\z", 1), lambda inner: F.arrays_zip(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 1).alias("name"), F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 2).alias("value")))

    def entry(e: Column) -> Column:
        return F.struct(F.lower(e["name"]).alias("name"), unescaped(F.when(e["value"].rlike("^[\"']"), F.substr(e["value"], F.lit(2), F.length(e["value"]) - 2)).otherwise(e["value"]), attribute=True).alias("value"))

    def first(entries: Column) -> Column:
        return bound(F.transform(entries, lambda x: x["name"]), lambda names: F.filter(entries, lambda e, i: F.array_position(names, e["name"]) == i + 1))

    return F.map_from_entries(bound(F.transform(each, entry), first))


def trimmed(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(_SPACES))


def trimmed_left(text: Column) -> Column:
    """Text without white space at its beginning: tells a blank text at its first character, where an end is looked for from the whole."""
    return F.ltrim(text, F.lit(_SPACES))


def squeezed(text: Column) -> Column:
    """Text with each run of white space as one blank, and none at its ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def tags_of(page: Column) -> Column:
    """The tags of a page (script, style, title and the like with their content) and its comments, without the text between them."""
    return F.regexp_extract_all(page, F.lit(_TAG), 0)


def contents(page: Column, name: str) -> Column:
    """Attributes and content (attrs, text) of a page's elements of one of the names whose content is text alone, in order; content is raw."""
    found = F.filter(tags_of(page), lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))

    def entry(t: Column) -> Column:
        return bound(F.regexp_extract(t, rf"(?s)^(?:<[A-Za-z]{_INSIDE}>|<[A-Za-z][^>]*+>)", 0), lambda o: F.struct(given(o).alias("attrs"), inside(t, o).alias("text")))

    def given(opening: Column) -> Column:
        return F.when(opening.rlike(r"[\s=]"), attributes(opening)).otherwise(F.create_map().cast("map<string,string>"))

    def inside(t: Column, opening: Column) -> Column:
        # Most content has no end tag's beginning in it and one plain end tag behind it, which is told by searches for a fixed text; the pattern takes a step for each character.
        close = f"</{name}>"
        plain = F.when(F.endswith(t, F.lit(close)), F.substr(t, F.length(opening) + 1, F.length(t) - F.length(opening) - len(close)))
        matched = F.regexp_extract(t, rf"(?is)^<{name}{_INSIDE}>([^<]*+(?:<(?!/{name}[\s/>])[^<]*+)*+)", 1)
        return bound(plain, lambda p: F.when(F.contains(p, F.lit("</")) | p.isNull(), matched).otherwise(p))

    return F.transform(found, entry)


def tokens(page: Column) -> Column:
    """The page cut into tags (script, style, title and the like with their content) and runs of text."""
    return F.filter(F.regexp_extract_all(page, F.lit(_TOKEN), 0), lambda t: ~t.rlike(r"^<(?:[!?]|/(?![A-Za-z]))"))


def stream(page: Column) -> Column:
    """The entries of a page: array<struct<at:int, tag:string, close:boolean, attrs:map<string,string>, text:string>>."""
    return entries(tokens(page))


def entries(cut: Column) -> Column:
    """Tokens as entries, numbered from 0."""

    def entry(token: Column, at: Column) -> Column:
        opening = F.when(token.rlike("^<[A-Za-z]"), F.regexp_extract(token, rf"(?s)^(?:<[A-Za-z]{_INSIDE}>|<[A-Za-z][^>]*+>)", 0))
        tag = F.when(token.rlike("^</?[A-Za-z]"), F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))).otherwise(TEXT)
        return bound(F.struct(opening.alias("opening"), tag.alias("tag")), lambda head: filled(token, at, head["opening"], head["tag"]))

    def filled(token: Column, at: Column, opening: Column, tag: Column) -> Column:
        enclosed = tag.isin(*_ENCLOSED.split("|")) & opening.isNotNull()
        inside = F.regexp_replace(F.substr(token, F.length(opening) + 1), rf"(?is)</(?:{_ENCLOSED})(?=[\s/>])[^>]*+>?\z", "")
        return F.struct(
            at.alias("at"),
            tag.alias("tag"),
            F.startswith(token, F.lit("</")).alias("close"),
            F.when(opening.rlike(r"[\s=]"), attributes(opening)).when(opening.isNotNull(), F.create_map().cast("map<string,string>")).alias("attrs"),
            F.when(tag == TEXT, unescaped(token)).when(enclosed & tag.isin("title", "textarea"), unescaped(inside)).when(enclosed, inside).alias("text"),
        )

    return F.transform(cut, entry)


def elements(stream: Column, *tags: str) -> Column:
    """Opening tags (with one of the names, where any are given) in document order."""
    return F.filter(stream, lambda t: t["attrs"].isNotNull() & (t["tag"].isin(*tags) if tags else F.lit(True)))


def having(stream: Column, attribute: str, pattern: str) -> Column:
    """Those opening tags whose attribute holds the pattern, any case."""
    return F.filter(stream, lambda t: F.coalesce(F.try_element_at(t["attrs"], F.lit(attribute)).rlike(f"(?i){pattern}"), F.lit(False)))


def attribute_of(entry: Column, name: str) -> Column:
    return F.try_element_at(entry["attrs"], F.lit(name))


def end_of(stream: Column, entry: Column) -> Column:
    """Where in the stream an element ends: at its own closing tag, or with the page; for one without content, at itself."""
    start = F.struct(F.lit(1).alias("depth"), F.size(stream).alias("end"))

    def step(s: Column, t: Column) -> Column:
        move = F.when(t["tag"] != entry["tag"], 0).when(t["close"], -1).otherwise(1)
        depth = F.when(s["depth"] == 0, 0).otherwise(s["depth"] + move)
        return F.struct(depth.alias("depth"), F.when((s["depth"] > 0) & (depth == 0), t["at"]).otherwise(s["end"]).alias("end"))

    whole = F.reduce(F.slice(stream, entry["at"] + 2, F.size(stream)), start, step)["end"]
    return F.when(entry["tag"].isin(*VOID) | entry["text"].isNotNull(), entry["at"] + 1).otherwise(whole)


def text_within(stream: Column, entry: Column) -> Column:
    """Text of an element: its runs of text, a blank between them where a tag stood."""
    inside = F.slice(stream, entry["at"] + 1, end_of(stream, entry) - entry["at"])
    return squeezed(F.array_join(F.transform(F.filter(inside, lambda t: t["text"].isNotNull()), lambda t: t["text"]), " "))
