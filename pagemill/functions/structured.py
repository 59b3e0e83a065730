"""schema.org data in JSON scripts: articles and events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from .htmltree import TEXT, Node

# Lower-cased schema.org type names that count.
ARTICLE_TYPES = frozenset("article newsarticle blogposting report techarticle scholarlyarticle socialmediaposting advertisercontentarticle reviewarticle satiricalarticle opinionnewsarticle analysisnewsarticle".split())
EVENT_TYPES = frozenset("event musicevent sportsevent theaterevent comedyevent festival exhibitionevent foodevent literaryevent socialevent educationevent businessevent childrensevent dancevent screeningevent visualartsevent broadcastevent courseinstance".split())
PLACE_PARTS = ("streetAddress", "addressLocality", "addressRegion", "postalCode")


def _refuse(name: str) -> Any:
    raise ValueError(name)


def scripts(root: Node) -> list[Any]:
    """Parsed JSON-LD scripts of a page in order; broken ones are left out."""
    out = []
    for s in root.matching("type", r"^application/ld\+json$", "script"):
        raw = "".join(k.text for k in s.kids if k.tag == TEXT)
        if raw.strip():
            try:
                out.append(json.loads(raw, parse_constant=_refuse))
            except (ValueError, RecursionError):
                continue
    return out


def records(value: Any, into: tuple[str, ...]) -> Iterator[dict]:
    """All objects in value, through lists and the members named in `into`, in document order."""
    pending = [value]
    while pending:
        v = pending.pop()
        if isinstance(v, list):
            pending.extend(reversed(v))
        elif isinstance(v, dict):
            yield v
            inner = [v[k] for k in into if isinstance(v.get(k), list) or (k == "item" and isinstance(v.get(k), dict))]
            pending.extend(reversed(inner))


def _is_type(value: Any, known: frozenset[str]) -> bool:
    if isinstance(value, list):
        return any(_is_type(v, known) for v in value)
    return isinstance(value, str) and value.lower() in known


def _said(value: Any, numbers: bool = False) -> str | None:
    """A string that is not blank, trimmed; with numbers, also a number as it would be written in JSON."""
    if isinstance(value, str):
        return value.strip() or None
    if numbers and isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(value)
    return None


def _names(value: Any) -> list[str]:
    if isinstance(value, list):
        return [n for v in value for n in _names(v)]
    if isinstance(value, dict):
        value = value.get("name")
    return [value] if isinstance(value, str) else []


def _picture(value: Any) -> str | None:
    while isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("url")
    return value if isinstance(value, str) else None


def _keywords(value: Any) -> list[str]:
    if isinstance(value, list):
        return [v for v in value if isinstance(v, str)]
    return [p for p in (x.strip() for x in value.split(",")) if p] if isinstance(value, str) else []


def article(root: Node) -> dict[str, Any] | None:
    """Fields of the first article record of the page."""
    for data in scripts(root):
        for r in records(data, ("@graph",)):
            if _is_type(r.get("@type"), ARTICLE_TYPES):
                return {
                    "title": _said(r.get("headline")) or _said(r.get("name")),
                    "text": _said(r.get("articleBody")),
                    "description": _said(r.get("description")),
                    "authors": _names(r.get("author")),
                    "publishDate": _said(r.get("datePublished")) or _said(r.get("dateCreated")),
                    "tags": _keywords(r.get("keywords")),
                    "imageUrl": _picture(r.get("image")),
                }
    return None


def _address(value: Any) -> str | None:
    if isinstance(value, dict):
        return ", ".join(p for p in (_said(value.get(k), True) for k in PLACE_PARTS) if p) or None
    return value if isinstance(value, str) else None


def _location(value: Any) -> dict | None:
    while isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, str):
        return {"name": value, "address": None, "url": None}
    if isinstance(value, dict):
        made = {"name": _said(value.get("name"), True), "address": _address(value.get("address")), "url": _said(value.get("url"), True)}
        return made if any(made.values()) else None
    return None


def _status(value: Any) -> str | None:
    said = _said(value, True)
    return said.rpartition("/")[2].removeprefix("Event").lower() or None if said else None


def events(root: Node, source_url: str) -> list[dict[str, Any]]:
    """One record for each event of all scripts of the page."""
    out = []
    for data in scripts(root):
        for r in records(data, ("@graph", "itemListElement", "item")):
            if not _is_type(r.get("@type"), EVENT_TYPES):
                continue
            said = {k: _said(r.get(k), True) for k in ("name", "description", "startDate", "endDate", "url")}
            offers = r.get("offers")
            offers = offers if isinstance(offers, list) else [offers]
            out.append(
                {
                    "title": said["name"], "description": said["description"], "startDate": said["startDate"], "endDate": said["endDate"],
                    "eventStatus": _status(r.get("eventStatus")), "location": _location(r.get("location")), "imageUrl": _picture(r.get("image")), "url": said["url"],
                    "organizer": next(iter(_names(r.get("organizer"))), None), "performers": _names(r.get("performer")),
                    "offers": [{k: _said(o.get(k), True) for k in ("price", "priceCurrency", "url")} for o in offers if isinstance(o, dict)],
                    "sourceUrl": source_url,
                }
            )
    return out
