"""One page to one article: metadata, main text, links, media and lead image.

The main text is found in the tree: paragraphs with enough stop words score
for their parent and grandparent, the best one is cleaned and printed.  Texts
are measured once a node between changes of the tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from . import structured
from .htmltree import COMMENT, TEXT, Node, fragment, parse, squeezed, text_of, to_xml
from .links import host_of, normal_url, resolved
from .stopwords import WordStats, count_words, short_lists

# Attribute patterns of parts that are not main text, in the order in which they are applied.
NOT_CONTENT = (
    "^side$|combx|retweet|mediaarticlerelated|menucontainer|navbar|storytopbar-bucket|utility-bar|inline-share-tools|comment|PopularQuestions|contact|"
    "foot|footer|Footer|footnote|cnn_strycaptiontxt|cnn_html_slideshow|cnn_strylftcntnt|^links$|meta$|shoutbox|sponsor|tags|socialnetworking|"
    "socialNetworking|cnnStryHghLght|cnn_stryspcvbx|^inset$|pagetools|post-attributes|welcome_form|contentTools2|the_answers|communitypromo|"
    "runaroundLeft|subscribe|vcard|articleheadings|date|^print$|popup|author-dropdown|tools|socialtools|byline|konafilter|KonaFilter|breadcrumbs|"
    "^fn$|wp-caption-text|legende|ajoutVideo|timestamp|js_replies"
)
MORE_NOT_CONTENT = ("^caption$", " google ", "^[^entry-]more.*$", "[^-]facebook", "facebook-broadcasting", "[^-]twitter")
BLOCKS_IN_DIV = ("a", "blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")
# Marks of a page's main text.
MAIN_TEXT = (("itemprop", "articleBody"), ("class", "post-content"), (None, "article"))
# Video providers, and names of pictures that are never the lead image.
VIDEO_PROVIDERS = ("youtube", "vimeo", "dailymotion", "kewego")
BAD_PICTURE = re.compile(r"\.html|\.gif|\.ico|button|twitter\.jpg|facebook\.jpg|ap_buy_photo|digg\.jpg|digg\.png|delicious\.png|facebook\.png|reddit\.jpg|doubleclick|diggthis|diggThis|adserver|/ads/|ec\.atdmt\.com|mediaplex\.com|adsatt|view\.atdmt")
KNOWN_PICTURE_BOXES = ("yn-story-related-media", "cnn_strylccimg300cntr", "big_photo", "ap-smallphoto-a")
TITLE_ENDS = ("|", "-", "»", ":")
DATE_MARKS = (("property", "rnews:datePublished", "content"), ("property", "article:published_time", "content"), ("name", "OriginalPublicationDate", "content"), ("itemprop", "datePublished", "datetime"))

#: (source of a picture) -> (bytes, width, height) or None.
PictureSource = Callable[[str], "tuple[int, int, int] | None"]


@dataclass(frozen=True)
class ArticleOptions:
    """stop_words: lists by language; word_kind: how words are cut, see count_words; pictures: None leaves the lead image out."""

    stop_words: dict[str, frozenset[str]] = field(default_factory=short_lists)
    target_language: str = "en"
    use_meta_language: bool = True
    word_kind: str = "plain"
    json_ld_fallback: bool = True
    least_text: int = 250
    pictures: PictureSource | None = None
    picture_boxes: dict[str, str] = field(default_factory=dict)


def _utf16(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


class _Page:
    """A page while it is read: its tree and what is known of its texts."""

    def __init__(self, source: str, url: str, options: ArticleOptions):
        self.root, self.url, self.options = parse(source), url, options
        self.raw = self.root.copy()
        self.scope = self.root
        self.listed: frozenset[str] = frozenset()
        self.counted: dict[tuple[str, frozenset[str]], WordStats] = {}

    def stats(self, text: str) -> WordStats:
        """Counted once a text, as a paragraph is looked at for itself and for its neighbours."""
        known = self.counted.get((text, self.listed))
        if known is None:
            known = self.counted[text, self.listed] = count_words(text, self.listed, self.options.word_kind)
        return known

    def stops(self, node: Node) -> int:
        return self.stats(text_of(node)).stop_words

    def parent(self, node: Node) -> Node | None:
        return None if node is self.root else node.up


# -- metadata


def _first(nodes: list[Node], attr: str) -> str | None:
    return nodes[0].attrs.get(attr) if nodes else None


def open_graph(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in root.elements("meta"):
        name, content = m.attrs.get("property", ""), m.attrs.get("content")
        if name.startswith("og:") and content:
            out[name.split(":")[1]] = content
    return out


def publish_date(root: Node) -> str | None:
    for attr, value, where in DATE_MARKS:
        found = root.matching(attr, value)
        if found:
            return found[0].attrs.get(where)
    return None


def canonical(root: Node, url: str) -> str:
    href = (_first(root.matching("rel", "canonical", "link"), "href") or "").strip() if url else ""
    if not href:
        return url
    if normal_url(href):
        return href
    base = normal_url(url)
    if base is None:
        return href
    scheme, _, rest = base.partition("://")
    return resolved(href, f"{scheme}://{host_of(base)}/") or href


def meta_language(root: Node) -> str | None:
    said = root.attrs.get("lang")
    if said is None:
        for attr, value in (("http-equiv", "content-language"), ("name", "lang")):
            found = root.matching(attr, value, "meta")
            if found:
                said = found[0].attrs.get("content")
                break
    start = (said or "")[:2]
    return start.lower() if re.fullmatch("[A-Za-z]{2}", start) else None


def named_content(root: Node, name: str) -> str:
    return next((m.attrs.get("content", "").strip() for m in root.elements("meta") if m.attrs.get("name") == name), "")


def tags(root: Node) -> list[str]:
    links = [a for a in root.elements("a") if a.attrs.get("rel") == "tag"]
    if not links:
        links = [a for a in root.elements("a") if any(x in a.attrs.get("href", "") for x in ("/tag/", "/tags/", "/topic/", "?keyword="))]
    return list(dict.fromkeys(t for t in map(text_of, links) if t))


def authors(root: Node) -> list[str]:
    named = ((n, n.matching("itemprop", "name")) for n in root.matching("itemprop", "author"))
    return list(dict.fromkeys(text_of(found[0]) for _, found in named if found))


def clean_title(title: str, site: str | None, domain: str | None) -> str:
    if site:
        title = title.replace(site, "", 1).strip()
    if domain:
        title = re.sub(re.escape(domain), "", title, count=1, flags=re.I).strip()
    words = title.split()
    if words[:1] and words[0] in TITLE_ENDS:
        words = words[1:]
    if words and words[-1] in TITLE_ENDS:
        words = words[:-1]
    return " ".join(words)


def page_title(root: Node, graph: dict[str, str], domain: str | None) -> str:
    found = root.matching("name", "headline", "meta")
    if "title" in graph:
        said = graph["title"]
    elif found:
        said = found[0].attrs.get("content") or ""
    else:
        shown = root.elements("title")
        said = text_of(shown[0]) if shown else ""
    return clean_title(said, graph.get("site_name"), domain)


# -- cleaning


def main_text_root(root: Node) -> Node | None:
    for attr, value in MAIN_TEXT:
        found = root.matching(attr, value) if attr else root.elements(value)
        if found:
            return found[0]
    return None


def _drop_parts(top: Node) -> None:
    for body in top.elements("body")[:1]:
        body.attrs.pop("class", None)
    for part in top.elements("article"):
        for attr in ("id", "name", "class"):
            part.attrs.pop(attr, None)
    for em in top.elements("em"):
        if not em.elements("img"):
            em.dissolve()
    for span in top.elements("span"):
        if {"dropcap", "drop_cap"} & set(span.attrs.get("class", "").split()):
            span.dissolve()
    for part in [*top.elements("script", "style"), *[n for n in top.walk() if n.tag == COMMENT]]:
        part.detach()
    for attr in ("id", "class", "name"):
        for part in top.matching(attr, NOT_CONTENT):
            part.detach()
    for pattern in MORE_NOT_CONTENT:
        for attr in ("id", "class"):
            for part in top.matching(attr, pattern):
                part.detach()
    for p in top.elements("p"):
        for span in p.elements("span"):
            span.dissolve()


def _regrouped(box: Node) -> list[Node]:
    """Children of a box with its loose text, and the links beside it, gathered in new spans."""
    kids = list(box.kids)
    used: set[int] = set()
    eaten: list[Node] = []
    out: list[Node] = []
    loose: list[str] = []

    def flush() -> None:
        if loose:
            made = next((n for n in fragment(f"<span>{''.join(loose)}</span>").walk() if n.tag == "span"), None)
            if made is not None:
                out.append(made)
            loose.clear()

    def eat(i: int, step: int) -> None:
        """Take in the unused links next to text i, going one way."""
        i += step
        while 0 <= i < len(kids) and kids[i].tag == "a" and i not in used and kids[i].attrs.get("grv-usedalready") != "yes":
            loose.append(f" {to_xml(kids[i])} ")
            kids[i].attrs["grv-usedalready"] = "yes"
            used.add(i)
            eaten.append(kids[i])
            i += step

    for i, kid in enumerate(kids):
        if kid.tag == TEXT:
            words = squeezed(kid.text).replace("^\\s+$", "")
            if len(words) > 1:
                eat(i, -1)
                loose.append(words)
                eat(i, 1)
        elif kid.tag == "p" and loose:
            flush()
            out.append(kid)
        else:
            out.append(kid)
    flush()
    for n in eaten:
        n.detach()
    return out


def _boxes_to_paragraphs(top: Node, tag: str) -> None:
    for box in top.elements(tag):
        if not box.elements(*BLOCKS_IN_DIV):
            box.tag = "p"
            continue
        new = _regrouped(box)
        for k in box.kids:
            k.up = None
        box.kids = []
        for k in new:
            box.add(k)


# -- scoring


def link_heavy(node: Node) -> bool:
    links = node.elements("a")
    if not links:
        return False
    words = len(text_of(node).split(" "))
    linked = len("".join(map(text_of, links)).split(" "))
    return linked / words * len(links) >= 1


def _supported(page: _Page, node: Node) -> bool:
    """Whether one of the three nearest paragraphs before this node has substance."""
    near = [n for n in node.earlier() if n.tag == "p"][:3]
    return any(page.stops(n) > 5 for n in near)


def best_node(page: _Page) -> Node | None:
    nodes = [n for tag in ("p", "pre", "td") for n in page.scope.elements(tag)]
    rated = [(n, s) for n, s in ((n, page.stops(n)) for n in nodes) if s > 2 and not link_heavy(n)]
    total, quarter, boosts = len(rated), len(rated) * 0.25, 0
    seen: list[Node] = []
    for i, (node, stops) in enumerate(rated):
        boost = 0.0
        if _supported(page, node):
            boosts += 1
            boost = 50 / boosts
        if total > 15 and total - i <= quarter:
            depth = (quarter - (total - i)) ** 2
            boost = 5 if depth > 40 else -depth
        gain, target = int(stops + boost), page.parent(node)
        for share in (gain, int(gain / 2)):
            if target is None or not target.is_element:
                break
            if target.score is None:
                target.score, target.hits = 0, 0
                seen.append(target)
            target.score += share
            target.hits += 1
            target = page.parent(target)
    top = max(seen, key=lambda n: n.score, default=None)
    return top if top is not None and top.score > 0 else (seen[0] if seen else None)


def _is_main_text(node: Node) -> bool:
    return any(node.attrs.get(attr) == value if attr else node.tag == value for attr, value in MAIN_TEXT)


def _add_neighbours(page: _Page, top: Node) -> None:
    """Bring in paragraphs of the siblings before the best node that read like its own."""
    if _is_main_text(top):
        return
    own = [s for s in (page.stops(p) for p in top.elements("p") if not link_heavy(p)) if s > 2]
    usual = sum(own) // len(own) if own else 100_000
    for sibling in top.earlier():
        if sibling.tag == "p" and text_of(sibling):
            sibling.detach()
            top.add(sibling, 0)
            continue
        for p in sibling.elements("p"):
            text = text_of(p)
            if text and page.stats(text).stop_words > usual * 0.3 and not link_heavy(p):
                made = Node("p")
                made.add(Node(TEXT, text=text))
                top.add(made, 0)


def _drop_poor_children(top: Node) -> None:
    def no_paragraph(node: Node) -> bool:
        for p in node.elements("p"):
            if _utf16(text_of(p)) < 25:
                p.detach()
        return node.tag != "td" and not node.elements("p")

    for kid in [k for k in top.kids if k.is_element and k.tag != "p"]:
        poor = kid.tag != "td" and (kid.score or 0) < (top.score or 0) * 0.08
        if link_heavy(kid) or no_paragraph(kid) or poor:
            kid.detach()


def printed(page: _Page, top: Node) -> str:
    """Plain text of the best node: one block for each child that is left."""
    for n in top.elements("a"):
        n.dissolve()
    for br in top.elements("br"):
        br.kids = []
        br.add(Node(TEXT, text="\\n"))
    for n in top.elements("b", "strong", "i", "br", "sup"):
        n.dissolve()
    for n in reversed(top.elements()):
        text = text_of(n)
        few = page.stats(text).stop_words < 3 and not n.elements("object", "embed") and not (n.tag == "br" and text == "\\r")
        if few or (text.startswith("(") and text.endswith(")")):
            n.detach()
    blocks = (squeezed(html.unescape(t)).split("\\n") for t in map(text_of, top.kids) if t)
    return "\n\n".join(b for block in blocks for b in block)


# -- media


def tweets(top: Node) -> list[str]:
    return [to_xml(n) for n in top.matching("class", "twitter-tweet", "blockquote")]


def _provider(src: str | None) -> str | None:
    return next((p for p in VIDEO_PROVIDERS if p in (src or "")), None)


def videos(top: Node) -> list[dict[str, str | None]]:
    out = []
    for n in top.elements("iframe", "embed", "object"):
        src = n.attrs.get("src")
        if n.tag == "object":
            films = n.matching("name", "movie", "param")
            src = films[0].attrs.get("value") if films else None
        elif n.tag == "embed" and n.up is not None and n.up.tag == "object":
            continue  # the object speaks for it
        if _provider(src):
            code = "".join(line.strip() for line in re.split(r"\r?\n", to_xml(n)))
            out.append({"embedType": n.tag, "provider": _provider(src), "width": n.attrs.get("width"), "height": n.attrs.get("height"), "embedCode": code, "src": src})
    return out


def _picture(url: str, kind: str, score: float, pictures: PictureSource) -> dict[str, Any]:
    size = pictures(url) or (0, 0, 0)
    return {"url": url, "bytes": size[0], "width": size[1], "height": size[2], "type": kind, "confidence": score}


def _banner(w: int, h: int) -> bool:
    return w != h and max(w, h) > 5 * min(w, h)


def lead_image(page: _Page, top: Node, domain: str | None) -> dict[str, Any]:
    get = page.options.pictures

    def path(src: str) -> str:
        return resolved(src, page.url) or src

    boxes = [*KNOWN_PICTURE_BOXES, *filter(None, page.options.picture_boxes.get((domain or "").replace("www.", "", 1), "").split("|"))]
    for attr in ("id", "class"):
        for box in boxes:
            for n in page.raw.matching(attr, box):
                shown = n if n.tag == "img" else next(iter(n.elements("img")), None)
                if shown is not None:
                    if shown.attrs.get("src"):
                        return _picture(path(shown.attrs["src"]), "known", 90, get)
                    break
    node, depth = top, 0
    while node is not None:
        named = [i for i in node.elements("img") if i.attrs.get("src") and not BAD_PICTURE.search(i.attrs["src"])]
        sized = [(u, get(u)) for u in (path(i.attrs["src"]) for i in named[:31])]
        fitting = [(u, s) for u, s in sized if s and (s[0] == 0 or s[0] > 4000) and s[0] < 15_728_640][:30]
        wide = [(u, s) for u, s in fitting if s[1] > (300 if depth else 50) and not _banner(s[1], s[2])]
        if wide:
            first = wide[0][1][1] * wide[0][1][2] * 1.48
            scores = [1.0] + [s[1] * s[2] / first / k for k, (_, s) in enumerate(wide[1:], 2)] if first else [1.0] * len(wide)
            url, size = wide[max(range(len(wide)), key=lambda k: scores[k])]
            return {"url": url, "bytes": 0, "width": size[1], "height": size[2], "type": "bigimage", "confidence": 100 / len(wide)}
        if depth > 2:
            break
        before = node.earlier()
        if before:
            node = before[0]
        else:
            node, depth = page.parent(node), depth + 1
    for found, attr, kind in ((page.raw.matching("rel", "image_src", "link"), "href", "linktag"), (page.raw.matching("property", "og:image", "meta"), "content", "opengraph")):
        src = next((n.attrs[attr] for n in found if n.attrs.get(attr)), None)
        if src:
            return _picture(path(src), kind, 100, get)
    return {"url": "", "bytes": 0, "width": 0, "height": 0, "type": "", "confidence": 0.0}


# -- all of it


def extract(source: str, url: str | None = None, options: ArticleOptions | None = None) -> dict[str, Any]:
    """All article fields of one page."""
    options, url = options or ArticleOptions(), (url or "").replace("#!", "?_escaped_fragment_=", 1)
    page = _Page(source, url, options)
    root, domain = page.root, host_of(url)
    graph, lang = open_graph(root), meta_language(root)
    out: dict[str, Any] = {
        "opengraph": graph, "publishDate": publish_date(root), "lang": lang, "favicon": _first(root.matching("rel", "icon", "link"), "href") or "",
        "description": named_content(root, "description"), "keywords": named_content(root, "keywords"), "canonical": canonical(root, url), "domain": domain,
        "tags": tags(root), "authors": authors(root), "title": page_title(root, graph, domain), "finalUrl": url,
        "cleanedText": "", "links": [], "tweets": [], "movies": [], "image": None, "fromJsonLd": False,
    }
    spoken = lang if options.use_meta_language and lang else options.target_language
    page.listed = options.stop_words.get(spoken, frozenset())
    page.scope = main_text_root(root) or root
    _drop_parts(page.scope)
    for tag in ("div", "span"):
        _boxes_to_paragraphs(page.scope, tag)
    top = best_node(page)
    if top is not None:
        out["links"] = [a.attrs["href"] for a in top.elements("a") if a.attrs.get("href")]
        out["tweets"], out["movies"] = tweets(top), videos(top)
        if options.pictures is not None:
            out["image"] = lead_image(page, top, domain)
        _add_neighbours(page, top)
        _drop_poor_children(top)
        out["cleanedText"] = printed(page, top)
    if options.json_ld_fallback and _utf16(out["cleanedText"].strip()) < options.least_text:
        data = structured.article(page.raw)
        if data and data["text"]:
            out["fromJsonLd"] = True
            out["cleanedText"] = data["text"]
            for name, value in (("title", data["title"]), ("description", data["description"]), ("authors", data["authors"]), ("publishDate", data["publishDate"]), ("tags", data["tags"])):
                out[name] = value or out[name]
            if out["image"] is None and data["imageUrl"] and options.pictures is not None:
                out["image"] = _picture(data["imageUrl"], "json-ld", 100, options.pictures)
    return out
