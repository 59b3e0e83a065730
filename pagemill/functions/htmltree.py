"""HTML text to a tree of nodes, by the public HTML tree-building rules that ordinary pages need.

Covered: implied html, head and body; void and raw-text elements; character
references; paragraphs, list items, table parts and options that end
implicitly; re-opening of unclosed formatting elements (three alike at most);
misnested formatting; content that a table does not allow goes before it.
Not covered: templates, frames, foreign (SVG, MathML) content rules.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TEXT, COMMENT = "#text", "#comment"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset(["title", "textarea"])
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p pre section summary table ul xmp".split()
)
SPECIAL = ENDS_P | frozenset("applet area base body br button caption col colgroup dd dt embed frame head html iframe img input li link marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot th thead title tr track ul wbr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript".split())
WALLS = frozenset("applet caption html table td th marquee object template".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())
_MARKERS = frozenset("applet marquee object td th caption".split())

_MARKUP = re.compile(r"<!--(?P<note>.*?)(?:--!?>|\Z)|<(?:!|\?|/(?![a-zA-Z]))[^>]*>|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<open>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<torn>[a-zA-Z][^\s/>]*)(?P<bits>[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*|[\"'][^\s=/>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_BLANK = re.compile(r"[ \t\n\f\r]*\Z")


class Node:
    """An element, text or comment; `up` is its parent."""

    __slots__ = ("attrs", "kids", "tag", "text", "up", "score", "hits")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs if attrs is not None else {}, text
        self.kids: list[Node] = []
        self.up: Node | None = None
        self.score = self.hits = None

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order; safe for any depth."""
        pending = [self]
        while pending:
            n = pending.pop()
            yield n
            pending.extend(reversed(n.kids))

    def elements(self, *tags: str) -> list[Node]:
        """Elements below this one with one of the tags (any, if none is given)."""
        return [n for n in self.walk() if n is not self and n.is_element and (not tags or n.tag in tags)]

    def matching(self, attr: str, pattern: str, tag: str | None = None) -> list[Node]:
        """Elements whose attribute holds the pattern (any case); this one too, unless a tag is asked for."""
        search = re.compile(pattern, re.I).search
        return [n for n in self.walk() if attr in n.attrs and n.is_element and (tag is None or (n.tag == tag and n is not self)) and search(n.attrs[attr])]

    def place(self) -> int:
        return next(i for i, k in enumerate(self.up.kids) if k is self)

    def add(self, kid: Node, at: int | None = None) -> None:
        kid.up = self
        self.kids.insert(len(self.kids) if at is None else at, kid)

    def detach(self) -> None:
        if self.up is not None and any(k is self for k in self.up.kids):
            del self.up.kids[self.place()]

    def dissolve(self) -> None:
        """Put the children in this node's place."""
        if self.up is None or not any(k is self for k in self.up.kids):
            return
        i = self.place()
        for k in self.kids:
            k.up = self.up
        self.up.kids[i : i + 1] = self.kids

    def earlier(self) -> list[Node]:
        """Element siblings before this one, the nearest first."""
        if self.up is None or not any(k is self for k in self.up.kids):
            return []
        return [k for k in reversed(self.up.kids[: self.place()]) if k.is_element]

    def copy(self) -> Node:
        top = Node(self.tag, dict(self.attrs), self.text)
        pending = [(self, top)]
        while pending:
            old, new = pending.pop()
            for k in old.kids:
                twin = Node(k.tag, dict(k.attrs), k.text)
                new.add(twin)
                pending.append((k, twin))
        return top


class _Builder:
    def __init__(self) -> None:
        self.root, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.root.add(self.head)
        self.stack: list[Node] = [self.root]
        self.active: list[Node | None] = []  # open formatting elements; None is a wall
        self.in_body = self.head_done = False

    # -- the stack of open elements

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def has(self, tags: frozenset | tuple, walls: frozenset = WALLS) -> bool:
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in walls:
                return False
        return False

    def pop_to(self, tags: frozenset | tuple) -> None:
        while self.stack.pop().tag not in tags:
            pass

    def close_p(self) -> None:
        if self.has(("p",), WALLS | {"button"}):
            self.pop_to(("p",))

    def start_body(self) -> None:
        if not self.in_body:
            self.in_body = self.head_done = True
            self.root.add(self.body)
            self.stack = [self.root, self.body]

    def put(self, node: Node) -> None:
        """Add a node at the insertion point; before the table where the table does not allow it."""
        if self.top.tag in ("table", "tbody", "tfoot", "thead", "tr") and node.tag not in TABLE_PARTS and node.tag not in ("script", "style", COMMENT):
            i = max(i for i, n in enumerate(self.stack) if n.tag == "table")
            table = self.stack[i]
            target = (table.up, table.place()) if table.up is not None else (self.stack[i - 1], None)
        else:
            target = (self.top, None)
        parent, at = target
        if node.tag == TEXT:
            before = parent.kids[(len(parent.kids) if at is None else at) - 1] if parent.kids and at != 0 else None
            if before is not None and before.tag == TEXT:
                before.text += node.text
                return
        parent.add(node, at)

    def push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.put(node)
        self.stack.append(node)
        return node

    # -- formatting elements

    def reopen(self) -> None:
        i = len(self.active)
        while i and self.active[i - 1] is not None and not any(n is self.active[i - 1] for n in self.stack):
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.push(old.tag, dict(old.attrs))

    def remember(self, node: Node) -> None:
        alike = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                alike.append(n)
        if len(alike) >= 3:
            self.active = [n for n in self.active if n is not alike[-1]]
        self.active.append(node)

    def end_formatting(self, tag: str) -> None:
        """Close a formatting element that may be misnested (the adoption agency rules)."""
        if self.top.tag == tag and not any(n is self.top for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            wall = max((i for i, n in enumerate(self.active) if n is None), default=-1)
            spot = next((i for i in range(len(self.active) - 1, wall, -1) if self.active[i].tag == tag), None)
            if spot is None:
                self.end_other(tag)
                return
            node = self.active[spot]
            depth = next((i for i, n in enumerate(self.stack) if n is node), None)
            if depth is None:
                del self.active[spot]
                return
            if not self.has((tag,)):
                return
            block = next((i for i in range(depth + 1, len(self.stack)) if self.stack[i].tag in SPECIAL), None)
            if block is None:
                del self.stack[depth:]
                del self.active[spot]
                return
            furthest, above = self.stack[block], self.stack[depth - 1]
            bookmark, last = spot, furthest
            inner = 0
            for i in range(block - 1, depth, -1):
                n = self.stack[i]
                inner += 1
                at = next((k for k, a in enumerate(self.active) if a is n), None)
                if inner > 3 and at is not None:
                    del self.active[at]
                    bookmark -= at < bookmark
                    at = None
                if at is None:
                    del self.stack[i]
                    continue
                twin = Node(n.tag, dict(n.attrs))
                self.active[at] = self.stack[i] = twin
                if last is furthest:
                    bookmark = at + 1
                last.detach()
                twin.add(last)
                last = twin
            last.detach()
            keep, self.stack = self.stack, self.stack[: next(i for i, n in enumerate(self.stack) if n is above) + 1]
            self.put(last)
            self.stack = keep
            twin = Node(node.tag, dict(node.attrs))
            for k in list(furthest.kids):
                twin.add(k)
            furthest.kids = []
            furthest.add(twin)
            at = next(k for k, a in enumerate(self.active) if a is node)
            del self.active[at]
            self.active.insert(bookmark - (at < bookmark), twin)
            self.stack = [n for n in self.stack if n is not node]
            self.stack.insert(next(i for i, n in enumerate(self.stack) if n is furthest) + 1, twin)

    # -- tokens

    def text(self, data: str) -> None:
        if not data:
            return
        if not self.in_body:
            if _BLANK.match(data):
                return
            self.start_body()
            data = data.lstrip(" \t\n\f\r") or data
        if self.top.tag == "colgroup" or (self.top.tag in ("table", "tbody", "tfoot", "thead", "tr") and _BLANK.match(data)):
            self.top.add(Node(TEXT, text=data))
            return
        self.reopen()
        self.put(Node(TEXT, text=data))

    def raw(self, tag: str, attrs: dict[str, str], data: str) -> None:
        node = Node(tag, attrs)
        if data:
            node.add(Node(TEXT, text=data))
        if not self.in_body and tag in HEAD_ONLY:
            self.head.add(node)
            return
        self.start_body()
        if tag in ("xmp",):
            self.close_p()
        self.put(node)

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body", "head"):
            if tag == "body":
                self.start_body()
            target = {"html": self.root, "body": self.body, "head": self.head}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            return
        if not self.in_body and tag in HEAD_ONLY and tag != "noscript":
            self.head.add(Node(tag, attrs))
            return
        self.start_body()
        if tag in ENDS_P:
            self.close_p()
        if tag in HEADINGS and self.top.tag in HEADINGS:
            self.stack.pop()
        elif tag == "li":
            self._end_item(("li",))
        elif tag in ("dd", "dt"):
            self._end_item(("dd", "dt"))
        elif tag in ("option", "optgroup") and self.top.tag == "option":
            self.stack.pop()
        elif tag == "button" and self.has(("button",)):
            self.pop_to(("button",))
        elif tag == "image":
            tag = "img"
        elif tag in TABLE_PARTS:
            if not self.has(("table",), frozenset(["html"])):
                return
            self._table_part(tag)
        elif tag == "table" and self.top.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            self.pop_to(("table",))
        if tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.end_formatting("a")
                    self.active = [x for x in self.active if x is not n]
                    self.stack = [x for x in self.stack if x is not n]
                    break
        elif tag == "nobr" and self.has(("nobr",)):
            self.end_formatting("nobr")
        if tag in FORMATTING:
            self.reopen()
            self.remember(self.push(tag, attrs))
            return
        if tag not in ENDS_P and tag not in TABLE_PARTS and tag not in ("li", "dd", "dt", "param", "source", "track"):
            self.reopen()
        node = self.push(tag, attrs)
        if tag in VOID:
            self.stack.pop()
        elif tag in _MARKERS:
            self.active.append(None)
        self.last = node

    def _end_item(self, tags: tuple) -> None:
        for n in reversed(self.stack):
            if n.tag in tags:
                self.pop_to(tags)
                break
            if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                break
        self.close_p()

    def _table_part(self, tag: str) -> None:
        def back(to: tuple) -> None:
            while self.top.tag not in to:
                n = self.stack.pop()
                if n.tag in _MARKERS:
                    self._drop_wall()

        if tag in ("td", "th"):
            back(("tr", "tbody", "tfoot", "thead", "table"))
            if self.top.tag == "table":
                self.push("tbody", {})
            if self.top.tag != "tr":
                self.push("tr", {})
        elif tag == "tr":
            back(("tbody", "tfoot", "thead", "table"))
            if self.top.tag == "table":
                self.push("tbody", {})
        elif tag == "col":
            back(("colgroup", "table"))
            if self.top.tag == "table":
                self.push("colgroup", {})
        else:
            back(("table",))

    def _drop_wall(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            self.start_body()
            return
        if tag == "head":
            return
        if not self.in_body:
            if tag != "br":
                return
            self.start_body()
        if tag == "p":
            if not self.has(("p",), WALLS | {"button"}):
                self.put(Node("p"))
                return
            self.close_p()
        elif tag == "br":
            self.open("br", {})
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in HEADINGS:
            if self.has(HEADINGS):
                self.pop_to(HEADINGS)
        elif tag in TABLE_PARTS or tag == "table":
            if self.has((tag,), frozenset(["html", "table"]) - {tag}):
                while True:
                    n = self.stack.pop()
                    if n.tag in _MARKERS:
                        self._drop_wall()
                    if n.tag == tag:
                        break
        elif tag in ("applet", "marquee", "object"):
            if self.has((tag,)):
                self.pop_to((tag,))
                self._drop_wall()
        elif tag in SPECIAL:
            if self.has((tag,), WALLS | {"ol", "ul"} if tag == "li" else WALLS):
                self.pop_to((tag,))
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag in SPECIAL:
                return


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def parse(source: str) -> Node:
    """The html element of a page."""
    b = _Builder()
    source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    at = 0
    while True:
        m = _MARKUP.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            chunk = source[at:end]
            b.text(html.unescape(chunk) if "&" in chunk else chunk)
        if not m:
            break
        at = m.end()
        if m["note"] is not None:
            node = Node(COMMENT, text=m["note"])
            (b.top if b.in_body else b.head).add(node)
        elif m["close"]:
            b.close(m["close"].lower())
        elif m["open"] or m["torn"]:
            tag = (m["open"] or m["torn"]).lower()
            attrs = _attributes(m["rest"] or m["bits"] or "")
            if tag in RAW or tag in ESCAPABLE:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                data = source[at : stop.start() if stop else len(source)]
                at = stop.end() if stop else len(source)
                b.raw(tag, attrs, html.unescape(data) if tag in ESCAPABLE else data)
            else:
                b.open(tag, attrs)
    b.start_body()
    return b.root


def fragment(source: str) -> Node:
    """A body-like node with the parsed content of a piece of HTML."""
    b = _Builder()
    b.start_body()
    return parse("<body>" + source).kids[-1] if source else b.body


_XML_TEXT = {ord("&"): "&amp;", ord("<"): "&lt;", ord(">"): "&gt;", 0xA0: "&#xa0;"}
_XML_VALUE = _XML_TEXT | {ord('"'): "&quot;"}


def to_xml(node: Node) -> str:
    """The node as XML, empty elements closed in themselves."""
    out: list[str] = []
    pending: list[Node | str] = [node]
    while pending:
        n = pending.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == TEXT:
            out.append(n.text.translate(_XML_TEXT))
        elif n.tag == COMMENT:
            out.append(f"<!--{n.text}-->")
        else:
            head = n.tag + "".join(f' {k}="{v.translate(_XML_VALUE)}"' for k, v in n.attrs.items())
            if n.kids:
                out.append(f"<{head}>")
                pending.append(f"</{n.tag}>")
                pending.extend(reversed(n.kids))
            else:
                out.append(f"<{head}/>")
    return "".join(out)


def squeezed(text: str) -> str:
    return " ".join((text.replace("\ufeff", " ") if "\ufeff" in text else text).split())


def text_of(node: Node) -> str:
    """All text below, with a blank where one element meets another, white space squeezed."""
    if node.tag == TEXT:
        return squeezed(node.text)
    runs: list[str] = []
    joined = False
    pending: list[Node | None] = [node]
    while pending:
        n = pending.pop()
        if n is None or n.tag == COMMENT:
            joined = False
        elif n.tag == TEXT:
            if joined:
                runs[-1] += n.text
            elif n.text:
                runs.append(n.text)
                joined = True
        else:
            joined = False
            pending.append(None)
            pending.extend(reversed(n.kids))
    return squeezed(" ".join(runs))
