"""Pages to articles, events and nodes: one parse a page, in Arrow batches, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import structured
from ..functions.article import ArticleOptions, extract
from ..functions.htmltree import TEXT, parse, squeezed, text_of
from ..functions.stopwords import count_words

_S = T.StringType()
_LIST = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ARTICLE = _struct(
    meta=_struct(description=_S, lang=_S, keywords=_S, favicon=_S, canonical=_S),
    image=_struct(url=_S, bytes=T.LongType(), width=T.LongType(), height=T.LongType(), type=_S, confidence=T.DoubleType()),
    domain=_S, title=_S, cleanedText=_S, opengraph=T.MapType(_S, _S), tags=_LIST, tweets=_LIST,
    movies=T.ArrayType(_struct(embedType=_S, provider=_S, width=_S, height=_S, embedCode=_S, src=_S)),
    links=_LIST, authors=_LIST, publishDate=_S, finalUrl=_S, fromJsonLd=T.BooleanType(),
)
EVENT = _struct(
    title=_S, description=_S, startDate=_S, endDate=_S, eventStatus=_S, location=_struct(name=_S, address=_S, url=_S), imageUrl=_S, url=_S, organizer=_S,
    performers=_LIST, offers=T.ArrayType(_struct(price=_S, priceCurrency=_S, url=_S)), sourceUrl=_S,
)
NODE = _struct(
    node_id=T.IntegerType(), parent_id=T.IntegerType(), depth=T.IntegerType(), sib_ord=T.IntegerType(), kind=_S, tag=_S, attrs=T.MapType(_S, _S),
    text=_S, stop_count=T.IntegerType(), word_count=T.IntegerType(), link_count=T.IntegerType(), link_words=T.IntegerType(), last_id=T.IntegerType(),
)
_META = ("description", "lang", "keywords", "favicon", "canonical")


def _per_page(pages: DataFrame, make: Callable[[str, str | None], list[dict[str, Any]]], fields: T.StructType, key: str, url: str, body: str) -> DataFrame:
    """Rows key + fields: what make(html, url) gives for each page whose html is not null."""
    rows = pages.filter(F.col(body).isNotNull()).select(F.col(key).alias(key), F.col(url).alias("url"), F.col(body).alias("html"))
    schema = T.StructType([rows.schema[key], *fields.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[dict[str, Any]] = []
            size = 0
            for lo in range(0, b.num_rows, 50):
                for r in b.slice(lo, 50).to_pylist():
                    found = make(r["html"], r["url"])
                    made.extend({key: r[key], **m} for m in found)
                    size += len(r["html"]) + 200 * len(found)
                    if size > 4_000_000:  # bounds what a worker holds
                        yield pa.RecordBatch.from_pylist(made, schema=arrow)
                        made, size = [], 0
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.mapInArrow(run, schema)


def extract_articles(pages: DataFrame, options: ArticleOptions | None = None, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One article row per page with html."""
    options = options or ArticleOptions()

    def make(source: str, address: str | None) -> list[dict[str, Any]]:
        a = extract(source, address, options)
        a["meta"] = {k: a.pop(k) for k in _META}
        a["opengraph"] = list(a["opengraph"].items())
        return [a]

    return _per_page(pages, make, ARTICLE, key, url, body)


def extract_events(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row per schema.org event of each page; pages without html (a failed fetch) raise when they are read."""
    checked = pages.withColumn(body, F.when(F.col(body).isNull(), F.raise_error(F.concat(F.lit("no page for "), F.coalesce(F.col(url), F.lit("?")))).cast("string")).otherwise(F.col(body)))
    return _per_page(checked, lambda source, address: structured.events(parse(source), address or ""), EVENT, key, url, body)


def html_nodes(pages: DataFrame, stop_words: frozenset[str] = frozenset(), key: str = "page_id", url: str = "url", body: str = "html", counts: bool = True, texts: bool = True) -> DataFrame:
    """One row per node of each page's tree, with the counts that scoring needs; without counts the text and counts of elements are null.

    Nodes are numbered in document order; last_id is the number of the last one below a node, or its own.

    Counts are sums over runs of text, so their cost grows with the page alone.  An element's text is that of all below it, so its
    cost grows with the depth of the tree; without texts it is null.
    """

    def make(source: str, _: str | None) -> list[dict[str, Any]]:
        numbers: dict[int, int] = {}
        out: list[dict[str, Any]] = []
        nodes = list(parse(source).walk())
        for n in nodes:
            i = numbers[id(n)] = len(numbers)
            up = None if n.up is None else numbers[id(n.up)]
            row = {
                "node_id": i, "parent_id": up, "depth": 0 if up is None else out[up]["depth"] + 1, "sib_ord": 0,
                "kind": "element" if n.is_element else "text" if n.tag == TEXT else "comment", "tag": n.tag, "attrs": list(n.attrs.items()), "text": n.text,
                "stop_count": None, "word_count": None, "link_count": None, "link_words": None, "last_id": i,
            }
            if not n.is_element:
                stats = count_words(n.text, stop_words)
                row |= {"stop_count": stats.stop_words, "word_count": stats.words, "link_count": 0, "link_words": 0}
            else:
                row["text"] = text_of(n) if counts and texts else None
            out.append(row)
        # From the last node up, so that what is below a node is known before it.
        blanks = [0] * len(out)
        for n, row in zip(reversed(nodes), reversed(out), strict=True):
            if not n.is_element:
                continue
            i = row["node_id"]
            words = stops = links = 0
            run: list[str] = []
            for place, k in enumerate((*n.kids, None)):
                if k is not None and k.tag == TEXT:
                    out[numbers[id(k)]]["sib_ord"] = place
                    run.append(k.text)
                    row["last_id"] = numbers[id(k)]
                    continue
                if run and counts:
                    stats = count_words(squeezed("".join(run)), stop_words)
                    words, stops = words + stats.words, stops + stats.stop_words
                run = []
                if k is None:
                    continue
                low = out[numbers[id(k)]]
                low["sib_ord"], row["last_id"] = place, low["last_id"]
                if k.is_element and counts:
                    own = k.tag == "a"
                    words, stops, links = words + low["word_count"], stops + low["stop_count"], links + low["link_count"] + own
                    blanks[i] += blanks[low["node_id"]] + (max(low["word_count"] - 1, 0) if own else 0)
            if counts:
                row |= {"stop_count": stops, "word_count": words, "link_count": links, "link_words": blanks[i] + 1 if links else 0}
        return out

    return _per_page(pages, make, NODE, key, url, body)
