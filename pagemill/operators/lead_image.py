"""The lead image of pages, as joins of their picture references with a catalog of pictures of any size.

Pictures are looked for in the top node, then in the siblings before it from the nearest on, then in its parent and so on, up to its third
ancestor; the first of these places with a fitting picture decides.  Which places a page has and which pictures they hold follows
from the numbers of nodes.  Only distinct sources meet the catalog.  Pages without a fitting picture have what their link or
Open Graph tags name, and else an empty source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links
from ..functions.article import BAD_PICTURE, KNOWN_PICTURE_BOXES

# How many pictures of a place are looked up and rated, their sizes in bytes, and least widths in the top node and elsewhere.
LOOKED_UP, RATED = 31, 30
LEAST_BYTES, MOST_BYTES = 4000, 15_728_640
LEAST_WIDTH, LEAST_WIDTH_ELSEWHERE = 50, 300
ANCESTORS = 3


def _attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def places(nodes: DataFrame, tops: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, depth, distance, first_id, last_id) of the nodes in which a page's pictures are looked for, in that order."""
    n = nodes.filter("kind = 'element'").select(F.col(key).alias("page"), "node_id", "parent_id", "sib_ord", "last_id")
    line = tops.select(F.col(key).alias("page"), F.col("node_id").alias("at")).withColumn("depth", F.lit(0))
    line = line.join(n, (line["page"].eqNullSafe(n["page"])) & (F.col("at") == F.col("node_id"))).select(line["page"], "depth", "node_id", "parent_id", "sib_ord", "last_id")
    levels = [line]
    for depth in range(1, ANCESTORS + 1):
        below = levels[-1].select(F.col("page").alias("p"), F.col("parent_id").alias("up"))
        levels.append(below.join(n, F.col("p").eqNullSafe(F.col("page")) & (F.col("up") == F.col("node_id"))).select("page", F.lit(depth).alias("depth"), "node_id", "parent_id", "sib_ord", "last_id"))
    ancestors = levels[0]
    for level in levels[1:]:
        ancestors = ancestors.unionByName(level)
    a, s = ancestors.alias("a"), n.alias("s")
    before = a.filter(F.col("depth") < ANCESTORS).join(s, F.col("a.page").eqNullSafe(F.col("s.page")) & (F.col("a.parent_id") == F.col("s.parent_id")) & (F.col("s.sib_ord") < F.col("a.sib_ord")))
    before = before.select("a.page", "a.depth", (F.col("a.sib_ord") - F.col("s.sib_ord")).alias("distance"), F.col("s.node_id").alias("first_id"), "s.last_id")
    return ancestors.select("page", "depth", F.lit(0).alias("distance"), F.col("node_id").alias("first_id"), "last_id").unionByName(before)


def pictures(nodes: DataFrame, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page, node_id, src, path) of all img elements that name a source; path is the source from the page's address."""
    base = pages.select(F.col(key).alias("own"), F.col(url).alias("base"))
    shown = nodes.filter("tag = 'img'").select(F.col(key).alias("page"), "node_id", _attribute("src").alias("src")).filter("src <> ''")
    joined = shown.join(base, F.col("page").eqNullSafe(F.col("own")))
    return joined.select("page", "node_id", "src", F.coalesce(links.resolve(F.col("src"), F.col("base")), F.col("src")).alias("path"))


def big_images(nodes: DataFrame, tops: DataFrame, pages: DataFrame, catalog: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page, path, width, height, confidence) of the best picture of the first place that has a fitting one.

    catalog has src, bytes, width and height, one row a source.
    """
    named = pictures(nodes, pages, key, url).filter(~F.col("src").rlike(BAD_PICTURE.pattern)).alias("i")
    where = places(nodes, tops, key).alias("w")
    held = named.join(where, F.col("i.page").eqNullSafe(F.col("w.page")) & (F.col("i.node_id") > F.col("w.first_id")) & (F.col("i.node_id") <= F.col("w.last_id")))
    held = held.select("i.page", "i.node_id", "i.path", "w.depth", "w.distance")
    place = Window.partitionBy("page", "depth", "distance").orderBy("node_id")
    held = held.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= LOOKED_UP)
    known = held.select("path").distinct().join(catalog.select(F.col("src").alias("path"), "bytes", "width", "height"), "path")
    sized = held.join(known, "path").filter(((F.col("bytes") == 0) | (F.col("bytes") > LEAST_BYTES)) & (F.col("bytes") < MOST_BYTES))
    sized = sized.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= RATED)
    long, short = F.greatest("width", "height"), F.least("width", "height")
    wide = sized.filter((F.col("width") > F.when(F.col("depth") > 0, LEAST_WIDTH_ELSEWHERE).otherwise(LEAST_WIDTH)) & ~((F.col("width") != F.col("height")) & (long > 5 * short)))
    area = F.col("width").cast("double") * F.col("height")
    group = Window.partitionBy("page", "depth", "distance")
    rated = wide.withColumns({"nth": F.row_number().over(place), "n": F.count(F.lit(1)).over(group), "first": F.first(area).over(place) * 1.48})
    score = F.when((F.col("nth") == 1) | (F.col("first") == 0), 1.0).otherwise(area / F.col("first") / F.col("nth"))
    best = F.min(F.struct("depth", "distance", (-score).alias("less"), "nth", "path", "width", "height", "n")).alias("b")
    return rated.groupBy("page").agg(best).select("page", "b.path", "b.width", "b.height", (100.0 / F.col("b.n")).alias("confidence"))


def boxed_images(nodes: DataFrame, pages: DataFrame, boxes: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page, path) of the picture in a box that is known to hold the lead image: by names for all sites, and by boxes (domain, css) for some.

    For ids first and then for classes, each name's first box with a picture decides, and the first name whose picture has a source.
    boxes is a fixed table of sites and is broadcast.
    """
    host = F.regexp_replace(links.host(F.col(url)), r"^www\.", "")
    everywhere = F.array(*[F.lit(x) for x in KNOWN_PICTURE_BOXES])
    names = pages.select(F.col(key).alias("page"), host.alias("domain"), everywhere.alias("names"))
    if boxes is not None:
        sites = boxes.groupBy("domain").agg(F.first("css").alias("css")).select(F.col("domain").alias("site"), F.filter(F.split("css", r"\|"), lambda c: c != "").alias("own"))
        names = names.join(F.broadcast(sites), F.col("domain") == F.col("site"), "left").withColumn("names", F.when(F.col("own").isNotNull(), F.concat("names", "own")).otherwise(F.col("names")))
    named = names.select("page", F.posexplode("names").alias("nth", "name"))
    marked = nodes.filter("kind = 'element'").select(F.col(key).alias("p"), "node_id", "last_id", F.explode(F.array(F.struct(F.lit(0).alias("by"), _attribute("id").alias("value")), F.struct(F.lit(1).alias("by"), _attribute("class").alias("value")))).alias("m")).filter("m.value IS NOT NULL")
    hit = marked.join(named, F.col("p").eqNullSafe(F.col("page"))).filter(F.expr("m.value rlike concat('(?i)', name)")).select("page", "m.by", "nth", "node_id", "last_id").alias("h")
    shown = nodes.filter("tag = 'img'").select(F.col(key).alias("page"), "node_id", _attribute("src").alias("src")).alias("i")
    within = hit.join(shown, F.col("h.page").eqNullSafe(F.col("i.page")) & F.col("i.node_id").between(F.col("h.node_id"), F.col("h.last_id")))
    first = within.groupBy("h.page", "h.by", "h.nth").agg(F.min(F.struct(F.col("h.node_id").alias("box"), F.col("i.node_id").alias("img"), "i.src")).alias("f")).filter("f.src <> ''")
    one = first.groupBy("page").agg(F.min(F.struct("by", "nth", "f.src")).alias("o")).select("page", "o.src").alias("o")
    base = pages.select(F.col(key).alias("own"), F.col(url).alias("base"))
    return one.join(base, F.col("o.page").eqNullSafe(F.col("own"))).select("o.page", F.coalesce(links.resolve(F.col("src"), F.col("base")), F.col("src")).alias("path"))


def tagged_images(nodes: DataFrame, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page, path, type) of the picture that a page's link tag, or else its Open Graph tag, names."""
    said = nodes.filter(F.col("tag").isin("link", "meta")).select(
        F.col(key).alias("page"), "node_id",
        F.when((F.col("tag") == "link") & _attribute("rel").rlike("(?i)image_src"), F.struct(F.lit(0).alias("by"), _attribute("href").alias("src"), F.lit("linktag").alias("type")))
        .when((F.col("tag") == "meta") & _attribute("property").rlike("(?i)og:image"), F.struct(F.lit(1).alias("by"), _attribute("content").alias("src"), F.lit("opengraph").alias("type"))).alias("s"),
    ).filter("s.src <> ''")
    one = said.groupBy("page").agg(F.min(F.struct("s.by", "node_id", "s.src", "s.type")).alias("o")).select("page", "o.src", "o.type").alias("o")
    base = pages.select(F.col(key).alias("own"), F.col(url).alias("base"))
    return one.join(base, F.col("o.page").eqNullSafe(F.col("own"))).select("o.page", F.coalesce(links.resolve(F.col("src"), F.col("base")), F.col("src")).alias("path"), "type")


def lead_images(nodes: DataFrame, tops: DataFrame, pages: DataFrame, catalog: DataFrame, boxes: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, src, type, confidence, width, height) of each page with a top node; type is known, bigimage, linktag, opengraph or empty."""
    none = F.lit(None).cast("int")
    known = boxed_images(nodes, pages, boxes, key, url).select("page", F.lit(0).alias("by"), "path", F.lit("known").alias("type"), F.lit(90.0).alias("confidence"), none.alias("width"), none.alias("height"))
    big = big_images(nodes, tops, pages, catalog, key, url).select("page", F.lit(1).alias("by"), "path", F.lit("bigimage").alias("type"), "confidence", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    tagged = tagged_images(nodes, pages, key, url).select("page", F.lit(2).alias("by"), "path", "type", F.lit(100.0).alias("confidence"), none.alias("width"), none.alias("height"))
    best = known.unionByName(big).unionByName(tagged).groupBy("page").agg(F.min(F.struct("by", "path", "type", "confidence", "width", "height")).alias("b")).select("page", "b.*")
    rows = tops.select(F.col(key).alias("own")).join(best, F.col("own").eqNullSafe(F.col("page")), "left")
    sizes = catalog.select(F.col("src").alias("c_src"), F.col("width").cast("int").alias("c_width"), F.col("height").cast("int").alias("c_height"))
    rows = rows.join(sizes, F.col("path") == F.col("c_src"), "left")
    return rows.select(
        F.col("own").alias(key), F.coalesce("path", F.lit("")).alias("src"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("width", "c_width", F.lit(0)).alias("width"), F.coalesce("height", "c_height", F.lit(0)).alias("height"),
    )
