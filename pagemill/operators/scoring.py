"""Where a page's main text is: paragraphs score for the two nodes above them, as relational algebra over the table of nodes.

nodes is what html_nodes() gives: one row a node, numbered in document order within its page, with counts of words, stop words and
links.  All windows are within a page, so one exchange by page serves them; what joins are the ids of ancestors.  A page
is never gathered into one row or object.

Pages without a candidate have no scores and no top node.  A node without a parent scores for nobody, but counts among the
candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.article import MAIN_TEXT

#: Tags of candidates in the order in which they are looked at.
CANDIDATES = ("p", "pre", "td")


def _attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def link_heavy() -> Column:
    """Whether the words of a node's links, times their number, reach all its words."""
    words = F.greatest(F.coalesce("word_count", F.lit(0)), F.lit(1))
    return (F.coalesce("link_count", F.lit(0)) > 0) & (F.col("link_words") / words * F.col("link_count") >= 1)


def main_text_roots(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id) of the first node that bears the first mark of main text that occurs in its page."""
    rank = None
    for i, (attribute, value) in enumerate(MAIN_TEXT):
        fits = _attribute(attribute).rlike(f"(?i){value}") if attribute else (F.col("tag") == value) & F.col("parent_id").isNotNull()
        rank = F.when(fits, i) if rank is None else rank.when(fits, i)
    return nodes.filter("kind = 'element'").select(key, "node_id", rank.alias("mark")).filter("mark IS NOT NULL").groupBy(key).agg(F.min(F.struct("mark", "node_id")).alias("m")).select(key, F.col("m.node_id").alias("node_id"))


def below(nodes: DataFrame, roots: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes under the root that roots (key, node_id) names for their page, with root_id; a root itself is not under it.

    A node's descendants follow it, up to the next node that is no deeper.
    """
    named = roots.select(F.col(key).alias("_page"), F.col("node_id").alias("root_id"))
    both = nodes.join(named, F.col(key).eqNullSafe(F.col("_page"))).drop("_page")
    page = Window.partitionBy(key)
    depth = F.max(F.when(F.col("node_id") == F.col("root_id"), F.col("depth"))).over(page)
    both = both.withColumn("_depth", depth)
    end = F.min(F.when((F.col("node_id") > F.col("root_id")) & (F.col("depth") <= F.col("_depth")), F.col("node_id"))).over(page)
    return both.withColumn("_end", end).filter((F.col("node_id") > F.col("root_id")) & (F.col("_end").isNull() | (F.col("node_id") < F.col("_end")))).drop("_depth", "_end")


def supported(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Elements that can be candidates, with supported: whether one of the three nearest paragraphs before it among its siblings has over five stop words.

    The paragraphs among siblings are numbered; a candidate needs the number of the last strong one before it and that of the last one.
    """
    return _supported(nodes.filter(F.col("tag").isin(*CANDIDATES)), key)


def _supported(nodes: DataFrame, key: str) -> DataFrame:
    """nodes with supported, which other rows than candidates may be among."""
    before = Window.partitionBy(key, "parent_id").orderBy("sib_ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key, "parent_id").orderBy("sib_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.withColumn("_nth", F.count(F.when(F.col("tag") == "p", 1)).over(upto))
    last = F.count(F.when(F.col("tag") == "p", 1)).over(before)
    strong = F.max(F.when((F.col("tag") == "p") & (F.col("stop_count") > 5), F.col("_nth"))).over(before)
    return rows.withColumn("supported", F.coalesce(strong > last - 3, F.lit(False)) & F.col("parent_id").isNotNull()).drop("_nth")


def candidates(nodes: DataFrame, scope: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(key, node_id, parent_id, place, total, gain) of nodes with substance: what each adds to its parent.

    place counts from 0 in the order of the tags, then of the page; scope (key, node_id) leaves those under its nodes.
    """
    rows = supported(nodes, key)
    if scope is not None:
        inside = below(nodes.select(key, "node_id", "depth"), scope, key).select(F.col(key).alias("_page"), F.col("node_id").alias("_node"))
        outside = nodes.select(key).distinct().join(scope.select(F.col(key).alias("_page")), F.col(key).eqNullSafe(F.col("_page")), "left_anti")
        free = rows.join(outside.select(F.col(key).alias("_page")), F.col(key).eqNullSafe(F.col("_page")), "left_semi")
        rows = free.unionByName(rows.join(inside, F.col(key).eqNullSafe(F.col("_page")) & (F.col("node_id") == F.col("_node")), "left_semi"))
    return _gains(rows.filter(_substance()).withColumn("_counts", F.lit(True)), key).select(key, "node_id", "parent_id", "place", "total", "gain")


def _substance() -> Column:
    return F.col("tag").isin(*CANDIDATES) & F.coalesce((F.col("stop_count") > 2) & ~link_heavy(), F.lit(False))


def _gains(rows: DataFrame, key: str) -> DataFrame:
    """rows with place, total and gain among those with _counts; these columns mean nothing in the others."""
    tag_rank = F.array_position(F.array(*[F.lit(t) for t in CANDIDATES]), F.col("tag"))
    order = Window.partitionBy(key, "_counts").orderBy(tag_rank, "node_id")
    boosts = F.sum(F.col("supported").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"place": F.row_number().over(order) - 1, "boosts": boosts, "total": F.count(F.lit(1)).over(Window.partitionBy(key, "_counts"))})
    left, quarter = F.col("total") - F.col("place"), F.col("total") * 0.25
    tail = F.pow(quarter - left, F.lit(2))
    boost = F.when((F.col("total") > 15) & (left <= quarter), F.when(tail > 40, 5.0).otherwise(-tail)).when(F.col("supported"), 50.0 / F.nullif("boosts", F.lit(0))).otherwise(0.0)
    return rows.withColumn("gain", (F.col("stop_count") + boost).cast("int"))


def scores(nodes: DataFrame, scope: DataFrame | None = None, key: str = "page_id", label: Column | None = None) -> DataFrame:
    """(key, node_id, score, hits, seen, label) of the nodes that candidates score for: parents in full, grandparents by half.

    label is worked out on the nodes that are scored for.  All elements go through one exchange by page and are read once: a node's row meets those
    of its children, and then what it hands on meets its parent's.
    """
    rows = nodes.filter("kind = 'element'").select(key, "node_id", "parent_id", "sib_ord", "tag", "stop_count", "word_count", "link_count", "link_words", (F.lit(None).cast("string") if label is None else label).alias("label"))
    if scope is None:
        rows = _gains(_supported(rows.repartition(key), key).withColumn("_counts", _substance()), key)
        gain, place = F.when(F.col("_counts") & F.col("parent_id").isNotNull(), F.col("gain")), F.col("place")
    else:
        found = candidates(nodes, scope, key).select(F.col(key).alias("_page"), F.col("node_id").alias("_node"), "gain", "place")
        rows = rows.join(found, F.col(key).eqNullSafe(F.col("_page")) & (F.col("node_id") == F.col("_node")), "left")
        gain, place = F.when(F.col("parent_id").isNotNull(), F.col("gain")), F.col("place")
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def entry(node: Column, up: Column, label: Column, gain: Column, half: Column, seen: Column) -> Column:
        return F.struct(node.alias("node_id"), up.alias("up"), label.alias("label"), gain.alias("gain"), half.alias("half"), seen.alias("seen"))

    rows = rows.withColumns({"_gain": gain, "_seen": (place * 2).cast("int")})
    own = entry(F.col("node_id"), F.col("parent_id"), F.col("label"), none, none, none)
    said = F.when(F.col("_gain").isNull(), F.array(own)).otherwise(F.array(own, entry(F.col("parent_id"), none, text, F.col("_gain"), (F.col("_gain") / 2).cast("int"), F.col("_seen"))))
    met = rows.select(key, F.explode(said).alias("s")).select(key, "s.*").groupBy(key, "node_id").agg(
        F.max("up").alias("up"), F.max("label").alias("label"), F.sum("gain").alias("gain"), F.sum("half").alias("half"), F.count("gain").alias("hits"), F.min("seen").alias("seen")
    )
    full = F.struct("node_id", "label", F.col("gain").alias("share"), "hits", "seen")
    part = F.struct(F.col("up").alias("node_id"), text.alias("label"), F.col("half").alias("share"), "hits", (F.col("seen") + 1).alias("seen"))
    each = met.select(key, F.explode(F.when((F.col("hits") > 0) & F.col("up").isNotNull(), F.array(full, part)).otherwise(F.array(full))).alias("s")).select(key, "s.*")
    return each.groupBy(key, "node_id").agg(F.sum("share").alias("score"), F.sum("hits").alias("hits"), F.min("seen").alias("seen"), F.max("label").alias("label")).filter("hits > 0")


def top_nodes(nodes: DataFrame, scope: DataFrame | None = None, key: str = "page_id", label: Column | None = None) -> DataFrame:
    """(key, node_id, score, hits) of each page's best node: of the highest scores the one met first; where none is positive, the first met of all.

    With label, an expression over nodes, also what it is on that node.
    """
    more = [] if label is None else ["label"]
    best = F.max(F.struct("score", (-F.col("seen")).alias("early"), "node_id", "hits", "label")).alias("best")
    first = F.min(F.struct("seen", "node_id", "score", "hits", "label")).alias("first")
    picked = scores(nodes, scope, key, label).groupBy(key).agg(best, first)
    names = ["node_id", "score", "hits", *more]
    one = F.when(F.col("best.score") > 0, F.struct(*[f"best.{n}" for n in names])).otherwise(F.struct(*[f"first.{n}" for n in names]))
    return picked.select(key, one.alias("n")).select(key, "n.*")


def usual_stops(nodes: DataFrame, tops: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, usual): the mean of stop words, without its fraction, of the paragraphs with substance under each top node; 100,000 without any."""
    inside = below(nodes, tops, key).filter((F.col("tag") == "p") & (F.col("stop_count") > 2) & ~link_heavy())
    mean = inside.groupBy(key).agg(F.floor(F.avg("stop_count")).cast("int").alias("mean")).withColumnRenamed(key, "_page")
    return tops.select(key, "node_id").join(mean, F.col(key).eqNullSafe(F.col("_page")), "left").select(key, "node_id", F.coalesce("mean", F.lit(100_000)).alias("usual"))


def neighbours(nodes: DataFrame, tops: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, node_id, copied, text): paragraphs of the siblings before each top node that go before its own, by place from 1.

    A sibling that is a paragraph itself comes in as it is; of another one the paragraphs whose stop words pass three tenths of the
    usual ones, as text.  Nodes that are marked as main text take in nothing.
    """
    own = F.lit(False)
    for attribute, value in MAIN_TEXT:
        own = own | (F.coalesce(_attribute(attribute) == value, F.lit(False)) if attribute else F.col("tag") == value)
    u = usual_stops(nodes, tops, key).select(F.col(key).alias("_page"), F.col("node_id").alias("_top"), "usual")
    at = nodes.join(u, F.col(key).eqNullSafe(F.col("_page")) & (F.col("node_id") == F.col("_top"))).filter(~own & F.col("parent_id").isNotNull())
    at = at.select("_page", F.col("parent_id").alias("_parent"), F.col("sib_ord").alias("_ord"), F.col("depth").alias("_depth"), "_top", "usual")
    page = nodes.filter("kind = 'element'").join(at, F.col(key).eqNullSafe(F.col("_page")))
    # Up to the top node, each node at the top's depth under its parent is a sibling; what follows is below the last such one.
    sibling = (F.col("parent_id") == F.col("_parent")) & (F.col("node_id") < F.col("_top"))
    line = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = page.filter(F.col("node_id") < F.col("_top")).withColumns({"_own": sibling, "_is": F.last(F.when(sibling, F.struct("node_id", "tag", "text")), ignorenulls=True).over(line)})
    held = F.col("_own") | (F.col("depth") > F.col("_depth"))
    whole = F.col("_own") & (F.col("tag") == "p") & (F.coalesce(F.col("text"), F.lit("")) != "")
    part = ~F.col("_own") & held & ((F.col("_is.tag") != "p") | (F.coalesce(F.col("_is.text"), F.lit("")) == "")) & (F.col("tag") == "p") & (F.coalesce(F.col("text"), F.lit("")) != "") & (F.col("stop_count") > F.col("usual") * 0.3) & ~link_heavy()
    taken = page.filter(F.col("_is").isNotNull() & (F.col("node_id") > F.col("_is.node_id") - 1) & (whole | part))
    # Each is put first: the nearest sibling's come in first and so stand last, and what a sibling gives is reversed.
    put = Window.partitionBy(key).orderBy(F.col("_is.node_id").asc(), F.col("node_id").desc())
    return taken.select(key, F.row_number().over(put).alias("place"), "node_id", (~F.col("_own")).alias("copied"), "text")
