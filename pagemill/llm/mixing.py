"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: the budget is shared by weight, a
source stops at max_repeat times its own words, and what exceeds that is
shared again among the others.  With the sources in the order of cap / weight
the level at which that ends follows from prefix sums, so no loop is needed.

Within a source every document expects target / size copies.  The documents
are ordered by size, the expected copies are summed up along that order, one
offset is added, and a document is emitted once per integer boundary that its
share crosses.  As the order is by size, the words taken differ from the
target by about one large document at most.  Ranks come in two steps, counts
per (source, size band, salt) and a rank inside each such cell, so that a
source with most of the rows is spread over many tasks.

Only DataFrame functions are used.

Defined results: a null or empty text has size 0 and takes no words; null is
a source of its own, last in order; a source without words has target 0; an
empty table gives no rows.  Repeated rows are separate documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free_name, row_hash
from .storage import stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPlan:
    """weights: of the sources by code point, repeated as needed; budget: share of all words; salts: cells per size band."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    budget: float = 1.5
    max_repeat: float = 2.0
    bands_per_octave: int = 16
    salts: int = 64
    seed: int = 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex_digits(value: Column, seed: int, n: int) -> Column:
    """A number of n hexadecimal digits, drawn by a hash of value and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, n), 16, 10).cast("long")


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """(source, source_size, target) from rows (source, size): the capped proportional share of the budget."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in plan.weights]), (F.col("rank") % len(plan.weights) + 1).cast("int"))
    w = (
        per.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(plan.max_repeat))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(plan.budget))
    )
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fill", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source in this order that its level does not fill sets the level of all.
    w = w.withColumn("common", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(everything))
    share = F.coalesce(F.col("common.level") * F.col("weight"), F.col("cap"))
    return w.select("source", "source_size", F.least(F.col("cap"), share).alias("target"))


def mix_sources(docs: DataFrame, plan: MixPlan | None = None, text: str = "text", source: str = "source", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """Per document: key, source, size, source_size, target, copies, taken; with carry also row, a struct of all its columns."""
    plan = plan or MixPlan()
    size = word_count(F.col(text))
    octave = F.length(F.bin("size"))
    band = (octave * plan.bands_per_octave + F.expr(f"size * {plan.bands_per_octave} div shiftleft(1L, length(bin(size)) - 1)")).cast("long")
    sizes = (
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"))
        .withColumn("band", band)
        .withColumn("salt", (_hex_digits(F.col("key"), plan.seed, 4) % plan.salts).cast("long"))
    )
    full = None
    if carry:
        full = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")).select(
            F.col(f"row.{key}").alias("key"), F.col(f"row.{source}").alias("source"), word_count(F.col(f"row.{text}")).alias("size"), "row"
        )
        full = full.withColumn("band", band).withColumn("salt", (_hex_digits(F.col("key"), plan.seed, 4) % plan.salts).cast("long"))
    else:
        sizes = stored(sizes, "mix-sizes")
    cells = sizes.groupBy("source", "band", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    cells = stored(cells, "mix-cells")
    targets = source_targets(cells.select("source", "size"), plan).withColumn("offset", _hex_digits(F.col("source"), plan.seed, 12) / F.lit(float(16**12)))
    earlier = Window.partitionBy("source").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "band", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    cells = (
        cells.alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select("c.source", "c.band", "c.salt", "c.start", "t.source_size", "t.target", "t.offset")
    )
    own = Window.partitionBy("source", "band", "salt").orderBy("size", "key", *([row_hash(docs, "row.")] if carry else []))
    ranked = (full if carry else sizes).withColumn("nth", F.row_number().over(own))
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.band") == F.col("c.band")) & (F.col("d.salt") == F.col("c.salt"))
    placed = ranked.alias("d").join(cells.alias("c"), same).select("d.key", "d.source", "d.size", "d.nth", *(["d.row"] if carry else []), "c.start", "c.source_size", "c.target", "c.offset")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("start") + F.col("nth")
    copies = F.floor(F.col("offset") + upto * rate) - F.floor(F.col("offset") + (upto - 1) * rate)
    return placed.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *(["row"] if carry else []),
    )


def mixed(docs: DataFrame, plan: MixPlan | None = None, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its number from 1 in copy (copy_ where docs has that, and so on)."""
    rows = mix_sources(docs, plan, text, source, key, carry=True).filter("copies > 0")
    return rows.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(free_name(docs, "copy")))
