"""Secret scans through an incremental ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes.  Only
blobs that the ledger does not yet hold for the present rule version are
scanned, one copy each, and what they show is joined back to every path (row)
that holds the blob.  Only DataFrame functions are used: matches are bracketed
by two control characters, the text is split at them, and running sums of the
parts' lengths give the spans, in code points.

Defined results: a null text counts as empty and shows nothing; repeated rows
each get their row; control characters U+0001 and U+0002 in a text are taken
as one other character each, so spans stay right; any length is read whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free_name
from .storage import stored


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost non-overlapping matches; value_group, value_least: a match counts if that group is so long."""

    kind: str
    pattern: str
    value_group: int = 0
    value_least: int = 0
    needs: str | None = None


#: Kinds in the order in which spans at one place are listed.  The first three are the base kinds.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
)
BASE_KINDS = 3
_OPEN, _CLOSE = "\x01", "\x02"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _holds(text: Column, rule: Rule) -> Column:
    hit = F.rlike(text, F.lit(rule.pattern))
    return F.contains(text, F.lit(rule.needs)) & hit if rule.needs else hit


def unseen_blobs(docs: DataFrame, ledger: DataFrame | None, text: str, key: str, version: str) -> DataFrame:
    """(blob, text) of one copy of each blob that the ledger lacks for this rule version."""
    rows = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    chosen = rows.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:  # of (blob, rule_version)
        chosen = chosen.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    c, r = chosen.hint("shuffle_hash").alias("c"), rows.alias("r")
    return r.join(c, (F.col("r.blob") == F.col("c.blob")) & F.col("r.path").eqNullSafe(F.col("c.path")), "left_semi").select("blob", "text")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found: array of (start, rank, end, kind) by start and rank) of the blobs that show anything."""
    flagged = blobs.withColumns({f"has_{r.kind}": _holds(F.col("text"), r) for r in rules})
    any_hit = F.lit(False)
    for r in rules:
        any_hit = any_hit | F.col(f"has_{r.kind}")
    hits = flagged.filter(any_hit).dropDuplicates(["blob"]).withColumn("text", F.translate("text", _OPEN + _CLOSE, "��"))
    per_rule = [
        F.when(
            F.col(f"has_{r.kind}"),
            F.struct(F.lit(i).alias("rank"), F.split(F.regexp_replace("text", f"({r.pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN).alias("parts")),
        )
        for i, r in enumerate(rules)
    ]
    kinds = hits.select("blob", F.explode(F.array_compact(F.array(*per_rule))).alias("k"))
    parts = kinds.select("blob", F.col("k.rank").alias("rank"), F.posexplode("k.parts").alias("nth", "part"))
    match = F.substring_index("part", _CLOSE, 1)
    good = F.lit(True)
    for i, r in enumerate(rules):
        if r.value_least:
            good = F.when(F.col("rank") == i, F.length(F.regexp_extract(match, r.pattern, r.value_group)) >= r.value_least).otherwise(good)
    measured = parts.select(
        "blob",
        "rank",
        "nth",
        (F.length("part") - F.when(F.col("nth") > 0, 1).otherwise(0)).cast("long").alias("size"),
        F.length(match).alias("match_size"),
        good.alias("good"),
    )
    before = Window.partitionBy("blob", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        measured.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .filter((F.col("nth") > 0) & F.col("good"))
        .withColumn("kind", F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1))
    )
    item = F.struct("start", "rank", (F.col("start") + F.col("match_size")).alias("end"), "kind")
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(item)).alias("found"))


def secret_scan(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    key: str = "doc_id",
    salts: int = 16,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, new_ledger, new_findings).

    rows: key, blob and found (null if nothing) for every row of docs, by the present rules only.
    new_ledger: (blob, rule_version) of what is scanned after this call; new_findings: (blob, rule_version, found).
    A caller stores the last two and passes them to the next call, which then scans new pairs of blob and version only.
    """
    version = rule_version(rules)
    found = scan_blobs(unseen_blobs(docs, ledger, text, key, version), rules).select("blob", F.lit(version).alias("rule_version"), "found")
    new = stored(found, "secret-findings")
    every = new if findings is None else findings.unionByName(new)
    paths = docs.select(F.col(key).alias(key), blob_id(F.col(text)).alias("blob"))
    scanned = paths.select("blob").distinct().withColumn("rule_version", F.lit(version))
    new_ledger = scanned if ledger is None else ledger.unionByName(scanned).distinct()
    # A blob may have most of the rows: its finding is repeated once per salt, its rows are dealt over the salts.
    spread = every.filter(F.col("rule_version") == version).select("blob", "found").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = paths.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(spread, ["blob", "salt"], "left")
    return rows.select(key, "blob", "found"), new_ledger, every


def span_digest(found: Column, base_only: bool) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    kept = F.filter(found, lambda s: s["rank"] < BASE_KINDS) if base_only else found
    return F.array_join(F.transform(kept, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", most_broadcast: int = 200_000, salts: int = 16) -> DataFrame:
    """docs with every found span (spans that overlap as one) replaced by its kind in brackets; findings: (blob, rule_version, found).

    Findings of other rules are not looked at.  All columns of docs stay as they are but text, which stays null where it is.
    Findings are broadcast where they have at most most_broadcast spans, else each is dealt over salts.
    """
    blob, found, salt = (free_name(docs, c) for c in ("_blob", "_found", "_salt"))
    mine = findings.filter(F.col("rule_version") == rule_version(rules)).select(F.col("blob").alias(blob), F.col("found").alias(found))
    named = docs.withColumn(blob, blob_id(F.col(text)))
    if (mine.agg(F.sum(F.size(found))).first()[0] or 0) <= most_broadcast:
        joined = named.join(F.broadcast(mine), blob, "left")
    else:
        spread = mine.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = named.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(spread, [blob, salt], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], free).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.when(F.col(found).isNotNull(), F.aggregate(found, start, step, finish)).otherwise(F.col(text))
    return joined.withColumn(text, clean).select(*docs.columns)
