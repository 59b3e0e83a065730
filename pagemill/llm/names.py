"""Names and hashes over all columns of a table, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as make it new to df (names count without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_hash(df: DataFrame, prefix: str = "") -> Column:
    """A hash of all columns of df; columns that may hold maps count by their JSON."""
    each = [(F.col(f"{prefix}`{f.name}`"), f.dataType.simpleString()) for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c for c, kind in each])
