"""Articles to text, JSON and zip archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that file names cannot bear, and those that do not show.
_RESERVED = r'[\x00-\x1f<>:"/\\|?*\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]'


def file_name(title: Column, fallback: str = "article", most: int = 120) -> Column:
    """A title as a file name of at most so many UTF-16 units; other scripts stay as they are."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), _RESERVED, "-")
    plain = F.regexp_replace(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), r"[. ]+$", "")
    named = F.when(plain == "", F.lit(fallback)).otherwise(plain)
    return F.decode(F.substring(F.encode(named, "UTF-16BE"), 1, 2 * most), "UTF-16BE")


def plain_text(title: Column, authors: Column, published: Column, canonical: Column, label: Column, text: Column) -> Column:
    """Title, byline, address and text of an article, by lines."""
    said = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    by = F.when(F.size(authors) > 0, F.concat(F.lit("By "), F.array_join(authors, ", ")))
    byline = F.nullif(F.concat_ws(" — ", by, F.nullif(published, F.lit(""))), F.lit(""))
    return F.concat_ws("\n", said(title, F.lit("(no title found)")), byline, said(canonical, label), F.lit(""), said(text, F.lit("(no article text extracted)")))


def text_bytes(text: Column) -> Column:
    """UTF-8 with a byte order mark."""
    return F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))


def pretty_json(compact: Column) -> Column:
    """JSON text indented by two."""

    @F.pandas_udf("string")
    def pretty(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False))

    return pretty(compact)


def unique_names(names: Iterable[str]) -> list[str]:
    """Names in order, with (2), (3) ... before the extension of those that are taken."""
    taken: set[str] = set()
    out = []
    for name in names:
        stem, dot, end = name.rpartition(".")
        stem, end = (stem, dot + end) if dot else (name, "")
        n, made = 1, name
        while made.lower() in taken:
            n += 1
            made = f"{stem} ({n}){end}"
        taken.add(made.lower())
        out.append(made)
    return out


def zip_bytes(names: Iterable[str], contents: Iterable[bytes]) -> bytes:
    """A zip archive of stored entries."""
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as z:
        for name, content in zip(unique_names(names), contents, strict=True):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return made.getvalue()


def zipped(items: DataFrame, by: str, order: str, name: str = "name", content: str = "content", most: int = 25) -> DataFrame:
    """(by, zip, entries): one archive per group of at most `most` items in order; a larger group raises."""
    spark_rows = items.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    sized = items.join(spark_rows, by).withColumn(name, F.when(F.col("n") > most, F.raise_error(F.lit(f"an archive holds {most} items at most")).cast("string")).otherwise(F.col(name)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "zip": [zip_bytes(pdf[name], [bytes(c) for c in pdf[content]])], "entries": [len(pdf)]})

    kind = items.schema[by].dataType.simpleString()
    return sized.select(by, order, name, content).groupBy(by).applyInPandas(run, f"{by} {kind}, zip binary, entries int")
