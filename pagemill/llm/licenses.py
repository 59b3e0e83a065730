"""License scans: MinHash bands over overlapping windows, then exact containment.

For each template length m (in shingles of five words) a text is cut into
windows of m + stride - 1 shingles that start every stride = m / 4 shingles,
so every run of m shingles lies in one window whole.  A window that holds 0.8
of a template's shingles has a Jaccard similarity of at least 0.55 to it; with
12 bands of one row, all twelve miss with a probability under 0.0001.  A
window retrieves the templates with an equal band, and the retrieved template
is reported if at least 0.8 of its distinct shingles are in the window.

A band's value is the least shingle after XOR with the band's mask, so it can
equal a template's only if that shingle is a template's: windows without any
template shingle are left out beforehand, which changes no result.

Only DataFrame functions are used.  Templates are a parameter of bounded size
and reach the tasks as literals; texts are not shuffled.

Defined results: null texts and texts of fewer than five words match nothing;
rows that repeat an id give one result per template; an empty table gives no
rows; texts of any length are read whole.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and opening paragraphs of common licenses.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at"
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}


@dataclass(frozen=True)
class LicensePlan:
    words: int = 5
    containment: float = 0.8
    bands: int = 12
    seed: int = 3

    def masks(self) -> list[int]:
        draw = random.Random(self.seed)
        return [draw.getrandbits(64) - 2**63 for _ in range(self.bands)]


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles_of(words: Column, n: int) -> Column:
    """Hash of each run of n words, in order."""
    return let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))


def _bands(window: Column, plan: LicensePlan) -> Column:
    """Array of band values."""

    def band(mask: int) -> Column:
        return F.array_min(F.transform(window, lambda h: h.bitwiseXOR(F.lit(mask))))

    return F.array(*[band(m) for m in plan.masks()])


def template_table(spark: SparkSession, templates: dict[str, str], plan: LicensePlan) -> list:
    """Rows (template, shingles, m, bands) of the templates."""
    t = spark.createDataFrame(sorted(templates.items()), "template string, text string").withColumn("words", words_of(F.col("text")))
    t = t.filter(F.size("words") >= plan.words).withColumn("shingles", F.array_distinct(shingles_of(F.col("words"), plan.words)))
    return t.select("template", "shingles", F.size("shingles").alias("m"), _bands(F.col("shingles"), plan).alias("bands")).collect()


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, plan: LicensePlan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id and template found: key, template, containment, first_word, n_words (of the best window, from 0)."""
    plan = plan or LicensePlan()
    spark = docs.sparkSession
    known = template_table(spark, templates or TEMPLATES, plan)
    listed = sorted({h for t in known for h in t["shingles"]})
    lengths = sorted({t["m"] for t in known})
    words = words_of(F.col(text))
    rows = docs.select(F.col(key).alias(key), words.alias("words"))
    found = let(
        shingles_of(F.col("words"), plan.words),
        lambda s: F.struct(s.alias("shingles"), F.filter(F.transform(s, lambda h, i: F.when(h.isin(listed), i)), lambda i: i.isNotNull()).alias("hits")),
    )
    rows = rows.select(key, F.when(F.size("words") >= plan.words, found).alias("found")).filter(F.size("found.hits") > 0)
    rows = rows.select(key, "found.shingles", "found.hits")
    size = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(max(1, m // 4)).alias("stride"), F.lit(m + max(1, m // 4) - 1).alias("width")) for m in lengths])
    # Starts of the windows over a hit, for each template length.
    cells = rows.select(key, "shingles", "hits", F.explode(size).alias("w"))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                F.col("hits"),
                lambda i: F.transform(
                    F.sequence(
                        F.greatest(F.lit(0), F.ceil((i - F.col("w.width") + 1) / F.col("w.stride"))).cast("int"),
                        F.floor(i / F.col("w.stride")).cast("int"),
                    ),
                    lambda j: (j * F.col("w.stride")).cast("int"),
                ),
            )
        )
    )
    # Each window row carries its own slice, never the shingles of its whole text.
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(F.col("shingles"), i + 1, F.col("w.width")).alias("window")))
    windows = cells.select(key, "w", F.explode(cut).alias("c")).select(key, "w", "c.start", "c.window").withColumn("bands", _bands(F.col("window"), plan))
    table = F.array(
        *[
            F.struct(F.lit(t["template"]).alias("template"), F.lit(t["m"]).alias("m"), F.array(*[F.lit(h) for h in t["shingles"]]).alias("shingles"), F.array(*[F.lit(b) for b in t["bands"]]).alias("bands"))
            for t in known
        ]
    )
    retrieved = F.filter(table, lambda t: (t["m"] == F.col("w.m")) & F.exists(F.zip_with(t["bands"], F.col("bands"), lambda a, b: a == b), lambda same: same))
    found = windows.select(key, "start", "window", F.explode(retrieved).alias("t"))
    share = F.size(F.array_intersect("window", "t.shingles")) / F.col("t.m")
    found = found.select(key, F.col("t.template").alias("template"), share.alias("containment"), F.col("start").cast("long").alias("start"), (F.size("window") + plan.words - 1).cast("long").alias("n"))
    best = found.filter(F.col("containment") >= plan.containment).groupBy(key, "template").agg(F.max(F.struct("containment", -F.col("start"), "n")).alias("b"))
    return best.select(key, "template", F.col("b.containment").alias("containment"), (-F.col("b.col2")).alias("first_word"), F.col("b.n").alias("n_words"))
