"""License scans with DataFrame functions only.

A template's word shingles are looked for in overlapping windows of each text. Windows come in size classes by powers of two, twice as long
as their class's longest template and half overlapping, so a template lies whole in a window of its class. A window and a
template are candidates if they agree in one of BANDS minima of hashed shingles; with a Jaccard similarity of J that misses
(1 - J) ** BANDS of the pairs, at most 1 in 500 at the least J that a match can have (about 0.2). A window can agree only where it
holds a shingle that is some template's minimum, so other windows are left out before their minima are taken; that loses none. Windows and templates are joined
by (band, minimum), so each window meets only the templates that it agrees with, however many there are. Candidates are
verified by the exact share of the template's shingles that the window holds.

Words are runs of letters and digits, in lower case. A text or template of fewer words than a shingle is one shingle. Null and blank texts
have no matches; repeated rows have each their own. Extra columns are not read. Texts are read whole. A text is not grouped with others at any point, so no
group can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
LEAST = 0.8
BANDS = 30
#: The templates are broadcast; so many shingles in all at most.
MOST_TEMPLATE_SHINGLES = 100_000

# Wordings by which licenses are stated.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, template string")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, n: int = WORDS) -> Column:
    """Hashes of all shingles in order; of the whole where there are fewer words; empty without words."""
    some = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, some).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def once(expression: Column) -> Column:
    """The expression's value worked out once a row: a generator of one row, past which the optimizer copies no expression."""
    return F.explode(F.array(expression))


def minima(shingles: Column) -> Column:
    """The least value of each of BANDS hash functions over the shingles, marked with the function's number."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(k))))

    return F.array(*map(least, range(BANDS)))


def prepared(templates: DataFrame) -> list[dict]:
    """The templates' rows with shingles, minima, the shingles that give the minima, and their window class. Their number is bounded by contract."""
    given = templates.where("template is not null").select("license", "template", once(words_of(F.col("template"))).alias("w"))
    each = given.select("license", "template", F.explode(shingles_of(F.col("w"))).alias("s"))
    if each.limit(MOST_TEMPLATE_SHINGLES + 1).count() > MOST_TEMPLATE_SHINGLES:
        raise ValueError("too many template shingles to broadcast")
    hashed = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("h", F.xxhash64("s", "k"))
    least = hashed.groupBy("license", "template", "k").agg(F.min("h").alias("h"), F.min_by("s", "h").alias("s"))
    minima_of: dict = {}
    for r in least.collect():
        minima_of.setdefault((r["license"] or "", r["template"]), {})[r["k"]] = (r["h"], r["s"])
    out = []
    for i, r in enumerate(sorted(each.groupBy("license", "template").agg(F.collect_set("s").alias("d"), F.count("*").alias("n")).collect(), key=lambda r: (r["license"] or "", r["template"]))):
        m = minima_of[r["license"] or "", r["template"]]
        out.append({"template": i, "license": r["license"], "d": sorted(r["d"]), "m": [m[k][0] for k in range(BANDS)], "at": sorted({m[k][1] for k in range(BANDS)}), "reach": 1 << max(0, (r["n"] - 1).bit_length())})
    return out


def scan(docs: DataFrame, templates: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, license, template, first_word, last_word, containment): for every row, template and place, the best window.

    Windows that overlap and match one template are one place. Words are counted from 0 in the text, last_word inclusive.
    """
    spark = docs.sparkSession
    known = prepared(default_templates(spark) if templates is None else templates)
    if not known:
        return docs.select(F.col(doc_id).cast("long").alias("doc_id")).limit(0).selectExpr("doc_id", "'' as license", "0L as template", "0L as first_word", "0L as last_word", "0.0D as containment")
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    marks = sorted({x for t in known for x in t["at"]})
    split = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), once(words_of(F.col(text))).alias("_w"))
    hashed = split.select("doc_id", F.size("_w").alias("n_words"), once(shingles_of(F.col("_w"))).alias("s"))
    held = hashed.where(F.arrays_overlap("s", lit(marks)))
    # One row a window: the classes' reach, the window's start and its own shingles, cut out before rows are made, so no row carries the whole text's. Windows without a minimum of
    # their own class are never made.
    reaches = sorted({t["reach"] for t in known})

    def of_class(reach: int) -> Column:
        own = lit(sorted({x for t in known if t["reach"] == reach for x in t["at"]}))
        starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(reach))
        cut = F.transform(starts, lambda a: F.struct(F.lit(reach).alias("reach"), a.cast("int").alias("start"), F.slice("s", a.cast("int") + 1, 1 if reach == 1 else 2 * reach).alias("v")))
        return F.filter(cut, lambda w: F.arrays_overlap(w["v"], own))

    windows = held.select("doc_id", "n_words", F.explode(F.concat(*map(of_class, reaches))).alias("w")).select("doc_id", "n_words", "w.*")
    banded = windows.withColumn("v", F.array_distinct("v")).withColumn("m", once(minima(F.col("v"))))
    # The join key is a band and its minimum; of several bands in which a window and a template agree, the first one's row stays.
    table = spark.createDataFrame([(k, t["m"][k], t["reach"], t["template"], t["license"], t["d"], t["m"]) for t in known for k in range(BANDS)], "band int, minimum long, reach int, template long, license string, d array<long>, tm array<long>")
    exploded = banded.select("*", F.posexplode("m").alias("band", "minimum"))
    first = F.array_position(F.zip_with("m", "tm", lambda x, y: x == y), True) == F.col("band") + 1
    pairs = exploded.join(F.broadcast(table), ["band", "minimum", "reach"]).where(first)
    share = (F.size(F.array_intersect("v", "d")) / F.size("d")).cast("double")
    found = pairs.withColumn("containment", share).where(F.col("containment") >= least)
    last = F.least(F.col("start") + F.when(F.col("reach") == 1, 1).otherwise(2 * F.col("reach")) + (WORDS - 2), F.col("n_words") - 1)
    return found.select("doc_id", "license", "template", F.col("start").cast("long").alias("first_word"), last.cast("long").alias("last_word"), "containment")


def licenses(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): for each document and license the best containment and first place."""
    return scan(docs, **options).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.count("*").alias("n_windows"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
