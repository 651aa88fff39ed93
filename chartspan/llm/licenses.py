"""Licences of files: headers and licence files by TF-IDF cosine, then the nearest directory's.

Passages that speak of rights (a line with a cue, and the whole text of such a file) are
compared with licence templates as sparse TF-IDF vectors. Equal passages are compared once.
Document frequencies count the distinct passages of the corpus and the templates; terms that
no template has share the largest weight, so all lookups go to the few template terms. A file
whose line reaches the threshold has that licence by its header; a file whose whole text
is little else, or whose name says so, is a licence file and gives its directory a licence. Every
other file takes the licence of its nearest directory upward that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import checkpointed, side

# Wordings of public licence notices, what passages about rights mention, and names
# of licence files.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUE = (r"(?i)licen[sc]e|copyright|\bSPDX\b|\bCC BY\b|creative commons|public domain|permission is hereby|"
       r"redistribution and use|all rights reserved")
NAMED = r"(?i)(^|/)(un)?(licen[sc]e|copying)[^/]*$"
THRESHOLD, WHOLE_THRESHOLD = 0.6, 0.9


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; dots inside version numbers stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def passage_key(text: Column) -> Column:
    """128 bits that stand for a passage, however long."""
    return F.md5(text.cast("binary"))


def _frequencies(texts: DataFrame) -> DataFrame:
    """``key, term, tf`` for a frame of distinct ``text``; the key stands for the text in every row."""
    return (texts.select(passage_key(F.col("text")).alias("key"), F.explode(terms(F.col("text"))).alias("term"))
            .groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")))


def similarities(passages: DataFrame, templates: DataFrame) -> DataFrame:
    """``key, license, cosine`` of the best template for distinct ``passages.text``; none without a shared term.

    ``templates`` (``license, text``) is configuration: at most some thousand rows, so that
    its terms and vectors can go to every executor. Equal cosines go to the smaller name.
    """
    known = _frequencies(templates.select("text").distinct())
    vocabulary = known.select("term").distinct()
    found = checkpointed(_frequencies(passages).join(F.broadcast(vocabulary.withColumn("known", F.lit(True))), "term", "left"))
    n = passages.count() + templates.select("text").distinct().count()
    counted = (found.where("known").select("term").unionByName(known.select("term"))
               .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    most = F.log(F.lit(1.0 + n)) + 1
    idf = checkpointed(counted.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    weighed = known.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    vectors = (weighed.join(lengths, "key").join(templates.select("license", passage_key(F.col("text")).alias("key")), "key")
               .select("license", F.col("key").alias("template"), "term", (F.col("w") / F.col("length")).alias("w")))
    own = (found.join(F.broadcast(idf), "term", "left")
           .select("key", "term", (F.col("tf") * F.coalesce("idf", most)).alias("v")))
    norms = own.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = (own.join(F.broadcast(vectors), "term").groupBy("key", "license", "template")
            .agg(F.sum(F.col("v") * F.col("w")).alias("dot")))
    best = (dots.join(norms, "key")
            .select("key", F.struct(F.round(-F.col("dot") / F.col("norm"), 9).alias("minus"), "license").alias("m"))
            .groupBy("key").agg(F.min("m").alias("m")))
    return best.select("key", F.col("m.license").alias("license"), (-F.col("m.minus")).alias("cosine"))


def _directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def _upward(directory: Column) -> Column:
    """A directory and all above it, the root (empty) last."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)),
                       lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD,
         whole_threshold: float = WHOLE_THRESHOLD) -> DataFrame:
    """``path, license, cosine, basis, directory`` for every row of ``files`` (``path``, ``text``).

    ``basis`` is ``file`` (the whole text reaches ``whole_threshold``, or the name says so and some passage
    reaches the threshold), ``header`` (a line is), ``inherited`` (from ``directory``) or
    ``none``. Null and empty texts have no licence of their own; a null path inherits nothing;
    of several licence files in a directory the best cosine counts, then the smaller name.
    Paths are told apart without empty parts, repeated paths are judged row by row, an empty
    table gives no rows, other columns are ignored.
    """
    if templates is None:
        templates = files.sparkSession.createDataFrame(TEMPLATES, "license string, text string")
    with_cue = files.where(F.col("text").rlike(CUE)).select("path", "text", F.xxhash64("path", "text").alias("row"))
    lines = F.filter(F.split("text", r"\n"), lambda x: x.rlike(CUE))
    passages = with_cue.select("path", "row", F.explode(F.array_distinct(F.concat(
        F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), F.trim(x).alias("text"))),
        F.array(F.struct(F.lit(True).alias("whole"), F.trim("text").alias("text")))))).alias("p"))
    passages = passages.select("path", "row", "p.whole", "p.text")
    scored = similarities(passages.select("text").distinct(), templates).where(F.col("cosine") >= threshold)
    places = passages.select("path", "row", "whole", passage_key(F.col("text")).alias("key"))
    hits = (places.withColumn("s", side(F.col("key")))
            .join(checkpointed(scored).withColumn("s", side(F.col("key"))), ["key", "s"])
            .withColumn("m", F.struct((-F.col("cosine")).alias("minus"), "license")))
    own = checkpointed(hits.groupBy("row").agg(F.min("m").alias("m"), F.max(F.col("whole") & (F.col("cosine") >= whole_threshold)).alias("whole"), F.first("path").alias("path"))
                       .select("row", "path", F.col("m.license").alias("license"), (-F.col("m.minus")).alias("cosine"),
                               F.when(F.col("whole") | F.coalesce(F.col("path").rlike(NAMED), F.lit(False)), "file").otherwise("header").alias("basis")))
    given = (own.where("basis = 'file' and path is not null")
             .select(F.element_at(_upward(_directory(F.col("path"))), 1).alias("directory"),
                     F.struct((-F.col("cosine")).alias("minus"), "license").alias("m"))
             .groupBy("directory").agg(F.min("m").alias("m")))
    keyed = files.select("path", F.xxhash64("path", "text").alias("row"), _directory(F.col("path")).alias("own_dir"))
    places = keyed.select("own_dir").where("own_dir is not null").distinct()
    steps = places.select("own_dir", F.posexplode(_upward(F.col("own_dir"))).alias("up", "directory"))
    nearest = (steps.withColumn("s", side(F.col("directory")))
               .join(given.withColumn("s", side(F.col("directory"))), ["directory", "s"])
               .groupBy("own_dir").agg(F.min(F.struct("up", "directory", "m")).alias("near")))
    told = (keyed.withColumn("s", side(F.col("row")))
            .join(own.drop("path").withColumn("s", side(F.col("row"))), ["row", "s"], "left")
            .drop("s").withColumn("s", side(F.col("own_dir")))
            .join(checkpointed(nearest).withColumn("s", side(F.col("own_dir"))), ["own_dir", "s"], "left"))
    inherited = F.col("license").isNull() & F.col("near").isNotNull()
    return told.select(
        "path", F.coalesce("license", "near.m.license").alias("license"),
        F.coalesce("cosine", -F.col("near.m.minus")).alias("cosine"),
        F.coalesce("basis", F.when(inherited, "inherited").otherwise("none")).alias("basis"),
        F.when(inherited, F.col("near.directory")).alias("directory"))
