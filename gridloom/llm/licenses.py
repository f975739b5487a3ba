"""Licence scans: sparse TF-IDF cosines of lines and files to templates, then inheritance down the directories.

Only DataFrame functions run here. A *unit* is a line that holds an anchor ("licen", "copyright", "redistribut":
every template holds one), a block of lines that holds one, or the whole text of a file with such a line. A block is a
run of two or more adjacent lines, comment marks stripped: one up to blank lines, or one of comment lines alone, so
that a header that wraps over lines is judged as one. Units and templates are sparse vectors of
tf * idf with idf = ln((1 + N) / (1 + df)) + 1 over all N files, df counted for the templates' words (a word of no
template has df 0). A unit's licence is the template with the highest cosine, ties to the smaller name, if it
reaches THRESHOLD. Equal units are scored once, so that a line that a third of all files share costs no more than
any other; its files join the result by its 128-bit hash, so that texts aren't shuffled for it.

A file's own licence is that of its best line or block (ties: lines, then the first); a *licence file* is one that is called LICENSE,
COPYING, ... or whose whole text reaches FILE_THRESHOLD. Files without a licence inherit from the nearest ancestor
directory with a licence file (several: the highest cosine, then the smaller name), by an equality join of
directory paths.

Edge cases: null or empty text has no licence of its own and may inherit; a null path has no directory; repeated
rows count and are answered each; extra columns are kept out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import scratch

ANCHORS = ("licen", "copyright", "redistribut")
THRESHOLD, FILE_THRESHOLD = 0.6, 0.8
FILE_NAMES = r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(?i)(^|/)copying[^/]*$"

#: What opens a comment line, and what surrounds its words.
COMMENT = r"(?i)^\s*(//|/?\*|#|;|--|%|<!--|dnl\b|rem\b)"
MARKS = r"(?i)^\s*(dnl\b|rem\b)|^[\s/*#;%!<>'\"-]+|[\s*/>'\"-]+$"

# The customary notices of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, subject to the above copyright notice and this permission notice being included."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0; a copy of the license was to be distributed with this file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, without copyright or license terms."),
]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; a dot only inside ("2.0")."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\.(?![0-9])", " "), r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def blocks(text: Column) -> Column:
    """Runs of adjacent lines, as one line each: those between blank lines, and those of comment lines."""
    lines = F.split(text, "\n")
    bare = lambda x: F.regexp_replace(x, MARKS, "")
    runs = [F.split(F.array_join(F.transform(lines, f), "\n"), r"\n{2,}") for f in (bare, lambda x: F.when(x.rlike(COMMENT), bare(x)).otherwise(""))]
    several = F.filter(F.transform(F.concat(*runs), lambda x: F.regexp_replace(x, r"^\n+|\n+$", "")), lambda x: x.contains("\n"))
    return F.array_distinct(F.transform(several, lambda x: F.regexp_replace(x, r"\s+", " ")))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path, license, cosine, found ("header", "file",
    "inherited"), from_path."""
    spark = files.sparkSession
    shown = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "tid int, name string, text string")
    of_templates = shown.select("tid", "name", F.explode(words(F.col("text"))).alias("word")).groupBy("tid", "name", "word").agg(F.count("*").alias("tf"))
    vocabulary = sorted(r[0] for r in of_templates.select("word").distinct().collect())  # of the templates: fixed
    known = F.array(*[F.lit(w) for w in vocabulary])

    anchor = lambda c: F.lower(c).rlike("|".join(ANCHORS))
    rows = files.select("doc_id", "path", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("anchored", anchor(F.col("text")))
    whole = F.regexp_replace("text", r"\s+", " ")
    lines = F.when(F.col("anchored"), F.filter(F.concat(F.split("text", "\n"), blocks(F.col("text"))), anchor)).otherwise(F.array().cast("array<string>"))
    marks = lambda c: (F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"))
    of_whole = F.when(F.col("anchored"), F.struct(*marks(whole)))
    base = scratch(rows.select("doc_id", "path", lines.alias("lines"), of_whole.alias("whole")).withColumn("uid", F.monotonically_increasing_id()), "licence-lines")

    seen = rows.select(F.explode(F.array_intersect(known, words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = F.lit(1.0 + base.count())
    idf = spark.createDataFrame([(w,) for w in vocabulary], "word string").join(seen, "word", "left")
    idf = scratch(idf.select("word", (F.log(total / (1.0 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")), "idf")

    units = base.select(F.explode("lines").alias("unit")).union(rows.filter("anchored").select(whole))
    units = scratch(units.select(*marks("unit"), "unit").dropDuplicates(["h1", "h2"]).withColumn("unit_id", F.monotonically_increasing_id()), "units")
    tf = units.select("unit_id", F.explode(words(F.col("unit"))).alias("word")).groupBy("unit_id", "word").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(idf.select("word", "idf")), "word", "left").select("unit_id", "word", (F.col("tf") * F.coalesce("idf", F.log(total) + 1)).alias("w"))  # idf: one row per word of the templates
    t_weighed = of_templates.join(idf, "word").select("tid", "name", "word", (F.col("tf") * F.col("idf")).alias("tw"))
    t_norm = t_weighed.groupBy("tid").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    t_unit = t_weighed.join(t_norm, "tid").groupBy("word").agg(F.collect_list(F.struct("tid", "name", (F.col("tw") / F.col("tn")).alias("tw"))).alias("of"))
    norm = weighed.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(t_unit), "word").select("unit_id", "w", F.explode("of").alias("t")).groupBy("unit_id", "t.tid", "t.name").agg(F.sum(F.col("w") * F.col("t.tw")).alias("dot"))
    cosine = dots.join(norm, "unit_id").select("unit_id", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = cosine.groupBy("unit_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("b")).select("unit_id", F.col("b.name").alias("name"), (-F.col("b.c")).alias("cosine")).filter(F.col("cosine") >= threshold)
    judged = scratch(units.join(best, "unit_id").select("h1", "h2", "name", "cosine"), "judged")

    asked = base.select("uid", F.posexplode("lines").alias("no", "unit")).select("uid", "no", *marks("unit"))
    asked = asked.union(base.filter("whole is not null").select("uid", F.lit(-1).alias("no"), "whole.h1", "whole.h2"))
    hits = asked.join(judged, ["h1", "h2"])
    order = F.struct((-F.col("cosine")).alias("c"), "no", "name")
    own = hits.groupBy("uid").agg(F.min(F.when(F.col("no") >= 0, order)).alias("line"), F.min(F.when(F.col("no") < 0, order)).alias("file"))
    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    is_file = named | (F.coalesce(-F.col("file.c"), F.lit(0.0)) >= file_threshold)
    state = base.select("uid", "doc_id", "path").join(own, "uid", "left").select(
        "uid", "doc_id", "path", F.coalesce("line.name", "file.name").alias("license"), (-F.coalesce("line.c", "file.c")).alias("cosine"), is_file.alias("is_file")
    )
    state = scratch(state, "own-licences")

    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    by_folder = state.filter("is_file and license is not null and path is not null").groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "path")).alias("l"))
    depth = F.size(parts)
    above = F.transform(F.sequence(F.lit(0), depth - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asks = state.filter("license is null and path is not null").select("uid", F.posexplode(above).alias("depth", "dir"))
    near = asks.join(by_folder, "dir").groupBy("uid").agg(F.max_by("l", "depth").alias("l"))
    return state.join(near, "uid", "left").select(
        "doc_id", "path", F.coalesce("license", "l.license").alias("license"), F.coalesce("cosine", -F.col("l.c")).alias("cosine"),
        F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("l").isNotNull(), "inherited").alias("found"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("l.path")).alias("from_path"),
    )
