"""License scans: sparse TF-IDF cosine to templates, and inheritance along directories.

DataFrame operations only. Header lines (lines with a word that licence
statements use), the comment or paragraph blocks around them, and whole licence
files are the units; a header that is wrapped over lines is known by its block. Distinct units are cut
into words, weighted by count and by the inverse document frequency over the
templates, and joined to the templates' words; the best template of a unit
that reaches the least cosine is its licence. A file has the licence of its
best header, else that of the licence file in its nearest ancestor directory:
every file's ancestor directories are joined to the directories that hold a
licence file, and the deepest one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm.common import read, staged

# Licence names and the statements by which files declare them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("PSF-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    (
        "PSF-2.0",
        "This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and "
        "otherwise using this software (Python) in source or binary form and its associated documentation.",
    ),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ),
    ("Proprietary", "All rights reserved."),
)
# A rights reservation stands beside most licences: it counts where nothing else is found.
BOILERPLATE = "Proprietary"
CUE = "licen[cs]|spdx|copyright|all rights reserved|permission (is|to)|redistribut|public domain|source code form|endorse or promote"
FILE_NAME = "(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
NOT_WORD = "[^a-z0-9.+-]+"
# A cue may be wrapped as well.
BLOCK_CUE = CUE.replace(" ", "[^a-z0-9]+")
# Where a block ends: marks around comments, a change between marked and other lines, lines without a letter or digit.
AROUND = r"""/\*|\*/|<!--|-->|\"{3}|'{3}"""
MARKED = r"[ \t]*+(?:#|//|--|;|%|(?:dnl|rem)\b)"
AFTER_MARKED = rf"(?mi)^({MARKED}[^\n]*+)\n(?!{MARKED})"
BEFORE_MARKED = rf"(?mi)^((?!{MARKED})[^\n]*+)\n(?={MARKED})"
BETWEEN = r"\n[^\n\p{L}\p{N}]*+\n[^\p{L}\p{N}]*+"


def words_of(text: Column) -> Column:
    """Lower-case words, without the signs at their ends."""
    parts = F.transform(F.split(F.lower(text), NOT_WORD), lambda w: F.btrim(w, F.lit(".+-")))
    return F.filter(parts, lambda w: w != "")


def blocks_of(text: Column) -> Column:
    """The blocks of comment lines or of other lines that hold a cue, wrapped or not."""
    cut = F.regexp_replace(text, AROUND, "\n\n")
    for end in (AFTER_MARKED, BEFORE_MARKED):
        cut = F.regexp_replace(cut, end, "$1\n\n")
    return F.filter(F.split(cut, BETWEEN), lambda x: F.lower(x).rlike(BLOCK_CUE))


def template_words(spark: SparkSession) -> DataFrame:
    """(template, license, word, count) of the templates; a few hundred rows."""
    each = [F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("text")) for i, (n, t) in enumerate(TEMPLATES)]
    rows = spark.range(1).select(F.inline(F.array(*each)))
    return rows.select("template", "license", F.explode(words_of(F.col("text"))).alias("word")).groupBy("template", "license", "word").count()


def idf(df: Column) -> Column:
    return F.log((1.0 + len(TEMPLATES)) / (1.0 + df)) + 1.0


def scored(units: DataFrame, least: float) -> DataFrame:
    """(unit, license, cosine, weight) of the distinct units that reach the least cosine; ties go to the first template.

    ``unit`` is the digest of ``said``. ``weight`` is the cosine times the
    logarithm of the words that unit and template both have room for, so that a
    paragraph counts more than a line of three words.
    """
    spark = units.sparkSession
    tf = template_words(spark)
    sizes = F.broadcast(tf.groupBy("template").agg(F.sum("count").alias("room")))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(df, "word").withColumn("w", F.col("count") * idf(F.col("df")))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    templates = weighed.join(norms, "template").select("template", "license", "word", (F.col("w") / F.col("norm")).alias("tw"))
    # Both sides of the joins below are the templates' words, whose number the code fixes.
    once = units.groupBy("unit").agg(F.first("said").alias("said"))
    counts = once.select("unit", F.explode(words_of(F.col("said"))).alias("word")).groupBy("unit", "word").count()
    own = counts.join(F.broadcast(df), "word", "left").withColumn("w", F.col("count") * idf(F.coalesce("df", F.lit(0))))
    length = own.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.sum("count").alias("words"))
    dots = own.join(F.broadcast(templates), "word").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = dots.join(length, "unit").join(sizes, "template")
    cosine = cosine.select("unit", "template", "license", F.round(F.col("dot") / F.col("length"), 6).alias("cosine"), F.least("words", "room").alias("both"))
    weight = F.round(F.col("cosine") * F.log(1.0 + F.col("both")), 6).alias("weight")
    best = cosine.where(F.col("cosine") >= least).groupBy("unit").agg(F.max_by(F.struct("license", "cosine", weight), F.struct("cosine", -F.col("template"))).alias("b"))
    return best.select("unit", "b.license", "b.cosine", "b.weight")


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, least: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """(id, path, license, how, cosine) for every row of ``files``.

    how is "header", "file" (the row is a licence file: so named, or header
    lines make up ``file_share`` of its words), "inherited", or "none" with a
    null license. Of a file's units the heaviest decides (see ``scored``), a
    rights reservation only where no unit is a licence. A directory with several
    licence files goes by the same order, then by the first path. The root is an
    ancestor of every path. Null texts are empty; a row with a
    null path inherits nothing. Repeated rows are kept. An empty table gives an
    empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(CUE))
    if_cue = lambda units: F.when(F.lower("text").rlike(BLOCK_CUE), units).otherwise(F.array().cast("array<string>"))
    found = src.select("id", "path", if_cue(lines).alias("lines"), if_cue(blocks_of(F.col("text"))).alias("blocks"), "text")
    named = F.coalesce(F.lower("path").rlike(FILE_NAME), F.lit(False))
    said = F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(words_of(x)))
    is_file = named | ((F.size("lines") > 0) & (said >= file_share * F.size(words_of(F.col("text")))))
    # Texts themselves go no further: only header lines, their blocks and whole licence files are kept.
    rows = found.select(
        F.monotonically_increasing_id().alias("row"), "id", "path",
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), is_file.alias("is_file"),
        F.array_distinct(F.concat("lines", "blocks", F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>")))).alias("units"),
    )
    rows = staged(rows, "license-units")
    # A unit goes by its digest: a long one would else travel with each of its words.
    units = rows.where(F.size("units") > 0).select("row", F.explode("units").alias("said")).select("row", F.md5("said").alias("unit"), "said")
    # Written first, so that plain scans meet in the join and a line that many files share can be split.
    known = units.select("row", "unit").join(staged(scored(units, least), "license-scores"), "unit")
    own = known.groupBy("row").agg(F.max_by(F.struct("license", "cosine", "weight"), F.struct(F.col("license") != BOILERPLATE, "weight", "cosine", "license")).alias("own"))
    rows = rows.select("row", "id", "path", "dir", "is_file").join(own, "row", "left")
    declared = rows.where(F.col("is_file") & F.col("own").isNotNull() & F.col("path").isNotNull())
    by_dir = declared.groupBy("dir").agg(F.min_by("own", F.struct(F.col("own.license") == BOILERPLATE, -F.col("own.weight"), -F.col("own.cosine"), "path")).alias("from_dir"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    # The root is '': the first part of a path with a leading slash, and above the first part of others.
    up = F.when(parts[0] == "", up).otherwise(F.concat(F.array(F.lit("")), up))
    # Directories are few beside files: their ancestors are matched once per directory, then joined to the files.
    dirs = rows.where(F.col("path").isNotNull() & F.col("own").isNull()).select("dir").distinct()
    above = dirs.select("dir", F.posexplode(up).alias("depth", "ancestor")).join(by_dir.withColumnRenamed("dir", "ancestor"), "ancestor")
    near = above.groupBy("dir").agg(F.max_by("from_dir", "depth").alias("near"))
    out = rows.join(near, "dir", "left")
    heir = F.col("own").isNull() & F.col("path").isNotNull() & F.col("near").isNotNull()
    chosen = F.when(F.col("own").isNotNull(), F.col("own")).when(heir, F.col("near"))
    how = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(heir, "inherited").otherwise("none")
    return out.select("id", "path", chosen["license"].alias("license"), how.alias("how"), chosen["cosine"].alias("cosine"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's licence. Documents have no path, so they are laid out as source/thousand/hundred/id, some of them higher up."""
    docs = read(spark, sf_dir, "documents")
    up = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    id_, source = F.col("doc_id").cast("string"), F.coalesce("source", F.lit(""))
    path = (
        F.when(F.col("doc_id") % 101 == 0, id_)
        .when(F.col("doc_id") % 10 == 0, F.concat_ws("/", source, id_))
        .when(F.col("doc_id") % 5 == 1, F.concat_ws("/", source, up(1000), id_))
        .otherwise(F.concat_ws("/", source, up(1000), up(100), id_))
    )
    out = scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")
    return out.withColumnRenamed("id", "doc_id")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_words(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{NOT_WORD}'), "
        "lambda w: trim(w, '.+-')), lambda w: w <> '')"
    )


ORACLE_OP10 = f"""
WITH tpl(template, license, text) AS (VALUES {", ".join(f"({i}, {_sql(n)}, {_sql(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
tw AS (SELECT template, license, word, count(*) AS n FROM (SELECT template, license, unnest({_sql_words("text")}) AS word FROM tpl) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tw GROUP BY word),
tv AS (SELECT template, license, word, n * (ln({1.0 + len(TEMPLATES)} / (1.0 + df)) + 1.0) AS w FROM tw JOIN df USING (word)),
tn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS tw FROM tv),
docs AS (
  SELECT doc_id,
         CASE WHEN doc_id % 101 = 0 THEN CAST(doc_id AS VARCHAR)
              WHEN doc_id % 10 = 0 THEN coalesce(source, '') || '/' || doc_id
              WHEN doc_id % 5 = 1 THEN coalesce(source, '') || '/' || doc_id // 1000 || '/' || doc_id
              ELSE coalesce(source, '') || '/' || doc_id // 1000 || '/' || doc_id // 100 || '/' || doc_id END AS path,
         coalesce(text, '') AS text,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(lower(x), '{CUE}')) AS lines
  FROM documents
),
f AS (
  SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
         regexp_matches(lower(path), '{FILE_NAME}') OR (len(lines) > 0
           AND list_sum(list_transform(lines, lambda x: len({_sql_words("x")}))) >= 0.5 * len({_sql_words("text")})) AS is_file
  FROM docs
),
said AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
  FROM (SELECT doc_id, string_split(regexp_replace(text, '{_sql(AROUND)[1:-1]}', chr(10) || chr(10), 'g'), chr(10)) AS parts FROM docs WHERE regexp_matches(lower(text), '{BLOCK_CUE}'))
),
kinds AS (
  SELECT *, regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS says, regexp_matches(line, '(?i)^{MARKED.replace("*+", "*")}') AS marked FROM said
),
steps AS (
  SELECT *, CASE WHEN says AND lag(says) OVER w AND marked = lag(marked) OVER w THEN 0 ELSE 1 END AS step
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
cuts AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM steps),
blocks AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS unit FROM cuts WHERE says GROUP BY doc_id, block
  HAVING regexp_matches(lower(string_agg(line, chr(10) ORDER BY i)), '{BLOCK_CUE}')
),
u AS (
  SELECT doc_id, unnest(CASE WHEN is_file THEN list_append(lines, text) ELSE lines END) AS unit FROM f
  UNION
  SELECT * FROM blocks
),
uw AS (SELECT unit, word, count(*) AS n FROM (SELECT unit, unnest({_sql_words("unit")}) AS word FROM (SELECT DISTINCT unit FROM u)) GROUP BY ALL),
uv AS (SELECT unit, word, n * (ln({1.0 + len(TEMPLATES)} / (1.0 + coalesce(df, 0))) + 1.0) AS w FROM uw LEFT JOIN df USING (word)),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uv GROUP BY unit),
room AS (SELECT template, sum(n) AS room FROM tw GROUP BY template),
size AS (SELECT unit, sum(n) AS words FROM uw GROUP BY unit),
cs AS (
  SELECT unit, template, license, round(sum(uv.w * tn.tw) / any_value(norm), 6) AS cosine
  FROM uv JOIN tn USING (word) JOIN un USING (unit) GROUP BY unit, template, license
),
best AS (SELECT *, round(cosine * ln(1 + least(words, room)), 6) AS weight FROM cs JOIN room USING (template) JOIN size USING (unit) WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, template) = 1),
own AS (
  SELECT doc_id, license, cosine, weight FROM u JOIN best USING (unit)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY license = '{BOILERPLATE}', weight DESC, cosine DESC, license DESC) = 1
),
dirs AS (
  SELECT dir, license, cosine FROM f JOIN own USING (doc_id) WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY license = '{BOILERPLATE}', weight DESC, cosine DESC, path) = 1
),
heirs AS (
  SELECT f.doc_id, d.license, d.cosine FROM f JOIN dirs d ON d.dir = '' OR f.dir = d.dir OR starts_with(f.dir, d.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.dir) DESC) = 1
)
SELECT f.doc_id, f.path, coalesce(o.license, h.license) AS license,
       CASE WHEN o.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END
            WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN o.license IS NOT NULL THEN o.cosine ELSE h.cosine END AS cosine
FROM f LEFT JOIN own o USING (doc_id) LEFT JOIN heirs h USING (doc_id)
"""
