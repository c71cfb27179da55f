"""License scan: statements matched to templates by sparse TF-IDF cosine, then inherited along directories.

1. Every line of every whole text that speaks of a licence is a statement. Equal statements are matched once.
2. Statements and templates are sparse vectors of term counts times inverse document frequency, counted over the
   statements of all documents and the templates. Statements meet templates on their terms alone; a statement has the
   licence of the template with the greatest cosine, if that is at least ``least``.
3. A file has the licence of its best statement. A file whose words are for ``file_share`` or more in matched statements,
   or that is named LICENSE, LICENCE or COPYING, is a licence file and speaks for its directory.
4. A file without a licence of its own has that of its nearest directory upwards that has a licence file. Directories
   are joined with their own ancestors, so no file is copied for every level above it.

All steps are built-in expressions. Templates are fixed and few; nothing else is broadcast by request.

``documents`` has no paths: a document lies at ``source/lang/doc_id``. Null source or lang are written as ``_``. Null and
empty texts have no statement and can inherit. Ties go to the better cosine, then the longer statement, then the
licence's name; in a directory then to the least path. Rows that repeat a path are kept, and have equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave.llm.common import read
from alertweave.session import materialise

# Common notices of public licences, by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
]

CUE = r"(?i)licen[sc]|copyright|copyleft|spdx|public domain|permission is hereby|all rights reserved"
WORD = r"[^\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Lower-case terms: letters and digits, with dots and signs between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"), F.lit(0))


def statements(files: DataFrame) -> DataFrame:
    """One row for each line that speaks of a licence: the columns of ``files`` but text, n_words and the line."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    speaking = files.where(F.col("text").rlike(CUE))
    rest = [c for c in files.columns if c != "text"]
    return (
        speaking.select(*rest, F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.explode(lines).alias("line"))
        .withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    )


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("notice")) for i, (n, t) in enumerate(TEMPLATES)])
    return spark.range(1).select(F.inline(rows))


def matched(lines: DataFrame, least: float) -> DataFrame:
    """line, license and similarity of the distinct lines that match a template; ``lines`` has line and n (documents)."""
    templates = _templates(lines.sparkSession)
    own = lines.select("line", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "term").agg(
        F.count("*").alias("tf"), F.max("n").alias("n")
    )
    theirs = templates.select("template", "license", F.explode(terms(F.col("notice"))).alias("term")).groupBy(
        "template", "license", "term"
    ).agg(F.count("*").alias("tf"))
    total = lines.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.lit(len(TEMPLATES))).alias("total"))
    df = (
        own.select("term", "n")
        .unionByName(theirs.select("term", F.lit(1).cast("long").alias("n")))
        .groupBy("term")
        .agg(F.sum("n").alias("df"))
        .crossJoin(F.broadcast(total))
        .select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    own = own.join(df, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    # The terms of the fixed templates: a few hundred rows.
    theirs = theirs.join(df, "term").select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("v"))
    norm = own.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    size = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dots = (
        own.join(F.broadcast(theirs), "term")
        .groupBy("line", "template", "license")
        .agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        .join(F.broadcast(size), "template")
        .join(norm, "line")
        .select("line", "license", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias("similarity"))
        .where(F.col("similarity") >= least)
    )
    best = F.min(F.struct((-F.col("similarity")).alias("order"), "license", "similarity")).alias("best")
    return dots.groupBy("line").agg(best).select("line", "best.license", "best.similarity")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, the nearest first; the top is the empty name."""
    parts = F.split(directory, "/")
    return F.concat(
        F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")),
        F.array(F.lit("")),
    )


def scanned(files: DataFrame, least: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """``files`` (path, text and more) with license, similarity, via (header, file, inherited or null) and licensed_by."""
    added = ["license", "similarity", "via", "licensed_by"]
    files = files.drop(*added).withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))
    spoken = materialise(statements(files.select("path", "directory", "text")), "statements")
    lines = spoken.groupBy("line").agg(F.count("*").alias("n"))
    known = matched(lines, least)
    found = (
        spoken.join(known, "line")
        .withColumn("length", F.regexp_count("line", F.lit(WORD)).cast("long"))
        .groupBy("path", "directory")
        .agg(
            F.min(F.struct((-F.col("similarity")).alias("a"), (-F.col("length")).alias("b"), "license", "similarity")).alias("best"),
            F.sum("length").alias("covered"),
            F.sum("n_words").alias("words"),
            F.count("*").alias("rows"),
        )
        .select(
            "path",
            "directory",
            "best.license",
            "best.similarity",
            ((F.col("covered") >= file_share * F.col("words") / F.col("rows")) | F.col("path").rlike(r"(?i)(^|/)(licen[cs]e|copying)[^/]*$")).alias("file"),
        )
    )
    found = materialise(found, "licenses")
    speaking = found.where("file").groupBy("directory").agg(
        F.min(F.struct((-F.col("similarity")).alias("a"), "path", "license", "similarity")).alias("best")
    )
    above = files.select("directory").distinct().select("directory", F.posexplode(_ancestors(F.col("directory"))).alias("up", "ancestor"))
    inherited = (
        above.join(speaking.withColumnRenamed("directory", "ancestor"), "ancestor")
        .groupBy("directory")
        .agg(F.min(F.struct("up", F.col("best.path").alias("by"), F.col("best.license").alias("license"), F.col("best.similarity").alias("similarity"))).alias("far"))
    )
    rest = [c for c in files.columns if c not in ("text", "directory")]
    own = found.select("path", F.struct("license", "similarity", "file").alias("own"))
    out = files.drop("text").join(own, "path", "left").join(inherited, "directory", "left")
    via = F.when(F.col("own").isNotNull(), F.when(F.col("own.file"), "file").otherwise("header")).when(F.col("far").isNotNull(), "inherited")
    return out.select(
        *rest,
        F.coalesce("own.license", "far.license").alias("license"),
        F.coalesce("own.similarity", "far.similarity").alias("similarity"),
        via.alias("via"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("far.by")).alias("licensed_by"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: doc_id, path and text."""
    parts = [F.regexp_replace(F.coalesce(F.col(c).cast(T.StringType()), F.lit("_")), "/", "_") for c in ("source", "lang", "doc_id")]
    return docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(as_files(read(spark, sf_dir, "documents")))
