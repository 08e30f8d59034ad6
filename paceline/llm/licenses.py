"""License scans: TF-IDF cosine of passages to templates, then inheritance down the directories.

A passage is a line that holds one of the anchor words. Its vector has a place for every term;
the document frequencies are those among all passages. Paragraphs, wrapped lines, sentences and
runs of words around an anchor are compared with notices and usual headers in the same way, whole
texts with full license texts by the runs of words they share, and SPDX tags are read. A file whose
passages or license text make up most of its text is a license file and speaks for its directory. Files without a license of their own take
that of the nearest directory above them. All of it is joins and aggregates.
"""

from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.arrays import once
from paceline.session import saved

#: Names of licenses and the wording of their notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
            " software and associated documentation files, under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license"),
)

#: Paragraphs that usual headers consist of.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
                   " except in compliance with the License. You may obtain a copy of the License at"
                   " http://www.apache.org/licenses/LICENSE-2.0"),
    *((f"{short}-{v}.0", f"This program is free software: you can redistribute it and/or modify it under the terms of"
                         f" the GNU {name} as published by the Free Software Foundation, either version {v} of the"
                         " License, or (at your option) any later version.")
      for short, name, v in (("GPL", "General Public License", 2), ("GPL", "General Public License", 3),
                             ("LGPL", "Lesser General Public License", 3), ("AGPL", "Affero General Public License", 3))),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
                 " Lesser General Public License as published by the Free Software Foundation; either version 2.1 of"
                 " the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
                " MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this"
                " work to the public domain worldwide under the CC0 1.0 Universal license."),
)


def full_texts() -> list[tuple[str, str]]:
    """Names and texts of whole licenses; the AGPL and two-clause BSD follow from their kin."""
    texts = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    affero = texts["GPL-3.0"].replace("GNU General Public", "GNU Affero General Public")
    texts["AGPL-3.0"] = affero.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    clauses = texts["BSD-3-Clause"]
    texts["BSD-2-Clause"] = clauses[: clauses.index("3. Neither")] + clauses[clauses.index("THIS SOFTWARE") :]
    return sorted(texts.items())


#: Words of a text: letters and digits, with single dots and hyphens inside.
TERMS = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


@dataclass(frozen=True)
class Settings:
    """score: least cosine of a match. file_share: part of a text that passages of a license file
    make up. anchors and terms are regular expressions. contained: part of a full license text
    that a text holds, by runs of ``run`` terms. longest: characters of a block; sentences and
    runs of words stand for longer ones."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    score: float = 0.6
    file_share: float = 0.5
    anchors: str = "(?i)licen[sc]e|copyright|public domain|permission is hereby"
    # possessive: a plain repeat of a group is a recursion over the text
    terms: str = "[a-z0-9]++(?:[.-][a-z0-9]++)*+"
    headers: tuple[tuple[str, str], ...] = HEADERS
    contained: float = 0.8
    run: int = 5
    longest: int = 2000


def passages(text: Column, settings: Settings) -> Column:
    """The lines of a text that hold an anchor, trimmed."""
    lines = F.filter(
        F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(settings.anchors))
    )
    trimmed = F.transform(lines, lambda line: F.trim(line))
    return F.when(F.regexp_like(text, F.lit(settings.anchors)), trimmed)


def digest(text: Column) -> Column:
    """128 bits that stand for a text; they go through joins once a term, so they are short."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def terms(text: Column, settings: Settings) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(settings.terms), F.lit(0))


def scored(lines: DataFrame, settings: Settings, text: str = "line") -> DataFrame:
    """(line, license, score) of the best template of each line that reaches the least score.

    lines is (line, n), n the number of passages that read so; another column may hold the text,
    line is its digest then. The weight of a term is its count
    times 1 + ln((1 + passages) / (1 + passages with the term)). Ties go to the first name.
    """
    spark = lines.sparkSession
    counted = lines.select("line", "n", F.explode(terms(F.col(text), settings)).alias("term"))
    tf = counted.groupBy("line", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    idf = tf.groupBy("term").agg(
        (1 + F.log((1.0 + total) / (1 + F.sum("n")))).alias("idf")
    )
    none = F.lit(1.0) + F.log(F.lit(1.0 + total))
    weighed = tf.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    patterns = (
        spark.createDataFrame(
            [(i, name, text) for i, (name, text) in enumerate(settings.templates)],
            "template int, license string, text string",
        )
        .select("template", "license", F.explode(terms(F.col("text"), settings)).alias("term"))
        .groupBy("template", "license", "term")
        .agg(F.count("*").alias("tf"))
        .join(idf, "term", "left")
        .select(
            "template", "license", "term", (F.col("tf") * F.coalesce("idf", none)).alias("tw")
        )
    )
    norms = patterns.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") ** 2)).alias("tn"))
    own = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    best = Window.partitionBy("line").orderBy(F.desc("score"), "license")
    return (
        weighed.join(patterns, "term")
        .groupBy("line", "template", "license")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
        .join(norms, "template")
        .join(own, "line")
        .select(
            "line", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tn")), 6).alias("score")
        )
        .where(F.col("score") >= settings.score)
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .drop("rank")
    )


#: Comment marks at the start of a line, and what a license tag says.
MARKS = r"(?m)^[ \t]*(?:[/*#;%!<>|\"'-]+|(?:dnl|rem|REM)\b)?[ \t]*"
TAG = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]++(?:\)?[ \t]++(?:OR|AND|WITH)[ \t]++\(?[A-Za-z0-9.+-]++)*+)"


def blocks(plain: Column, settings: Settings) -> Column:
    """Parts of a text without comment marks that hold an anchor: paragraphs, two and three lines
    on end, one and two sentences, and runs of words around the anchor."""

    def joined(parts: Column, size: int) -> Column:
        return once(
            parts,
            lambda all_: F.transform(all_, lambda x, i: F.array_join(F.slice(all_, i + 1, size), " ")),
        )

    near = r"(?<!\S)(?:[^\s]++\s++){0,%d}[^\s]*(?:" + settings.anchors.removeprefix("(?i)") + r")[^\s]*(?:\s+[^\s]+){0,%d}"
    lines, one = F.split(plain, r"\r?\n"), F.regexp_replace(plain, r"\s+", " ")
    sentences = F.split(one, r"(?<=[.;!?:])\s+")
    parts = F.concat(
        F.split(plain, r"\r?\n[ \t\r]*\n"),
        joined(lines, 2),
        joined(lines, 3),
        sentences,
        joined(sentences, 2),
        *(F.regexp_extract_all(one, F.lit("(?i)" + near % (n, n)), F.lit(0)) for n in (5, 15)),
    )
    good = F.filter(
        parts,
        lambda x: (F.length(x) <= settings.longest) & F.regexp_like(x, F.lit(settings.anchors)),
    )
    return F.array_distinct(F.transform(good, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def term_runs(text: Column, settings: Settings) -> Column:
    """Hashes of the distinct runs of terms."""
    return once(
        terms(text, settings),
        lambda found: F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found) - settings.run + 1)),
                lambda i: F.xxhash64(F.slice(found, i, settings.run)),
            )
        ),
    )


#: What is found in a file; min of best picks the surest kind, then score and name.
EVIDENCE = ["path", "license", "score", "is_file", "kind"]


def whole(plain: DataFrame, settings: Settings) -> DataFrame:
    """Files (path, plain) that hold most of a full license text; score is the part they hold.

    Of texts that share parts the one most alike by Dice's measure counts.
    """
    known = (
        plain.sparkSession.createDataFrame(full_texts(), "license string, text string")
        .select("license", term_runs(F.col("text"), settings).alias("runs"))
        .select("license", F.size("runs").alias("size"), F.explode("runs").alias("run"))
    )
    own = plain.select(
        "path",
        F.xxhash64("plain").alias("fp"),
        F.size(terms(F.col("plain"), settings)).alias("n"),
        F.explode(term_runs(F.col("plain"), settings)).alias("run"),
    )
    best = Window.partitionBy("path", "fp").orderBy(F.desc("dice"), "license")
    # A repeated row has each run once more, so runs are counted as distinct ones.
    return (
        own.join(F.broadcast(known), "run")
        .groupBy("path", "fp", "license")
        .agg(F.count_distinct("run").alias("common"), F.max("n").alias("n"), F.max("size").alias("size"))
        .where(F.col("common") >= settings.contained * F.col("size"))
        .withColumn("dice", 2 * F.col("common") / (F.col("n") + F.col("size")))
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .withColumn("score", F.round(F.col("common") / F.col("size"), 6))
        .withColumn("is_file", F.col("common") >= settings.file_share * F.col("n"))
        .withColumn("kind", F.when(F.col("is_file"), 0).otherwise(2))
        .select(EVIDENCE)
    )


def tagged(plain: DataFrame, settings: Settings) -> DataFrame:
    """Files with a license tag; -only, -or-later and + are left out of its names."""
    tag = F.regexp_extract("plain", TAG, 1)
    named = F.regexp_replace(F.regexp_replace(tag, r"-only\b|-or-later\b|\+|[()]", ""), r"\s+", " ")
    return plain.where(F.col("plain").contains("SPDX-License-Identifier:") & (tag != "")).select(
        "path",
        named.alias("license"),
        F.lit(1.0).alias("score"),
        (F.length(tag) + len("SPDX-License-Identifier: ") >= settings.file_share * F.length("plain")).alias("is_file"),
        F.lit(1).alias("kind"),
    )


def noticed(plain: DataFrame, settings: Settings) -> DataFrame:
    """Files with a block that is like a notice or a usual header."""
    tasks = 4 * int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = saved(
        plain.repartition(tasks, "path").select("path", F.length("plain").alias("size"), F.explode(blocks(F.col("plain"), settings)).alias("text"))
        .withColumn("line", digest(F.col("text")))
    )
    lines = found.groupBy("line").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    more = replace(settings, templates=(*settings.templates, *settings.headers))
    return (
        found.select("path", "size", F.length("text").alias("chars"), "line")
        .join(scored(saved(lines), more, "text"), "line")
        .withColumn("is_file", F.col("chars") >= settings.file_share * F.col("size"))
        .withColumn("kind", F.lit(3))
        .select(EVIDENCE)
    )


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def best_of(*columns: str) -> Column:
    """The best score, then the first name, after the given columns."""
    return F.min(F.struct(*columns, (-F.col("score")).alias("minus"), "license")).alias("best")


def licensed(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The columns of files (path, text) without text, and license, how, score, license_dir.

    how is ``file`` or ``header`` for a license in the text, ``inherited`` for that of the license
    files in the directory license_dir, and ``none``. A text that mostly is a full license counts
    before a tag, a tag before a full license in a longer text, that before passages; of several
    passages the best counts, of several license files in a directory too; ties go to the first
    name. Files that share a path are one file; those without a path are one each and in no
    directory. A null or empty text has no license. Columns with the names of the results are replaced.
    """
    files = files.drop("license", "how", "score", "license_dir")
    # a path cannot hold the character that marks the texts of files without one
    own = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    key = F.coalesce(F.col("path"), F.concat(F.lit("\0"), own))
    found = saved(
        files.select(key.alias("path"), F.length("text").alias("size"), passages(F.col("text"), settings).alias("p"))
        .where("size(p) > 0")
        .select("path", "size", F.explode("p").alias("text"))
        .withColumn("line", digest(F.col("text")))
    )
    # A line has many terms and may be the whole text, so its digest goes through the joins.
    lines = found.groupBy("line").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    matched = (
        found.select("path", "size", F.length("text").alias("chars"), "line")
        .join(scored(saved(lines), settings, "text"), "line")
        .groupBy("path")
        .agg(best_of(), F.sum("chars").alias("covered"), F.max("size").alias("size"))
        .select(
            "path",
            "best.license",
            (-F.col("best.minus")).alias("score"),
            (F.col("covered") >= settings.file_share * F.col("size")).alias("is_file"),
            F.lit(3).alias("kind"),
        )
    )
    plain = saved(
        files.where(F.regexp_like("text", F.lit(settings.anchors))).select(
            key.alias("path"), F.trim(F.regexp_replace("text", MARKS, "")).alias("plain")
        )
    )
    # A block adds nothing where a line says the same.
    said = matched.select(F.col("path").alias("at"), F.col("license").alias("name"))
    new = noticed(plain, settings).join(
        said, F.col("path").eqNullSafe(F.col("at")) & (F.col("license") == F.col("name")), "left_anti"
    )
    evidence = matched.withColumn("later", F.lit(0)).union(
        whole(plain, settings)
        .union(tagged(plain, settings))
        .union(new)
        .withColumn("later", F.lit(1))
    )
    own = saved(
        evidence.groupBy("path")
        .agg(
            F.min(
                F.struct(
                    "kind", (-F.col("score")).alias("minus"), "later", "license", (~F.col("is_file")).alias("part")
                )
            ).alias("best")
        )
        .select(
            "path",
            "best.license",
            (-F.col("best.minus")).alias("score"),
            (~F.col("best.part")).alias("is_file"),
        )
    )
    speaking = (
        own.where(F.col("is_file") & ~F.col("path").startswith("\0"))
        .groupBy(parent(F.col("path")).alias("license_dir"))
        .agg(best_of())
        .select(
            "license_dir",
            F.col("best.license").alias("dir_license"),
            (-F.col("best.minus")).alias("dir_score"),
        )
    )
    steps = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")
    )
    near = (
        files.where("path is not null")
        .select(parent(F.col("path")).alias("dir"))
        .distinct()
        .select("dir", F.explode(above).alias("license_dir"))
        .join(speaking, "license_dir")
        .groupBy("dir")
        .agg(
            F.max_by(
                F.struct("license_dir", "dir_license", "dir_score"), F.length("license_dir")
            ).alias("up")
        )
    )
    # The columns of a file travel as one, so that none of them can clash with those added here.
    kept = [c for c in files.columns if c != "text"]
    return (
        files.select(
            F.struct(*(F.col(f"`{c}`") for c in kept)).alias("file"),
            parent(F.col("path")).alias("dir"),
            key.alias("path"),
        )
        .join(own, "path", "left")
        .join(near, "dir", "left")
        .select(
            *(F.col("file").getField(c).alias(c) for c in kept),
            F.coalesce("license", "up.dir_license").alias("license"),
            F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header"))
            .when(F.col("up").isNotNull(), "inherited")
            .otherwise("none")
            .alias("how"),
            F.coalesce("score", "up.dir_score").alias("score"),
            F.when(F.col("license").isNull(), F.col("up.license_dir")).alias("license_dir"),
        )
    )
