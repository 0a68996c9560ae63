"""Licence scans: TF-IDF cosine of licence lines to templates, then the nearest directory.

Only DataFrame functions: lines with a licence word are taken from whole texts,
equal lines fold into one, and their terms meet the weights of the templates in a
join. Inverse document frequencies come from all documents, for the terms of the
templates; any other term counts as one that no document holds. Files without a
licence of their own take that of the nearest directory above that has a licence
file. Directories fold before their ancestors are listed, so a directory that
holds a third of all files is one row there; files and lines meet their small
tables by plain joins, which Spark broadcasts by size or splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.llm.registry import ORACLES, query, table
from patchlight.session import written

# Licence names and sentences of their usual notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TRIGGER = r"licen[cs]|copyright|permission|redistribution|public domain|(^|[^a-z])cc by"
TERM = r"[a-z0-9]+(\.[0-9]+)*"
LEAST_SCORE = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def licence_lines(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "\n"), lambda line: F.lower(line).rlike(TRIGGER)))


def templates(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    numbered = [(k, name, text) for k, (name, text) in enumerate(rows)]
    return spark.createDataFrame(numbered, "template int, licence string, text string")


def line_scores(files: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """(line, licence, score) of the best template of each distinct licence line of ``files(lines)``; ties go to the first template."""
    known = templates(files.sparkSession, rows)
    words = known.select("template", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    vocabulary = words.select("term").distinct()
    held = F.array_distinct(F.flatten(F.transform("lines", terms)))
    spread = files.select(F.explode(held).alias("term"))
    df = spread.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    n = files.count()
    rarity = lambda d: F.log((F.lit(n) + 1) / (d + 1)) + 1
    idf = written(vocabulary.join(df, "term", "left").select("term", rarity(F.coalesce("df", F.lit(0))).alias("idf")), "idf")
    weights = words.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = written(weights.join(norms, "template").select("template", "term", (F.col("w") / F.col("norm")).alias("tw")), "weights")
    lines = written(files.select(F.explode("lines").alias("line")).distinct(), "lines")
    own = lines.select("line", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))
    own = own.join(idf, "term", "left").select("line", "term", (F.col("tf") * F.coalesce("idf", rarity(F.lit(0)))).alias("w"))
    own = written(own, "terms")
    lengths = own.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.join(weights, "term").groupBy("line", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(lengths, "line").select("line", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.groupBy("line").agg(F.max(F.struct("score", (-F.col("template")).alias("minus"))).alias("best"))
    best = best.select("line", F.col("best.score").alias("score"), (-F.col("best.minus")).alias("template"))
    return best.join(known.select("template", "licence"), "template").select("line", "licence", "score", "template")


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, with their depths, up to the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))).alias("above")),
    )


def licensed(files: DataFrame, rows: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, path, own_licence, own_score, licence, licence_folder) of every row of ``files(doc_id, path, text)``.

    ``own_licence`` is the best template of any licence line of the whole text with
    at least the least score; ``licence`` is it, or that of the nearest folder
    above, the file's own included, with a licence file of one; null if there is
    none. Of several licence files in a folder the best score counts, then the
    first template. Null texts have no line and null paths no folder; repeated
    rows stay rows. Other columns are ignored.
    """
    lines = F.coalesce(licence_lines(F.col("text")), F.array().cast("array<string>"))
    held = written(files.select("doc_id", "path", lines.alias("lines"), F.monotonically_increasing_id().alias("row")), "files")
    scores = written(line_scores(held, rows).where(F.col("score") >= least), "scores")
    found = held.select("row", F.explode("lines").alias("line")).join(scores, "line")
    best = F.max(F.struct("score", (-F.col("template")).alias("minus"), "licence")).alias("best")
    found = written(found.groupBy("row").agg(best), "found")
    own = held.drop("lines").join(found, "row", "left").withColumn("folder", parent(F.col("path")))
    own = written(own, "own")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    givers = own.where(F.col("best").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("folder").agg(F.max("best").alias("given"))
    givers = givers.select(F.col("folder").alias("above"), F.col("given.licence").alias("given"))
    folders = own.where("folder is not null").select("folder").distinct()
    steps = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.depth", "a.above")
    nearest = steps.join(givers, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    nearest = written(nearest.select("folder", F.col("near.above").alias("above"), F.col("near.given").alias("given")), "nearest")
    return own.join(nearest, "folder", "left").select(
        "doc_id", "path", F.col("best.licence").alias("own_licence"), F.col("best.score").alias("own_score"),
        F.coalesce("best.licence", "given").alias("licence"), F.when(F.col("best").isNull(), F.col("above")).alias("licence_folder"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder for each source, language and thousand ids. A document of at most two lines
    with a licence word is the licence file of its source and language."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda line: F.trim(line) != ""))
    folder = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"))
    short = (lines <= 2) & (F.size(licence_lines(F.col("text"))) > 0)
    own = F.concat(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", F.concat(folder, F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(own)).alias("path"), "text")


@query
def op3_license_scan(spark, sf_dir):
    """Licence of every document, its own or that of the nearest folder."""
    return licensed(document_files(table(spark, sf_dir, "documents")))


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
    return rf"""
WITH known(template, licence, text) AS (VALUES {values}),
files AS (
  SELECT doc_id, text, list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(lower(x), '{TRIGGER}'))) AS lines,
    len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n_lines,
    '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS top
  FROM documents),
held AS (
  SELECT doc_id, lines, top || CASE WHEN n_lines <= 2 AND len(lines) > 0 THEN '/LICENSE.' || doc_id
    ELSE '/' || (doc_id // 1000) || '/' || doc_id || '.txt' END AS path FROM files),
tw AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM known) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM tw),
df AS (
  SELECT term, count(*) AS df FROM (
    SELECT DISTINCT doc_id, unnest(flatten(list_transform(lines, lambda x: regexp_extract_all(lower(x), '{TERM}')))) AS term FROM held)
  WHERE term IN (SELECT term FROM vocabulary) GROUP BY term),
idf AS (SELECT term, ln(((SELECT count(*) FROM held) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM vocabulary LEFT JOIN df USING (term)),
w AS (SELECT template, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS tw FROM tw JOIN idf USING (term)),
lines AS (SELECT DISTINCT unnest(lines) AS line FROM held),
own AS (
  SELECT line, term, tf * coalesce(idf, ln((SELECT count(*) FROM held) + 1) + 1) AS w
  FROM (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines) GROUP BY ALL)
  LEFT JOIN idf USING (term)),
norms AS (SELECT line, sqrt(sum(w * w)) AS norm FROM own GROUP BY line),
scored AS (
  SELECT line, template, round(sum(w * tw) / any_value(norm), 6) AS score FROM own JOIN w USING (term) JOIN norms USING (line) GROUP BY line, template),
best AS (
  SELECT line, score, template, licence FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, template) AS r FROM scored)
  JOIN known USING (template) WHERE r = 1 AND score >= {LEAST_SCORE}),
found AS (
  SELECT * FROM (SELECT doc_id, licence, score, template, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS r
    FROM (SELECT doc_id, unnest(lines) AS line FROM held) JOIN best USING (line)) WHERE r = 1),
mine AS (
  SELECT h.doc_id, path, licence, score, template, regexp_replace(path, '/[^/]*$', '') AS folder FROM held h LEFT JOIN found f ON h.doc_id = f.doc_id),
givers AS (
  SELECT folder, licence AS given FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, template) AS r FROM mine
    WHERE licence IS NOT NULL AND regexp_matches(path, '/LICENSE\.[^/]*$')) WHERE r = 1),
near AS (
  SELECT f.folder, max_by(g.folder, length(g.folder)) AS above, max_by(given, length(g.folder)) AS given
  FROM (SELECT DISTINCT folder FROM mine) f JOIN givers g ON f.folder = g.folder OR starts_with(f.folder, g.folder || '/') GROUP BY f.folder)
SELECT doc_id, path, licence AS own_licence, score AS own_score, coalesce(licence, given) AS licence,
  CASE WHEN licence IS NULL THEN above END AS licence_folder
FROM mine LEFT JOIN near USING (folder)"""


ORACLES["op3_license_scan"] = _sql()
