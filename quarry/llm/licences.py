"""Licence scans: sparse TF-IDF cosine of statements and licence files to templates, then directory inheritance.

A unit is a run of up to Settings.window neighbouring segments of a text, its lines cut at sentence ends, so that a statement
within a long line and one that is wrapped over lines are units as well. A unit's terms, weighted by count and inverse document
frequency, are compared with the terms of the templates: an equi-join on the term, with the template side of fixed size. Document
frequencies of the templates' terms count all texts; any other term has the greatest weight, as if no text had it. A file's own
licence is that of its best unit.

Most units are never looked at: by the Cauchy-Schwarz inequality the cosine is at most the root of the sum of a template's
squared weights over the shared terms. Of each template the most frequent terms, whose squares together stay below the
threshold's, can't reach it alone: a unit must have one of the others (see signs()).

A file without one takes the licence of the nearest directory above it that has a licence file: the distinct directories
are joined with their ancestors, and the deepest with a licence wins.

DataFrame functions only. Aggregations are partial before the shuffle; only units with such a term are exploded to terms,
and only distinct directories to ancestors.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Statements by which licences are named, one licence on several lines if need be.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Ends of sentences, at which a line is cut.
SENTENCE = "[.!?;] +"


@dataclass(frozen=True)
class Settings:
    """threshold: least cosine of a match. window: segments of a unit, at most."""

    threshold: float = 0.6
    window: int = 4


def terms(column):
    """The terms of a text column: runs of ASCII letters and digits, lower-cased, with decimals of versions."""
    return F.regexp_extract_all(F.translate(column, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _template_rows() -> list[tuple[int, str, str, int]]:
    out = []
    for i, (name, text) in enumerate(TEMPLATES):
        counts = Counter(re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER))))
        out += [(i, name, term, n) for term, n in sorted(counts.items())]
    return out


def _weights(files: DataFrame) -> DataFrame:
    """template, licence, term, idf and t_weight (the templates' unit vectors), and the weight of unknown terms."""
    spark = files.sparkSession
    rows = _template_rows()
    vocabulary = sorted({r[2] for r in rows})
    have = F.array_intersect(F.array_distinct(terms(F.col("text"))), F.array(*map(F.lit, vocabulary)))
    # a row per term of the templates, and one, with the empty term, per text
    found = files.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(have, F.expr("cast(array() as array<string>)")))).alias("term"))
    df = common.settle(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).coalesce(1))  # read twice; a row per term
    known = spark.createDataFrame([(v,) for v in vocabulary], "term string").join(F.broadcast(df), "term", "left")
    n = df.filter("term = ''").select(F.col("df").alias("n"))
    known = known.join(F.broadcast(n), F.lit(True), "left")  # one row
    idf = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    known = known.select("term", idf.alias("idf"), (F.log(F.coalesce("n", F.lit(0)) + 1.0) + 1).alias("unknown"))
    t = spark.createDataFrame(rows, "template int, licence string, term string, n int").join(F.broadcast(known), "term").withColumn("w", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))  # the terms of one template
    return common.settle(t.select("template", "licence", "term", "idf", "unknown", (F.col("w") / norm).alias("t_weight")).coalesce(1))


def signs(weights: DataFrame, s: Settings) -> list[str]:
    """Terms of which a unit must have one to match any template."""
    rising = Window.partitionBy("template").orderBy("idf", "term")
    below = weights.withColumn("sum", F.sum(F.col("t_weight") * F.col("t_weight")).over(rising))
    # a little less than the threshold, since scores are rounded
    return sorted(r.term for r in below.filter(F.col("sum") >= s.threshold**2 - 1e-4).select("term").distinct().collect())  # part of the templates' terms


def units(texts: DataFrame, signs_: list[str], s: Settings) -> DataFrame:
    """file, line, at and size (first segment and number of segments) and unit of texts(file, text): runs of segments, one of which
    has one of signs_; the first line is 1."""
    sign = F.array(*map(F.lit, signs_)) if signs_ else F.expr("cast(array() as array<string>)")
    has = lambda text: F.arrays_overlap(terms(text), sign)
    cut = F.transform(F.split("text", "\n", -1), lambda x, i: F.transform(F.split(x, SENTENCE, -1), lambda y: F.struct((i + 1).alias("line"), y.alias("text"))))
    some = F.filter(F.flatten(cut), lambda x: x["text"].rlike("[A-Za-z0-9]"))
    marked = F.transform(some, lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), has(x["text"]).alias("hit")))
    d = texts.filter(has(F.col("text"))).select("file", marked.alias("segments"))
    d = d.filter(F.size("segments") > 0).select("file", "segments", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("at"))
    d = d.select("file", "at", F.slice("segments", F.col("at"), s.window).alias("segments")).filter(F.exists("segments", lambda x: x["hit"]))
    d = d.select("file", "at", "segments", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("size"))
    d = d.select("file", F.col("segments")[0]["line"].alias("line"), "at", "size", F.slice("segments", F.lit(1), F.col("size")).alias("segments")).filter(F.exists("segments", lambda x: x["hit"]))
    return d.select("file", "line", "at", "size", F.array_join(F.transform("segments", lambda x: x["text"]), " ").alias("unit"))


def scan(files: DataFrame, s: Settings = Settings()) -> DataFrame:
    """file, line, licence, score of the best unit of each row of files(file, text) that has one. file tells rows apart;
    units at one place of repeated files are one. A null text has no unit. line, of the unit's first segment, is counted from 1."""
    weights = _weights(files)
    known = F.broadcast(weights.select("term", "idf").distinct())  # of fixed size, as the templates
    unknown = weights.agg(F.max("unknown").alias("unknown"))
    found = units(files.filter(F.col("text").isNotNull()), signs(weights, s), s)
    key = ["file", "line", "at", "size"]
    counted = found.select(*key, F.explode(terms(F.col("unit"))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))
    weighted = counted.join(known, "term", "left").join(F.broadcast(unknown), F.lit(True), "left").withColumn("w", F.col("n") * F.coalesce("idf", "unknown"))
    per = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("own"))
    dots = per.select(*key, "norm", F.explode("own").alias("o")).join(F.broadcast(weights.withColumnRenamed("term", "t_term")), F.col("o.term") == F.col("t_term"))
    dots = dots.groupBy(*key, "norm", "template", "licence").agg(F.sum(F.col("o.w") * F.col("t_weight")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= s.threshold)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "at", "size", "template", "licence", "line")).alias("b")
    return scored.groupBy("file").agg(best).select("file", F.col("b.line").cast("int").alias("line"), F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def above(directory):
    """All directories above one, and itself, from a column without a trailing slash: /a/b gives /a/b, /a and the empty root."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def inherit(files: DataFrame) -> DataFrame:
    """files(file, directory, is_licence_file, own) with licence and inherited_from: its own, or that of the nearest directory
    at or above its own with a licence file that has one (there: that of the least file name); null where none."""
    given = files.filter("is_licence_file and own is not null and directory is not null").groupBy("directory").agg(F.min_by("own", "file").alias("given"))
    places = files.filter("directory is not null").select("directory").distinct()
    ways = places.select("directory", F.explode(above(F.col("directory"))).alias("up"))
    nearest = (
        ways.join(given.withColumnRenamed("directory", "up"), "up").groupBy("directory")
        .agg(F.max_by(F.struct("up", "given"), F.length("up")).alias("g"))
        .select("directory", F.col("g.up").alias("from_"), F.col("g.given").alias("given"))
    )
    both = files.join(nearest, "directory", "left")
    return both.select(
        *[files[c] for c in files.columns if c != "directory"], "directory",
        F.coalesce("own", "given").alias("licence"), F.when(F.col("own").isNull() & F.col("given").isNotNull(), F.col("from_")).alias("inherited_from"),
    )


def documents_scan(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, path, own_licence, own_line, own_score, licence, inherited_from for each row of docs(doc_id, text, source).

    The table has no paths; these stand for them: directories /source/id div 1000/id div 100, one level higher for an id
    divisible by 30; the file is LICENSE-id for an id divisible by 10, id.txt for others. A null id or source counts as an
    empty name, id 0. Repeated ids (of a source) are one file, whose units at one place are one; each of their rows
    has its licence. Empty input gives an empty frame.
    """
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    d = docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    low = F.when(number % 30 != 0, F.concat(F.lit("/"), F.expr("cast(coalesce(doc_id, 0) div 100 as string)"))).otherwise("")
    folder = F.concat(F.lit("/"), "source", F.lit("/"), F.expr("cast(coalesce(doc_id, 0) div 1000 as string)"), low)
    name = F.when(number % 10 == 0, F.concat(F.lit("LICENSE-"), number.cast("string"))).otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    named = d.select("doc_id", "text", folder.alias("directory"), F.concat(folder, F.lit("/"), name).alias("file"), (number % 10 == 0).alias("is_licence_file"))
    matched = scan(named.select("file", "text"), s).select("file", F.col("licence").alias("own"), F.col("line").alias("own_line"), F.col("score").alias("own_score"))
    all_ = named.select("doc_id", "directory", "file", "is_licence_file").join(matched, "file", "left")
    out = inherit(all_)
    return out.select("doc_id", F.col("file").alias("path"), F.col("own").alias("own_licence"), "own_line", "own_score", "licence", "inherited_from")


def documents_sql(s: Settings = Settings()) -> str:
    """DuckDB SQL with the rows of documents_scan(), which looks at all units."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(name)}, {quote(term)}, {n})" for i, name, term, n in _template_rows())
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    return f"""
    WITH t(template, licence, term, n) AS (VALUES {values}),
    named AS (
      SELECT doc_id, text, '/' || coalesce(source, '') || '/' || CAST(coalesce(doc_id, 0) // 1000 AS VARCHAR)
        || CASE WHEN coalesce(doc_id, 0) % 30 <> 0 THEN '/' || CAST(coalesce(doc_id, 0) // 100 AS VARCHAR) ELSE '' END AS directory,
        coalesce(doc_id, 0) % 10 = 0 AS is_file FROM documents),
    f AS (
      SELECT *, directory || '/' || CASE WHEN is_file THEN 'LICENSE-' || CAST(coalesce(doc_id, 0) AS VARCHAR) ELSE CAST(coalesce(doc_id, 0) AS VARCHAR) || '.txt' END AS file FROM named),
    total AS (SELECT count(*) AS n FROM documents),
    vocabulary AS (SELECT DISTINCT term FROM t),
    have AS (
      SELECT DISTINCT file, unnest(regexp_extract_all({low % 'text'}, '{TERM}')) AS term FROM f WHERE text IS NOT NULL),
    weights AS (
      SELECT v.term, ln((any_value(total.n) + 1) / (count(h.file) + 1)) + 1 AS idf
      FROM vocabulary v LEFT JOIN have h USING (term), total GROUP BY v.term),
    tw AS (SELECT template, licence, term, t.n * idf AS w FROM t JOIN weights USING (term)),
    tn AS (SELECT template, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS t_weight FROM tw),
    cut AS (SELECT file, row_number() OVER () AS copy, string_split(text, chr(10)) AS parts FROM f WHERE text IS NOT NULL),
    lines AS (SELECT file, copy, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS line_text FROM cut),
    sentences AS (SELECT file, copy, line, string_split_regex(line_text, '{SENTENCE}') AS parts FROM lines),
    pieces AS (SELECT file, copy, line, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS piece FROM sentences),
    segments AS (
      SELECT file, copy, line, piece, row_number() OVER (PARTITION BY copy ORDER BY line, k) AS place FROM pieces WHERE regexp_matches(piece, '[A-Za-z0-9]')),
    words AS (SELECT file, copy, line, place, unnest(regexp_extract_all({low % 'piece'}, '{TERM}')) AS term FROM segments),
    counts AS (SELECT file, copy, place, term, count(*) AS n FROM words GROUP BY ALL),
    wide AS (
      SELECT s.file, s.line, s.place, z.size, c.term, c.n FROM segments s, range(1, {s.window} + 1) z(size), counts c
      WHERE c.copy = s.copy AND c.place >= s.place AND c.place < s.place + z.size
      AND s.place + z.size - 1 <= (SELECT max(place) FROM segments m WHERE m.copy = s.copy)),
    found AS (SELECT file, line, place, size, term, sum(n) AS n FROM wide GROUP BY ALL),
    weighted AS (
      SELECT file, line, place, size, term, found.n * coalesce(idf, ln(total.n + 1) + 1) AS w FROM found LEFT JOIN weights USING (term), total),
    norms AS (SELECT file, line, place, size, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY ALL),
    dots AS (SELECT file, line, place, size, template, licence, sum(w * t_weight) AS dot FROM weighted JOIN tn USING (term) GROUP BY ALL),
    scored AS (
      SELECT file, line, place, size, template, licence, round(dot / norm, 6) AS score FROM dots JOIN norms USING (file, line, place, size) WHERE round(dot / norm, 6) >= {s.threshold}),
    own AS (
      SELECT file, line, licence, score FROM scored QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, place, size, template) = 1),
    given AS (
      SELECT f.directory, arg_min(own.licence, f.file) AS licence FROM f JOIN own USING (file) WHERE is_file GROUP BY f.directory),
    nearest AS (
      SELECT d.directory, arg_max(g.directory, length(g.directory)) AS from_, arg_max(g.licence, length(g.directory)) AS licence
      FROM (SELECT DISTINCT directory FROM f) d JOIN given g ON d.directory = g.directory OR starts_with(d.directory, g.directory || '/') GROUP BY d.directory)
    SELECT f.doc_id, f.file AS path, own.licence AS own_licence, CAST(own.line AS INTEGER) AS own_line, own.score AS own_score,
      coalesce(own.licence, nearest.licence) AS licence, CASE WHEN own.licence IS NULL THEN nearest.from_ END AS inherited_from
    FROM f LEFT JOIN own USING (file) LEFT JOIN nearest ON f.directory = nearest.directory
    """
