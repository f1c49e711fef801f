"""Licence scans: TF-IDF cosine of a file's lines, paragraphs and windows to licence notices and texts, then inheritance from the nearest directory.

Document frequencies of the notices' terms are counted over all files; words outside the notices weigh as a term that no file has. A unit
(line or paragraph) can reach the ``least`` cosine only if it holds one of a notice's anchors, the heaviest terms that must not all be missing, so only
units with an anchor are cut into terms. A notice with a number, its version, is met only by a unit with that number.

Templates (``licence_texts``: whole headers, licence texts or their heads, SPDX tags, and the notices inside longer lines) are compared with windows of
their length over the terms of the whole text. A window must hold the template's phrases, which name licence and version; windows begin at every eighth
of the template's length, those of short templates at every term. A file takes the licence of its best header, text or tag, without one that of its best
notice. A file without either takes that of the nearest directory on its path
which holds a licence file, one whose name matches ``LICENCE_NAME`` and whose own text has a licence.

All work is DataFrame expressions. Terms are runs of a-z and 0-9 in lower case. Null or empty texts have no licence of their own and may inherit;
a null path has no directory. Ties go to the licence first by name. Repeated rows are answered row by row; a path with several texts counts each text. An
empty table gives an empty result. Only path, text and the ``keep`` columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import let
from cloakframe.llm.common import saved
from cloakframe.llm.licence_texts import NOTICE_PHRASES, TEMPLATES

TERM = r"[a-z0-9]+"
LEAST = 0.7
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)"
# Notices by which files name their licence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released to the public domain under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _any_of(words: set[str]) -> str:
    return rf"(?<![a-z0-9])(?:{'|'.join(sorted(words))})(?![a-z0-9])"


def _cut(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def notice_windows(notices: tuple[tuple[str, str], ...] = NOTICES) -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """The notices that hold their licence's phrase, as templates."""
    known = [(licence, text, NOTICE_PHRASES.get(licence)) for licence, text in notices]
    return tuple((licence, text, (phrase,)) for licence, text, phrase in known if phrase and f" {phrase} " in f" {' '.join(_cut(text))} ")


def weights(files: DataFrame, text_col: str, texts: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency of the texts' terms over all files, and that of any other word."""
    vocabulary = {t for text in texts for t in _cut(text)}
    words = F.from_json(F.lit(json.dumps(sorted(vocabulary))), "array<string>")
    found = F.array_intersect(_terms(F.col(text_col)), words)
    # one row a term and task, however many files
    counts = dict(files.select(F.explode(found).alias("t")).groupBy("t").count().collect())
    n = files.count()
    return {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(n + 1) + 1


def notice_vectors(notices: tuple[tuple[str, str], ...], idf: dict[str, float], least: float) -> tuple[list[tuple], set[str]]:
    """(notice, licence, term, weight of the unit vector, 1 for the version, 1 if there is one) and the anchors of all notices."""
    rows, anchors = [], set()
    for i, (licence, text) in enumerate(notices):
        vector = {t: c * idf[t] for t, c in Counter(_cut(text)).items()}
        norm = math.sqrt(sum(w * w for w in vector.values()))
        version = next((t for t in _cut(text) if t.isdigit()), None)
        rows += [(i, licence, t, w / norm, int(t == version), int(version is not None)) for t, w in vector.items()]
        rest = 1.0
        for t in sorted(vector, key=lambda t: (-vector[t], t)):
            if rest < least * least - 1e-9:
                break
            anchors.add(t)
            rest -= (vector[t] / norm) ** 2
    return rows, anchors


def _met(phrases: str, joined: Column) -> Column:
    """Whether terms, joined and bordered by blanks, hold all phrases."""
    return F.forall(phrases, lambda p: F.contains(joined, p))


def window_licences(files: DataFrame, path_col: str, text_col: str, templates: tuple, idf: dict[str, float], other: float, least: float) -> DataFrame:
    """(path, text_md5, template, licence, cosine) of the windows that reach ``least``."""
    spark = files.sparkSession
    given, rows = [], []
    for i, (licence, text, phrases) in enumerate(templates):
        cut = _cut(text)
        vector = {t: c * idf[t] for t, c in Counter(cut).items()}
        norm = math.sqrt(sum(w * w for w in vector.values()))
        rows += [(i, t, w / norm) for t, w in vector.items()]
        given.append((i, licence, len(cut), max(1, len(cut) // 8), phrases[0].split()[0], [f" {p} " for p in phrases]))
    given = F.broadcast(spark.createDataFrame(given, "template int, licence string, length int, stride int, key string, phrases array<string>"))
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, term string, weight double"))
    terms = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    begins = {"[^a-z0-9]+".join(phrases[0].split()[:2]) for _, _, phrases in templates}
    held = files.filter(F.lower(F.col(text_col)).rlike(_any_of(begins)))
    joined = F.concat(F.lit(" "), F.array_join(_terms(F.col(text_col)), " "), F.lit(" "))
    held = saved(held.select(F.col(path_col).alias("path"), F.md5(F.col(text_col)).alias("text_md5"), joined.alias("joined")))
    pairs = held.join(given, _met("phrases", F.col("joined")))
    # the multiples of the stride from which a window reaches the place
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - F.col("length") + 1) / F.col("stride"))).cast("int")
    last = lambda i: F.floor(i / F.col("stride")).cast("int")

    def cuts(terms: Column) -> Column:
        at = F.filter(F.transform(terms, lambda t, i: F.when(t == F.col("key"), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(first(i), last(i)))))
        windows = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(terms, s * F.col("stride") + 1, F.col("length")).alias("terms")))
        return F.filter(windows, lambda w: let(F.concat(F.lit(" "), F.array_join(w["terms"], " "), F.lit(" ")), lambda j: _met("phrases", j)))

    key = ["path", "text_md5", "template", "licence", "at"]
    windows = pairs.select("path", "text_md5", "template", "licence", F.explode(let(F.split(F.trim("joined"), " "), cuts)).alias("c"))
    counted = windows.select("path", "text_md5", "template", "licence", "c.at", F.explode("c.terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(terms, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other))).join(vectors, ["template", "term"], "left")
    cosine = F.sum(F.col("w") * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))
    return weighed.groupBy(*key).agg(F.round(cosine, 9).alias("cosine")).filter(F.col("cosine") >= least).drop("at")


def own_licences(files: DataFrame, path_col: str = "path", text_col: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES, least: float = LEAST, templates: tuple = TEMPLATES) -> DataFrame:
    """(path, text_md5, licence, cosine) of the files whose text names a licence."""
    spark = files.sparkSession
    inside = (*templates, *notice_windows(notices))
    every, other = weights(files, text_col, [t for _, t in notices] + [t for _, t, _ in inside])
    idf = {t: every[t] for _, text in notices for t in _cut(text)}
    rows, anchors = notice_vectors(notices, idf, least)
    terms = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))  # both have the notices' size
    vectors = F.broadcast(spark.createDataFrame(rows, "notice int, licence string, term string, weight double, version int, versions int"))
    anchor = _any_of(anchors)
    held = files.filter(F.lower(F.col(text_col)).rlike(anchor)).select(F.col(path_col).alias("path"), F.md5(F.col(text_col)).alias("text_md5"), F.col(text_col).alias("text"))
    units = F.array_distinct(F.concat(F.split("text", r"\n"), F.split("text", r"\n\s*\n")))
    unit = held.select("path", "text_md5", F.posexplode(units).alias("at", "unit")).filter(F.lower("unit").rlike(anchor))
    counted = unit.select("path", "text_md5", "at", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("path", "text_md5", "at", "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(terms, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    weighed = saved(weighed.select("path", "text_md5", "at", "term", "w"))
    key = ["path", "text_md5", "at"]
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors, "term").groupBy(*key, "notice", "licence", "versions").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sum("version").alias("version"))
    dots = dots.filter("version = versions")
    same = [dots[c].eqNullSafe(norms[c]) for c in key]
    near = dots.join(norms, same).select(dots.path, dots.text_md5, "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"))
    near = near.filter(F.col("cosine") >= least).select("*", F.lit(1).alias("kind"))
    kind = F.when(F.col("template") < len(templates), 0).otherwise(2)
    found = near.unionByName(window_licences(files, path_col, text_col, inside, every, other, least).select("path", "text_md5", "licence", "cosine", kind.alias("kind")))
    # of one licence a text before a unit before a notice inside a unit; of several licences a text before the others
    found = found.groupBy("path", "text_md5", "licence").agg(F.min(F.struct("kind", (-F.col("cosine")).alias("less"))).alias("m"))
    order = F.struct(F.least("m.kind", F.lit(1)), "m.less", "licence")
    best = F.min_by(F.struct("licence", (-F.col("m.less")).alias("cosine")), order).alias("b")
    return found.groupBy("path", "text_md5").agg(best).select("path", "text_md5", "b.licence", "b.cosine")


def directory(path: Column) -> Column:
    """Path without its last part; empty for a path without a slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), notices: tuple[tuple[str, str], ...] = NOTICES, least: float = LEAST, name: str = LICENCE_NAME) -> DataFrame:
    """``keep``, path, licence, cosine, origin (own, directory or null) and from_directory for every row of ``files``."""
    own = saved(own_licences(files, path_col, text_col, notices, least))
    rows = files.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(path_col).alias("p"), F.md5(F.col(text_col)).alias("m"))
    rows = saved(rows.withColumn("d", directory(F.col("p"))))
    named = own.filter(F.regexp_extract("path", r"[^/]*$", 0).rlike(name)).withColumn("d", directory(F.col("path")))
    first = F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "licence", "path"))
    given = named.groupBy("d").agg(first.alias("g")).select(F.col("d").alias("from_directory"), F.col("g.licence").alias("g_licence"), F.col("g.cosine").alias("g_cosine"))
    # directories, not files, are paired with their ancestors
    dirs = rows.select("d").filter("d IS NOT NULL").distinct()
    parts = F.split("d", "/")
    above = dirs.select("d", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.withColumn("up", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("d", "/"), F.lit(1), F.greatest("depth", F.lit(1))), "/")))
    near = above.join(given, above.up == given.from_directory)
    nearest = near.groupBy("d").agg(F.max_by(F.struct("from_directory", "g_licence", "g_cosine"), "depth").alias("g")).select("d", "g.*")
    mine = own.select(F.col("path").alias("o_path"), F.col("text_md5").alias("o_md5"), F.col("licence").alias("o_licence"), F.col("cosine").alias("o_cosine"))
    out = rows.join(mine, rows.p.eqNullSafe(mine.o_path) & rows.m.eqNullSafe(mine.o_md5), "left").join(nearest, "d", "left")
    has = F.col("o_licence").isNotNull()
    return out.select(
        *[F.col(f"k_{c}").alias(c) for c in keep], F.col("p").alias(path_col), F.coalesce("o_licence", "g_licence").alias("licence"),
        F.coalesce("o_cosine", "g_cosine").alias("cosine"), F.when(has, "own").when(F.col("g_licence").isNotNull(), "directory").alias("origin"),
        F.when(~has, F.col("from_directory")).alias("from_directory"),
    )
