"""License scan of a file tree (DataFrame functions only).

*Detection.* Each line of a file, and the whole text of a licence file (a file
named like LICENSE, COPYING or NOTICE), is compared with the licence templates by
the cosine of sparse TF-IDF vectors. The idf is that of the template collection
(a word in no template counts as rarest), so it needs no pass over the corpus
and is the same at every size. A line can only reach the least cosine ``t`` with
a template if it holds one of the template's key words: those left when its
commonest words, up to less than ``t`` of its norm, are set aside. Only lines
with a key word are taken apart; no line that could match is left out.
Equal lines are compared once, however many files hold them.

*Tags.* ``SPDX-License-Identifier:`` tags are read as licence expressions, ids whole;
their first id goes before any likeness, and all their ids are among ``licenses``.

*Texts and headers.* With ``texts`` (whole licence texts, standard headers, the
notices; several per licence, with an idf of their own), files that hold
a licence word (``WORDS``) are also compared over their lines: comment marks are no
words, so a header of several lines, a notice inside a longer line and a whole text
are runs of words. Three-word shingles shared with a template vote for where it would
begin in the file; the template-sized window that most of them agree on is compared,
if shared shingles are a twentieth of the template's or more. Titles of licences are
compared with whole lines. The better score wins, on equal scores the line's notice.

*Inheritance.* A file without a licence of its own takes that of the licence
files in the nearest directory on its path, its own first. Distinct directories
are joined with the directories that have a licence through all their ancestors;
files then join their directory's answer, so a directory that holds a third of
all files costs one row until that last, skew-tolerant join.

Words are runs of letters and digits, with inner dots before a digit kept
("4.0"), lower case.

Defined results: a null or empty text has no licence of its own; a null path is
a file in the root; of several matches in a file the best cosine wins, then the
first template by id; of several licence files in a directory likewise; repeated
rows are repeated with the same result; a line that denies a licence ("is not
licensed under") names none; of a very long text only lines and windows with a
licence word are taken apart; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .license_texts import HEADERS, HEADINGS, TEXTS

#: Public notices, by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
LICENSE_FILE = r"^(?:LICEN[CS]E|COPYING|NOTICE|UNLICENSE)(?:[.\-_].*)?$"
#: A tag's licence expression: ids joined by AND, OR and WITH (fixed form).
SPDX = r"(?i:SPDX-License-Identifier):[ \t]*\(*([A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"
#: Known ids; others state nothing that the scan can name.
SPDX_IDS = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
            "CC0-1.0", "EPL-2.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")
#: A line that denies a licence is no notice of it.
DENIAL = r"(?i)\bnot\s+(?:\w+\s+)?(?:licen[sc]ed|released|distributed|covered|available)\b"
#: ``(licence, text, whole lines only)``.
LONG = [(i, t, False) for i, t in (*TEMPLATES, *HEADERS, *TEXTS)] + [(i, t, True) for i, t in HEADINGS]
WORDS = r"licen[sc]|copyright|permission|warrant|redistribut|spdx|public domain"
SHINGLE = 3
WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"


def templates(spark: SparkSession, rows: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``(license_id, text)`` of a fixed list."""
    listed = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in rows])
    return spark.range(1).select(F.explode(listed).alias("t")).select("t.*")


def texts(spark: SparkSession, rows: list[tuple[str, str, bool]] = LONG) -> DataFrame:
    """``(license_id, text, line_only)``; a number after the id tells a licence's texts apart."""
    listed = F.array(*[F.struct(F.lit(f"{i}#{k}").alias("license_id"), F.lit(t).alias("text"), F.lit(line).alias("line_only")) for k, (i, t, line) in enumerate(rows)])
    return spark.range(1).select(F.explode(listed).alias("t")).select("t.*")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def weigh(templates: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """``(license_id, token, w)`` with unit norm, ``(token, idf)``, and the idf
    of a word in no template: ln((1 + N) / (1 + df)) + 1."""
    said = templates.select("license_id", F.explode(tokens(F.col("text"))).alias("token"))
    counts = said.groupBy("license_id", "token").agg(F.count("*").alias("tf"))
    n = templates.select("license_id").distinct().count()
    idf = counts.groupBy("token").agg((F.log((1 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = counts.join(idf, "token").select("license_id", "token", (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy("license_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "license_id").select("license_id", "token", (F.col("x") / F.col("norm")).alias("w")), idf, math.log(1 + n) + 1


def commonness(files: DataFrame, weights: DataFrame, text_col: str) -> dict[str, int]:
    """How many files hold each word of the templates (all files; one small row a word)."""
    known = [r.token for r in weights.select("token").distinct().collect()]
    held = F.array_intersect(tokens(F.col(f"`{text_col}`")), F.lit(known).cast("array<string>"))
    return {r.token: r["count"] for r in files.select(F.explode(held).alias("token")).groupBy("token").count().collect()} if known else {}


def key_pattern(weights: DataFrame, least: float, common: dict[str, int]) -> str:
    """A pattern that finds a key word of any template: as many of a template's
    commonest words as weigh less than ``least`` of its norm are no key words.
    The template collection, not the corpus, bounds what comes to the driver."""
    held: dict[str, list[tuple[int, str, float]]] = {}
    for r in weights.collect():
        held.setdefault(r.license_id, []).append((common.get(r.token, 0), r.token, r.w))
    keys = set()
    for ws in held.values():
        rest = 0.0
        for _, token, w in sorted(ws, key=lambda x: (-x[0], x[1])):
            if rest + w * w < least * least - 1e-9:
                rest += w * w
            else:
                keys.add(token)
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(k) for k in sorted(keys)) + r")(?![\p{L}\p{N}])" if keys else r"(?!)"


def match_units(units: DataFrame, weights: DataFrame, idf: DataFrame, unseen: float, least: float) -> DataFrame:
    """``(key, license_id, score)``: the best template of each distinct unit.

    Units go by their digest ``key``: a unit may be a whole file, and its text
    must not travel with each of its words.
    """
    words = units.dropDuplicates(["key"]).select("key", F.explode(tokens(F.col("unit"))).alias("token"))
    tf = words.groupBy("key", "token").agg(F.count("*").alias("tf"))
    own = tf.join(idf, "token", "left").select("key", "token", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("x"))
    norm = own.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = own.join(weights, "token").groupBy("key", "license_id").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norm, "key").select("key", "license_id", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    first = F.min(F.struct((-F.col("score")).alias("minus"), "license_id")).alias("b")
    return scored.filter(F.col("score") >= least).groupBy("key").agg(first).select("key", "b.license_id", (-F.col("b.minus")).alias("score"))


def folder(path: Column) -> Column:
    """The directory of a path ('' for the root)."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/+$", "")


def spdx_ids(text: Column) -> Column:
    """The licence ids of a text's SPDX tags, in order: each expression is read
    whole, exceptions (WITH) are left out, and -only, -or-later and + dropped."""
    said = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda e: F.regexp_replace(e, r"[ \t]+WITH[ \t]+\S+", ""))
    ids = F.flatten(F.transform(said, lambda e: F.split(F.regexp_replace(e, r"[()]", ""), r"[ \t]+(?:AND|OR)[ \t]+")))
    ids = F.array_distinct(F.transform(ids, lambda i: F.regexp_replace(i, r"(?:-only|-or-later|\+)$", "")))
    return F.filter(ids, lambda i: i.isin(*SPDX_IDS))


def detect_tags(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, license_id, score, place)``: the ids that SPDX tags state, score 1."""
    named = files.select(F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("text"))
    tagged = named.filter(F.col("text").rlike("(?i)SPDX-License-Identifier:")).select("path", spdx_ids(F.col("text")).alias("ids"))
    return tagged.select("path", F.posexplode("ids").alias("place", "license_id")).select("path", "license_id", F.lit(1.0).alias("score"), "place")


def detect(files: DataFrame, templates: DataFrame, least: float = 0.7, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, license_id, score)`` of every licence that a path's text names."""
    weights, idf, unseen = weigh(templates.select("license_id", "text"))
    pattern = key_pattern(weights, least, commonness(files, weights, text_col))
    named = files.select(F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("text"))
    whole = F.when(F.regexp_extract("path", r"[^/]*$", 0).rlike("(?i)" + LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = (named.filter(F.lower("text").rlike(pattern)).select("path", F.explode(F.concat(F.split("text", "\n"), whole)).alias("unit"))
             .filter(F.lower("unit").rlike(pattern) & ~F.col("unit").rlike(DENIAL)))
    units = materialise(units.withColumn("key", F.sha2("unit", 256)), "notice-lines")
    best = match_units(units, weights, idf, unseen, least)
    return units.select("path", "key").join(best, "key").groupBy("path", "license_id").agg(F.max("score").alias("score"))


def shingles(words: Column) -> Column:
    """The runs of ``SHINGLE`` words, by place."""
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " ")))).otherwise(F.array().cast("array<bigint>"))


def detect_texts(files: DataFrame, texts: DataFrame, least: float = 0.7, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, license_id, score)`` of every licence whose text, header or title a path holds."""
    texts = materialise(texts.withColumn("words", tokens(F.col("text"))), "licence-texts")
    weights, idf, unseen = weigh(texts.select("license_id", "text"))
    weights, idf = materialise(weights, "text-weights"), materialise(idf, "text-idf")
    placed = (texts.filter(~F.col("line_only")).select("license_id", F.size("words").alias("n_words"), shingles(F.col("words")).alias("s"))
              .select("license_id", "n_words", F.posexplode("s").alias("place", "shingle")))
    placed = materialise(placed, "text-shingles")

    named = files.select(F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("text"))
    held = materialise(named.filter(F.lower("text").rlike(WORDS)).withColumn("file", F.sha2("text", 256)), "licence-word-files")
    once = materialise(held.dropDuplicates(["file"]).select("file", "text", tokens(F.col("text")).alias("words")), "distinct-licence-word-files")

    said = once.select("file", shingles(F.col("words")).alias("s")).select("file", F.posexplode("s").alias("at", "shingle"))
    met = said.join(F.broadcast(placed), "shingle").groupBy("file", "license_id", "n_words", (F.col("at") - F.col("place")).alias("begin")).agg(F.count("*").alias("votes"))
    best = met.groupBy("file", "license_id", "n_words").agg(F.sum("votes").alias("shared"), F.min(F.struct((-F.col("votes")).alias("minus"), "begin"))["begin"].alias("begin"))
    best = best.filter(F.col("shared") * 20 >= F.col("n_words") - (SHINGLE - 1))
    window = F.slice("words", F.greatest(F.col("begin"), F.lit(0)) + 1, F.col("n_words") + F.least(F.col("begin"), F.lit(0)))
    opening = F.array_join(F.slice("words", F.greatest(F.col("begin") - 3, F.lit(0)) + 1, 7), " ")  # a denial stands before or at the window's first words
    windows = once.select("file", "words").join(best, "file").filter(~opening.rlike(DENIAL)).select("file", F.array_join(window, " ").alias("unit"))
    lines = once.select("file", F.explode(F.split("text", "\n")).alias("unit")).filter(F.lower("unit").rlike(WORDS) & ~F.col("unit").rlike(DENIAL))
    units = windows.withColumn("line", F.lit(False)).unionByName(lines.withColumn("line", F.lit(True)))
    units = materialise(units.withColumn("key", F.sha2("unit", 256)).distinct(), "text-units")

    matched = match_units(units, weights, idf, unseen, least)
    hits = units.select("file", "key").distinct().join(matched, "key").withColumn("license_id", F.substring_index("license_id", "#", 1))
    found = hits.groupBy("file", "license_id").agg(F.max("score").alias("score"))
    return held.select("path", "file").distinct().join(found, "file").groupBy("path", "license_id").agg(F.max("score").alias("score"))


def ancestors(path: Column) -> Column:
    """All directories of a directory's path, itself first, the root ('') last."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, templates: DataFrame, least: float = 0.7, path_col: str = "path", text_col: str = "text", texts: DataFrame | None = None,
         keep: tuple[str, ...] = (), all_licenses: bool = False) -> DataFrame:
    """``(path, *keep, license_id, score, how, licensed_by)`` of every file: how is
    header, inherited or none; licensed_by is the directory inherited from. With
    ``all_licenses`` also ``licenses``: all that the file (or directory) names, sorted."""
    named = detect(files, templates, least, path_col, text_col).withColumn("rank", F.lit(0))
    tags = detect_tags(files, path_col, text_col).select("path", "license_id", "score", (F.col("place") - 1_000_000).alias("rank"))
    hits = named.unionByName(tags)
    if texts is not None:
        hits = hits.unionByName(detect_texts(files, texts, least, path_col, text_col).withColumn("rank", F.lit(1)))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "rank", "license_id")).alias("b")
    own = hits.groupBy("path").agg(best, F.array_sort(F.collect_set("license_id")).alias("licenses")).select("path", "b.license_id", (-F.col("b.minus")).alias("score"), "licenses")
    own = materialise(own, "own-licences")
    paths = files.select(F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), *[F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)])
    paths = paths.withColumn("dir", folder(F.col("path")))
    is_license = F.regexp_extract("path", r"[^/]*$", 0).rlike("(?i)" + LICENSE_FILE)
    first = F.min(F.struct((-F.col("score")).alias("minus"), "license_id")).alias("b")
    by_dir = (own.filter(is_license).groupBy(folder(F.col("path")).alias("up")).agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_set("licenses")))).alias("dir_licenses"))
              .select("up", F.col("b.license_id").alias("dir_license"), (-F.col("b.minus")).alias("dir_score"), "dir_licenses"))
    dirs = paths.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("away", "up"))
    nearest = F.min(F.struct("away", "up", "dir_license", "dir_score", "dir_licenses")).alias("n")
    inherited = dirs.join(by_dir, "up").groupBy("dir").agg(nearest).select("dir", "n.up", "n.dir_license", "n.dir_score", "n.dir_licenses")
    found = paths.join(own, "path", "left").join(inherited, "dir", "left")
    has = F.col("license_id").isNotNull()
    how = F.when(has, "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    every = [F.when(has, F.col("licenses")).otherwise(F.col("dir_licenses")).alias("licenses")] if all_licenses else []
    return found.select("path", *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], F.coalesce("license_id", "dir_license").alias("license_id"),
                        F.when(has, F.col("score")).otherwise(F.col("dir_score")).alias("score"), how.alias("how"), F.when(~has, F.col("up")).alias("licensed_by"), *every)
