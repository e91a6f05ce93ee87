"""License scan: an exact set-similarity join of text blocks with license templates, in SQL functions only.

A text's lines, and the text as a whole (line breaks as blanks, for notices wrapped over lines), are cut into blocks, each
starting half a block after the one before, so that any run of half a block's words lies in one. A template of SHORT
different words or more meets blocks of BLOCK words (more where it is longer itself), and matches where a block holds at
least CONTAINMENT of its words; a shorter one meets blocks of twice the longest short template and must be there wholly.
Words that name the license have to be among them. Of the templates that match one block those go whose common words
another one has too: a strict part of them, or the same ones as a smaller share. So a notice of one license isn't taken
for those of its family that differ by a word.

The templates' words are ordered by the number of documents that have them, rarest first. By that order a matching block
has one of a template's first n - o + 1 words (prefix filter; o of n must be there), has at least o words of the
templates' (length filter), and from its first word in common with the template on, both have enough words left
(positional filter). What passes is verified by counting the common words.

The prefix words of the templates (a parameter; here a few dozen rows) are what is broadcast. Base matches are whole
phrases. Null and empty texts match nothing; repeated rows get the same result each; an empty table gives no rows; matches
do not depend on the corpus, only the work saved by the order does.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, running, text_or_empty

CONTAINMENT, BLOCK, SHORT = 0.8, 96, 10

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of public licenses: label, notice, and the words of it that name the license.
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted software"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser"),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3.", "gnu affero"),
    ("gfdl", "This work is licensed under the GNU Free Documentation License, version 1.3.", "gnu documentation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution permitted"),
    ("bsd", "Licensed under the BSD 3-Clause License.", "bsd"),
    ("bsd", "Released under the BSD License.", "bsd"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission granted software"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "waived copyright"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc sa"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc nc"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License.", "creative commons noncommercial"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc nd"),
]

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """A text's words, in their own case, with one space between them and at both ends."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), _SEPARATORS, " ")


def running_words(notice: str) -> list[str]:
    return [w for w in re.split(_SEPARATORS, notice.translate(str.maketrans(_UPPER, _LOWER))) if w]


def words_in(notice: str) -> frozenset[str]:
    return frozenset(running_words(notice))


def literals(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def cut(words: Column, half: int) -> Column:
    """The blocks of 2 * half words of a line or text, half of it apart; the words are split once, not for each block."""

    def parts(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - half, F.lit(1)), F.lit(half))
        return F.when(F.size(words) <= 2 * half, F.array(words)).otherwise(F.transform(starts, lambda at: F.slice(words, at, 2 * half)))

    return once(words, parts)


def blocks_of(text: Column, half: int = BLOCK // 2) -> Column:
    """The blocks of each line, then, if there are more lines than one, those of the whole text: arrays of words, A-Z lower-cased."""
    lower = F.translate(text, _UPPER, _LOWER)
    blocks_in = lambda part: cut(F.split(F.trim(spaced(part)), " "), half)
    lines = F.flatten(F.transform(F.split(lower, "\n"), blocks_in))
    return F.when(F.contains(text, F.lit("\n")), F.concat(lines, blocks_in(lower))).otherwise(lines)


def phrase_places(phrase: str, label: str) -> Column:
    """struct<at, label> of all places of a phrase in the column `spaced`: words before it, from the gaps between places."""
    n = len(phrase.split())
    pieces = F.split("spaced", f"(?i) {phrase}(?= )")
    gaps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))))

    def places(gaps: Column) -> Column:
        before = running(F.transform(gaps, lambda gap: gap + n), lambda a, b: a + b)
        return F.zip_with(before, gaps, lambda a, gap: F.struct((a + gap).cast("long").alias("at"), F.lit(label).alias("label")))

    return F.when(F.col("spaced").rlike(f"(?i) {phrase} "), once(gaps, places))


def frequency_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that have each word, rarest first."""
    found = rows.select(F.explode(F.array_intersect(literals(vocabulary), F.split(F.lower("spaced"), " "))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in found.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


class Template:
    """A template's label, different words, words that must be there, how many must, and whether it is a short one."""

    def __init__(self, label: str, notice: str, needed: str = "", containment: float = CONTAINMENT):
        self.label, self.words, self.length = label, words_in(notice), len(running_words(notice))
        self.needed, self.short = words_in(needed) & self.words, len(self.words) < SHORT
        self.least = len(self.words) if self.short else math.ceil(len(self.words) * containment - 1e-9)


def prefix_table(templates: list[Template], order: list[str]) -> list[tuple]:
    """(word, p, template number, label, its words in order, o, the needed ones) of each word in a template's prefix."""
    place = {w: i for i, w in enumerate(order)}
    out = []
    for number, t in enumerate(templates):
        ordered = sorted(t.words, key=place.__getitem__)
        out += [(w, p, number, t.label, ordered, t.least, sorted(t.needed)) for p, w in enumerate(ordered[: len(ordered) - t.least + 1])]
    return out


def half_of(templates: list[Template], short: bool) -> int:
    """Half a block's words: any template as it runs lies in one block."""
    return max([1 if short else BLOCK // 2, *(t.length for t in templates)])


def hopeful(words: Column, templates: list[Template]) -> Column:
    """Whether a text of these words has enough words of some template, and those that it needs."""

    def fits(found: Column) -> Column:
        parts = [(F.size(F.array_except(literals(sorted(t.needed)), found)) == 0 if t.needed else F.lit(True)) & (F.size(F.array_intersect(literals(sorted(t.words)), found)) >= t.least) for t in templates]
        return reduce(lambda x, y: x | y, parts)

    known = literals(sorted(frozenset().union(*(t.words for t in templates))))
    return once(F.array_intersect(known, words), fits)


def shrunk_blocks(templates: list[Template], order: list[str], short: bool) -> Column:
    """struct<short, words>: of the blocks that may match what they have of the templates' words, rarest first."""
    entries = prefix_table(templates, order)
    known = literals([w for w in order if any(w in t.words for t in templates)])
    fewest, heads = min(e[5] for e in entries), literals(sorted({e[0] for e in entries}))
    words = F.transform(blocks_of(F.col("text"), half_of(templates, short)), lambda b: F.array_intersect(known, b))
    kept = F.filter(words, lambda b: (F.size(b) >= fewest) & F.arrays_overlap(b, heads))
    return F.transform(kept, lambda b: F.struct(F.lit(short).alias("short"), b.alias("words")))


def matched_blocks(rows: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """doc_id, text_key, block_no, label, share and common words of every block and template that match."""
    # A text's own words bound those of its blocks: few texts are cut up at all.
    few = rows.filter(hopeful(F.split(F.lower("spaced"), " "), templates))
    kinds = [(short, some) for short in (True, False) if (some := [t for t in templates if t.short == short])]
    table = [(short, *entry) for short, some in kinds for entry in prefix_table(some, order)]
    blocks = [shrunk_blocks(some, order, short) for short, some in kinds]
    cut_up = few.select("doc_id", "text_key", F.posexplode(F.concat(*blocks)).alias("block_no", "b")).select("doc_id", "text_key", "block_no", "b.short", F.col("b.words").alias("block"))
    tokens = cut_up.select("*", F.posexplode("block").alias("q", "word"))
    prefixes = rows.sparkSession.createDataFrame(table, "short boolean, word string, p int, template int, label string, words array<string>, least int, needed array<string>")
    joined = tokens.join(F.broadcast(prefixes), ["short", "word"])
    common = F.array_intersect("words", "block")
    left = 1 + F.least(F.size("words") - F.col("p") - 1, F.size("block") - F.col("q") - 1)
    passed = joined.filter((F.size("block") >= F.col("least")) & (left >= F.col("least")) & (F.element_at(common, 1) == F.col("word")))
    named = F.size(F.array_except("needed", "block")) == 0
    verified = passed.filter((F.size(common) >= F.col("least")) & named)
    return verified.select("doc_id", "text_key", "block_no", "label", (F.size(common) / F.size("words")).alias("share"), common.alias("common"))


def undominated(matches: Column) -> Column:
    """The matches of one block (struct<share, label, common>) whose common words no other one has too."""

    def by(m: Column, o: Column) -> Column:
        within = F.size(F.array_intersect(m["common"], o["common"])) == F.size(m["common"])
        return within & ((F.size(o["common"]) > F.size(m["common"])) | (o["share"] > m["share"]))

    return F.filter(matches, lambda m: ~F.exists(matches, lambda o: by(m, o)))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, ...]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Per row of docs: doc_id, n_words, base (array of struct<at, label>), matches: an array of
    struct<block_no, label, share, labels>, of each matching block the best template (largest share, then most words) and
    the labels of all that it matches and no other template explains better. templates: label, notice and, where given,
    the words of it that must be there."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text")).withColumn("spaced", spaced(F.col("text")))
    n_words = F.greatest(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "))) - 1, F.lit(0)).cast("long")
    base = F.flatten(F.array_compact(F.array(*(phrase_places(phrase, label) for phrase, label in PHRASES.items()))))
    counted = rows.select("doc_id", "text_key", n_words.alias("n_words"), base.alias("base"))
    all_of = [t for t in (Template(*t, containment=containment) for t in (TEMPLATES if templates is None else templates)) if t.words]
    order = frequency_order(rows, sorted(frozenset().union(*(t.words for t in all_of))))
    found = matched_blocks(rows, all_of, order)
    # One block has as many matches as there are templates, at most.
    single = F.struct("share", F.size("common").alias("n"), "label", "common")
    found = found.groupBy("doc_id", "text_key", "block_no").agg(undominated(F.collect_set(single)).alias("kept"))
    best = F.array_max(F.transform("kept", lambda m: F.struct(m["share"], m["n"], m["label"])))
    match = F.struct("block_no", best["label"].alias("label"), best["share"].alias("share"), F.sort_array(F.array_distinct(F.transform("kept", lambda m: m["label"]))).alias("labels"))
    found = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    same = F.col("c.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("c.text_key") == F.col("m.text_key"))
    none = F.array().cast("array<struct<block_no:int,label:string,share:double,labels:array<string>>>")
    return counted.alias("c").join(found.alias("m"), same, "left").select("c.doc_id", "n_words", "base", F.coalesce("matches", none).alias("matches"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = F.transform("base", lambda b: b["at"])
    base_labels = F.transform("base", lambda b: b["label"])
    labels = F.array_union(base_labels, F.flatten(F.transform("matches", lambda m: m["labels"])))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)))

    def joined(names: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base_labels).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))
