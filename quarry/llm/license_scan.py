"""Licence scans: an exact set-similarity join of text blocks with licence templates, in DataFrame operations only.

A template of n words is looked for in blocks: all words in 2 * w at a time, every w words, where w is the power of two from n on; so each
stretch of n words lies within one block. A block of words B meets a template T if it holds at least its threshold's share of T's distinct
words: \\|B & T\\| >= need = ceil(threshold * \\|T\\|). Words are ordered by the number of documents that hold them, rarest first. A pair that
meets shares a word among T's first \\|T\\| - need + 1 and B's first \\|B\\| - need + 1 words (prefix filter), B has at least need words of
templates (length filter), and where the first shared word stands at places i and j, need words can still follow (positional filter).
Pairs that pass are verified by their overlap. Words that no template has decide nothing and are left out of B.

Every whole text is read once: it gives the places of the base phrases, the template words it holds, which make the counts, and, if it
holds need words of some template at all, where they stand. What is broadcast are the templates' own words, a list given by the caller.

Defined cases: a null, empty or wordless text has no place, label or block, n_words 0 and score 0; first_word and last_word are null where no
base phrase stands; places that overlap all count; rows that repeat get equal results, and equal texts are one text; a very long text is one row
of words and many blocks; ties among words of equal count go by the word; an empty table gives no row; the scan reads doc_id and text alone.
A text under the GNU lesser or Affero terms usually holds the words of ``gpl`` too and then has that label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read_table
from quarry.sources.tables import Scratch, Stored

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    label: str
    text: str
    #: Share of the distinct words that a block must hold. Short notices need all: one word fewer is another licence.
    threshold: float = 0.8

    @property
    def words(self) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.text.translate(str.maketrans(UPPER, LOWER)))

    @property
    def need(self) -> int:
        return math.ceil(round(self.threshold * len(set(self.words)), 9))

    @property
    def width(self) -> int:
        return 1 << (len(self.words) - 1).bit_length()


#: Phrases that stand for a licence wherever they occur word by word.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Public notices of licences.
TEMPLATES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", 0.9),
    Template("gpl", "licensed under the GNU General Public License", 1.0),
    Template("cc-by", "licensed under a Creative Commons Attribution International License"),
    Template("cc-by-nc", "licensed under CC BY NC", 1.0),
    Template("all-rights-reserved", "All rights reserved", 1.0),
]


def vocabulary(templates: Sequence[Template], width: int | None = None) -> list[str]:
    return sorted({w for t in templates if width in (None, t.width) for w in t.words})


def starts(words: Column, phrase: Sequence[str]) -> Column:
    """Where the phrase's words stand one after another; places may overlap."""
    k = len(phrase)
    found = F.sequence(F.lit(0), F.size(words) - k)
    return F.filter(found, lambda i: F.slice(words, i + 1, F.lit(k)) == F.array(*map(F.lit, phrase)))


def read(docs: DataFrame, phrases: Sequence[tuple[str, str]], templates: Sequence[Template]) -> DataFrame:
    """(doc_id, h1, h2, n_words, places, present, hits) of each row: places of each phrase; the template words it holds; where they stand, if there are enough of them for any template."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATOR, " "))
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), plain.alias("plain"))
    words, padded = F.col("words"), F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    own = own.withColumn("words", F.when(F.col("plain") != "", F.split("plain", " ")).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<int>")
    places = [F.when(F.contains(padded, F.lit(f" {p} ")), starts(words, p.split(" "))).otherwise(none).alias(f"p{i}") for i, (_, p) in enumerate(phrases)]
    asked = vocabulary(templates)
    own = own.withColumn("present", F.array_intersect(F.array(*map(F.lit, asked)), words))
    enough = F.lit(False)
    for t in templates:
        enough |= F.size(F.array_intersect("present", F.array(*map(F.lit, sorted(set(t.words)))))) >= t.need
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(asked))
    return own.select("doc_id", "h1", "h2", F.size(words).cast("long").alias("n_words"), F.struct(*places).alias("places"), "present", F.when(enough, hits).alias("hits"))


def ordered(spark: SparkSession, rows: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(word, rank): the templates' words, rarest first; as long as the templates, whatever the documents."""
    asked = spark.createDataFrame([(w,) for w in vocabulary(templates)], "word string")
    counts = rows.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return asked.join(counts, "word", "left").select("word", F.row_number().over(Window.orderBy(F.coalesce("df", F.lit(0)), "word")).alias("rank"))


def ranked(spark: SparkSession, ranks: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(t, label, width, need, own): each template's words as ranks, rarest first."""
    flat = [(i, t.label, t.width, t.need, w) for i, t in enumerate(templates) for w in sorted(set(t.words))]
    own = spark.createDataFrame(flat, "t int, label string, width int, need int, word string")
    return own.join(F.broadcast(ranks), "word").groupBy("t", "label", "width", "need").agg(F.sort_array(F.collect_set("rank")).alias("own"))


def blocks(rows: DataFrame, ranks: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(h1, h2, width, block, held): the ranks of template words in each block that has enough of them, rarest first."""
    found = rows.where(F.col("hits").isNotNull()).select("h1", "h2", F.explode("hits").alias("x")).select("h1", "h2", "x.at", "x.word")
    at = F.col("at")
    inside = []
    for width in sorted({t.width for t in templates}):
        block = F.floor(at / width).cast("int")
        cells = F.transform(F.when(block > 0, F.array(block, block - 1)).otherwise(F.array(block)), lambda b: F.struct(F.lit(width).alias("width"), b.alias("block")))
        inside.append(F.when(F.col("word").isin(vocabulary(templates, width)), cells).otherwise(F.slice(cells, F.lit(1), F.lit(0))))
    dealt = found.join(F.broadcast(ranks), "word").select("h1", "h2", "rank", F.explode(F.concat(*inside)).alias("c")).select("h1", "h2", "c.width", "c.block", "rank")
    return dealt.groupBy("h1", "h2", "width", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))


def joined(cells: DataFrame, wanted: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(h1, h2, width, block, label, score): all blocks that meet a template."""
    least = {w: min(t.need for t in templates if t.width == w) for w in {t.width for t in templates}}
    need = F.coalesce(*[F.when(F.col("width") == w, F.lit(n)) for w, n in least.items()])
    size = F.size("held")
    left = cells.where(size >= need).select("*", F.posexplode(F.slice("held", F.lit(1), size - need + 1)).alias("i", "rank"))
    total = F.size("own")
    right = wanted.select("*", F.posexplode(F.slice("own", F.lit(1), total - F.col("need") + 1)).alias("j", "rank"))
    follows = F.least(size - F.col("i"), total - F.col("j")) >= F.col("need")
    met = left.join(F.broadcast(right), ["width", "rank"]).where((size >= F.col("need")) & (F.col("i") <= size - F.col("need")) & follows)
    overlap = F.size(F.array_intersect("held", "own"))
    return met.where(overlap >= F.col("need")).select("h1", "h2", "width", "block", "label", (overlap / total).alias("score")).distinct()


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as read() gives them, without words; and the blocks found: (h1, h2, first, last, label, score), first and last being words of the text, last one beyond."""
    spark = docs.sparkSession
    rows = Stored(read(docs, phrases, templates)).df
    with Scratch() as scratch:
        ranks = scratch.keep(ordered(spark, rows, templates))
        wanted = scratch.keep(ranked(spark, ranks, templates))
        found = joined(blocks(rows, ranks, templates), wanted, templates)
        first = F.col("block") * F.col("width")
        found = Stored(found.select("h1", "h2", first.alias("first"), (first + 2 * F.col("width")).alias("last"), "label", "score")).df
    return rows.drop("present", "hits"), found


def labelled(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks) of every row."""
    rows, found = scan(docs, phrases, templates)
    # a table of its own, so that both sides of the join are dealt alike and the rows of a very common text can be split
    by_text = Stored(found.groupBy("h1", "h2").agg(F.collect_set("label").alias("added"), F.max("score").alias("best"), F.count(F.lit(1)).alias("n_blocks"))).df
    places = [F.col(f"places.p{i}") for i in range(len(phrases))]
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (label, _) in zip(places, phrases)]))
    every = F.concat(*places)
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return rows.join(by_text, ["h1", "h2"], "left").select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.coalesce("added", none))).alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    """Every block against every template, by counting. doc_id is unique in these tables."""
    words = ", ".join(f"({i}, '{t.label}', {t.width}, {t.need}, {len(set(t.words))}, '{w}')" for i, t in enumerate(TEMPLATES) for w in sorted(set(t.words)))
    phrases = ", ".join(f"('{label}', {p.split(' ')!r})" for label, p in PHRASES)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ph AS (SELECT * FROM (VALUES {phrases}) x(label, p)),
pl AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS pos FROM d, ph WHERE len(w) >= len(p)),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {words}) x(t, label, width, need, total, word)),
h AS (SELECT doc_id, i AS pos, w[i + 1] AS word FROM d, unnest(range(len(w))) r(i)),
c AS (SELECT doc_id, t, label, width, need, total, pos // width - y.o AS block, count(DISTINCT word) AS n
      FROM h JOIN t USING (word), (VALUES (0), (1)) y(o) WHERE pos // width - y.o >= 0 GROUP BY ALL),
f AS (SELECT DISTINCT doc_id, label, width, block, n / total AS score FROM c WHERE n >= need),
m AS (SELECT doc_id, max(score) AS best, count(*) AS n_blocks FROM f GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM f UNION ALL SELECT doc_id, label FROM pl) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN a USING (doc_id)
"""


ORACLE = oracle()
