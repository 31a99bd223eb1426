"""Operator 13: license scans by an exact set-similarity join, with DataFrame functions only.

A template is the set of the words of a license notice. Of a text, its blocks for a template of L
words are the runs of 2 L words that start at every L-th word, so that a notice that stands in the
text as a whole stands within one block. A block meets a template if it holds PERCENT of its distinct
words. The join finds every such block:

1. All documents are counted for each word that any template has (as many counts as templates have
   words): the global order of tokens, rare first, then by code point.
2. A template's prefix are its first words in that order, one more than a block may lack. A block that
   meets the template has one of them, so only the places of prefix words leave the rows, with the
   words around them, and join the templates' prefixes by word.
3. A joined block is ordered in the same way. It stays if it has enough words (length), if the joined
   word is early enough in it (prefix) and if enough words follow it in both (position).
4. A block is verified once, by intersection, at the first of the prefix words that it holds.

Base phrases are found beside it as words that stand one after another. Rows are scanned in pieces of
PIECE words, so that no array grows with the square of a text. Results are put together by one
aggregation with a row for each document.

Defined results: null text has no words; texts without a match have no labels, score 0 and null
places; repeated rows, and rows without a doc_id, are all kept; of a block that stands at the end of
a text, the words that are there count; ties between templates give all their labels; an empty table
has no rows; further columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

WORDS, GAPS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only letter beyond ASCII that has a lower case within it, and one that stands for it.
KELVIN, OTHER = "\u212a", "\u00e5"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a template's distinct words, how many a block has to hold, in per cent.
PERCENT = 80
#: Words of a row's piece.
PIECE = 4096

# Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License notices, label and text.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)


def words(text: Column) -> Column:
    """The words of a text (null: none), in lower case. Words of ASCII letters are just those that A-Z in lower case gives."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    parts = F.split(low, GAPS)
    return F.slice(parts, _gap(parts, 0) + 1, F.greatest(F.lit(0), F.size(parts) - _gap(parts, 0) - _gap(parts, -1)))


def _gap(parts: Column, at: int) -> Column:
    """1 if a text begins (0) or ends (-1) between words, else 0."""
    return (F.element_at(parts, 1 if at == 0 else -1) == "").cast("int")


def parsed(templates) -> list[dict]:
    """Templates with their words' number and distinct words."""
    out = []
    for k, (label, notice) in enumerate(templates):
        found = re.findall(WORDS, notice.replace(KELVIN, OTHER).lower())
        if found:
            out.append({"template": k, "label": label, "length": len(found), "tokens": sorted(set(found))})
    return out


def token_order(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, those in the fewest rows of texts (words) first, then by code point."""
    held = texts.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("token"))
    count = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}  # at most the vocabulary
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _prefixes(spark: SparkSession, templates: list[dict], order: list[str], percent: int) -> DataFrame:
    """A row for each prefix word: token, place (from 1) in the template, and the template."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for t in templates:
        tokens = sorted(t["tokens"], key=rank.get)
        least = -(-percent * len(tokens) // 100)
        of = [F.lit(t["template"]).alias("template"), F.lit(t["label"]).alias("label"), F.lit(t["length"]).alias("length"), F.lit(tokens).alias("tokens"), F.lit(least).alias("least")]
        rows += [F.struct(F.lit(w).alias("token"), F.lit(k).alias("place"), *of) for k, w in enumerate(tokens[: len(tokens) - least + 1], 1)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _places(w: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after another."""
    first, *rest = phrase.split(" ")

    def here(i: Column) -> Column:
        met = F.get(w, i) == first
        for k, r in enumerate(rest, 1):
            met = met & F.coalesce(F.get(w, i + k) == r, F.lit(False))
        return met

    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)


def based(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """row, doc_id, words, n_words, n_base, first_word, last_word, base (labels, distinct) of every row of docs."""
    rows = docs.select("doc_id", words(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    some = F.size("words") > 0
    found = {f"at{k}_": F.when(some, _places(F.col("words"), p)).otherwise(F.array().cast("array<int>")) for k, p in enumerate(phrases)}
    rows = rows.withColumns(found)
    every = F.concat(*found)
    labels = F.array_compact(F.array(*[F.when(F.size(at) > 0, F.lit(label)) for at, label in zip(found, phrases.values())]))
    return rows.select(
        "row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_distinct(labels).alias("base"),
    )


_KEPT = ("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base")


def joined(rows: DataFrame, order: list[str], templates: list[dict], percent: int = PERCENT) -> DataFrame:
    """rows as based() leaves them, without words, for each block that meets a template: template, label,
    start and end (words, from 0, end exclusive), overlap, size (the template's words), score.

    A row without such a block comes with nulls, at least once.
    """
    prefixes = _prefixes(rows.sparkSession, templates, order, percent)
    wanted = sorted({w for t in templates for w in sorted(t["tokens"], key=order.index)[: len(t["tokens"]) - -(-percent * len(t["tokens"]) // 100) + 1]})
    far = 2 * max(t["length"] for t in templates)
    start = F.greatest(F.lit(0), F.col("piece") * PIECE - far)
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / PIECE).cast("int") - 1))))
    pieces = pieces.select(*_KEPT, "piece", start.alias("from_"), F.slice("words", start + 1, F.lit(PIECE + 2 * far)).alias("part_"))
    own = F.filter(
        F.sequence(F.col("piece") * PIECE - F.col("from_"), F.least(F.col("piece") * PIECE - F.col("from_") + PIECE, F.size("part_")) - 1), lambda i: F.get("part_", i).isin(wanted)
    )
    low = lambda i: F.greatest(F.lit(0), i - far)
    hits = F.transform(own, lambda i: F.struct((F.col("from_") + i).alias("at"), F.get("part_", i).alias("token"), (F.col("from_") + low(i)).alias("low"), F.slice("part_", low(i) + 1, F.lit(2 * far)).alias("near")))
    hit = pieces.select(*_KEPT, F.explode_outer(F.when(F.size("part_") > 0, hits)).alias("hit")).select(*_KEPT, "hit.*")
    met = hit.join(F.broadcast(prefixes), "token", "left")  # bounded by the templates
    last = F.floor(F.col("at") / F.col("length")).cast("int")
    met = met.withColumn("block", F.explode_outer(F.sequence(F.greatest(F.lit(0), last - 1), last)))
    met = met.withColumn("begin", F.col("block") * F.col("length"))
    met = met.withColumn("held", F.slice("near", F.col("begin") - F.col("low") + 1, 2 * F.col("length")))
    met = met.withColumn("ranked", F.array_intersect(F.lit(order), F.col("held")))  # the block's template words, rare first
    size, before = F.size("tokens"), F.slice("tokens", F.lit(1), F.col("place") - 1)
    at = F.array_position("ranked", F.col("token"))
    length = F.size("ranked") >= F.col("least")
    prefix = at <= F.size("ranked") - F.col("least") + 1
    position = F.least(size - F.col("place"), F.size("ranked") - at) + 1 >= F.col("least")
    once = (F.array_position("held", F.col("token")) == F.col("at") - F.col("begin") + 1) & ~F.arrays_overlap("ranked", before)
    met = met.withColumn("overlap", F.when(length & prefix & position & once, F.size(F.array_intersect("tokens", "ranked"))))
    good = F.col("overlap") >= F.col("least")
    end = F.least(F.col("begin") + 2 * F.col("length"), F.col("n_words"))
    made = {"template": "template", "label": "label", "start": F.col("begin"), "end": end, "overlap": "overlap", "size": size, "score": F.col("overlap") / size}
    return met.select(*_KEPT, *[F.when(good, F.col(c) if isinstance(c, str) else c).alias(n) for n, c in made.items()])


def _prepared(docs: DataFrame, templates, phrases: dict[str, str]) -> tuple[DataFrame, list[str], list[dict]]:
    known = parsed(templates)
    order = token_order(docs.select(words(F.col("text")).alias("words")), sorted({w for t in known for w in t["tokens"]}))
    return based(docs, phrases), order, known


def blocks(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Every block that meets a template: doc_id, template, label, start, end, overlap, size, score."""
    found = joined(*_prepared(docs, templates, PHRASES), percent)
    return found.filter("template is not null").select("doc_id", "template", "label", "start", "end", "overlap", "size", "score")


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row for each document: words, base places, labels, and score.

    The score is 1 where a base phrase stands, else the greatest share of a template's words that a block
    holds which meets it, else 0.
    """
    found = joined(*_prepared(docs, templates, phrases), percent)
    out = found.groupBy(*_KEPT).agg(F.collect_set("label").alias("made"), F.max("score").alias("best"))
    named = lambda c: F.array_join(F.array_sort(c), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", named("base").alias("base_labels"), named(F.array_union("base", "made")).alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the licenses that every document names or quotes."""
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


def _base(phrase: str) -> str:
    p = phrase.split(" ")
    return f"list_filter(range(len(w)), lambda i: w[i + 1] = {_quoted(p[0])}" + "".join(f" AND w[i + {k}] = {_quoted(x)}" for k, x in enumerate(p[1:], 2)) + ")"


#: Every block of every text against every template.
SQL = f"""
WITH t(label, length, tokens) AS (VALUES {", ".join(f"({_quoted(t['label'])}, {t['length']}, {_list(t['tokens'])})" for t in parsed(TEMPLATES))}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
b AS (SELECT r, doc_id, w, {", ".join(f"{_base(p)} AS a{k}" for k, p in enumerate(PHRASES))} FROM d),
e AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, list_concat({", ".join(f"a{k}" for k in range(len(PHRASES)))}) AS a,
      list_filter([{", ".join(f"CASE WHEN len(a{k}) > 0 THEN {_quoted(p)} END" for k, p in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS base FROM b),
k AS (SELECT r, label, length, tokens, w, unnest(range((len(w) + length - 1) // length)) AS k FROM d, t),
m AS (SELECT r, label, len(list_intersect(tokens, w[k * length + 1 : (k + 2) * length])) AS overlap, len(tokens) AS size FROM k),
g AS (SELECT r, list(DISTINCT label) AS made, max(overlap::DOUBLE / size) AS best FROM m WHERE 100 * overlap >= {PERCENT} * size GROUP BY r)
SELECT doc_id, n_words, len(a)::BIGINT AS n_base, list_min(a)::BIGINT AS first_word, list_max(a)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(made, [])))), ',') AS labels,
       CASE WHEN len(a) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM e LEFT JOIN g USING (r)
"""
