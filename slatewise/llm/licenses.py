"""License scans: an exact set-similarity join of text blocks with licence templates, in DataFrame functions only.

Words are runs of characters other than the ASCII ones that are neither digits nor letters, A-Z lower-cased. A text is
cut into blocks of ``2 * STRIDE`` words, one every ``STRIDE`` words, so any run of up to ``STRIDE + 1`` words lies whole
in some block. A template with the distinct words T matches a block with the distinct words B where
``|T & B| >= alpha = ceil(threshold * |T|)``. The join is exact and never compares all blocks with all templates:

* words are ordered by the number of documents that have them, rarest first, counted over all documents. Only words of
  templates can be shared, so only they are ranked; a block is reduced to them;
* prefix filter: two sets that share alpha words share one among the first ``|T| - alpha + 1`` words of T and the first
  ``|B| - alpha + 1`` of B. Blocks without any template's prefix word drop out before anything is exploded, the others
  meet templates by equality on a prefix word;
* length filter: ``|B| >= alpha``. Positional filter: at the first shared word, at T's place i and B's place j,
  ``min(|T| - i, |B| - j) >= alpha``;
* what is left is verified on the full sets.

Templates are the bounded side (``MAX_TEMPLATE_WORDS``, checked): their words are literals and broadcast. Rows that
leave a task are one narrow row a document and the candidate blocks; nothing is gathered but a block (at most
``2 * STRIDE`` words) and a document's distinct labels.

Besides, base phrases are found word by word at all their places; their labels always stand.

Defined cases: a null or word-less text has no words, no places, no labels and score 0; repeated rows get equal results,
each on its own row, null ids too; very long texts are more blocks; an empty table gives an empty result; extra columns
are ignored whatever their names; no templates or no phrases: only the other part labels; a template without words matches
nothing; templates that repeat, or tie in frequency (then by the word), change nothing.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from slatewise.llm.exact_dedup import normalised
from slatewise.llm.storage import save

STRIDE = 32
THRESHOLD = 0.8
#: Words of all templates together; more is an error, since they travel with every task.
MAX_TEMPLATE_WORDS = 20_000
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that label a document wherever their words stand one after the other.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: How licences announce themselves, in at most ``STRIDE + 1`` words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(WORDS), F.lit(0))


def split_words(text: str | None) -> list[str]:
    """The same words of a template or phrase."""
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def template_sets(templates: list[tuple[str, str]], stride: int = STRIDE, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, alpha) of each template that has words."""
    out, total = [], 0
    for label, text in templates:
        found = split_words(text)
        total += len(found)
        if len(found) > stride + 1 or total > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have at most {stride + 1} words, and {MAX_TEMPLATE_WORDS} together: {label}")
        distinct = sorted(set(found))
        if distinct:
            # Rounded first: 0.8 * 5 must not become 5 by a bit of the last place.
            out.append((label, distinct, max(1, math.ceil(round(threshold * len(distinct), 9)))))
    return out


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def word_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """(word, docs): in how many documents each word of ``vocabulary`` stands."""
    has = F.array_intersect(words_of(F.col(text_col)), _literal(vocabulary))
    return docs.select(F.explode(has).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


def _rarest_first(docs: DataFrame, text_col: str, sets: list[tuple[str, list[str], int]]) -> dict[str, int]:
    """The rank of every template word in the global order; one row a template word comes to the driver."""
    vocabulary = sorted({w for _, t, _ in sets for w in t})
    if not vocabulary:
        return {}
    count = {r["word"]: r["docs"] for r in word_frequencies(docs, vocabulary, text_col).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def _places_of(words: Column, label: str, phrase: list[str]) -> Column:
    """Array of (at, label), null where some word of the phrase is missing: only texts with all of them are walked."""
    here = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase)]))
    places = F.transform(here, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
    return F.when(_all([F.size(words) >= len(phrase), *[F.array_contains(words, w) for w in phrase]]), places)


def _places(phrases: list[tuple[str, str]]) -> Column:
    """Array of (at, label): the places of every phrase."""
    empty = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.concat(empty, *[F.coalesce(_places_of(F.col("words"), label, split_words(p)), empty) for label, p in phrases if split_words(p)])


def _blocks(ranked: dict[str, int], prefixes: list[str], stride: int) -> Column:
    """The blocks that hold a prefix word of some template, each as its distinct template words."""
    words, empty = F.col("words"), F.array().cast("array<array<string>>")
    if not prefixes:
        return empty
    n = F.greatest(F.ceil((F.size(words) - stride) / stride), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(words, b * stride + 1, 2 * stride))
    some = F.filter(cut, lambda b: F.arrays_overlap(b, _literal(prefixes)))
    return F.when(F.arrays_overlap(words, _literal(prefixes)), F.transform(some, lambda b: F.array_intersect(b, _literal(sorted(ranked))))).otherwise(empty)


def join_templates(blocks: DataFrame, sets: list[tuple[str, list[str], int]], ranked: dict[str, int]) -> DataFrame:
    """(row_no, label, contained) of all pairs of a block (row_no, block, words) and a template that reach the threshold."""
    spark = blocks.sparkSession
    order = spark.createDataFrame(sorted(ranked.items()), "word string, rank int")
    sides = []
    for k, (label, t, alpha) in enumerate(sets):
        ranks = sorted(ranked[w] for w in t)
        sides += [(k, label, alpha, ranks, i, r) for i, r in enumerate(ranks[: len(ranks) - alpha + 1])]
    templates = spark.createDataFrame(sides, "template int, label string, alpha int, t array<int>, i int, rank int")
    own = blocks.select("row_no", "block", F.explode("words").alias("word")).join(F.broadcast(order), "word").groupBy("row_no", "block").agg(
        F.sort_array(F.collect_list("rank")).alias("b"))
    met = own.select("row_no", "block", "b", F.posexplode("b").alias("j", "rank")).join(F.broadcast(templates), "rank").where(
        F.least(F.size("t") - F.col("i"), F.size("b") - F.col("j")) >= F.col("alpha"))
    shared = F.size(F.array_intersect("b", "t"))
    return met.dropDuplicates(["row_no", "block", "template"]).where(shared >= F.col("alpha")).select("row_no", "label", (shared / F.size("t")).alias("contained"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
                 phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """(id, n_words, places, base_labels, labels, score) of each row: ``places`` is an array of (at, label), the label lists
    are sorted and distinct. ``score`` is 1 with a base phrase, else the largest containment found, else 0."""
    sets = template_sets(templates, stride, threshold)
    ranked = _rarest_first(docs, text_col, sets)
    prefixes = sorted({w for _, t, alpha in sets for w in sorted(t, key=ranked.get)[: len(t) - alpha + 1]})
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = save(words.select(
        "id", F.monotonically_increasing_id().alias("row_no"), F.size("words").cast("long").alias("n_words"), _places(phrases).alias("places"),
        _blocks(ranked, prefixes, stride).alias("blocks")), "licence-rows")
    own = rows.where(F.size("blocks") > 0).select("row_no", F.posexplode("blocks").alias("block", "words"))
    found = join_templates(own, sets, ranked).groupBy("row_no").agg(F.collect_set("label").alias("found"), F.max("contained").alias("contained"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    return rows.join(found, "row_no", "left").select(
        F.col("id").alias(id_col), "n_words", "places", base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"))

