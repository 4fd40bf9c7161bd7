"""Operator 4: licence scans by an exact set-similarity join. Built-in functions only.

Base: the places where a licence's name stands (phrases of consecutive words).
Method: every document is cut into overlapping text blocks of twice the longest
template; a block meets a template if it contains at least ``threshold`` of the
template's distinct words. The join finds all such pairs exactly:

* the templates' words are put in one global order, by the number of documents
  that hold them (counted over all documents), rarest first;
* of a template with n words of which k must be met, the first n - k + 1 in that
  order are its prefix: a block without any of them cannot meet it, and the join
  is on these words alone;
* length filter: a block must have k words of the vocabulary; positional filter: a
  match at place p of the template and q of the block leaves at most
  min(n - p, m - q) common words, which must be k or more;
* what remains is verified on the whole word sets.

Templates are a parameter. Up to ``INLINE`` different words of theirs stand in the plan
itself; then documents are never shuffled, only one narrow row for each document and
each block that meets a template. More words become a table of their places in the global
order, broadcast up to 16 MB of its own bytes, else joined by a shuffle: blocks are then
made of the words that this join finds. The rows are the same.

Defined cases: null or empty texts have no words, labels '' and score 0; long
texts are cut into blocks like any other; repeated rows get one equal result each;
a null id is kept; templates without words are met by nothing; columns besides id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, picked
from .native_text import count_words, spaced, words_of

INLINE = 2000  # different words of templates that are put into the plan
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of public licences, with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
]


def template_words(text: str) -> list[str]:
    """Distinct words of a template in their order, by the words' rule of documents (A-Z lower-cased)."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the templates as a table, marked for broadcast up to MAX_BROADCAST bytes of their words and numbers."""
    size = sum(sum(sum(8 + len(str(x).encode()) for x in v) if isinstance(v, list) else len(v.encode()) if isinstance(v, str) else 8 for v in r) for r in rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def held_by(documents: DataFrame, vocabulary: list[str], text_col="text") -> dict[str, int]:
    """Number of documents that hold each word of the templates' vocabulary."""
    words = words_of(spaced(F.col("text")))
    rows = picked(documents, text=text_col)
    if len(vocabulary) <= INLINE:
        rows = rows.select(F.explode(F.array_intersect(_array(vocabulary), words)).alias("word"))
    else:
        rows = rows.select(F.explode(F.array_distinct(words)).alias("word")).join(_table(documents.sparkSession, [(w,) for w in vocabulary], "word string"), "word")
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row for each word of the vocabulary


def _blocks(words: Column, size: int, of: Callable[[Column], Column]) -> Column:
    """What is wanted of each of the overlapping blocks of 2 * size words, one of which begins at every size-th."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size)) if size else F.array(F.lit(0))
    return F.transform(starts, lambda i: of(F.slice(words, i + 1, 2 * size)))


def scan(documents: DataFrame, *, id_col="doc_id", text_col="text", templates=TEMPLATES, threshold=0.8) -> DataFrame:
    """One row for each row of documents: counts and places of the phrases, labels and the best containment."""
    sets = [(label, t) for label, text in templates if (t := template_words(text))]
    vocabulary = sorted({w for _, t in sets for w in t})
    spark = documents.sparkSession
    counts = held_by(documents, vocabulary, text_col) if sets else {}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    size = max((len(t) for _, t in sets), default=0)
    inlined = len(vocabulary) <= INLINE
    probes = []
    for label, t in sets:
        ranked = sorted(t, key=place.__getitem__) if inlined else sorted(place[w] for w in t)
        k = math.ceil(threshold * len(ranked) - 1e-9)
        probes += [(w, p, label, ranked, len(ranked), k) for p, w in enumerate(ranked[: len(ranked) - k + 1])]
    kind = "string" if inlined else "int"
    probe = _table(spark, probes, f"word {kind}, p int, label string, t array<{kind}>, n int, k int")
    least = min((x[5] for x in probes), default=1)

    # One row for each document, with what the base asks for. The row number is made in the scan's own stage and used in this one plan only.
    rows = picked(documents, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.array(F.struct(spaced(F.col("text")).alias("padded")))))
    plain = all(re.search("[a-z0-9]", w) for w in vocabulary)  # then a text without such characters holds no word of the templates
    rows = rows.withColumn("words", F.when(F.col("padded").rlike("[a-z0-9]"), words_of(F.col("padded"))) if plain else words_of(F.col("padded")))
    phrase = " (?=(?:" + "|".join(PHRASES) + ") )"
    named = F.col("padded").contains(" license ")
    parts = F.when(named, F.split("padded", phrase))
    spaces = lambda c: (F.char_length(c) - F.char_length(F.translate(c, " ", ""))).cast("long")
    if inlined:
        prefix = _array(sorted({x[0] for x in probes}))
        met = _blocks(F.col("words"), size, lambda b: F.array_intersect(_array(order), b))
        blocks = F.when(F.arrays_overlap("words", prefix), F.filter(met, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, prefix)))
    else:
        blocks = _blocks(F.col("words"), size, F.array_distinct)
    rows = rows.select(
        "row", "doc_id", count_words(F.col("padded")).alias("n_words"),
        F.inline(F.array(F.struct(parts.alias("parts")))),
        F.concat_ws(",", *[F.when(F.col("padded").contains(f" {p} "), F.lit(label)) for p, label in sorted(PHRASES.items(), key=lambda x: x[1])]).alias("base_labels"),
        blocks.alias("blocks"),
    )
    has = F.size("parts") > 1
    base = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    rows = rows.select(
        "row", "doc_id", "n_words", F.when(has, F.size("parts") - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(has, spaces(F.element_at("parts", 1))).alias("first_word"), F.when(has, F.col("n_words") - spaces(F.element_at("parts", -1))).alias("last_word"), "base_labels",
        *([F.explode_outer("blocks").alias("block")] if inlined else [F.posexplode_outer("blocks").alias("at", "block")]),
    )
    if not inlined:
        known = _table(spark, [(w, k) for k, w in enumerate(order)], "spelt string, word int")
        each = rows.select(*base, "at", F.explode_outer("block").alias("spelt")).join(known, "spelt", "left")
        rows = each.groupBy(*base, "at").agg(F.array_sort(F.collect_list("word")).alias("block"))
    pairs = rows.select(*base, "block", F.posexplode_outer("block").alias("q", "word")).join(probe, "word", "left")
    possible = (F.size("block") >= F.col("k")) & (F.least(F.col("n") - F.col("p"), F.size("block") - F.col("q")) >= F.col("k"))
    common = F.when(possible, F.size(F.array_intersect("block", "t")))
    sure = common >= F.col("k")
    found = pairs.groupBy(*base).agg(F.collect_set(F.when(sure, F.col("label"))).alias("more"), F.max(F.when(sure, common / F.col("n"))).alias("best"))
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(own, "more")), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle(threshold=0.8, templates=TEMPLATES) -> str:
    """The same rows by comparing every block with every template."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    sets = [(label, template_words(text)) for label, text in templates]
    size = max(len(t) for _, t in sets)
    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in t)}], {math.ceil(threshold * len(t) - 1e-9)})" for label, t in sets)
    at = lambda *w: "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(w)) + ")"
    place = {p: at(*p.split()) for p in PHRASES}
    lists = ", ".join(f"{place[p]} AS {label}" for p, label in PHRASES.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    places AS (SELECT r, doc_id, len(w) AS n_words, {lists} FROM d),
    base AS (SELECT r, doc_id, n_words, list_concat(list_concat(mit, apache), gpl) AS spots,
             list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS own FROM places),
    blocks AS (SELECT r, list_distinct(list_slice(w, b + 1, b + {2 * size})) AS b FROM (SELECT r, w, unnest(range(0, len(w), {size})) AS b FROM d)),
    t(label, words, k) AS (VALUES {values}),
    met AS (SELECT r, label, len(list_intersect(b, words)) / len(words) AS c FROM blocks, t WHERE len(list_intersect(b, words)) >= k),
    best AS (SELECT r, list(DISTINCT label) AS more, max(c) AS c FROM met GROUP BY r)
    SELECT doc_id, n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word, array_to_string(own, ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels,
           greatest(coalesce(c, 0.0), CASE WHEN len(spots) > 0 THEN 1.0 ELSE 0.0 END) AS score
    FROM base LEFT JOIN best USING (r)"""
