"""License scan by diagonal voting, as DataFrame joins.

All rolling word k-grams of a text are joined with the positions they have in the notice templates.
A hit lies on the diagonal (text position - template position); hits of one notice share it, chance
hits do not. Votes are counted per diagonal, neighbouring diagonals (a word added or lost) are
merged, and a merged span is verified: enough of the template's k-grams, densely enough.

The templates below are constants of this module (a few hundred k-grams), which bounds the
broadcast. Texts never leave their row; only hits are shuffled, by text and template.

Defined results: a null or empty text has no words, no places and score 0. Repeated rows are
scanned each. Labels are sorted and joined by commas, none is the empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pedalgrid.llm.common import ascii_lower, text_rows
from pedalgrid.session import cut_lineage

K = 4
#: Diagonals up to this many words apart belong together.
GAP = 3
#: Share of a template's k-grams, and share of k-grams hit within the span.
COVERED, DENSE = 0.75, 0.6

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common licence notices.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "under a Creative Commons Attribution-NonCommercial 4.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))


def words_of(text: Column) -> Column:
    """Array of words; one empty word for a text without any."""
    return F.split(F.btrim(ascii_lower(text), F.lit(_SEPARATORS)), _SEPARATOR)


def gram(words: Column, i: Column) -> Column:
    return F.xxhash64(*(words[i + j] for j in range(K)))


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, label, tpos, n_grams) of the constants above."""
    rows = []
    for label, texts in TEMPLATES.items():
        for n, text in enumerate(texts):
            words = re.findall("[0-9a-z]+", text.lower())
            rows += [(f"{label}/{n}", label, i, len(words) - K + 1, words[i : i + K]) for i in range(len(words) - K + 1)]
    made = spark.createDataFrame(rows, "template string, label string, tpos int, n_grams int, words array<string>")
    return made.select(gram(F.col("words"), F.lit(0)).alias("gram"), "template", "label", "tpos", "n_grams")


def worded(docs: DataFrame) -> DataFrame:
    rows = text_rows(docs).withColumn("_words", words_of(F.col("text")))
    empty = (F.size("_words") == 1) & (F.col("_words")[0] == "")
    return rows.withColumn("_n", F.when(empty, 0).otherwise(F.size("_words")))


def _stands(parts: list[str]) -> Callable[[Column], Column]:
    def at(i: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.col("_words")[i + j] == p for j, p in enumerate(parts)))

    return at


def base_places(rows: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n_words, n_base, first_word, last_word, base_labels array) per row."""
    low = ascii_lower(F.col("text"))
    maybe = F.contains(low, F.lit("license")) | F.contains(low, F.lit("cc"))
    starts = {}
    for phrase in PHRASES:
        parts = phrase.split()
        enough = maybe & (F.col("_n") >= len(parts))
        places = F.filter(F.sequence(F.lit(0), F.col("_n") - len(parts)), _stands(parts))
        starts[phrase] = F.when(enough, places).otherwise(F.array().cast("array<int>"))
    named = rows.withColumn("_places", F.struct(*(c.alias(f"p{i}") for i, c in enumerate(starts.values()))))
    every = F.concat(*(F.col(f"_places.p{i}") for i in range(len(PHRASES))))
    labels = F.array_compact(
        F.array(*(F.when(F.size(f"_places.p{i}") > 0, F.lit(v)) for i, v in enumerate(PHRASES.values())))
    )
    return named.select(
        "k1",
        "k2",
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.sort_array(labels).alias("_base_labels"),
    )


def notice_spans(rows: DataFrame) -> DataFrame:
    """Verified spans: (k1, k2, template, label, start, end, coverage), in words of the text."""
    grams = (
        rows.filter(F.col("_n") >= K)
        .withColumn(
            "_grams",
            F.transform(F.sequence(F.lit(0), F.col("_n") - K), lambda i: gram(F.col("_words"), i)),
        )
        # The outer form keeps Spark from testing the array in a filter of its own, into which it
        # would copy the splitting of the text, once per k-gram.
        .select("k1", "k2", F.posexplode_outer("_grams").alias("pos", "gram"))
    )
    hits = grams.join(F.broadcast(template_grams(rows.sparkSession)), "gram")
    diagonals = hits.groupBy(
        "k1", "k2", "template", "label", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal")
    ).agg(
        F.collect_set("tpos").alias("tposes"),  # at most the template's length
        F.min("pos").alias("start"),
        F.max("pos").alias("end"),
    )
    along = W.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    merged = (
        diagonals.withColumn("_new", apart.cast("int"))
        .withColumn("_span", F.sum("_new").over(along))
        .groupBy("k1", "k2", "template", "label", "n_grams", "_span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("tposes"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
    )
    seen = F.size("tposes")
    return merged.filter(
        (seen >= COVERED * F.col("n_grams")) & (seen >= DENSE * (F.col("end") - F.col("start") + 1))
    ).select(
        "k1",
        "k2",
        "template",
        "label",
        F.col("start").cast("long").alias("start"),
        (F.col("end") + K).cast("long").alias("end"),
        (seen / F.col("n_grams")).alias("coverage"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base places and the labels of both ways."""
    rows = worded(docs)
    spans = (
        notice_spans(rows)
        .groupBy("k1", "k2")
        .agg(F.collect_set("label").alias("_found"), F.max("coverage").alias("_coverage"))
    )
    none = F.array().cast("array<string>")
    return (
        cut_lineage(base_places(rows), "license-base")
        .join(cut_lineage(spans, "license-spans"), ["k1", "k2"], "left")
        .select(
            "k1",
            "k2",
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join("_base_labels", ",").alias("base_labels"),
            F.array_join(
                F.sort_array(F.array_union("_base_labels", F.coalesce("_found", none))), ","
            ).alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_coverage", F.lit(0.0))).alias("score"),
        )
    )


def _sql() -> str:
    """The same in SQL, k-grams as lists of words."""
    positions = ", ".join(
        f"('{label}/{n}', '{label}', {i}, {len(w) - K + 1}, {w[i : i + K]})"
        for label, texts in TEMPLATES.items()
        for n, w in enumerate(re.findall("[0-9a-z]+", t.lower()) for t in texts)
        for i in range(len(w) - K + 1)
    )
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    return f"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, i - 1 AS i, label
  FROM texts, LATERAL unnest(range(1, len(w) + 1)) AS u(i) JOIN phrases ON w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    list_sort(list(DISTINCT label)) AS base_labels FROM places GROUP BY doc_id),
positions(template, label, tpos, n_grams, gram) AS (VALUES {positions}),
hits AS (
  SELECT doc_id, template, label, n_grams, tpos, i - 1 AS pos, i - 1 - tpos AS diagonal
  FROM texts, LATERAL unnest(range(1, len(w) - {K - 2})) AS u(i) JOIN positions ON w[i:i + {K - 1}] = gram),
merged AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span
  FROM (SELECT *, CAST(coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template
      ORDER BY diagonal, pos) > {GAP}, TRUE) AS INTEGER) AS apart FROM hits)),
spans AS (
  SELECT doc_id, label, count(DISTINCT tpos) AS seen, n_grams, max(pos) - min(pos) + 1 AS wide
  FROM merged GROUP BY doc_id, template, label, n_grams, span),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(seen / n_grams) AS coverage FROM spans
  WHERE seen >= CAST('{COVERED}' AS DOUBLE) * n_grams AND seen >= CAST('{DENSE}' AS DOUBLE) * wide GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(coverage, 0.0) END AS score
FROM texts LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


SQL = _sql()
