"""Licence scans: known phrases by place, and licence notices by an exact set-similarity join.

The set-similarity join compares text blocks with templates by containment: the share of a template's distinct words that a
block holds. Words are ordered by how many documents hold them, rarest first. A block that reaches the threshold holds one
of a template's first ``|T| - need + 1`` words (prefix filter), has ``need`` distinct words (length filter), and enough of
the template's words follow the first that it holds (positional filter); what is left is verified. No text block above
the threshold is missed. Blocks are ``BLOCK`` words of the whole text, one every ``STEP`` words and across line ends, so
every notice of up to ``BLOCK - STEP + 1`` words stands whole in a block however it is wrapped.

The templates are few and fixed, so their words (a bounded table) go to every task; blocks never leave theirs.

Defined results: a null or empty text has no words and no labels (score 0); repeated rows are judged one by one; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases with their labels, and notices with theirs.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("all-rights-reserved", "copyright all rights reserved"),
)
CONTAINMENT = 0.9
BLOCK, STEP = 64, 32  # words

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of text in any case


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR), lambda w: w != "")


def template_table(docs: DataFrame, templates, containment: float) -> list[tuple[str, str, int, int, list[str]]]:
    """Prefix words of the templates: word, label, place, need, all words in order. One row per prefix word."""
    words = sorted({w for _, text in templates for w in text.split()})
    held = F.array_intersect(F.split(F.lower("text"), SEPARATOR), F.array(*map(F.lit, words)))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    frequency = {row["word"]: row["count"] for row in counted.collect()}  # no more rows than the templates have words
    table = []
    for label, text in templates:
        ordered = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        need = math.ceil(containment * len(ordered) - 1e-9)
        table += [(ordered[i], label, i, need, ordered) for i in range(len(ordered) - need + 1)]
    return table


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """``(at, label)`` for every place where the words of a phrase stand one after the other."""

    def label_at(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in phrases.items():
            same = F.lit(True)
            for n, word in enumerate(phrase.split()):
                same = same & F.coalesce(F.get(words, i + n) == word, F.lit(False))
            found = F.when(same, F.lit(label)).otherwise(found)
        return found

    places = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("at"), label_at(i).alias("label")))
    return F.filter(F.when(F.size(words) > 0, places), lambda p: p["label"].isNotNull())


def blocks(text: Column, wanted: Column) -> Column:
    """Distinct words of every block of the text that holds one of the words ``wanted``."""

    def cut(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - BLOCK) / STEP).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * STEP + 1, F.lit(BLOCK)))

    # A one-element array binds the words to a name, so that they are split once.
    cuts = F.flatten(F.transform(F.array(split_words(text)), cut))
    return F.transform(F.filter(cuts, lambda block: F.arrays_overlap(block, wanted)), lambda block: F.array_distinct(block))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``.

    ``score``: the largest containment of a template that reaches the threshold, 1 where a phrase stands, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = template_table(docs, templates, containment)
    prefix = F.broadcast(
        spark.createDataFrame(table, "_word string, _label string, _place int, _need int, _template array<string>")
    )
    rare = sorted({row[0] for row in table})
    any_prefix = "(?i)" + "|".join(rare)
    any_phrase = "(?i)" + "|".join("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+".join(phrase.split()) for phrase in phrases)
    # Cheap tests on the raw text first: only texts that may match are lower-cased and cut.
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(any_phrase), lower_ascii(F.col("text"))).alias("_phrase_text"),
        F.when(F.col("text").rlike(any_prefix), lower_ascii(F.col("text"))).alias("_block_text"),
    )
    rows = rows.select("_row", "doc_id", "n_words", "_block_text", F.when(F.col("_phrase_text").isNotNull(), split_words(F.col("_phrase_text"))).alias("_words"))
    rows = rows.select("_row", "doc_id", "n_words", "_block_text", phrase_places(F.col("_words"), phrases).alias("_places"))
    rows = rows.select(
        "_row", "doc_id", "n_words", F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"]))), ","), F.lit("")).alias("base_labels"),
        F.when(F.col("_block_text").isNotNull(), blocks(F.col("_block_text"), F.array(*map(F.lit, rare)))).alias("_blocks"),
    )
    keys = ["_row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    block = rows.select(*keys, F.explode_outer("_blocks").alias("_block"))
    word = block.select(*keys, "_block", F.explode_outer(F.array_intersect("_block", F.array(*map(F.lit, rare)))).alias("_w"))
    paired = word.join(prefix, F.col("_w") == F.col("_word"), "left")
    # Positional filter: this is the template's first word in the block, so each pair comes once.
    first = F.size(F.array_intersect(F.slice("_template", F.lit(1), F.col("_place")), "_block")) == 0
    long_enough = (F.size("_block") >= F.col("_need")) & (F.size("_template") - F.col("_place") >= F.col("_need"))
    common = F.when(first & long_enough, F.size(F.array_intersect("_template", "_block")))
    share = F.when(common >= F.col("_need"), common / F.size("_template"))
    scored = paired.select(*keys, F.when(share.isNotNull(), F.col("_label")).alias("_label"), share.alias("_share"))
    found = scored.groupBy(*keys).agg(F.collect_set("_label").alias("_found"), F.max("_share").alias("_best"))
    labels = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), "_found")))
    return found.select(
        *keys[1:], F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def scan_sql(phrases: dict[str, str] = PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same scan for DuckDB: every block against every template."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrase_rows = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in phrases.items())
    template_rows = ", ".join(f"({listed(sorted(set(t.split())))}, '{label}')" for label, t in templates)
    split = lambda text: f"list_filter(string_split_regex({text}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
w AS (SELECT r, doc_id, t, {split('t')} AS ws FROM d),
phrases(p, label) AS (VALUES {phrase_rows}),
places AS (SELECT r, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1 : i + len(p)] = p)) AS i FROM w, phrases WHERE list_contains(ws, p[1])),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS bl FROM places GROUP BY r),
blocks AS (SELECT r, unnest(list_transform(range(0, CAST(greatest(ceil((len(ws) - {BLOCK}) / {STEP}), 0) AS BIGINT) + 1), lambda i: ws[i * {STEP} + 1 : i * {STEP} + {BLOCK}])) AS b FROM w WHERE len(ws) > 0),
templates(tw, label) AS (VALUES {template_rows}),
hits AS (SELECT r, label, len(list_intersect(tw, b)) / len(tw) AS share FROM blocks, templates WHERE len(list_intersect(tw, b)) >= ceil({containment} * len(tw) - 1e-9)),
method AS (SELECT r, list(DISTINCT label) AS ml, max(share) AS best FROM hits GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN method USING (r)"""
