"""License scan: which license template a block of a document contains.

Two searches, both built-in expressions only:

* Phrases: places where a fixed phrase's words stand consecutively (``phrase_places``).
* Templates, an exact set-similarity join: a template matches where a run of words, over line ends
  too, holds at least ``threshold`` of its distinct words. Runs are half as long again as a template.
  Short templates have no word to spare: all their words stand together, in any order, and other
  wordings are templates of their own. Words are ordered by their count over the whole corpus, rare
  first. A match must hold one of a template's first ``n - need + 1`` words, where ``need`` is the
  overlap asked for (prefix filter), so blocks are the words around each of these: runs through it lie
  inside. Blocks that hold fewer than ``need`` of the template's words are left out (length filter),
  words before the shared one don't count, as a block around them does that (positional filter), and
  what is left is verified run by run.

The templates are a fixed list of short texts, so their side of the join is broadcast.
Blocks leave the document row only as the few words around a rare one; full texts are
never shuffled, and one hot source or word spreads as its documents do.

Results for odd input: a null text is the empty one (no words, no labels, score 0); repeated rows
get the same result each; rows that share an id keep their own results; extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, same_key, split_words, text_of

WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
"""Between words, before A-Z are lower-cased: as in the contract's word class, but for A-Z."""
WORD_CHAR = r"[0-9A-Z\x{80}-\x{10FFFF}]"

# Phrases and their labels, and the notices searched for. "gnu" is the notice that the versions of
# the GNU licenses share but for single words.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
TEMPLATES = (
    ("mit", "released under mit license"),
    ("mit", "licensed under mit license"),
    ("mit", "the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license v2"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license v3"),
    ("gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the public domain under the cc0 1 0 universal license"),
)
THRESHOLD = Fraction(4, 5)
#: Most distinct words of a short template.
SHORT_WORDS = 12


@dataclass(frozen=True)
class Template:
    """``width``: the words of a run."""

    number: int
    label: str
    words: frozenset[str]
    need: int
    width: int

    @property
    def prefix(self) -> int:
        return len(self.words) - self.need + 1


def templates(texts: tuple[tuple[str, str], ...] = TEMPLATES, threshold: Fraction = THRESHOLD) -> list[Template]:
    """``need``: the words a run must hold, ``threshold`` of the template's, rounded up; of a short one all."""
    found = []
    for i, (label, text) in enumerate(texts):
        words, length = frozenset(text.split()), len(text.split())
        if len(words) <= SHORT_WORDS:
            found.append(Template(i, label, words, len(words), length))
        else:
            found.append(Template(i, label, words, -(-len(words) * threshold.numerator // threshold.denominator), 3 * length // 2))
    return found


def phrase_places(words: str, phrase: str) -> Column:
    """Indices in the array column ``words`` at which the words of ``phrase`` stand one after another."""
    here = lambda i: reduce(
        lambda a, b: a & b, [F.get(words, i + k) == F.lit(word) for k, word in enumerate(phrase.split())]
    )
    return F.filter(F.transform(words, lambda w, i: F.when(F.coalesce(here(i), F.lit(False)), i)), lambda i: i.isNotNull())


def scan_phrases(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """Per row: the key, ``n_words``, and ``places``, a struct (label, at) for each phrase that occurs."""
    spaced = docs.select(*row_key(), F.trim(F.regexp_replace(text_of(), WORD_BREAK, " ")).alias("spaced"))
    likely = F.col("spaced").rlike("(?i)" + "|".join(re.escape(p).replace(r"\ ", " ") for p, _ in phrases))
    lowered = F.translate("spaced", string.ascii_uppercase, string.ascii_lowercase)
    counted = spaced.select(
        "key_id",
        "key_text",
        F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(likely, F.split(lowered, " ")).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    found = [F.struct(F.lit(label).alias("label"), phrase_places("words", phrase).alias("at")) for phrase, label in phrases]
    return counted.select(
        "key_id", "key_text", "n_words", F.filter(F.array(*found), lambda p: F.size(p["at"]) > 0).alias("places")
    )


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of the few given words occurs in all texts."""
    counts = (
        docs.select(F.explode(split_words(F.lower(text_of()), WORD_BREAK)).alias("word"))
        .where(F.col("word").isin(words))
        .groupBy("word")
        .count()
        .collect()
    )
    return {w: 0 for w in words} | {r.word: r["count"] for r in counts}


def match_templates(docs: DataFrame, wanted: list[Template]) -> DataFrame:
    """Per row key and template found: (key_id, key_text, label, containment), the largest of its blocks.

    Letters outside A-Z are lower-cased too here; the template words have none.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in wanted for w in t.words})
    counts = word_counts(docs, vocabulary)
    ordered_words = sorted(vocabulary, key=lambda w: (counts[w], w))
    order = {w: i + 1 for i, w in enumerate(ordered_words)}
    ordered = {t.number: sorted(order[w] for w in t.words) for t in wanted}
    index = spark.createDataFrame(
        [(rank, len(t.words), t.need, t.width, ordered[t.number], t.label) for t in wanted for rank in ordered[t.number][: t.prefix]],
        "rank int, size int, need int, width int, ranks array<int>, label string",
    )
    reach = max(t.width for t in wanted) - 1
    rare = [w for w in vocabulary if any(order[w] in ordered[t.number][: t.prefix] for t in wanted)]
    # The join can only begin at a word in some template's prefix: a text without one goes at once.
    likely = docs.select(*row_key(), text_of().alias("text_read")).where(
        F.col("text_read").rlike(f"(?i)(?<!{WORD_CHAR})(?:{'|'.join(map(re.escape, rare))})(?!{WORD_CHAR})")
    )
    words = likely.select("key_id", "key_text", split_words(F.lower("text_read"), WORD_BREAK).alias("words"))
    rare_places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    around = words.select("key_id", "key_text", "words", F.explode(rare_places).alias("at"))
    first = F.greatest(F.col("at") - reach, F.lit(0))
    place = F.array(*map(F.lit, ordered_words))
    # Ranks of the words around ``at``, 0 for those of no template.
    blocks = around.select(
        "key_id",
        "key_text",
        F.transform(
            F.slice("words", first + 1, F.col("at") + reach - first + 1),
            lambda w, i: F.struct(i.alias("at"), F.array_position(place, w).cast("int").alias("rank")),
        ).alias("block"),
        (F.col("at") - first).alias("at"),
    )
    seeds = blocks.select("key_id", "key_text", "at", F.element_at("block", F.col("at") + 1)["rank"].alias("rank"), F.filter("block", lambda x: x["rank"] > 0).alias("block"))
    pairs = seeds.join(F.broadcast(index), "rank").withColumn(
        "shared",
        F.filter(
            "block",
            lambda x: (F.abs(x["at"] - F.col("at")) < F.col("width")) & (x["rank"] >= F.col("rank")) & F.array_contains("ranks", x["rank"]),
        ),
    )
    distinct = lambda places: F.size(F.array_distinct(F.transform(places, lambda x: x["rank"])))
    able = pairs.where(distinct("shared") >= F.col("need"))
    run = lambda x: F.filter("shared", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("width")))
    overlap = F.array_max(F.transform("shared", lambda x: distinct(run(x))))
    return (
        able.select("key_id", "key_text", "label", "need", "size", overlap.alias("overlap"))
        .where(F.col("overlap") >= F.col("need"))
        .groupBy("key_id", "key_text", "label")
        .agg(F.max(F.col("overlap") / F.col("size")).alias("containment"))
    )


def scan_licenses(docs: DataFrame, wanted: list[Template] | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest containment of a template, 1 where a phrase stands, else 0.
    """
    phrases = scan_phrases(docs)
    matched = (
        match_templates(docs, wanted or templates())
        .groupBy("key_id", "key_text")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    )
    places = F.flatten(F.transform("places", lambda p: p["at"]))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    joined = phrases.join(matched, same_key(phrases, matched), "left").select(
        phrases["key_id"].alias("doc_id"), "n_words", places.alias("all_places"), base.alias("base"), F.coalesce("found", F.array()).alias("found"), "best"
    )
    return joined.select(
        "doc_id",
        "n_words",
        F.size("all_places").cast("long").alias("n_base"),
        F.array_min("all_places").cast("long").alias("first_word"),
        F.array_max("all_places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
