"""Quality rules as a short-circuit cascade.

``measures`` derives the figures of a text that rules look at; everything is a built-in
expression inside the document row, so nothing is shuffled and a long text costs n log n. Rules
are conditions that reject. ``plan_cascade`` times each rule on a sample and counts what it
rejects, and orders them by rejections per second; ``apply_cascade`` evaluates them in that order
and stops at the first that rejects, so later rules run only on what is left. The order changes
the cost, never the verdict; ``failed_rule`` names the first rule in that order.

Repeated windows: the three words of a window are hashed to 64 bits; the leading bits of the hash
and the window's position share one long, so sorting longs brings equal windows together, and
neighbours are compared by the full hash.

Results for odd input: a null text has no words and counts 0 throughout, hence fails; repeated
rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtally.session import write_scratch

from .common import SPACE_RUN, split_words, text_of

WINDOW = 3
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over ``text`` and the columns of ``measures``."""

    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    return [
        Rule("too_short", F.col("n_words") < 50),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ]


def method_rules() -> list[Rule]:
    """Further rules, set wide enough to leave ordinary prose alone."""
    words = F.col("n_words")
    return [
        Rule("word_length", (F.col("word_chars") > 15 * words) | (F.col("word_chars") < 2 * words)),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * words),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("no_letters", 10 * F.regexp_count(text_of(), F.lit(r"\p{L}")) < 4 * F.col("word_chars")),
        Rule("ellipses", 10 * F.regexp_count(text_of(), F.lit(r"(?m)(?:\.\.\.|…)$")) > 3 * F.col("n_lines")),
        Rule("shouting", 10 * F.regexp_count(text_of(), F.lit(r"\p{Lu}")) > 5 * F.col("word_chars")),
    ]


def _window_hashes() -> Column:
    """A hash of each three consecutive words, in order."""
    return F.when(
        F.size("words") >= WINDOW,
        F.transform(
            F.slice("words", 1, F.size("words") - (WINDOW - 1)),
            lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
    """``keep`` and, as longs: n_words, word_chars, n_symbols, n_lines (those with a word),
    n_dup_lines (equal to an earlier one), n_repeat_words (words inside a three-word window that
    the text holds twice or more)."""
    kept = docs.select(*keep).columns
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *keep,
        split_words(text).alias("words"),
        F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    second = first.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes().alias("hashes"),
    )
    # As many low bits as positions need.
    bits = F.length(F.bin(F.size("hashes").cast("long"))).cast("int")
    third = second.withColumn("low", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    packed = third.withColumn(
        "sorted", F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long"))))
    )
    at = lambda x: F.get("hashes", x.bitwiseAND(F.col("low")).cast("int"))
    same = lambda x, y: F.coalesce(at(x) == at(y), F.lit(False))
    twice = packed.withColumn(
        "repeated",
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda x, i: same(x, F.get("sorted", i + 1)) | ((i > 0) & same(x, F.get("sorted", F.greatest(i - 1, F.lit(0))))),
                ),
                lambda x: x.bitwiseAND(F.col("low")),
            )
        ),
    )
    # A window adds the words up to where the next repeated one begins.
    covered = F.aggregate(
        F.transform("repeated", lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get("repeated", i + 1) - p, F.lit(WINDOW).cast("long")))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return twice.select(*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


#: Rules that cost less than this share of reading the sample count as equally cheap: timings don't tell them apart.
CHEAP = 0.1


def rule_seconds(sample: DataFrame, rules: Sequence[Rule], repeats: int = 3) -> list[float]:
    """What each rule's expression costs over ``sample``, beyond a job that reads the same columns and does nothing
    with them; the least of ``repeats`` runs each."""

    def seconds(value: Column) -> float:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            sample.agg(*[F.count(c) for c in sample.columns], value).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(F.count(F.lit(1)))  # starts what later runs find started
    idle = seconds(F.count(F.lit(1)))
    return [max(CHEAP * idle, seconds(F.count_if(r.rejects)) - idle) for r in rules]


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 10_000, seed: int = 11) -> list[Rule]:
    """``rules`` by rejections per second on a sample of about ``sample_rows`` rows, best first.

    ``docs`` has ``text`` and the columns the rules name. The sample decides the order only.
    """
    rows = docs.count()
    if not rows or not rules:
        return list(rules)
    sample = write_scratch(docs.sample(fraction=min(1.0, sample_rows / rows), seed=seed), "quality-sample")
    rejected = sample.agg(*[F.count_if(r.rejects).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    seconds = rule_seconds(sample, rules)
    order = sorted(range(len(rules)), key=lambda i: (-rejected[i] / seconds[i], rules[i].name))
    return [rules[i] for i in order]


def first_rejection(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; the rest are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    return reduce(lambda case, r: case.when(r.rejects, r.name), rules[1:], F.when(rules[0].rejects, rules[0].name))


def apply_cascade(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``docs`` with ``failed_rule`` and ``kept``."""
    return docs.withColumn("failed_rule", first_rejection(rules)).withColumn("kept", F.col("failed_rule").isNull())
