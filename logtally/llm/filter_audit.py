"""Filter interaction audit: what each filter of a set removes, in every order the filters could run.

A document is a mask of the filters it fails. Masks are counted per part of the corpus, so what is
left of any number of documents is at most 2^n cells a part. Each cell then folds across the array of
all orders: ``transform`` over the orders and ``aggregate`` over an order's steps carry whether the
cell is still in, and give one struct of weighted counts per order and step (600 for five filters). Structs
of a part's cells are merged by elementwise sums.

Duplicates of a smaller id are told by the smallest id of each text, a join on text and id: a text
that a third of all documents share is spread by their ids.

Results for odd input: a null text is empty; a null id has no labels, is never a duplicate, and makes none; rows
with one id and one text are no duplicates of each other; an id labelled twice counts as good (toxic) if one label
says so; a null part is the empty string; parts of extra columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, split_words, text_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filter that looks at more than one document.
DUPLICATE = "E"
WEIGHTS = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters() -> dict[str, Column]:
    """Failure conditions over ``text`` (never null) and ``words``, by letter."""
    n_words = F.size("words")
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n_words,
        "C": 100 * capitals > 3 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def _bits(conditions: Mapping[str, Column], letters: Sequence[str]) -> Column:
    total = F.lit(0)
    for letter, fails in conditions.items():
        total = total + F.when(fails, 1 << letters.index(letter)).otherwise(0)
    return total


def cells(docs: DataFrame, labels: DataFrame, part: str, letters: Sequence[str]) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and those of them labelled quality 1 and
    toxic 1. ``docs``: doc_id, text and the column ``part``; ``labels``: doc_id, quality, toxic."""
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    measured = texts.withColumn("words", split_words(F.col("text")))
    narrow = measured.select("doc_id", "part", _bits(text_filters(), letters).alias("own_mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # Equal rows become one with a count, within tasks first.
    rows = cut_lineage(narrow.groupBy("doc_id", "part", "own_mask", "digest").agg(F.count("*").alias("n")))
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    marked = rows.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    weight = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return (
        marked.withColumn("mask", F.col("own_mask") + F.when(copied, 1 << letters.index(DUPLICATE)).otherwise(0))
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), weight("quality").alias("good"), weight("is_toxic").alias("toxic"))
    )


def _step(order: Column, step: Column, letters: Sequence[str], so_far: Column) -> Column:
    """What happens to a cell at one step of an order; ``so_far``: whether it is still in."""
    bit = F.call_function("shiftleft", F.lit(1), F.ascii(F.substring(order, step, F.lit(1))) - F.lit(ord(letters[0])))
    fails = F.col("mask").bitwiseAND(bit) != 0
    weight = lambda when, c: F.when(when, F.col(c)).otherwise(F.lit(0)).cast("long")
    removed = so_far & fails
    return F.struct(
        order.alias("filter_order"),
        step.alias("step"),
        weight(so_far & ~fails, "n").alias("kept"),
        weight(removed, "n").alias("removed"),
        weight(~so_far & fails, "n").alias("redundant"),
        weight(F.col("mask") == bit, "n").alias("unique_fails"),
        weight(removed, "good").alias("good_lost"),
        weight(removed, "toxic").alias("toxic_lost"),
    )


STEP = "struct<filter_order: string, step: int, " + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"


def fold_cells(counted: DataFrame, letters: Sequence[str]) -> DataFrame:
    """One row per part, order and step with ``COUNTS``, from cells (part, mask, n, good, toxic)."""
    if [ord(x) - ord(letters[0]) for x in letters] != list(range(len(letters))):
        raise ValueError(f"{letters} are not neighbouring letters")
    # A constant array: it travels inside the tasks' code.
    orders = F.lit(["".join(p) for p in itertools.permutations(letters)])
    steps = F.lit(list(range(1, len(letters) + 1)))

    def fold(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("still_in"), F.array().cast(f"array<{STEP}>").alias("rows"))

        def go(state: Column, step: Column) -> Column:
            row = _step(order, step, letters, state["still_in"])
            still = state["still_in"] & (row["removed"] == 0)
            return F.struct(still.alias("still_in"), F.concat(state["rows"], F.array(row)).alias("rows"))

        return F.aggregate(steps, start, go, lambda state: state["rows"])

    folded = counted.select("part", F.flatten(F.transform(orders, fold)).alias("rows"))
    add = lambda x, y: F.struct(x["filter_order"].alias("filter_order"), x["step"].alias("step"), *[(x[c] + y[c]).alias(c) for c in COUNTS])
    # At most one array for each mask of a part.
    merged = folded.groupBy("part").agg(F.collect_list("rows").alias("cells")).select(
        "part",
        F.aggregate(F.slice("cells", 2, 1 << len(letters)), F.get("cells", F.lit(0)), lambda total, rows: F.zip_with(total, rows, add)).alias("rows"),
    )
    return merged.select("part", F.inline("rows"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", letters: Sequence[str] = "ABCDE") -> DataFrame:
    """Per part, order of the filters and step: the counts of ``fold_cells`` and ``shapley``, the documents that the
    step's filter removes, summed over all orders."""
    steps = cut_lineage(fold_cells(cells(docs, labels, part, letters), letters))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    lettered = steps.withColumn("filter_letter", letter)
    # One row per part and filter.
    shares = lettered.groupBy("part", "filter_letter").agg(F.sum("removed").alias("shapley"))
    return lettered.join(shares, ["part", "filter_letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
