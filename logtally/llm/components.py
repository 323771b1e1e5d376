"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b) the smallest id it is connected to.

    Every id points to an id that is not larger, at first to its smallest neighbour. Each round replaces the ends of
    the links by what they point to, which leaves only links between different parts, lets the larger end of those
    point to the smaller, and lets every id point to where its pointer points. The rounds needed grow with the
    logarithm of a component's width, and links inside a part that is joined are not read again. Each round reads and
    writes tables.

    Results for odd input: links with a null end or to themselves say nothing, and an id with no others is not in
    the result; repeated and reversed links count once; no links give no rows; other columns are ignored.
    """
    edges = cut_lineage(_between(links.where(F.col("a") != F.col("b")), F.col("a"), F.col("b")))
    ends = edges.select(F.col("a").alias("id"), "a").unionByName(edges.select(F.col("b").alias("id"), "a"))
    labels = cut_lineage(ends.groupBy("id").agg(F.min("a").alias("component")))
    apart = not edges.isEmpty()
    while True:
        moved = labels.withColumn("to", F.col("component"))
        if apart:
            low = labels.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
            high = labels.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
            edges = cut_lineage(_between(edges.join(low, "a").join(high, "b"), F.col("of_a"), F.col("of_b")))
            apart = not edges.isEmpty()
        if apart:
            below = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("near"))
            moved = labels.join(below, "id", "left").select("id", "component", F.least("component", "near").alias("to"))
        up = moved.select(F.col("id").alias("to"), F.col("to").alias("above"))
        jumped = cut_lineage(moved.join(up, "to").select("id", "component", F.col("above").alias("to")))
        changed = not jumped.where(F.col("to") != F.col("component")).isEmpty()
        labels = jumped.select("id", F.col("to").alias("component"))
        if not changed and not apart:
            return labels


def _between(rows: DataFrame, one: Column, other: Column) -> DataFrame:
    """(a, b), a < b: the links of different ids, once each."""
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).where(F.col("a") < F.col("b")).distinct()
