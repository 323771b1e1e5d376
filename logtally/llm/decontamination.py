"""Benchmark decontamination by greedy string tiling.

Texts are compared as words: lower-cased runs of letters and digits, hashed to 64 bits. Seeds are
all runs of ``tile`` words of a benchmark item (the whole item, if it is shorter). A document that
shares a seed with an item is tiled against it: the longest common stretches of words that no
earlier tile covers are found by Karp-Rabin hashes of falling length and marked, until none of
``tile`` words is left. Tiles may come in any order, so a passage whose sentences were reordered is
still covered. A document is contaminated by an item when its tiles cover ``coverage`` of the
item's words.

Candidates come from a join of seeds. Tiles that cover enough of an item hold a least number of its
seed places (``seeds_needed``), so only an item's rarest seeds are indexed, as many as any such cover
must meet one of (prefix filter): seeds that many items share drop out, and no pair is lost. A bit
filter of the indexed seeds, whose size is fixed, goes to the tasks; documents without a seed in it are
never shuffled, the rest once, as word hashes, to their candidate items. The benchmark is a table
throughout, so its size changes neither the passes over the documents nor what the driver holds. Seeds
that many documents share, and documents that are there many times, are spread by a salt.

Results for odd input: a null text, and an item without words, match nothing; repeated rows and
repeated items count each; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Scratch, add_columns, map_arrow, packed, row_key, split_by_membership, split_words, text_of
from .ngram_join import list_slices, longs_array

WORD_BREAK = r"[^\p{L}\p{N}]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class TilingSettings:
    """``filter_bits``, a power of two: size of the bit filter of seeds. With very many seeds more documents pass it,
    and the join does the rest. ``salts``: parts of a hot seed or document."""

    tile: int = 5
    coverage: float = 0.6
    filter_bits: int = 1 << 23
    salts: int = 16


def word_hashes() -> Column:
    return F.transform(split_words(F.lower(text_of()), WORD_BREAK), lambda w: F.xxhash64(w))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every ``size`` consecutive words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    hashes = np.zeros(count, np.uint64)
    for i in range(size):
        hashes = hashes * _BASE + words[i : i + count]
    return hashes


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` words none of which is marked."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[size:] == sums[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), longest first, no overlaps.

    The search length starts at the item's and halves down to ``least``; a longer match than twice
    the search length restarts it there. Ties go to the earliest place in the item, then in the document.
    """
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), 20))
    while True:
        matches = _maximal(item, doc, in_item, in_doc, size)
        longest = max((n for _, _, n in matches), default=0)
        if longest > 2 * size:
            size = longest
            continue
        for n, a, b in sorted(((n, a, b) for a, b, n in matches), key=lambda m: (-m[0], m[1], m[2])):
            # What an earlier tile of this round took is given up; the rest is found in a later one.
            if not in_item[a : a + n].any() and not in_doc[b : b + n].any():
                in_item[a : a + n] = in_doc[b : b + n] = True
                found.append((a, b, n))
        if size == least:
            if not _maximal(item, doc, in_item, in_doc, least):
                return found
        else:
            size = max(least, size // 2)


def _maximal(item: np.ndarray, doc: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches of ``size`` words or more of unmarked words."""
    at_item, at_doc = _free(in_item, size), _free(in_doc, size)
    if not len(at_item) or not len(at_doc):
        return []
    hashes = window_hashes(item, size)[at_item]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    of_doc = window_hashes(doc, size)[at_doc]
    low, high = np.searchsorted(ranked, of_doc, "left"), np.searchsorted(ranked, of_doc, "right")
    matches = []
    for k in np.flatnonzero(high > low):
        b = int(at_doc[k])
        for a in at_item[order[low[k] : high[k]]].tolist():
            if a and b and item[a - 1] == doc[b - 1] and not in_item[a - 1] and not in_doc[b - 1]:
                continue  # part of the match that began before
            n = 0
            while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and not in_item[a + n] and not in_doc[b + n]:
                n += 1
            if n >= size:
                matches.append((a, b, n))
    return matches


def seeds_needed(n_words: int, settings: TilingSettings) -> int:
    """How many of an item's seed places tiles that cover enough of it hold at least: one per ``tile`` words covered."""
    covered = next(c for c in range(n_words + 1) if c / n_words >= settings.coverage)
    return max(1, -(-covered // min(settings.tile, n_words)))


def seed_places(items: DataFrame, settings: TilingSettings) -> DataFrame:
    """(item_row, at, seed, n_kept): an item's seeds by place, and how many of them suffice as its prefix."""

    def make(column: pa.Array) -> list[pa.Array]:
        seeds = [window_hashes(words, min(settings.tile, len(words))) for words in list_slices(column)]
        needed = [seeds_needed(len(words), settings) for words in list_slices(column)]
        return [longs_array(seeds), pa.array([len(s) - n + 1 for s, n in zip(seeds, needed, strict=True)], pa.int32())]

    made = add_columns(items, ["item_row"], [F.col("item_words")], "seeds array<bigint>, n_kept int", make)
    return made.select("item_row", "n_kept", F.posexplode("seeds").alias("at", "seed"))


def seed_index(places: DataFrame) -> DataFrame:
    """(seed, item_row) for the rarest seeds of each item."""
    counts = places.groupBy("seed").agg(F.count("*").alias("n_places"))
    rank = F.row_number().over(Window.partitionBy("item_row").orderBy("n_places", "seed", "at"))
    return places.join(counts, "seed").withColumn("rank", rank).where(F.col("rank") <= F.col("n_kept")).select("seed", "item_row").distinct()


def seed_filter(index: DataFrame, settings: TilingSettings) -> np.ndarray:
    """Two bits for each seed, as words of 64: at most ``filter_bits`` / 64 rows come to the driver."""
    halves = F.array(F.col("seed"), F.call_function("shiftright", F.col("seed"), F.lit(32)))
    slot = F.explode(F.transform(halves, lambda h: F.pmod(h, F.lit(settings.filter_bits))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    rows = (
        index.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .collect()
    )
    words = np.zeros(settings.filter_bits // 64, np.int64)
    for r in rows:
        words[r.word] = r.bits
    return words.view(np.uint64)


def seeded_documents(docs: DataFrame, words: np.ndarray, sizes: list[int]) -> DataFrame:
    """(key_id, key_text, words, seeds) of the documents with windows of these sizes that pass the filter."""
    rows = docs.select(*row_key(), word_hashes().alias("words"))
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = StructType(rows.schema.fields + [StructField("seeds", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.uint64(64 * len(bits) - 1)
        for batch in batches:
            seeds = []
            for doc in list_slices(batch.column(2)):
                hashes = np.concatenate([window_hashes(doc, size) for size in sizes])
                for shift in (np.uint64(0), np.uint64(32)):
                    slots = (hashes >> shift) & mask
                    hashes = hashes[(bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1]
                seeds.append(np.unique(hashes))
            out = pa.RecordBatch.from_arrays([*batch.columns, longs_array(seeds)], schema.names)
            yield out.filter(pa.array([len(s) > 0 for s in seeds], pa.bool_()))

    return map_arrow(rows, run, schema)


def cover_items(pairs: DataFrame, settings: TilingSettings) -> DataFrame:
    """Tiles the pairs (key_id, key_text, item_id, words, item_words); those with enough coverage."""

    def make(texts: pa.Array, items: pa.Array) -> list[pa.Array]:
        found = []
        for doc, item in zip(list_slices(texts), list_slices(items), strict=True):
            cover = tiles(item, doc, min(settings.tile, len(item)))
            covered = sum(n for _, _, n in cover)
            found.append((covered / len(item), len(cover), max((n for *_, n in cover), default=0), min((b for _, b, _ in cover), default=0)))
        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]

    schema = "coverage double, n_tiles bigint, longest bigint, first_word bigint"
    tiled = add_columns(pairs, ["key_id", "key_text", "item_id"], [F.col("words"), F.col("item_words")], schema, make)
    return tiled.where(F.col("coverage") >= settings.coverage)


def _same_row() -> Column:
    return F.col("key_id").eqNullSafe(F.col("row_id")) & (F.col("key_text") == F.col("row_text"))


def _salted(small: DataFrame, settings: TilingSettings) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))


def _leaks(docs: DataFrame, benchmark: DataFrame, settings: TilingSettings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Leaks by row key, each once however often the row is there, and the keys of all rows that were candidates."""
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item_row"), "item_id", word_hashes().alias("item_words"))
    items = scratch.keep(numbered.where(F.size("item_words") > 0), "items")
    index = scratch.keep(seed_index(seed_places(items, settings)), "seeds")
    sizes = sorted(r.size for r in items.select(F.least(F.size("item_words"), F.lit(settings.tile)).alias("size")).distinct().collect())
    near = scratch.keep(seeded_documents(docs, seed_filter(index, settings), sizes or [settings.tile]), "near")
    # Equal rows lie in many partitions, so a hot row's seeds are spread as well.
    seeds = near.select("key_id", "key_text", (F.spark_partition_id() % settings.salts).alias("salt"), F.explode("seeds").alias("seed"))
    pairs = seeds.join(_salted(index, settings), ["seed", "salt"]).select("key_id", "key_text", "item_row").distinct()
    part = F.pmod(F.xxhash64("key_id", "key_text"), F.lit(settings.salts)).cast("int")
    wanted = pairs.withColumn("salt", part).join(_salted(items, settings), ["item_row", "salt"]).select("key_id", "key_text", "item_id", "item_words")
    once = near.groupBy(F.col("key_id").alias("row_id"), F.col("key_text").alias("row_text")).agg(F.first("words").alias("words"))
    both = wanted.join(once, _same_row()).select("key_id", "key_text", "item_id", "words", "item_words")
    return scratch.keep(cover_items(both, settings), "leaks"), near.select("key_id", "key_text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: TilingSettings = TilingSettings()) -> DataFrame:
    """One row per document row and item that contaminates it: doc_id, item_id, coverage (share of the
    item's words under tiles), n_tiles, longest (words of the longest tile), first_word (smallest start
    of a tile in the document, in words)."""
    with Scratch(docs.sparkSession) as scratch:
        leaks, near = _leaks(docs, benchmark, settings, scratch)
        # A row that is there very often has one key, but lies in many partitions.
        rows = near.select(F.col("key_id").alias("row_id"), F.col("key_text").alias("row_text"), (F.spark_partition_id() % settings.salts).alias("part"))
        found = rows.join(_salted(leaks, settings), _same_row() & (F.col("part") == F.col("salt")))
        columns = ["item_id", "coverage", "n_tiles", "longest", "first_word"]
        return scratch.keep(found.select(F.col("row_id").alias("doc_id"), *columns), "found", for_result=True)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: TilingSettings = TilingSettings()) -> DataFrame:
    """``docs`` without the rows whose text some item contaminates."""
    keyed = docs.select(packed(docs), F.col("doc_id").alias("leak_id"), F.xxhash64(text_of()).alias("leak_text"))
    with Scratch(docs.sparkSession) as scratch:
        leaks, _ = _leaks(docs, benchmark, settings, scratch)
        named = scratch.keep(leaks.select("key_id", "key_text").distinct(), "named", for_result=True)
    maybe, clean = split_by_membership(keyed, F.col("leak_text"), named, F.col("key_text"))
    kept = maybe.join(named, F.col("leak_id").eqNullSafe(F.col("key_id")) & (F.col("leak_text") == F.col("key_text")), "left_anti")
    return clean.select("row.*").unionByName(kept.select("row.*"))
