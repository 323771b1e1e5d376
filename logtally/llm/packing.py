"""Best-fit packing: documents as token sequences of a fixed capacity, as few as possible.

A document is the ids of its text and a closing id. Only documents longer than the capacity are
cut, into pieces of full capacity and a rest. Which piece goes where depends on lengths alone, so
the plan is made from the histogram of lengths, at most one number per length up to the capacity:

1. **Exact complements.** From the longest length down, the gap a piece leaves is looked up among the
   lengths at hand, their pair sums and their triple sums. A hit fills the sequence exactly, and is
   consumed as often as all its lengths are available.
2. **Best fit.** A gap that no single, pair or triple fills gets the longest piece that fits, and what
   is left of it is looked up again. Only a sequence with no fitting piece left stays unfilled.

The plan is a list of patterns (lengths, and how many sequences look so). The pieces of one length
are numbered, over all tasks: each task counts its own, and running sums over the tasks' counts give
where its numbers begin. A piece's number then says which sequence and place it takes. So no task sees
more than its own pieces, even if all documents have the same length, and only numbers are shuffled.

Results for odd input: a null or empty text is one closing id; a null id, equal ids and repeated rows
are packed row by row; extra columns are ignored; no documents give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtally.session import write_scratch

from .common import map_arrow
from .tokens import WordTokenizer


@dataclass(frozen=True)
class PackSettings:
    capacity: int = 4096
    closing_id: int = 1
    vocabulary: str = field(default_factory=lambda: public_tokenizers.path("word_bpe_49k.json"))
    #: Keep the ids of each piece beside its checksum.
    with_ids: bool = False


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that each hold ``parts``: (length, copies), longest first."""

    times: int
    parts: tuple[tuple[int, int], ...]


class SumIndex:
    """Which lengths are at hand, and which numbers are sums of one, two or three of them.

    Lengths only ever run out, so an index that is out of date still has every possible sum; one that
    turns out to be gone makes it anew."""

    def __init__(self, free: np.ndarray):
        self.free = free
        self.renew()

    def renew(self) -> None:
        n = len(self.free)
        width = 2 * n
        spectrum = np.fft.rfft((self.free > 0).astype(float), width)
        self.pairs = np.fft.irfft(spectrum**2, width)[:n] > 0.5
        spectrum *= np.fft.rfft(self.pairs.astype(float), width)
        self.triples = np.fft.irfft(spectrum, width)[:n] > 0.5

    def pair(self, total: int, taken: dict[int, int]) -> tuple[int, ...] | None:
        """The pair of the sum with the longest first."""
        if total < 2:
            return None
        here = self.free[1:total] > 0
        at = np.flatnonzero(here & here[::-1]) + 1
        for x in at[at >= (total + 1) // 2][::-1].tolist():
            y = total - x
            if self.free[x] - taken.get(x, 0) >= 1 + (x == y) and self.free[y] - taken.get(y, 0) >= 1:
                return (x, y)
        return None

    def exact(self, gap: int, taken: dict[int, int]) -> tuple[int, ...] | None:
        """One to three lengths that fill the gap, as few as can be."""
        if self.free[gap] > taken.get(gap, 0):
            return (gap,)
        for _ in range(2):
            if self.pairs[gap] and (found := self.pair(gap, taken)):
                return found
            if self.triples[gap] and (found := self._triple(gap, taken)):
                return found
            if not (self.pairs[gap] or self.triples[gap]):
                return None
            self.renew()
        return None

    def _triple(self, gap: int, taken: dict[int, int]) -> tuple[int, ...] | None:
        first = np.flatnonzero(self.free[: gap - 1] > 0)
        for z in first[self.pairs[gap - first]][::-1].tolist():
            if self.free[z] > taken.get(z, 0) and (rest := self.pair(gap - z, taken | {z: taken.get(z, 0) + 1})):
                return (z, *rest)
        return None

    def best_fit(self, gap: int, taken: dict[int, int]) -> int | None:
        for length in np.flatnonzero(self.free[: gap + 1] > 0)[::-1].tolist():
            if self.free[length] > taken.get(length, 0):
                return length
        return None


def plan(counts: np.ndarray) -> list[Pattern]:
    """Patterns that use each length as often as ``counts`` (index: length, last index: the capacity) says."""
    free = counts.astype(np.int64)
    capacity = len(free) - 1
    index, out = SumIndex(free), []
    for longest in range(capacity, 0, -1):
        while free[longest]:
            taken, gap = {longest: 1}, capacity - longest
            while gap:
                if found := index.exact(gap, taken):
                    for x in found:
                        taken[x] = taken.get(x, 0) + 1
                    break
                length = index.best_fit(gap, taken)
                if length is None:
                    break
                # All but the last few at once: those are left to the sums.
                copies = max(1, min(int(free[length]) - taken.get(length, 0), gap // length - 3))
                taken[length] = taken.get(length, 0) + copies
                gap -= copies * length
            times = min(int(free[x]) // n for x, n in taken.items())
            for x, n in taken.items():
                free[x] -= times * n
            out.append(Pattern(times, tuple(sorted(taken.items(), reverse=True))))
    return out


@dataclass(frozen=True)
class Places:
    """Where the k-th piece of each length goes. ``key`` (length and first number of a run, ascending) names
    runs of ``copies`` neighbours in each sequence from ``sequence`` on, beginning at ``offset``."""

    key: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    #: Numbers of one length stay below this.
    SPAN = 1 << 48

    @staticmethod
    def of(patterns: list[Pattern]) -> Places:
        rows, used, sequence = [], {}, 0
        for p in patterns:
            offset = 0
            for length, copies in p.parts:
                first = used.get(length, 0)
                rows.append((length * Places.SPAN + first, copies, sequence, offset))
                used[length] = first + p.times * copies
                offset += length * copies
            sequence += p.times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return Places(*np.ascontiguousarray(table.T))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        wanted = length * self.SPAN + number
        at = np.searchsorted(self.key, wanted, side="right") - 1
        inside, copies = wanted - self.key[at], self.copies[at]
        return self.sequence[at] + inside // copies, self.offset[at] + inside % copies * length


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The vocabulary a worker has loaded, kept between its tasks.
_LOADED: dict[str, WordTokenizer] = {}


def cut_pieces(docs: DataFrame, settings: PackSettings) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids if asked for, and its ``number`` among the
    pieces of its length in its ``task``."""
    capacity, closing = settings.capacity, np.array([settings.closing_id], "<u4").tobytes()
    path, with_ids = settings.vocabulary, settings.with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordTokenizer(path)
        tokenizer = _LOADED[path]
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, length, crc, kept = [], [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                ids = (tokenizer.ids(text) if text else b"") + closing
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            number = np.zeros(len(row), np.int64)
            for i, n in enumerate(length):
                number[i] = seen[n]
                seen[n] += 1
            pieces = np.array(piece, np.int32)
            columns = [
                batch.column("doc_id").take(pa.array(row, pa.int64())),
                pa.array(pieces),
                pa.array(pieces.astype(np.int64) * capacity),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(np.full(len(row), task, np.int32)),
                pa.array(number),
                *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{PIECES}, task int, number long" + ", ids array<int>" * with_ids
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def pack_documents(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """``docs`` (doc_id, text) as pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if
    ``settings.with_ids``."""
    pieces = write_scratch(cut_pieces(docs, settings), "pieces")
    counted = write_scratch(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-lengths")
    # One row per length up to the capacity.
    lengths = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(settings.capacity + 1, np.int64)
    for r in lengths:
        counts[r.length] = r.n
    places = docs.sparkSession.sparkContext.broadcast(Places.of(plan(counts)))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    numbered = pieces.join(begins, ["task", "length"]).withColumn("number", F.col("begins") + F.col("number"))
    kept = [x.strip().split(" ")[0] for x in PIECES.split(",")] + ["ids"] * settings.with_ids
    fields = PIECES + ", ids array<int>" * settings.with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            found = places.value.find(length, number)
            columns = [batch.column(c) for c in kept] + [pa.array(x) for x in found]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return map_arrow(numbered.select(*kept, "number"), run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids, and doc_ids with where each
    piece begins. A sequence holds at most its capacity, so its rows are few."""
    row = F.struct("offset", "doc_id", "ids")
    ordered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("parts"))
    return ordered.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"))).alias("documents"),
    )
