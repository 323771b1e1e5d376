"""N-gram Jaccard join: documents whose shingle sets are alike, and their groups.

1. **Sets.** A document's set holds the 64-bit hashes of its distinct shingles. Documents with equal
   sets are one class. All steps work on classes, named by a 64-bit hash of their set and read from
   one row each; classes are mapped to rows at the end.
2. **Blocks.** Sets of up to ``hi`` shingles that link differ in at most ``D = 2 hi (1-t)/(1+t)`` of
   them. Dealt to ``D+1+c`` segments by hash, they agree on at least ``c+1`` whole segments, and meet
   in the block of one's content. Sizes are banded, so that both sides use the same numbers. Empty
   segments agree with any other empty one, so a set only enters their blocks if it has more than
   ``c`` of them: two sets that agree on none but empty segments both do. Sharing a frequent shingle
   or passage is not enough to meet, whole segments must be equal. Blocks with the same members are
   one: most of a group's segments say the same.
3. **Signature trees.** Every block of two or more is a tree: leaves are members, with a bitmap of their
   hashed shingles and their size; inner nodes hold OR-combined bitmaps and size ranges. A dual
   traversal drops node pairs whose size ranges rule a link out or whose common bits can't make up
   the overlap needed. It joins groups as it goes: members that may link become one group, which
   no later pair is looked up in, so a tree gives a spanning forest, less pairs than members. The
   smallest member is compared with all others first. Blocks larger than ``TREE_MEMBERS`` are dealt
   to parts, and each pair of parts is a tree.
4. **Verification.** Forest pairs are compared in full: the texts of a pair's ends meet in the task of its
   smaller end, dealt to several tasks where many pairs share that one.
5. **Trees with a pair that failed** are traversed once more, now for every pair of different verified groups that
   can link; each such pair is compared in full once, whatever trees it is in. A tree with more of them than
   ``OPEN_PAIRS`` times its members is traversed over the members' whole sets instead, each pair of groups not
   joined yet compared in its task until one links or none is left.

No link is lost: what a tree leaves out lies inside a verified group, or can't link by signature, or was
compared in full. Groups come from label spreading over tables; nothing is collected. Tables are
deleted once their successors stand.

Results for odd input: a null or empty text has an empty set and links with nothing; a text with
fewer words than a shingle is one shingle; rows that share an id are one node (each row keeps its
own set size), but keep_first tells them apart; a row with a null id links like any other, and its group
is null if no row of it has an id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, Scratch, add_columns, map_arrow, packed, split_by_membership, split_words, text_of
from .components import components

SIGNATURE_WORDS = 32
FAN_OUT = 16
TREE_MEMBERS = 1_000
#: Shingles of the members of one tree whose whole sets are compared, about; bounds memory only.
TREE_SHINGLES = 4_000_000
#: Node pairs that one step of a traversal looks at together; bounds memory only.
PAIR_SLICE = 20_000
#: Pairs of one smaller end that are compared in one task, about.
HUB_PAIRS = 500
#: Pairs that a tree with a failed pair may give for each member before its whole sets go to one task.
OPEN_PAIRS = 4
#: Bits of the bitmap that tells which blocks have several members.
BLOCK_BITS = 1 << 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class JoinSettings:
    """Sets link when intersection / union is at least ``threshold``, which is 1/2 or more. ``key_parts``: passes over
    the texts in which block keys are counted; more take less room and more time, with the same result."""

    shingle: int = 5
    threshold: Fraction = Fraction(8, 10)
    key_parts: int = 1

    def __post_init__(self) -> None:
        if not Fraction(1, 2) <= self.threshold <= 1:
            raise ValueError(f"threshold {self.threshold} is not between 1/2 and 1")

    def differing(self, total: int) -> int:
        """Most shingles in which linked sets of ``total`` shingles together can differ."""
        p, q = self.threshold.numerator, self.threshold.denominator
        return (q - p) * total // (q + p)


def word_hashes(separator: str = SPACE_RUN) -> Column:
    """A hash per word of ``text``, A-Z lower-cased."""
    lowered = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(split_words(lowered, separator), lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes (uint64)."""
    if not len(words):
        return words
    size = min(shingle, len(words))
    count = len(words) - size + 1
    hashes = np.full(count, size, np.uint64)
    for i in range(size):
        hashes = _mix(hashes * _M2 + words[i : i + count])
    return np.unique(hashes)


class Bands:
    """Upper sizes of the bands, and with them the number of segments."""

    def __init__(self, settings: JoinSettings):
        self.settings = settings
        self.widest = max(Fraction(3, 2), 1 / settings.threshold)
        self.upper = [1]

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(upper size, segments, spare segments) of the bands in which a set of ``size`` meets its partners."""
        while self.upper[-1] < 2 * size + 2:
            self.upper.append(max(self.upper[-1] + 1, int(self.upper[-1] * self.widest)))
        at = next(i for i, hi in enumerate(self.upper) if hi >= size)
        reach = int(size / self.settings.threshold)
        # One segment means equal sets, which are one class before.
        return [
            (self.upper[i], d + 1 + (spare := self._spare(i, d + 1)), spare)
            for i in ([at, at + 1] if reach > self.upper[at] else [at])
            if (d := self.settings.differing(2 * self.upper[i]))
        ]

    def _spare(self, at: int, segments: int) -> int:
        """As many empty segments as hardly any set of the band exceeds."""
        smallest = float(self.settings.threshold) * (self.upper[at - 1] + 1 if at else 1)
        empty = segments * math.exp(-smallest / segments)
        return math.ceil(empty + 3 * math.sqrt(empty))


def segment_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    keys = [np.zeros(0, np.uint64)]
    for upper, segments, spare in bands.of(len(shingles)):
        sums = np.zeros(segments, np.uint64)
        mixed = _mix(shingles)
        at = ((mixed >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)
        np.add.at(sums, at, mixed)
        names = _mix(_mix(sums) + _mix(np.arange(segments, dtype=np.uint64) + np.uint64(upper << 32)))
        held = np.bincount(at, minlength=segments) > 0
        keys.append(names if segments - held.sum() > spare else names[held])
    return np.concatenate(keys)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of the hashed shingles: ``SIGNATURE_WORDS`` longs, doubled until there are four bits to a
    shingle. A wider one folds to a narrower by OR of its halves."""
    words = SIGNATURE_WORDS
    while words * 16 < len(shingles):
        words *= 2
    bits = np.zeros(words * 64, np.uint8)
    bits[(shingles % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(bits: np.ndarray, words: int = SIGNATURE_WORDS) -> np.ndarray:
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def list_slices(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of an Arrow list of longs as uint64 views."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def longs_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _measures(shingles: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """Size and two sums that stand for the set."""
    return len(shingles), _mix(shingles).sum(dtype=np.uint64), _mix(shingles ^ _M1).sum(dtype=np.uint64)


def _measure_arrays(measures: list[tuple[int, np.uint64, np.uint64]]) -> list[pa.Array]:
    longs = lambda k: pa.array(np.array([m[k] for m in measures], np.uint64).view(np.int64))
    return [longs(0), longs(1), longs(2)]


def class_id() -> Column:
    """Names the class of a row with n, set_a and set_b."""
    return F.xxhash64("n", "set_a", "set_b").alias("id")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(text_of()).alias("key_text"))


def _set_rows(docs: DataFrame, settings: JoinSettings) -> DataFrame:
    """doc_id, key_text, n, the class id and the signature of each row."""

    def make(column: pa.Array) -> list[pa.Array]:
        sets = [shingle_set(words, settings.shingle) for words in list_slices(column)]
        return [*_measure_arrays([_measures(x) for x in sets]), longs_array([signature(x) for x in sets])]

    found = add_columns(_keyed(docs), ["doc_id", "key_text"], [word_hashes()], "n long, set_a long, set_b long, bits array<long>", make)
    return found.select("doc_id", "key_text", "n", class_id(), "bits")


def _block_keys(texts: DataFrame, settings: JoinSettings, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, id): the blocks each class enters, from one of its texts. Made from the texts when needed: the
    keys take more room than their shuffle leaves free. Of ``parts`` by key, ``part`` alone."""
    bands = Bands(settings)

    def make(column: pa.Array) -> list[pa.Array]:
        sets = [shingle_set(words, settings.shingle) for words in list_slices(column)]
        made = [segment_keys(x, bands) if len(x) else x for x in sets]
        keys = longs_array([x[x % np.uint64(parts) == part] for x in made] if parts > 1 else made)
        return [*_measure_arrays([_measures(x) for x in sets]), keys]

    found = add_columns(texts, ["key_text"], [word_hashes()], "n long, set_a long, set_b long, keys array<long>", make)
    return found.select(class_id(), "keys").select(F.explode("keys").alias("key"), "id")


class Groups:
    """Union-find over the members of a tree; ``label`` is up to date after ``settle``."""

    def __init__(self, labels: np.ndarray):
        _, first, number = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[number].tolist()
        self.settle()

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def settle(self) -> None:
        self.label = np.array([self.find(i) for i in range(len(self.up))])

    def join(self, i: np.ndarray, j: np.ndarray, links: Callable[[int, int], bool] | None) -> tuple[list[int], list[int]]:
        """Joins the ends of the pairs that link (without ``links``: all), and gives those that joined two groups."""
        out_i, out_j = [], []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y and (links is None or links(a, b)):
                self.up[max(x, y)] = min(x, y)
                out_i.append(a)
                out_j.append(b)
        if out_i:
            self.settle()
        return out_i, out_j


class SignatureTree:
    """Levels of one tree: OR of bitmaps, smallest and largest size, most shingles lost to shared bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, settings: JoinSettings):
        self.p, self.q = settings.threshold.numerator, settings.threshold.denominator
        lost = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, lost)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, lost = self.levels[-1]
            at = np.arange(0, len(low), FAN_OUT)
            self.levels.append(
                (np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at))
            )

    def label_levels(self, label: np.ndarray) -> list[np.ndarray]:
        """The one label below each node, -1 where there are several."""
        out = [label]
        for level in range(1, len(self.levels)):
            at = np.arange(0, len(out[-1]), FAN_OUT)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether members below the nodes can link."""
        b, low, high, lost = self.levels[level]
        p, q = self.p, self.q
        keep = q * np.minimum(high[i], high[j]) >= p * np.maximum(low[i], low[j])
        i, j = i[keep], j[keep]
        least = low[i] + low[j]
        most = np.bitwise_count(b[i] & b[j]).sum(axis=1, dtype=np.int64) + np.minimum(lost[i], lost[j])
        able = (q + p) * most >= p * least
        if level == 0:
            # Each differing bit is a differing shingle at least.
            able &= (q + p) * np.bitwise_count(b[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= (q - p) * least
        keep[keep] = able
        return keep

    def forest(self, groups: Groups, first: int, links: Callable[[int, int], bool] | None = None) -> Iterator[tuple[list[int], list[int]]]:
        """Index pairs that join ``groups``: those that can link, or, with ``links``, those that do. ``first`` is
        compared with all others before the traversal."""
        others = np.flatnonzero(groups.label != groups.label[first])
        hub = np.full(len(others), first)
        able = self.possible(0, hub, others)
        yield groups.join(hub[able], others[able], links)
        for i, j in self.pairs(lambda: groups.label):
            joined = groups.join(i, j, links)
            if joined[0]:
                yield joined

    def pairs(self, current: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i < j) that can link and whose labels differ, by dual traversal. ``current`` gives the labels,
        which may come together on the way."""
        label = current()
        labels = self.label_levels(label)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if current() is not label:
                label = current()
                labels = self.label_levels(label)
            if len(i) > PAIR_SLICE:
                stack += [(level, i[PAIR_SLICE:], j[PAIR_SLICE:])]
                i, j = i[:PAIR_SLICE], j[:PAIR_SLICE]
            apart = (labels[level][i] != labels[level][j]) | (labels[level][i] < 0)
            if level == 0:
                apart &= i < j
            i, j = i[apart], j[apart]
            able = self.possible(level, i, j)
            i, j = i[able], j[able]
            if level == 0:
                if len(i):
                    yield i, j
                continue
            # The children of both, a node with itself once.
            below = len(self.levels[level - 1][1])
            step = np.arange(FAN_OUT)
            for a in range(0, len(i), max(1, PAIR_SLICE // FAN_OUT**2)):
                x, y = i[a : a + PAIR_SLICE // FAN_OUT**2], j[a : a + PAIR_SLICE // FAN_OUT**2]
                ci = (x[:, None, None] * FAN_OUT + step[None, :, None]).repeat(FAN_OUT, 2).ravel()
                cj = (y[:, None, None] * FAN_OUT + step[None, None, :]).repeat(FAN_OUT, 1).ravel()
                inside = (ci < below) & (cj < below) & (ci <= cj)
                if inside.any():
                    stack.append((level - 1, ci[inside], cj[inside]))


def tree_pairs(bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, settings: JoinSettings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i < j) of different ``labels`` that can link. ``bits``: members x words, uint64; ``sizes`` ascending."""
    yield from SignatureTree(bits, sizes, settings).pairs(lambda: labels)


def alike(a: np.ndarray, b: np.ndarray, settings: JoinSettings) -> bool:
    """Whether two sorted sets link."""
    p, q = settings.threshold.numerator, settings.threshold.denominator
    total = len(a) + len(b)
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return q * shared >= p * (total - shared)


def _two_leaves(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, settings: JoinSettings) -> np.ndarray:
    """``SignatureTree.possible`` of many trees of two leaves at once."""
    tree = SignatureTree(np.concatenate([left, right]), np.concatenate([n_left, n_right]), settings)
    at = np.arange(len(left))
    return tree.possible(0, at, at + len(left))


def _pairs_batch(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["tree", "a", "b"])


def _by_tree(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list]:
    """Whole trees: lists of Arrow columns. A tree may go on in the next batch; it has a bounded number of members."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = batch.column("tree").to_numpy()
        starts = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]])
        if held and held[-1].column("tree")[-1].as_py() != trees[0]:
            yield _joined(held, columns)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            yield _joined(held, columns)
            held = []
        held.append(batch.slice(starts[-1]))
    if held:
        yield _joined(held, columns)


def _joined(held: list[pa.RecordBatch], columns: list[str]) -> list:
    made = pa.Table.from_batches(held).combine_chunks()
    return [made.column(c).chunk(0) for c in columns]


def _tree_candidates(members: DataFrame, settings: JoinSettings) -> DataFrame:
    """Forest pairs (tree, a, b), a < b, from ``members`` (tree, id, n, bits): each tree traversed."""
    rows = members.select("tree", "id", "n", "bits").repartition("tree").sortWithinPartitions("tree", "n", "id")
    columns = ["tree", "id", "n", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[tuple] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            for width in {len(x[3]) for x in small}:
                now = [x for x in small if len(x[3]) == width]
                tree, i, j, left, right, n_left, n_right = (np.array(c) for c in zip(*now, strict=True))
                able = _two_leaves(left, right, n_left, n_right, settings)
                if able.any():
                    yield _pairs_batch(tree[able], i[able], j[able])

        for tree, id_, n, bits in _by_tree(batches, columns):
            ids, sizes = id_.to_numpy(), n.to_numpy()
            raw = list(list_slices(bits))
            # Sizes that allow a link have widths at most one step apart.
            words = min(map(len, raw))
            signatures = [folded(x, words) for x in raw]
            if len(ids) == 2:
                small.append((tree[0].as_py(), ids[0], ids[1], *signatures, sizes[0], sizes[1]))
                if len(small) == 2_000:
                    yield from pairs()
                    small = []
                continue
            made = SignatureTree(np.vstack(signatures), sizes, settings)
            for i, j in made.forest(Groups(np.arange(len(ids))), int(ids.argmin())):
                if i:
                    yield _pairs_batch(np.full(len(i), tree[0].as_py()), ids[i], ids[j])
        if small:
            yield from pairs()

    return map_arrow(rows, run, "tree long, a long, b long")


def _open_pairs(members: DataFrame, settings: JoinSettings) -> DataFrame:
    """(tree, a, b): all pairs of different labels that can link, from ``members`` (tree, id, label, n, bits); one row
    without ends for a tree that has more than ``OPEN_PAIRS`` for each member."""
    columns = ["tree", "id", "label", "n", "bits"]
    rows = members.select(*columns).repartition("tree").sortWithinPartitions("tree", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, id_, label, n, bits in _by_tree(batches, columns):
            ids, labels, raw = id_.to_numpy(), label.to_numpy(), list(list_slices(bits))
            words = min(map(len, raw))
            made = SignatureTree(np.vstack([folded(x, words) for x in raw]), n.to_numpy(), settings)
            _, labels = np.unique(labels, return_inverse=True)
            found, size = [], 0
            for pair in made.pairs(lambda labels=labels: labels):
                found.append(pair)
                size += len(pair[0])
                if size > OPEN_PAIRS * len(ids):
                    break
            if size > OPEN_PAIRS * len(ids):
                none = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([tree[0].as_py()]), none, none], ["tree", "a", "b"])
            elif size:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _pairs_batch(np.full(size, tree[0].as_py()), ids[i], ids[j])

    return map_arrow(rows, run, "tree long, a long, b long")


def _tree_links(members: DataFrame, settings: JoinSettings) -> DataFrame:
    """Pairs (a, b) that link and join the groups of ``members`` (tree, id, label, n, text): each tree
    traversed over whole sets."""
    rows = members.repartition("tree").sortWithinPartitions("tree", "n", "id").select("tree", "id", "label", word_hashes().alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, id_, label, words in _by_tree(batches, ["tree", "id", "label", "words"]):
            ids = id_.to_numpy()
            sets = [shingle_set(w, settings.shingle) for w in list_slices(words)]
            raw = [signature(x) for x in sets]
            width = min(map(len, raw))
            made = SignatureTree(np.vstack([folded(x, width) for x in raw]), np.array([len(x) for x in sets]), settings)
            groups = Groups(label.to_numpy())
            for i, j in made.forest(groups, int(ids.argmin()), lambda x, y, s=sets: alike(s[x], s[y], settings)):
                if i:
                    yield _pairs_batch(np.full(len(i), tree[0].as_py()), ids[i], ids[j])

    return map_arrow(rows, run, "tree long, a long, b long").select("a", "b")


def _plant(blocks: DataFrame) -> DataFrame:
    """``blocks`` (key, id, n, m: members of the block, n_max: their largest size) dealt to trees (tree, id, n).

    A block of more than ``TREE_MEMBERS``, or of more shingles than a task compares, is dealt by hash to parts
    of about half as many; each pair of parts is a tree, as is a block of one part. No task ever gets all of a
    large block.
    """
    large = F.greatest(F.col("m") / TREE_MEMBERS, F.col("m") * F.col("n_max") / TREE_SHINGLES)
    parts = F.when(large <= 1, 1).otherwise(F.least(F.ceil(2 * large), F.col("m"))).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int")
    dealt = blocks.withColumn("parts", parts).withColumn("own", own)
    # With one part, or with each other part and itself.
    partner = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = dealt.select("key", "id", "n", "own", "parts", partner.alias("partner")).where(
        (F.col("parts") == 1) | (F.col("own") != F.col("partner"))
    )
    return paired.select(F.xxhash64("key", F.least("own", "partner"), F.greatest("own", "partner")).alias("tree"), "id", "n")


def _class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id and text of ``classes`` (id, key_text: the text they are read from), one row each."""
    likely, _ = split_by_membership(_keyed(docs).select("key_text", "text"), F.col("key_text"), classes, F.col("key_text"))
    once = likely.join(classes.select("key_text"), "key_text", "left_semi").groupBy("key_text").agg(F.first("text").alias("text"))
    return once.join(classes, "key_text").select("id", "text")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, settings: JoinSettings, scratch: Scratch) -> DataFrame:
    """The ``pairs`` (a, b) whose sets link, compared in full. ``classes``: id, key_text.

    Both texts of a pair go to the task of its end ``a``, in as many parts as ``a`` has pairs for; a part gets the
    text of ``a`` once."""
    hubs = scratch.keep(pairs.groupBy("a").agg(F.count("*").alias("m")), "hubs")
    dealt = pairs.join(hubs, "a").withColumn("part", F.pmod(F.xxhash64("b", F.lit(3)), F.ceil(F.col("m") / HUB_PAIRS)).cast("int"))
    dealt = scratch.keep(dealt.select("a", "b", "part"), "dealt")
    ends = dealt.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("side")).distinct()
    routes = scratch.keep(ends.unionByName(dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("side"))), "routes")
    named = scratch.keep(routes.select("id").distinct().join(classes.select("id", "key_text"), "id"), "pair-classes")
    sent = _class_texts(docs, named).join(routes, "id")
    rows = sent.repartition("a", "part").sortWithinPartitions("a", "part", "side", "id").select("a", "side", "id", word_hashes().alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            columns = (batch.column(c).to_pylist() for c in ("a", "side", "id"))
            for smaller, side, other, words in zip(*columns, list_slices(batch.column("words")), strict=True):
                own = shingle_set(words, settings.shingle)
                if not side:
                    hub = own
                elif alike(hub, own, settings):
                    a.append(smaller)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = scratch.keep(map_arrow(rows, run, "a long, b long"), "links")
    scratch.drop(hubs, dealt, routes, named)
    return links


def _groups(links: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.keep(components(links), "groups")


def _class_groups(docs: DataFrame, settings: JoinSettings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key_text, n, id: the class, null for an empty set), and the groups of linked
    classes (id, component)."""
    measured = scratch.keep(_set_rows(docs, settings), "measured")
    known = measured.where(F.col("n") > 0)
    # The smallest text hash of a class names the text that it is read from.
    classes = scratch.keep(known.groupBy("id").agg(F.min("key_text").alias("key_text"), F.count("*").alias("m")), "classes")
    several = classes.where(F.col("m") > 1).select("id", F.col("key_text").alias("first_text"))
    texts = scratch.keep(known.select("id", "key_text").join(several, "id").select("key_text", "first_text").distinct(), "class-texts")
    keyed = _keyed(docs).select("key_text", "text")
    maybe, single = split_by_membership(keyed, F.col("key_text"), texts, F.col("key_text"))
    # One row for each class: copies of its text are combined within tasks first.
    left_out = texts.where(F.col("key_text") != F.col("first_text")).select("key_text")
    once = maybe.join(left_out, "key_text", "left_anti").groupBy("key_text").agg(F.first("text").alias("text"))
    texts_once = single.unionByName(once)
    met = _block_keys(texts_once, settings)
    # Counts by key are combined before the shuffle. ``members`` stands for who is in the block; of blocks with the same
    # members one is enough. Part of the keys at a time, so that the shuffle of one part is freed before the next.
    shared = []
    for part in range(settings.key_parts):
        some = _block_keys(texts_once, settings, part, settings.key_parts)
        counted = some.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id", F.lit(5))).alias("members"))
        shared.append(scratch.keep(counted.where(F.col("m") > 1).select("key", "m", "members"), "shared"))
    together = reduce(DataFrame.unionByName, shared)
    blocks = scratch.keep(together.groupBy("members", "m").agg(F.min("key").alias("key")).select("key", "m"), "blocks")
    scratch.drop(*shared)
    likely, _ = split_by_membership(met, F.col("key"), blocks, F.col("key"), BLOCK_BITS)
    sizes = measured.where(F.col("n") > 0).select("id", "n").dropDuplicates(["id"])
    joined = scratch.keep(likely.join(blocks, "key").join(sizes, "id").select("key", "id", "n", "m"), "block-members")
    largest = scratch.keep(joined.groupBy("key").agg(F.max("n").alias("n_max")), "block-sizes")
    planted = scratch.keep(_plant(joined.join(largest, "key")), "planted")
    scratch.drop(blocks, joined, largest, texts)

    signatures = known.select("id", "bits").dropDuplicates(["id"])
    found = scratch.keep(_tree_candidates(planted.join(signatures, "id"), settings), "forest")
    rows = measured.select("doc_id", "key_text", "n", F.when(F.col("n") > 0, F.col("id")).alias("id"))
    pairs = scratch.keep(found.select("a", "b").distinct(), "pairs")
    links = _links(pairs, classes, docs, settings, scratch)
    groups = _groups(links, scratch)
    failed = scratch.keep(found.join(links, ["a", "b"], "left_anti").select("tree").distinct(), "failed-trees")
    scratch.drop(found)
    if not failed.isEmpty():
        again = _open_members(planted.join(failed, "tree"), groups, scratch)
        more = scratch.keep(_open_pairs(again.join(signatures, "id"), settings), "open-pairs")
        untested = more.where(F.col("a").isNotNull()).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        untested = scratch.keep(untested, "untested")
        links = scratch.keep(links.unionByName(_links(untested, classes, docs, settings, scratch)), "all-links")
        groups = _groups(links, scratch)
        many = more.where(F.col("a").isNull()).select("tree")
        if not many.isEmpty():
            rest = _open_members(planted.join(many, "tree"), groups, scratch)
            named = scratch.keep(rest.select("id").distinct().join(classes.select("id", "key_text"), "id"), "open-classes")
            last = scratch.keep(_tree_links(rest.join(_class_texts(docs, named), "id"), settings).distinct(), "last-links")
            groups = _groups(links.unionByName(last), scratch)
    return rows, groups


def _open_members(members: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` (tree, id, n) with their groups as labels, of trees that still hold more than one."""
    labelled = members.join(groups, "id", "left").select("tree", "id", "n", F.coalesce("component", "id").alias("label"))
    labelled = scratch.keep(labelled, "labelled-trees")
    state = labelled.groupBy("tree").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high"))
    several = scratch.keep(state.select("tree"), "open-trees")
    return scratch.keep(labelled.join(several, "tree"), "open-members")


def _grouped_rows(docs: DataFrame, settings: JoinSettings, scratch: Scratch) -> DataFrame:
    """doc_id, key_text, n and the group of each row (``near``, null for an empty set)."""
    rows, groups = _class_groups(docs, settings, scratch)
    return scratch.keep(rows.join(groups, "id", "left").select("doc_id", "key_text", "n", F.coalesce("component", "id").alias("near")), "grouped")


# The right sides of joins on ``near`` below are tables, not aggregates in place: a group with many rows can then
# be split.


def similarity_groups(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    with Scratch(docs.sparkSession) as scratch:
        rows = _grouped_rows(docs, settings, scratch)
        roots = scratch.keep(rows.where(F.col("near").isNotNull()).groupBy("near").agg(F.min("doc_id").alias("root")), "roots")
        rooted = scratch.keep(rows.join(roots, "near", "left").select("doc_id", "n", "root"), "rooted")
        # Ids with several texts tie groups together.
        ties = rooted.where(F.col("root") != F.col("doc_id")).select(F.col("root").alias("a"), F.col("doc_id").alias("b")).distinct()
        ties = scratch.keep(ties, "ties")
        final = scratch.keep(components(ties).withColumnRenamed("id", "node"), "final")
        out = rooted.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("doc_id", "root").alias("own"))
        joined = out.join(final, F.col("own") == F.col("node"), "left")
        return scratch.keep(joined.select("doc_id", "n_shingles", F.coalesce("component", "own").alias("component_id")), "similar", for_result=True)


def keep_first(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest id (no id comes last). Rows that share an
    id but no text are told apart; rows without words stay."""
    with Scratch(docs.sparkSession) as scratch:
        rows = _grouped_rows(docs, settings, scratch).where(F.col("near").isNotNull())
        rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key_text")
        counted = scratch.keep(rows.groupBy("near", "doc_id", "key_text").agg(F.count("*").alias("copies")), "counted")
        best = scratch.keep(rows.groupBy("near").agg(F.min(rank).alias("best")), "best")
        judged = counted.join(best, "near").withColumn("stays", rank == F.col("best"))
        # What isn't named here stays as it is.
        named = scratch.keep(
            judged.where(~F.col("stays") | (F.col("copies") > 1)).select(F.col("doc_id").alias("near_id"), F.col("key_text").alias("near_text"), F.col("stays").alias("near_stays")),
            "named",
            for_result=True,
        )
    keyed = docs.select(packed(docs), F.xxhash64(text_of()).alias("near_key"))
    maybe, clean = split_by_membership(keyed, F.col("near_key"), named, F.col("near_text"))
    met = maybe.join(named, (F.col("near_key") == F.col("near_text")) & F.col("row.doc_id").eqNullSafe(F.col("near_id")), "left")
    once = met.where("near_stays").withColumn("near_id", F.col("row.doc_id")).dropDuplicates(["near_id", "near_key"]).select("row.*")
    return clean.select("row.*").unionByName(met.where(F.col("near_stays").isNull()).select("row.*")).unionByName(once)
