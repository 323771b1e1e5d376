"""Conversation prefix trie: what conversations have in common from their first turn on.

A turn is 16 bytes of the SHA-256 of role and text, and the number of its words; a conversation the row
of its turns, cut to segments of ``segment`` turns at the same depths everywhere. Equal segments below
one head (all that comes before) are one row with a count and the smallest id. Conversations of any
length are thus rows of bounded size, and copies cost one row.

The trie is built as a burst trie:

1. **Containers.** All segments below one head are a container of suffixes.
2. **Bursting.** A container of more than ``container_bytes`` bursts: the turns that all its suffixes share,
   found from the smallest and the largest of them, become a chain of nodes; each next turn id below
   its end heads a container of its own. A round bursts all such containers at once, in one
   aggregation. Rounds follow the branching of what many conversations share, not the length of it.
3. **Sweeping.** The containers left are dealt to tasks and sorted; a sweep over neighbours' common
   prefixes gives their nodes with counts, leaves and saved tokens of each subtree.
4. **Adding up.** Sums of a container's top nodes go to the end of the chain that it hangs on, last round
   first, and those of deeper segments to the segment's end before it is swept.

Turns are numbered over a range partitioning by conversation and turn, with running counts over the
tasks, so a conversation with a third of all rows is spread. The ids that end at a node are hashed in
order, from texts of many ids each that other tasks have joined: one stream per node, in constant memory.

Results for odd input: rows without conv_id are left out; a null role or text is empty; a null turn comes
first, rows of one turn are ordered by their digest, and all count; extra columns are ignored; no
conversations give no rows. Two turns are one if 128 bits of their digests agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtally.session import write_scratch

from .common import SPACE_RUN, map_arrow, split_words

#: A turn in a row of turns: 16 bytes of digest, then its words as a big-endian number.
TURN = np.dtype([("digest", "V16"), ("words", ">u4")])
WIDTH = TURN.itemsize
ROOT = "00" * 16
NO_IDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieSettings:
    #: Conversations are rebuilt in blocks of so many ids, on up to ``leads`` - 1 turns of the block's first.
    block: int = 20
    leads: int = 4
    segment: int = 1024
    container_bytes: int = 4 << 20
    #: Rows that a sweep takes together, at least; it ends at a container's end.
    sweep_rows: int = 20_000
    #: Ids of one text of joined ids, about.
    joined_ids: int = 50_000


def _digest(*parts: Column) -> Column:
    """32 hex digits."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


# --- turns, in order ------------------------------------------------------------------------------


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, key): hex digits of each turn as in ``TURN``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(split_words(text, SPACE_RUN))
    key = F.concat(_digest(F.length(role).cast("string"), F.lit(":"), role, text), F.lpad(F.hex(words), 8, "0"))
    return turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"))


def numbered(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keys`` with ``at``, ascending in the order of turns, and ``task``; and (conv_id, task, begins, earlier, n):
    its first ``at`` in each task, its turns in earlier tasks, and those here."""
    ranged = keys.repartitionByRange("conv_id", "turn", "key").sortWithinPartitions("conv_id", "turn", "key")
    rows = write_scratch(ranged.select("conv_id", "key", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("task")), "turns")
    runs = rows.groupBy("conv_id", "task").agg(F.min("at").alias("begins"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return rows, runs.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))


def rebuilt(turns: DataFrame, settings: TrieSettings) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, key) of the rebuilt conversations, and (conv_id, total) of all, turnless ones too.

    The first h turns of the block's first conversation, h = crc32(decimal id) % ``leads``, then the
    conversation's own turns after its first h."""
    rows, runs = numbered(turn_keys(turns))
    runs = write_scratch(runs, "turn-runs")
    h, base = F.crc32(F.col("conv_id").cast("string")) % settings.leads, F.col("conv_id") - F.col("conv_id") % settings.block
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    bases = sizes.where(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("base_own"))
    lead = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = sizes.join(bases, "base", "left").select(
        "conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("total")
    )
    convs = write_scratch(convs, "conversations")
    place = F.col("at") - F.col("begins") + 1 + F.col("earlier")
    located = rows.join(runs.join(convs.select("conv_id", "h", "lead"), "conv_id"), ["conv_id", "task"]).withColumn("place", place)
    own = located.where(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("depth"), "key")
    # At most leads - 1 turns of each block's first, for at most a block of conversations.
    first = rows.where(F.col("conv_id") % settings.block == 0).join(runs, ["conv_id", "task"]).withColumn("depth", place)
    first = first.where(F.col("depth") < settings.leads).select(F.col("conv_id").alias("base"), "depth", "key")
    lent = convs.where(F.col("lead") > 0).join(first, "base").where(F.col("depth") <= F.col("lead"))
    return own.unionByName(lent.select("conv_id", "depth", "key")), convs.select("conv_id", "total")


# --- distinct segments ----------------------------------------------------------------------------


def segments(turns: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """(conv_id, level, head, tail, keys, ends): each conversation's segments. ``head`` and ``tail`` stand for all
    turns before it and up to its end; ``ends`` says that the conversation does."""
    level = F.floor((F.col("depth") - 1) / size).cast("int")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "key"))), lambda t: t["key"]), "")
    cut = turns.groupBy("conv_id", level.alias("level")).agg(joined.alias("keys"))
    cut = write_scratch(cut.join(convs, "conv_id"), "segments")
    one = cut.where(F.col("total") <= size).withColumn("head", F.lit(ROOT))
    # Digests of segments, in order; one for each ``size`` turns.
    chained = (
        cut.where(F.col("total") > size)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("level", _digest(F.col("keys")).alias("digest")))).alias("parts"))
        .select(
            "conv_id",
            F.posexplode(
                F.aggregate(
                    "parts",
                    F.array(F.lit(ROOT)),
                    lambda heads, part: F.concat(heads, F.array(_digest(F.element_at(heads, -1), part["digest"]))),
                )
            ).alias("level", "head"),
        )
    )
    more = cut.where(F.col("total") > size).join(chained, ["conv_id", "level"])
    whole = one.unionByName(more.select(*one.columns))
    ends = F.col("level") == F.floor((F.col("total") - 1) / size)
    return whole.select("conv_id", "level", "head", _digest("head", _digest(F.col("keys"))).alias("tail"), "keys", ends.alias("ends"))


def ids_sha256(ends: DataFrame, settings: TrieSettings) -> DataFrame:
    """(tail, ends_sha256): SHA-256 of the decimal ids of each tail, ascending, joined by commas. ``ends``: tail, conv_id."""
    limit = settings.joined_ids

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, ids = None, []

        def text() -> tuple[str, int, str]:
            return tail, ids[0], ",".join(map(str, ids))

        for batch in batches:
            out = []
            for now, conv in zip(batch.column("tail").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (now != tail or len(ids) >= limit):
                    out.append(text())
                    ids = []
                tail = now
                ids.append(conv)
            if out:
                yield _batch(out, _JOINED)
        if ids:
            yield _batch([text()], _JOINED)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, state = None, None
        for batch in batches:
            out = []
            for now, ids in zip(batch.column("tail").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if now != tail:
                    if state:
                        out.append((tail, state.hexdigest()))
                    tail, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _batch(out, _DIGESTS)
        if state:
            yield _batch([(tail, state.hexdigest())], _DIGESTS)

    ordered = ends.select("tail", "conv_id").repartitionByRange("tail", "conv_id").sortWithinPartitions("tail", "conv_id")
    joined = map_arrow(ordered, join, "tail string, first_id long, ids string")
    streams = joined.repartition("tail").sortWithinPartitions("tail", "first_id")
    return map_arrow(streams, digest, "tail string, ends_sha256 string")


_JOINED = pa.schema([("tail", pa.string()), ("first_id", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("tail", pa.string()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# --- containers -------------------------------------------------------------------------------------

#: What hangs below the end of a segment: child nodes, and sums of their subtrees.
BELOW = ("below_children", "below_leaves", "below_saved")
NODE_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, anchor string"
)
NODES = [x.strip().split(" ")[0] for x in NODE_SCHEMA.split(",")]
RESULT = NODES[:-1]


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // WIDTH


def sweep(
    keys: Sequence[bytes],
    fresh: np.ndarray,
    first: np.ndarray,
    n: np.ndarray,
    ends: Sequence[str | None],
    below: np.ndarray,
    anchor: Sequence[str],
    anchor_first: np.ndarray,
    anchor_depth: np.ndarray,
) -> dict[str, list]:
    """Nodes of whole containers, their suffixes distinct, not empty and in order; ``fresh`` marks each container's
    first. ``below``: rows of ``BELOW``. Goes through the depths, so work is in proportion to the turns."""
    length = np.array([len(k) // WIDTH for k in keys])
    shared = np.array([0, *map(common_turns, keys, keys[1:])])
    shared[fresh] = 0
    words = np.frombuffer(b"".join(keys), TURN)["words"].astype(np.int64)
    start = np.cumsum(length) - length
    node_of, levels = np.zeros(len(keys), np.int64), []
    rows = np.arange(len(keys))
    depth = 0
    while True:
        depth += 1
        rows = rows[length[rows] >= depth]
        if not len(rows):
            break
        new = shared[rows] < depth
        at = np.flatnonzero(new)
        top = rows[at]
        parent = node_of[top].copy()
        node_of[rows] = np.cumsum(new) - 1
        ending = rows[length[rows] == depth]
        count = np.add.reduceat(n[rows], at)
        levels.append((top, parent, count, np.minimum.reduceat(first[rows], at), words[start[top] + depth - 1], ending, node_of[ending]))
    out: dict[str, list] = {c: [] for c in NODES}
    children = leaves = saved = above = None
    for depth in range(len(levels), 0, -1):
        top, parent, count, smallest, spoken, ending, ended = levels[depth - 1]
        sums = np.zeros((3, len(top)), np.int64)
        if above is not None:
            np.add.at(sums[0], above, 1)
            np.add.at(sums[1], above, leaves)
            np.add.at(sums[2], above, saved)
        sums[:, ended] += below[:, ending]
        children, leaves = sums[0], np.where(sums[0] == 0, 1, sums[1])
        saved, above = sums[2] + (count - 1) * spoken, parent
        closing = [NO_IDS] * len(top)
        for node, row in zip(ended.tolist(), ending.tolist(), strict=True):
            closing[node] = ends[row] or NO_IDS
        out["conv_id"].append(smallest)
        out["depth"].append(anchor_depth[top] + depth)
        out["parent_conv_id"].append(levels[depth - 2][3][parent] if depth > 1 else anchor_first[top])
        for name, values in (("n_convs", count), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
            out[name].append(values)
        out["ends_sha256"] += closing
        out["anchor"] += [anchor[i] for i in top.tolist()] if depth == 1 else [None] * len(top)
    return out


def _node_batch(out: dict[str, list]) -> pa.RecordBatch:
    arrays = [pa.array(out[c], pa.string()) if c in ("ends_sha256", "anchor") else pa.array(np.concatenate(out[c]).astype(np.int64)) for c in NODES]
    return pa.RecordBatch.from_arrays(arrays, NODES)


#: A suffix in its container.
MEMBER = ["box", "anchor", "anchor_first", "anchor_depth", "keys", "first", "n", "ends_sha256", *BELOW]


def sweep_containers(members: DataFrame, settings: TrieSettings) -> DataFrame:
    """Nodes of all containers of ``members`` (``MEMBER``)."""
    least = settings.sweep_rows

    def nodes(held: list[dict[str, list]]) -> pa.RecordBatch:
        c = {name: [x for part in held for x in part[name]] for name in MEMBER}
        fresh = np.array([True, *(a != b for a, b in zip(c["box"], c["box"][1:]))])
        number = lambda name: np.array(c[name], np.int64)
        return _node_batch(
            sweep(c["keys"], fresh, number("first"), number("n"), c["ends_sha256"], np.array([c[x] for x in BELOW], np.int64), c["anchor"], number("anchor_first"), number("anchor_depth"))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, list]] = []
        size = 0
        for batch in batches:
            now = batch.to_pydict()
            boxes = now["box"]
            if size >= least and boxes:
                # Up to where the container at hand ends, which holds a bounded number of bytes.
                last = held[-1]["box"][-1]
                cut = next((i for i, b in enumerate(boxes) if b != last), None)
                if cut is not None:
                    yield nodes([*held, *([{k: v[:cut] for k, v in now.items()}] if cut else [])])
                    held, size, now = [], 0, {k: v[cut:] for k, v in now.items()}
            if now["box"]:
                held.append(now)
                size += len(now["box"])
        if held:
            yield nodes(held)

    ordered = members.select(*MEMBER).repartition("box").sortWithinPartitions("box", "keys")
    return map_arrow(ordered, run, NODE_SCHEMA)


def _shared_turns(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``low`` and ``high`` replaced by ``chain``: the turns that both begin with."""
    kept = [c for c in boxes.columns if c not in ("low", "high")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            chain = [a[: WIDTH * common_turns(a, b)] for a, b in zip(low, high, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(chain, pa.binary())], [*kept, "chain"])

    return map_arrow(boxes, run, boxes.select(*kept).withColumn("chain", F.lit(b"")).schema)


def _chain_nodes(boxes: DataFrame) -> DataFrame:
    """Nodes of the chains of burst containers. ``boxes``: anchor, anchor_first, anchor_depth, chain, first, n,
    ends_sha256, and ``BELOW`` of the chain's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = np.frombuffer(r["chain"], TURN)["words"].astype(np.int64).tolist()
                children, leaves, saved = (r[c] for c in BELOW)
                ends = r["ends_sha256"] or NO_IDS
                for i in range(len(words) - 1, -1, -1):
                    saved += (r["n"] - 1) * words[i]
                    parent, anchor = (r["first"], None) if i else (r["anchor_first"], r["anchor"])
                    out.append((r["first"], r["anchor_depth"] + i + 1, parent, r["n"], children, leaves, saved, ends, anchor))
                    children, ends = 1, NO_IDS
            if out:
                yield _batch(out, _NODES)

    return map_arrow(boxes, run, NODE_SCHEMA)


_NODES = pa.schema([(c, pa.string() if c in ("ends_sha256", "anchor") else pa.int64()) for c in NODES])


def _top_sums(nodes: DataFrame) -> DataFrame:
    """(anchor, and ``BELOW``): what hangs on each anchor."""
    return (
        nodes.where(F.col("anchor").isNotNull())
        .groupBy("anchor")
        .agg(F.count("*").alias(BELOW[0]), F.sum("n_leaves").alias(BELOW[1]), F.sum("saved_tokens").alias(BELOW[2]))
    )


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in BELOW})


def container_nodes(members: DataFrame, settings: TrieSettings) -> DataFrame:
    """All nodes below the anchors of ``members`` (``MEMBER``), in containers named ``box``."""
    active, small, rounds = members.select(*MEMBER), [], []
    while True:
        boxes = active.groupBy("box").agg(
            F.count("*").alias("m"),
            F.sum(F.length("keys")).alias("size"),
            F.min("keys").alias("low"),
            F.max("keys").alias("high"),
            *[F.first(c).alias(c) for c in ("anchor", "anchor_first", "anchor_depth")],
            F.min("first").alias("first"),
            F.sum("n").alias("n"),
        )
        large = boxes.where((F.col("m") > 1) & (F.col("size") > settings.container_bytes)).drop("m", "size")
        large = write_scratch(_shared_turns(large), "burst-containers")
        if large.isEmpty():
            small.append(active)
            break
        marks = large.select("box", "chain", F.col("first").alias("box_first"))
        joined = write_scratch(active.join(marks, "box", "left"), "suffixes")
        small.append(joined.where(F.col("chain").isNull()).select(*MEMBER))
        burst = joined.where(F.col("chain").isNotNull())
        taken = F.length("chain")
        # What ends where the chain does; distinct, so one suffix of a container at most.
        stubs = burst.where(F.length("keys") == taken).select("box", "ends_sha256", *[F.col(c).alias(f"own_{c}") for c in BELOW])
        rounds.append((large, stubs))
        rest = F.substring("keys", taken + 1, F.length("keys"))
        chained = taken > 0
        active = burst.where(F.length("keys") > taken).select(
            _digest("box", F.hex(F.substring("keys", 1, taken + WIDTH))).alias("box"),
            # Without a chain the containers hang where the burst one did.
            F.when(chained, F.col("box")).otherwise(F.col("anchor")).alias("anchor"),
            F.when(chained, F.col("box_first")).otherwise(F.col("anchor_first")).alias("anchor_first"),
            (F.col("anchor_depth") + taken / WIDTH).cast("long").alias("anchor_depth"),
            rest.alias("keys"),
            "first",
            "n",
            "ends_sha256",
            *BELOW,
        )
    nodes = write_scratch(sweep_containers(reduce(DataFrame.unionByName, small), settings), "trie-nodes")
    for large, stubs in reversed(rounds):
        chains = large.where(F.length("chain") > 0)
        sums = _top_sums(nodes).withColumnRenamed("anchor", "box")
        summed = chains.join(sums, "box", "left").join(stubs, "box", "left")
        total = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"own_{c}", F.lit(0))).cast("long").alias(c) for c in BELOW]
        done = _chain_nodes(summed.select("anchor", "anchor_first", "anchor_depth", "chain", "first", "n", "ends_sha256", *total))
        nodes = nodes.unionByName(write_scratch(done, "chain-nodes"))
    return nodes


def conversation_trie(turns: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``RESULT``). ``turns``: conv_id, turn, role, text."""
    rows, convs = rebuilt(turns, settings)
    figures = convs.agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.max("total").alias("deepest")).first()
    cut = write_scratch(segments(rows, convs, settings.segment), "chained-segments")
    turnless = convs.where(F.col("total") == 0).select(F.lit(ROOT).alias("tail"), "conv_id")
    ended = write_scratch(ids_sha256(cut.where("ends").select("tail", "conv_id").unionByName(turnless), settings), "ended")
    distinct = cut.groupBy("level", "head", "tail").agg(
        F.min("conv_id").alias("first"), F.count("*").alias("n"), F.unhex(F.first("keys")).alias("keys")
    )
    distinct = write_scratch(distinct.join(ended, "tail", "left"), "distinct-segments")

    deepest = -(-(figures.deepest or 0) // settings.segment)
    parts, hanging = [], None
    for level in range(deepest - 1, -1, -1):
        here = distinct.where(F.col("level") == level)
        if hanging is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in BELOW})
        else:
            here = _filled(here.join(hanging.withColumnRenamed("anchor", "tail"), "tail", "left"))
        if level:
            above = distinct.where(F.col("level") == level - 1).select(F.col("tail").alias("head"), F.col("first").alias("anchor_first"))
            here = here.join(above, "head")
        else:
            here = here.withColumn("anchor_first", F.lit(figures.first).cast("long"))
        members = here.withColumns({"box": F.col("head"), "anchor": F.col("head"), "anchor_depth": F.lit(level * settings.segment).cast("long")})
        nodes = container_nodes(members, settings)
        parts.append(nodes.select(*RESULT))
        heads = here.select(F.col("head").alias("anchor")).distinct()
        hanging = write_scratch(_top_sums(nodes).join(heads, "anchor", "left_semi"), "hanging")

    # The root: one row, or none without conversations.
    root = turns.sparkSession.range(1 if figures.n else 0).select(F.lit(ROOT).alias("anchor"))
    root = root.join(ended.withColumnRenamed("tail", "anchor"), "anchor", "left")
    root = _filled(root.join(hanging, "anchor", "left") if hanging is not None else root.withColumns({c: F.lit(None).cast("long") for c in BELOW}))
    top = root.select(
        F.lit(figures.first).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(figures.n).cast("long").alias("n_convs"),
        F.col(BELOW[0]).alias("n_children"),
        F.greatest(F.lit(1), F.col(BELOW[1])).cast("long").alias("n_leaves"),
        F.col(BELOW[2]).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    return reduce(DataFrame.unionByName, parts, top)
