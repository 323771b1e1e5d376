"""Mixing sources to target weights by budgets over a tree of domain, language and source.

The token budget flows from the root by weights. At each node a child gets its weight's share, but
no more than its subtree holds over ``max_epochs``; what it can't take goes to its siblings, and
only when all of them are full does the node itself take less, which its own siblings then make
up. At each leaf the budget is spent on seeded epochs: whole passes over the leaf, then the prefix
of one more pass, in an order that depends on seed, epoch and document.

Shares are found by sorting siblings by capacity over weight and running sums, level by level, all
in whole tokens. The prefix of a leaf is found from sums over slices of its order, so that a leaf
with a third of all rows is spread over many tasks; only slice totals are windowed by leaf. Texts
are never shuffled: the cut of each leaf is joined to the documents (one row per leaf).

Results for odd input: a null text has no tokens and is kept in its leaf's passes; null languages
and sources form leaves of their own, named by an empty string; documents with one id go together,
repeated rows count each; extra columns pass through ``select_documents``; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtally.session import write_scratch

from .common import SPACE_RUN, packed, split_words, text_of

LEVELS = ["mix_domain", "mix_lang", "mix_source"]
MADE = ("mix_domain", "mix_tokens", "mix_epoch")
#: Parts in which the rows of a leaf meet what is known of it, so that a large leaf isn't one task.
SALTS = 32


@dataclass(frozen=True)
class MixSettings:
    """``budget_percent`` of all tokens are wanted. Weights are whole numbers from 1; a name without one has 1."""

    budget_percent: int = 60
    max_epochs: int = 3
    seed: int = 5
    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"forum": 2, "reference": 3, "web": 5})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    source_weights: Mapping[str, int] = field(default_factory=lambda: {"src0": 2})
    #: Rows of one slice of a leaf's order, about.
    slice_rows: int = 2_000


# The tables have no domain column: sources are dealt to three by the last digit of their names.
def domain_of(source: Column) -> Column:
    last = F.substring(source, -1, 1)
    return F.when(last.isin("0", "1", "2", "3", "4"), "web").when(last.isin("5", "6", "7"), "reference").otherwise("forum")


def with_leaf(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, packed, with doc_id, the names of their leaves and ``mix_tokens``, the words of their texts."""
    source = F.coalesce("source", F.lit(""))
    return docs.select(
        packed(docs),
        "doc_id",
        domain_of(source).alias("mix_domain"),
        F.coalesce("lang", F.lit("")).alias("mix_lang"),
        source.alias("mix_source"),
        F.size(split_words(text_of(), SPACE_RUN)).cast("long").alias("mix_tokens"),
    )


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    named = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return F.coalesce(F.get(F.map_values(F.map_filter(named, lambda k, _: k == F.col(column))), F.lit(0)), F.lit(1)).cast("long")


def share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes`` (parent columns, child, capacity, weight, parent_budget) with ``budget``.

    Siblings in order of capacity / weight: while one can't take its share of what is left it takes
    all it holds. The others split the rest by weight, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), child)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    ranked = nodes.select("*", left.alias("left"), F.sum("weight").over(onward).alias("weights"))
    full = ranked.withColumn("full", F.col("capacity") * F.col("weights") <= F.col("weight") * F.col("left"))
    group = Window.partitionBy(*parent)
    rest = F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(group)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(group)
    parts = full.select("*", rest.alias("rest"), open_weight.alias("open_weight"))
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.call_function("div", F.col("weight") * F.col("rest"), F.col("open_weight")))
    return parts.select(*nodes.columns, budget.cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, settings: MixSettings) -> DataFrame:
    """``leaves`` (LEVELS, n_tokens, n_rows) with ``budget``. One row per leaf in and out."""
    held = leaves.withColumn("capacity", F.col("n_tokens") * settings.max_epochs)
    total = held.agg((F.call_function("div", F.sum("n_tokens") * settings.budget_percent, F.lit(100))).alias("parent_budget"))
    weights = {
        "mix_domain": settings.domain_weights,
        "mix_lang": settings.lang_weights,
        "mix_source": settings.source_weights,
    }
    budgets = total
    for depth, child in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = held.groupBy(*parent, child).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(child, weights[child]))
        nodes = nodes.join(budgets, parent) if parent else nodes.crossJoin(F.broadcast(budgets))
        shared = share(nodes, parent, child)
        budgets = write_scratch(shared.select(*LEVELS[: depth + 1], F.col("budget").alias("parent_budget")), f"mix-budgets-{depth}")
    return leaves.join(budgets, LEVELS).withColumnRenamed("parent_budget", "budget")


def order_key(epoch: Column, seed: int) -> Column:
    """Place of a document in an epoch's order: an md5 text, the same in any engine."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_cuts(docs: DataFrame, settings: MixSettings) -> DataFrame:
    """One row per leaf: LEVELS, ``budget``, ``full`` (epochs taken whole) and ``cut``, the last order key
    taken in epoch ``full`` + 1 (null: none). ``docs``: doc_id, LEVELS, mix_tokens.

    The prefix holds as many documents as fit the rest of the budget; those of one id go together.
    """
    salt = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(SALTS)).cast("int")
    narrow = write_scratch(docs.select("doc_id", *LEVELS, "mix_tokens", salt.alias("salt")), "mix-rows")
    # Small tables are written before what follows reads them, often: one plan for all would make each again at each
    # use, and broadcast more than a dozen of them at a time in the driver.
    leaves = write_scratch(narrow.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("n_tokens"), F.count("*").alias("n_rows")), "mix-leaves")
    budgets = leaf_budgets(leaves, settings)
    planned = write_scratch(
        budgets.select(
            *LEVELS,
            "budget",
            "n_rows",
            F.when(F.col("n_tokens") > 0, F.call_function("div", F.col("budget"), F.col("n_tokens"))).otherwise(0).cast("int").alias("full"),
            F.when(F.col("n_tokens") > 0, F.col("budget") % F.col("n_tokens")).otherwise(0).alias("rest"),
        ),
        "mix-plan",
    )
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / settings.slice_rows))
    # Eight hex digits of the key as a number in [0, 1).
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    keyed = (
        narrow.join(planned.where(F.col("rest") > 0).select("*", salted), [*LEVELS, "salt"])
        .withColumn("key", order_key(F.col("full") + 1, settings.seed))
        .select(*LEVELS, "key", "mix_tokens", "rest", F.floor(part * slices).alias("slice"))
    )
    slices_of = keyed.groupBy(*LEVELS, "rest", "slice").agg(F.sum("mix_tokens").alias("tokens"), F.max("key").alias("last_key"))
    so_far = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices_of.select(
        *LEVELS, "rest", "slice", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)).alias("begins"), F.max("last_key").over(so_far).alias("in_earlier")
    )
    # The slice in which the budget ends; if it never does, all are taken, and the last stands for them. With it the
    # last key of the slices before, for when no document of that slice fits.
    at_end = [F.max_by(c, "slice").alias(c) for c in ("slice", "begins", "in_earlier")]
    ending = write_scratch(starts.where(F.col("begins") <= F.col("rest")).groupBy(*LEVELS).agg(*at_end), "mix-ending")
    inside = keyed.join(ending, [*LEVELS, "slice"])
    running = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = inside.select(*LEVELS, "key", "rest", (F.col("begins") + F.sum("mix_tokens").over(running)).alias("upto"))
    last = upto.where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("in_slice"))
    return (
        planned.select(*LEVELS, "budget", "full")
        .join(ending.select(*LEVELS, "in_earlier"), LEVELS, "left")
        .join(last, LEVELS, "left")
        .select(*LEVELS, "budget", "full", F.coalesce("in_slice", "in_earlier").alias("cut"))
    )


def select_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang, source and others), ``mix_domain``, ``mix_tokens`` and
    ``mix_epoch``: one row for each epoch a document is taken in. A leaf without tokens is taken in none.
    Columns of ``docs`` with these three names are replaced."""
    marked = with_leaf(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(SALTS)).cast("int"))
    cuts = write_scratch(leaf_cuts(marked, settings), "mix-cuts").withColumnsRenamed({c: f"cut_{c}" for c in LEVELS})
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("cut_salt"))
    joined = marked.join(cuts, [*[F.col(c) == F.col(f"cut_{c}") for c in LEVELS], F.col("salt") == F.col("cut_salt")])
    partial = F.col("cut").isNotNull() & (order_key(F.col("full") + 1, settings.seed) <= F.col("cut"))
    times = F.col("full") + partial.cast("int")
    epochs = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    made = [c for c in docs.columns if c not in MADE]
    return joined.select(*[F.col("row")[c].alias(c) for c in made], "mix_domain", "mix_tokens", epochs.alias("mix_epoch"))
