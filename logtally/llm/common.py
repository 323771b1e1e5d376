"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logtally.session import new_scratch_dir, scratch_root
from logtally.sinks.files import SharedFiles

SPACE_RUN = r"[\x20\x09-\x0D]+"
"""What separates words wherever a contract says words are ``[^\\x20\\x09-\\x0D]+``."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column, separator: str = SPACE_RUN) -> Column:
    """The words of a text in order; none for a text of separators only."""
    return F.array_remove(F.split(text, separator), "")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``: the fold rule of the labelled operators.
    A null counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % modulus


def row_key() -> list[Column]:
    """Identifies a document by id and text, so that two rows with one id keep their own results
    and equal rows share one. 64 hash bits next to the id."""
    return [F.col("doc_id").alias("key_id"), F.xxhash64(text_of()).alias("key_text")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["key_id"].eqNullSafe(right["key_id"]) & (left["key_text"] == right["key_text"])


#: Lets Spark delete the shuffle files of a query when it ends, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from files in the shared folder; a lost executor costs a re-read. The shuffle files that
    went into it are of no more use and freed."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(scratch_root(spark))
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


class Scratch:
    """Intermediate tables of one run, as Parquet in the shared folder. ``drop`` deletes one whose successor
    stands; leaving the context deletes the rest but those kept ``for_result``, which lazy results read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, new_scratch_dir(spark, "llm")
        self.files = SharedFiles(spark, self.root)
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.results: set[int] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[df for df, _ in self.paths.values() if id(df) not in self.results])

    def keep(self, df: DataFrame, label: str, for_result: bool = False) -> DataFrame:
        """``df`` from files; the shuffle files that went into it are freed."""
        path = f"{self.root}/{label}-{len(self.paths)}"
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        if for_result:
            self.results.add(id(kept))
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            _, path = self.paths.pop(id(df))
            self.files.delete(path)


def by_hash(ids: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(ids, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package's code on every executor.

    Rows hold whole texts or their words, so batches are kept small; the session setting is lowered to
    ``BATCH_ROWS`` where it is higher, since Spark reads it when the plan is made, after this returns.
    """
    spark = rows.sparkSession
    _ship_code(spark)
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)


def _ship_code(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_ships_logtally", False):
        return
    package = Path(__file__).resolve().parents[1]
    # Executors fetch it from the driver whenever they start, so it stays.
    archive = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._ships_logtally = True


def add_columns(
    docs: DataFrame,
    keep: Sequence[str | Column],
    inputs: Sequence[Column],
    schema: str,
    make: Callable[..., Sequence[pa.Array]],
) -> DataFrame:
    """``keep`` columns followed by those of ``schema``, which ``make`` computes from the ``inputs``.

    ``make`` takes and returns Arrow arrays, one Arrow batch at a time. The kept columns pass
    through as they are, nulls and all.
    """
    kept = docs.select(*keep)
    rows = docs.select(*keep, *[c.alias(f"input_{i}") for i, c in enumerate(inputs)])
    width, made = len(kept.columns), StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            arrays = columns[:width] + list(make(*columns[width:]))
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:width] + made.names)

    return map_arrow(rows, run, StructType(kept.schema.fields + made.fields))


#: Bits of the membership bitmap. Its size is fixed: with more members more rows pass the first test,
#: and the exact join after it does the rest.
BITMAP_BITS = 1 << 20


def packed(rows: DataFrame) -> Column:
    """A row as one value, so that no inner column meets a column of the caller; ``row.*`` unpacks it."""
    return F.struct(*[rows[c] for c in rows.columns]).alias("row")


def split_by_membership(
    rows: DataFrame, key: Column, members: DataFrame, member_key: Column, bits: int = BITMAP_BITS
) -> tuple[DataFrame, DataFrame]:
    """``rows`` as two parts: those whose key may be among the members, and those whose key surely isn't.

    Joining only the first part keeps wide rows that have no partner out of the shuffle. The bitmap
    is at most ``bits`` / 64 rows, which bounds the broadcast whatever the number of members.
    """
    slot = lambda k: F.pmod(F.xxhash64(k, F.lit(1)), F.lit(bits))
    word, bit = (lambda s: F.floor(s / 64).cast("int")), (lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int")))
    words = (
        members.select(slot(member_key).alias("s"))
        .select(word(F.col("s")).alias("bitmap_word"), bit(F.col("s")).alias("b"))
        .groupBy("bitmap_word")
        .agg(F.bit_or("b").alias("bitmap_bits"))
    )
    words = cut_lineage(words)
    marked = rows.select(packed(rows), slot(key).alias("bitmap_slot")).join(
        F.broadcast(words), word(F.col("bitmap_slot")) == F.col("bitmap_word"), "left"
    )
    hit = F.coalesce(F.col("bitmap_bits").bitwiseAND(bit(F.col("bitmap_slot"))) != 0, F.lit(False))
    return marked.where(hit).select("row.*"), marked.where(~hit).select("row.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: Mapping[int, int], seed: int) -> DataFrame:
    """(doc_id, text, label) of about ``rows_per_class`` rows of each class, chosen by a hash of the id.

    The chosen ids, so bounded, are broadcast to the documents. An id labelled twice takes the larger label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().where(F.col("label").isin(list(rows_per_class))).collect()}
    wanted = F.lit(False)
    for value, count in sizes.items():
        wanted |= (F.col("label") == value) & (by_hash(F.col("doc_id"), seed) * count < rows_per_class[value])
    chosen = cut_lineage(known.where(wanted).select(F.col("doc_id").alias("chosen_id"), "label"))
    return docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("chosen_id")).select(docs["doc_id"], docs["text"], "label")
