"""Header blocks: which field layout governs which lines.

The layout can change at any line of a file, so it has to be carried forward over the lines
that follow. Doing that with a window per file would put a whole file into one task. Instead one
light pass condenses every input split to a single row (its header lines, line count and first
line id); carrying the layout from split to split is then a window over those few rows. Lines meet
the row of their split through an equi join on ``(file, block_start)`` and find the layout in its sorted
stretches by binary search, so a split with many headers costs a line no more than their logarithm. Whether
that side is broadcast is left to its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import non_empty_parts
from ..sources.discovery import file_utc_date

# Header prefix and field names.
HEADER_PREFIX = "#fields:"
REQUIRED_FIELDS = ("date", "time", "cs-uri-stem", "cs(User-Agent)", "cs(Referer)", "sc-status", "time-taken")
FORWARDED_FOR_FIELD = "X-Forwarded-For"
NO_HEADER_REASON = "no #Fields header block found"


def is_header(line: Column) -> Column:
    return F.lower(F.substring(line, 1, len(HEADER_PREFIX))) == HEADER_PREFIX


def is_data(line: Column) -> Column:
    """Neither a directive nor blank. The first character settles it for all but odd lines."""
    first = F.substring(line, 1, 1)
    return F.when(first.between("!", "~"), first != "#").otherwise(line.rlike(r"(?U)\S"))


def header_fields(line: Column) -> Column:
    return non_empty_parts(F.substring(line, len(HEADER_PREFIX) + 1, 1 << 30), " ")


def _position(names: Column, name: str) -> Column:
    """0-based place of a field, the last one if repeated; NULL if absent."""
    from_end = F.array_position(F.reverse(names), F.lit(name.lower()))
    return F.when(from_end > 0, F.size(names) - from_end).cast("int")


def layout(header_line: Column) -> Column:
    """Field count and the place of every field we read, resolved once per header."""
    names = header_fields(F.lower(header_line))
    return F.struct(
        F.size(names).alias("n"),
        *[_position(names, f).alias(a) for a, f in zip(LAYOUT_FIELDS, (*REQUIRED_FIELDS, FORWARDED_FOR_FIELD))],
    )


LAYOUT_FIELDS = ("date", "time", "uri_stem", "user_agent", "referer", "status", "time_taken", "forwarded_for")


def split_index(lines: DataFrame) -> DataFrame:
    """One row per input split. The aggregate combines within each scan task, so what is
    shuffled is one small row per split. The file's date is read off its name here, not per line."""
    index = lines.groupBy("file", "block_start").agg(
        F.min("line_id").alias("first_id"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(is_data(F.col("line"))).alias("data_lines"),
        F.array_sort(F.collect_list(F.when(is_header(F.col("line")), F.struct("line_id", "line")))).alias("headers"),
    )
    return index.withColumn("file_utc_date", file_utc_date(F.col("file")))


def _before() -> W:
    return W.partitionBy("file").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)


def _first_line_no() -> Column:
    """File line number of a split's first line."""
    return F.coalesce(F.sum("n_lines").over(_before()), F.lit(0)) + 1


def skipped_files(splits: DataFrame) -> DataFrame:
    """``(file, file_utc_date, reason)`` of the files to leave out whole: a header block lacks a
    required field (the first such block is named), or there is no header at all."""
    per_header = (
        splits.withColumn("line_no_base", _first_line_no() - F.col("first_id"))
        .select("file", "file_utc_date", "line_no_base", F.explode_outer("headers").alias("h"))
        .select(
            "file",
            "file_utc_date",
            (F.col("line_no_base") + F.col("h.line_id")).alias("line_no"),
            _missing_fields(F.col("h.line")).alias("missing"),
        )
    )
    first_bad = F.min(F.when(F.size("missing") > 0, F.struct("line_no", F.array_join("missing", ", ").alias("names"))))
    reason = F.when(F.count("line_no") == 0, NO_HEADER_REASON).otherwise(
        F.concat(
            F.lit("header block at line "),
            first_bad["line_no"].cast("string"),
            F.lit(" is missing required field(s): "),
            first_bad["names"],
        )
    )
    return (
        per_header.groupBy("file", "file_utc_date").agg(reason.alias("reason")).where(F.col("reason").isNotNull())
    )


def _missing_fields(header_line: Column) -> Column:
    names = header_fields(F.lower(header_line))
    return F.array_compact(
        F.array(*[F.when(~F.array_contains(names, f.lower()), F.lit(f)) for f in REQUIRED_FIELDS])
    )


def split_layouts(splits: DataFrame) -> DataFrame:
    """One row per split: ``(file, file_utc_date, block_start, line_no_base, end_id, from_ids, layouts)``. The k-th of
    ``layouts`` governs the lines from the k-th of ``from_ids`` on; the first one is carried in from the splits
    before. A header that repeats the layout before it starts no new stretch, so most splits have one."""
    inside = F.transform("headers", lambda h: F.struct(h["line_id"].alias("from_id"), layout(h["line"]).alias("layout")))
    own = splits.select("file", "file_utc_date", "block_start", "first_id", "n_lines", inside.alias("inside"))
    carried = F.last(F.try_element_at("inside", F.lit(-1))["layout"], ignorenulls=True).over(_before())
    opening = own.select(
        "*",
        carried.alias("carried"),
        (_first_line_no() - F.col("first_id")).alias("line_no_base"),
        (F.col("first_id") + F.col("n_lines")).alias("end_id"),
    )
    # Just before the split's first line, which may be a header itself.
    first = F.array(F.struct((F.col("first_id") - 1).alias("from_id"), F.col("carried").alias("layout")))
    stretches = opening.withColumn("stretches", F.concat(first, "inside"))
    changed = F.filter(
        "stretches", lambda s, i: (i == 0) | ~s["layout"].eqNullSafe(F.get("stretches", i - 1)["layout"])
    )
    return stretches.withColumn("stretches", changed).select(
        "file",
        "file_utc_date",
        "block_start",
        "line_no_base",
        "end_id",
        F.col("stretches.from_id").alias("from_ids"),
        F.col("stretches.layout").alias("layouts"),
    )


UNKNOWN_SPLIT = "a line lies outside all splits that the first pass over the text has seen"


def header_blocks(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Data lines with ``layout``, the one of the header governing them (NULL before the first
    header). ``layouts`` must hold every split of every file to read; those marked ``left_out`` give
    no lines. A line that no split covers fails the job: the text was cut in another way than when
    the layouts were made, and dropping it would lose it without a trace.

    A line meets one row, that of its split, and finds its stretch there by binary search, halving as often
    as the split with the most stretches needs. Every step is a plain column, so the arrays are looked into where
    they are and never copied to a line."""
    most = layouts.agg(F.max(F.size("from_ids"))).first()[0] or 1
    side = layouts.withColumnsRenamed({"file": "in_file", "block_start": "in_block"})
    of_split = (F.col("file") == F.col("in_file")) & (F.col("block_start") == F.col("in_block"))
    met = lines.where(is_data(F.col("line"))).join(side, of_split, "left").where(~F.coalesce("left_out", F.lit(False)))
    known = ["file", "file_utc_date", "block_start", "line_id", "line_no_base", "line", "in_file", "end_id", "from_ids", "layouts"]
    at = F.lit(0)
    for power in reversed(range((most - 1).bit_length())):
        ahead = at + F.lit(1 << power)
        met = met.select(*known, F.when(F.get("from_ids", ahead) <= F.col("line_id"), ahead).otherwise(at).alias("at"))
        at = F.col("at")
    covered = (F.col("line_id") > F.get("from_ids", F.lit(0))) & (F.col("line_id") < F.col("end_id"))
    outside = F.col("in_file").isNull() | ~covered
    return met.select(
        "file",
        "file_utc_date",
        "block_start",
        "line_id",
        (F.col("line_no_base") + F.col("line_id")).alias("line_no"),
        "line",
        F.when(outside, F.raise_error(F.lit(UNKNOWN_SPLIT))).otherwise(F.get("layouts", at)).alias("layout"),
    )
