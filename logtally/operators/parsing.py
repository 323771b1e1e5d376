"""Data lines to typed fields, or to the reason they are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_empty_parts
from .once import evaluate_once

# Fixed value.
NO_HEADER_YET = "no header block seen yet"


def split_fields(line: Column) -> Column:
    """Fields between single or repeated spaces; the common case needs no second pass."""
    has_empty = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(has_empty, non_empty_parts(line, " ")).otherwise(F.split(line, " "))


def parse_utc_ts(date_text: Column, time_text: Column) -> Column:
    """Strict ``yyyy-MM-dd HH:mm:ss`` from year 1 on, NULL otherwise.

    A cast takes more spellings (short fields, signs, zones, fractions) but only digits between
    separators, so fixing the places of the separators and the final digit makes it strict, at a
    fraction of the cost of a pattern.
    """

    def has(text: Column, length: int, separator: str, *places: int) -> Column:
        shape = F.length(text) == length
        for place in places:
            shape = shape & (F.substring(text, place, 1) == separator)
        return shape

    strict = (
        has(date_text, 10, "-", 5, 8)
        & has(time_text, 8, ":", 3, 6)
        & F.substring(time_text, 8, 1).between("0", "9")
        & (date_text >= "0001")
    )
    return F.when(strict, F.concat_ws(" ", date_text, time_text).try_cast("timestamp_ntz"))


def parse_int32(text: Column) -> Column:
    return text.try_cast("int")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed fields per data line; ``reason`` is NULL for a valid line, else names the first
    check that failed: header, field count, date and time, status, time taken."""
    tokens = lines.withColumn("t", split_fields(F.col("line")))

    def field(name: str) -> Column:
        return F.get("t", F.col(f"layout.{name}"))

    raw = tokens.select(
        "file",
        "file_utc_date",
        "block_start",
        "line_id",
        "line_no",
        F.col("layout.n").alias("expected"),
        F.size("t").alias("got"),
        field("date").alias("date_text"),
        field("time").alias("time_text"),
        field("status").alias("status_text"),
        field("time_taken").alias("time_taken_text"),
        field("uri_stem").alias("uri_stem"),
        field("user_agent").alias("user_agent"),
        field("referer").alias("referer"),
        field("forwarded_for").alias("forwarded_for"),
    )
    typed = raw.select(
        "*",
        parse_utc_ts(F.col("date_text"), F.col("time_text")).alias("utc_ts"),
        parse_int32(F.col("status_text")).alias("status"),
        parse_int32(F.col("time_taken_text")).alias("time_taken_ms"),
    )
    values = ("utc_ts", "uri_stem", "user_agent", "referer", "status", "time_taken_ms", "forwarded_for")
    return evaluate_once(
        typed,
        keep=("file", "file_utc_date", "block_start", "line_id", "line_no"),
        values=[*map(F.col, values), _reason().alias("reason")],
    )


def _reason() -> Column:
    expected, got = F.col("expected"), F.col("got")

    def unparseable(what: str, *texts: str) -> Column:
        return F.concat(F.lit(f"unparseable {what} '"), F.concat_ws(" ", *texts), F.lit("'"))

    return (
        F.when(expected.isNull(), NO_HEADER_YET)
        .when(
            got != expected,
            F.concat(
                F.lit("field count mismatch (expected "),
                expected.cast("string"),
                F.lit(", got "),
                got.cast("string"),
                F.lit(")"),
            ),
        )
        .when(F.col("utc_ts").isNull(), unparseable("date/time", "date_text", "time_text"))
        .when(F.col("status").isNull(), unparseable("status", "status_text"))
        .when(F.col("time_taken_ms").isNull(), unparseable("time-taken", "time_taken_text"))
    )


def valid_requests(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason", "line_no")


def reject_lines(parsed: DataFrame) -> DataFrame:
    """``(file, line_no, reason)`` of every rejected line."""
    return parsed.where(F.col("reason").isNotNull()).select("file", "line_no", "reason")


def line_counts(parsed: DataFrame) -> DataFrame:
    """``(file, total, valid, invalid)`` over the lines of files that were not skipped. Counts
    every valid line, whichever local date it falls on."""
    return parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid"),
    )


def run_summary(counts: DataFrame) -> DataFrame:
    """One row: total, valid and invalid lines over all files."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "valid", "invalid")])
