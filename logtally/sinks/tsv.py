"""Tab-separated exports of the complete-view reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import tsv_cell


@dataclass(frozen=True)
class TsvReport:
    """Column titles with the columns they show, and the columns that order the rows."""

    columns: tuple[tuple[str, str], ...]
    order: tuple[str, ...]


# Titles of the exported columns.
_TIMES = (("Total Time Taken (s)", "total_time_taken_second"), ("Average Time Taken (s)", "average_time_taken_second"))
_OUTCOMES = (("Successful Hits", "successful_hits"), ("Failed Hits", "failed_hits"))

ROOT_REPORT = TsvReport((("Root", "root"), ("Hits", "hits"), *_TIMES), ("root",))
SERVICE_REPORT = TsvReport(
    (
        ("Site", "site"),
        ("Folder", "folder"),
        ("Service Name", "service_name"),
        ("Service Type", "service_type"),
        ("Hits", "hits"),
        *_TIMES,
        *_OUTCOMES,
    ),
    ("site", "folder", "service_name", "service_type"),
)
PORTAL_REPORT = TsvReport(
    (("Portal Item", "portal_item_id"), ("Hits", "hits"), *_TIMES, *_OUTCOMES), ("portal_item_id",)
)
DEVICE_REPORT = TsvReport(
    (("Username", "username"), ("Device ID", "device_id"), ("Hits", "hits"), *_TIMES, ("Last Seen", "last_seen")),
    ("device_id",),
)


def _cell(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.DoubleType):
        # Three decimals at most, no exponent, no trailing zeros.
        text = F.col(name).cast("decimal(38,3)").cast("string")
        return tsv_cell(F.regexp_replace(text, r"\.?0+\z", ""), is_text=False)
    # Dates are exported as text, but a date never starts like a formula.
    return tsv_cell(F.col(name), is_text=isinstance(kind, T.StringType))


def tsv_lines(df: DataFrame, columns: Sequence[tuple[str, str]]) -> Column:
    """One text line per row."""
    return F.concat_ws("\t", *[_cell(df, name) for _, name in columns])


def export_tsv(df: DataFrame, path: str, report: TsvReport) -> bool:
    """Write the report as text parts which, joined in name order, are one TSV file with one
    header line. Nothing is written for a report without rows; tells whether it was."""
    if df.isEmpty():
        return False
    keys = [f"k{i}" for i in range(len(report.order))]
    body = df.select(
        F.lit(1).alias("part"), *[F.col(c).alias(k) for c, k in zip(report.order, keys)], tsv_lines(df, report.columns).alias("line")
    )
    header = df.sparkSession.range(1).select(
        F.lit(0).alias("part"),
        *[F.lit(None).cast(body.schema[k].dataType).alias(k) for k in keys],
        F.lit("\t".join(title for title, _ in report.columns)).alias("line"),
    )
    # Range partitioning puts the header first in the first part; large reports stay spread out.
    ordered = header.unionByName(body).orderBy("part", *[F.col(k).asc_nulls_first() for k in keys])
    ordered.select("line").write.mode("overwrite").option("lineSep", "\n").text(path)
    return True
