"""Outcome, time and presentation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: first status that counts as failed.
FAILED_STATUS = 400
FORMULA_START = r"\A[=+\-@]"


def is_success(status: Column) -> Column:
    return status < FAILED_STATUS


def is_failed(status: Column) -> Column:
    return status >= FAILED_STATUS


def ms_to_seconds(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1000.0)


def round3(c: Column) -> Column:
    """Three decimals: scaled, rounded to the nearest whole number with halves to even, unscaled."""
    return F.rint(c * 1000) / F.lit(1000.0)


def average_time(total_second: Column, hits: Column) -> Column:
    """Mean seconds for tables: 0.0 when there are no hits."""
    return F.when(hits > 0, total_second / hits).otherwise(F.lit(0.0))


def average_time_or_null(total_second: Column, hits: Column) -> Column:
    """Mean seconds for series: a gap when there are no hits."""
    return F.when(hits > 0, total_second / hits)


def service_label(folder: Column, name: Column, service_type: Column) -> Column:
    plain = F.concat(name, F.lit(" ("), service_type, F.lit(")"))
    return F.when(folder.isNull(), plain).otherwise(F.concat(folder, F.lit("/"), plain))


def device_label(username: Column, device_id: Column) -> Column:
    return F.coalesce(F.concat(username, F.lit(" · "), device_id), device_id)


def device_heading(username: Column, device_id: Column) -> Column:
    return F.concat(F.coalesce(username, F.lit("Unattributed")), F.lit(" » "), device_id)


def tsv_cell(c: Column, is_text: bool) -> Column:
    """One cell: no tabs or line breaks; text that a spreadsheet would run gets a quote."""
    text = F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t\r\n", "   ")
    if not is_text:
        return text
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)
