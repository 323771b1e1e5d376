"""Row predicates shared by aggregates and reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_ALL = "all"
RANGE_LAST_7 = "last-7-days"


def filter_local_date(df: DataFrame, d: date) -> DataFrame:
    return df.where(F.col("local_date") == F.lit(d))


def filter_date_range(df: DataFrame, start: date, end: date) -> DataFrame:
    """Both ends included; prunes partitions of a stored table."""
    return df.where(F.col("local_date").between(F.lit(start), F.lit(end)))


def filter_last_7_days(df: DataFrame, last7_start: date) -> DataFrame:
    return df.where(F.col("local_date") >= F.lit(last7_start))


def filter_identity_matched(df: DataFrame, identity: str) -> DataFrame:
    return df.where(F.col(identity).isNotNull())


def filter_forwarded_declared(requests: DataFrame) -> DataFrame:
    """Drops requests whose log had no forwarded-for field; a declared but empty one stays."""
    return requests.where(F.col("forwarded_for").isNotNull())


def filter_site(df: DataFrame, site: str) -> DataFrame:
    return df.where(F.col("site") == site)


def filter_included_roots(df: DataFrame, roots: Sequence[str], column: str = "root") -> DataFrame:
    return df.where(F.col(column).isin(list(roots)))


def filter_service(df: DataFrame, site: str, folder: str | None, name: str, service_type: str) -> DataFrame:
    """One service; a NULL folder matches only services without a folder."""
    return df.where(
        (F.col("site") == site)
        & F.col("folder").eqNullSafe(F.lit(folder))
        & (F.col("service_name") == name)
        & (F.col("service_type") == service_type)
    )


def filter_portal_item(df: DataFrame, item_id: str) -> DataFrame:
    return df.where(F.col("portal_item_id") == item_id)


def filter_device(df: DataFrame, device_id: str) -> DataFrame:
    return df.where(F.col("device_id") == device_id)


def filter_referer_present(df: DataFrame) -> DataFrame:
    return df.where(F.col("referer") != "-")


def _in_range(start: date, end: date) -> Column:
    return F.col("local_date").between(F.lit(start), F.lit(end))


def tag_ranges(df: DataFrame, all_start: date, last7_start: date, end: date) -> DataFrame:
    """Adds ``range``: one copy of each row per report range it lies in. One scan serves both
    ranges, and only the last days' rows are doubled."""
    ranges = F.array_compact(
        F.array(
            F.when(_in_range(all_start, end), RANGE_ALL),
            F.when(_in_range(last7_start, end), RANGE_LAST_7),
        )
    )
    return filter_date_range(df, min(all_start, last7_start), end).withColumn("range", F.explode(ranges))
