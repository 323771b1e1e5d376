"""Report queries over the daily aggregate tables.

Every query takes a table and an inclusive date range. Where a report walks over entities (one
query per service, item or device), the ``*_all`` form answers for all of them in one grouping.
Results carry no order of their own unless the function says so.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.devices import resolve_username
from ..schemas import BY_SERVICE, KEYS

SERVICE = KEYS[BY_SERVICE]
HIT_COUNTS = ("hits", "successful_hits", "failed_hits")
TIME_COUNTS = ("successful_time_taken_second", "successful_hits", "failed_time_taken_second", "failed_hits")


def _ms(column: str) -> F.Column:
    """Whole milliseconds of a seconds column, so that sums do not depend on their order."""
    return F.round(F.col(column) * 1000).cast("long")


def sum_seconds(*columns: str) -> F.Column:
    total = _ms(columns[0])
    for c in columns[1:]:
        total = total + _ms(c)
    return F.sum(total).cast("double") / F.lit(1000.0)


def _sums(*columns: str) -> list[F.Column]:
    return [(sum_seconds(c) if c.endswith("_second") else F.sum(c)).alias(c) for c in columns]


def root_daily_totals(table: DataFrame, start: date, end: date, roots: Sequence[str]) -> DataFrame:
    """Ordered by date and root."""
    rows = filters.filter_included_roots(filters.filter_date_range(table, start, end), roots)
    return rows.groupBy("local_date", "root").agg(F.sum("hits").alias("hits")).orderBy("local_date", "root")


def root_range_totals(table: DataFrame, start: date, end: date, roots: Sequence[str]) -> DataFrame:
    rows = filters.filter_included_roots(filters.filter_date_range(table, start, end), roots)
    return rows.groupBy("root").agg(
        F.sum("hits").alias("hits"), sum_seconds("time_taken_second").alias("total_time_taken_second")
    )


def service_daily_hits(table: DataFrame, start: date, end: date, site: str) -> DataFrame:
    rows = filters.filter_site(filters.filter_date_range(table, start, end), site)
    return rows.groupBy("local_date").agg(*_sums(*HIT_COUNTS)).orderBy("local_date")


def service_daily_average_time(table: DataFrame, start: date, end: date, site: str) -> DataFrame:
    """Totals per date; the caller divides."""
    rows = filters.filter_site(filters.filter_date_range(table, start, end), site)
    return rows.groupBy("local_date").agg(*_sums(*TIME_COUNTS)).orderBy("local_date")


def service_detail_daily_hits(
    table: DataFrame, start: date, end: date, site: str, folder: str | None, name: str, service_type: str
) -> DataFrame:
    rows = filters.filter_service(filters.filter_date_range(table, start, end), site, folder, name, service_type)
    return rows.groupBy("local_date").agg(*_sums(*HIT_COUNTS)).orderBy("local_date")


def service_detail_daily_average_time(
    table: DataFrame, start: date, end: date, site: str, folder: str | None, name: str, service_type: str
) -> DataFrame:
    rows = filters.filter_service(filters.filter_date_range(table, start, end), site, folder, name, service_type)
    return rows.groupBy("local_date").agg(*_sums(*TIME_COUNTS)).orderBy("local_date")


def service_detail_daily_hits_all(table: DataFrame, start: date, end: date) -> DataFrame:
    return (
        filters.filter_date_range(table, start, end).groupBy(*SERVICE, "local_date").agg(*_sums(*HIT_COUNTS))
    )


def service_detail_daily_average_time_all(table: DataFrame, start: date, end: date) -> DataFrame:
    return (
        filters.filter_date_range(table, start, end).groupBy(*SERVICE, "local_date").agg(*_sums(*TIME_COUNTS))
    )


def service_range_totals(table: DataFrame, start: date, end: date, roots: Sequence[str]) -> DataFrame:
    """Ordered by service, those without a folder first."""
    rows = filters.filter_included_roots(filters.filter_date_range(table, start, end), roots, "site")
    return (
        rows.groupBy(*SERVICE)
        .agg(
            *_sums(*HIT_COUNTS),
            sum_seconds("successful_time_taken_second", "failed_time_taken_second").alias("total_time_taken_second"),
        )
        .orderBy("site", F.col("folder").asc_nulls_first(), "service_name", "service_type")
    )


def portal_daily_hits(table: DataFrame, start: date, end: date) -> DataFrame:
    rows = filters.filter_date_range(table, start, end)
    return rows.groupBy("local_date").agg(*_sums(*HIT_COUNTS)).orderBy("local_date")


def portal_item_daily_hits(table: DataFrame, start: date, end: date, item_id: str) -> DataFrame:
    rows = filters.filter_portal_item(filters.filter_date_range(table, start, end), item_id)
    return rows.groupBy("local_date").agg(*_sums(*HIT_COUNTS)).orderBy("local_date")


def portal_item_daily_hits_all(table: DataFrame, start: date, end: date) -> DataFrame:
    rows = filters.filter_date_range(table, start, end)
    return rows.groupBy("portal_item_id", "local_date").agg(*_sums(*HIT_COUNTS))


def portal_item_range_totals(table: DataFrame, start: date, end: date) -> DataFrame:
    """Ordered by item."""
    return (
        filters.filter_date_range(table, start, end)
        .groupBy("portal_item_id")
        .agg(*_sums(*HIT_COUNTS), sum_seconds("time_taken_second").alias("total_time_taken_second"))
        .orderBy("portal_item_id")
    )


def device_daily_hits(table: DataFrame, start: date, end: date, device_id: str) -> DataFrame:
    rows = filters.filter_device(filters.filter_date_range(table, start, end), device_id)
    return rows.groupBy("local_date").agg(F.sum("hits").alias("hits")).orderBy("local_date")


def device_daily_hits_all(table: DataFrame, start: date, end: date) -> DataFrame:
    rows = filters.filter_date_range(table, start, end)
    return rows.groupBy("device_id", "local_date").agg(F.sum("hits").alias("hits"))


def device_range_totals(table: DataFrame, start: date, end: date) -> DataFrame:
    """Per device seen in the range; its username is looked up over the whole table."""
    totals = (
        filters.filter_date_range(table, start, end)
        .groupBy("device_id")
        .agg(
            F.sum("hits").alias("hits"),
            sum_seconds("time_taken_second").alias("total_time_taken_second"),
            F.max("local_date").alias("last_seen"),
        )
    )
    return resolve_username(totals, table).select(
        "device_id", "username", "hits", "total_time_taken_second", "last_seen"
    )
