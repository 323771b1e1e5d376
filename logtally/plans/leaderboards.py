"""Top-k reports.

Ties are broken by key, so a result never depends on how the data is spread. Both report ranges
and, for services, all sites are ranked in one job: a ranked window limited to ``k`` prunes each
task's rows to ``k`` per group before anything moves, so a group of any size costs the final task
only ``k`` rows per upstream task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters
from ..schemas import BY_SERVICE, KEYS
from .queries import sum_seconds

# Sizes of the reports.
FLAT_SIZE = 500
BAR_SIZE = 50

SERVICE_IN_SITE = KEYS[BY_SERVICE][1:]


def _asc(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


#: Parts in which large groups are ranked first.
TOP_BUCKETS = 32


def top_k(df: DataFrame, groups: Sequence[str], measure: str, keys: Sequence[str], k: int, buckets: int = 1) -> DataFrame:
    """Adds ``rank`` and keeps the ``k`` largest per group. With ``buckets`` a group is ranked in so many parts
    first, so that its last task gets ``buckets`` * ``k`` rows however many tasks there were before."""
    largest = [F.col(measure).desc(), *_asc(keys)]
    if buckets > 1:
        dealt = df.withColumn("top_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        inside = F.row_number().over(W.partitionBy(*groups, "top_bucket").orderBy(*largest))
        df = dealt.withColumn("top_rank", inside).where(F.col("top_rank") <= k).drop("top_bucket", "top_rank")
    order = W.partitionBy(*groups).orderBy(*largest)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _flat(table: DataFrame, key: str, start: date, end: date) -> DataFrame:
    """Largest by hits over one range; sorted top-k without a full sort."""
    return (
        filters.filter_date_range(table, start, end)
        .groupBy(F.col(key).alias("value"))
        .agg(F.sum("hits").alias("hits"), sum_seconds("time_taken_second").alias("total_time_taken_second"))
        .orderBy(F.col("hits").desc(), "value")
        .limit(FLAT_SIZE)
    )


def top_uris(table: DataFrame, start: date, end: date) -> DataFrame:
    return _flat(table, "uri_stem", start, end)


def top_user_agents(table: DataFrame, start: date, end: date) -> DataFrame:
    return _flat(table, "user_agent", start, end)


def top_referers(table: DataFrame, start: date, end: date) -> DataFrame:
    return _flat(filters.filter_referer_present(table), "referer", start, end)


def top_forwarded_for_ips(table: DataFrame, start: date, end: date) -> DataFrame:
    return _flat(table, "forwarded_for_ip", start, end)


def _services(table: DataFrame, start: date, end: date, outcome: str, by_average: bool) -> DataFrame:
    """All sites; services without a hit of the outcome are out (no average is defined there)."""
    totals = (
        filters.filter_date_range(table, start, end)
        .groupBy("site", *SERVICE_IN_SITE)
        .agg(
            sum_seconds(f"{outcome}_time_taken_second").alias("total_time_taken_second"),
            F.sum(f"{outcome}_hits").alias("hits"),
        )
        .where(F.col("hits") > 0)
    )
    if not by_average:
        return top_k(totals.drop("total_time_taken_second"), ["site"], "hits", SERVICE_IN_SITE, BAR_SIZE)
    rated = totals.withColumn("average", F.col("total_time_taken_second") / F.col("hits"))
    return top_k(rated, ["site"], "average", SERVICE_IN_SITE, BAR_SIZE).drop("average")


def top_services_by_successful_hits(table: DataFrame, start: date, end: date) -> DataFrame:
    return _services(table, start, end, "successful", by_average=False)


def top_services_by_failed_hits(table: DataFrame, start: date, end: date) -> DataFrame:
    return _services(table, start, end, "failed", by_average=False)


def top_services_by_avg_successful_time(table: DataFrame, start: date, end: date) -> DataFrame:
    return _services(table, start, end, "successful", by_average=True)


def top_services_by_avg_failed_time(table: DataFrame, start: date, end: date) -> DataFrame:
    return _services(table, start, end, "failed", by_average=True)


def _portal_items(table: DataFrame, start: date, end: date, outcome: str) -> DataFrame:
    return (
        filters.filter_date_range(table, start, end)
        .groupBy("portal_item_id")
        .agg(F.sum(f"{outcome}_hits").alias("hits"))
        .where(F.col("hits") > 0)
        .orderBy(F.col("hits").desc(), "portal_item_id")
        .limit(BAR_SIZE)
    )


def top_portal_items_by_successful_hits(table: DataFrame, start: date, end: date) -> DataFrame:
    return _portal_items(table, start, end, "successful")


def top_portal_items_by_failed_hits(table: DataFrame, start: date, end: date) -> DataFrame:
    return _portal_items(table, start, end, "failed")


def name_top_devices(top: DataFrame, table: DataFrame) -> DataFrame:
    """Usernames of an already limited device list, all of whose devices are in ``table``. The list is
    at most ``BAR_SIZE`` per range, so it is broadcast to the table, once; the donor of each of its rows
    (as in ``devices.donors``) is then a minimum over few rows."""
    donor = F.min(F.when(F.col("username").isNotNull(), F.struct("local_date", "username")))["username"]
    rows = table.select("device_id", "local_date", "username").join(F.broadcast(top), "device_id")
    return rows.groupBy(*top.columns).agg(donor.alias("username"))


def top_devices(table: DataFrame, start: date, end: date) -> DataFrame:
    """Limited first, named afterwards."""
    top = (
        filters.filter_date_range(table, start, end)
        .groupBy("device_id")
        .agg(F.sum("hits").alias("hits"))
        .orderBy(F.col("hits").desc(), "device_id")
        .limit(BAR_SIZE)
    )
    return name_top_devices(top, table).select("device_id", "username", "hits")
