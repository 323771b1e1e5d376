"""Who uses a device: the donor of a username, back-fill, and attribution counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEVICE = ("device_id",)


def donors(table: DataFrame, device: Sequence[str] = DEVICE) -> DataFrame:
    """``(*device, donor)``: per device the username of its earliest attributed date,
    alphabetically first among several on that date. ``device`` names what tells devices apart.

    A minimum over ``(local_date, username)`` instead of a ranked window: it combines before the
    shuffle and holds one row per device, never a device's whole history.
    """
    return (
        table.where(F.col("username").isNotNull())
        .groupBy(*device)
        .agg(F.min(F.struct("local_date", "username"))["username"].alias("donor"))
    )


def fill_usernames(table: DataFrame, known: DataFrame, device: Sequence[str] = DEVICE) -> DataFrame:
    """``table`` with missing usernames taken from ``known`` donors."""
    return (
        table.join(known, list(device), "left")
        .withColumn("username", F.coalesce("username", "donor"))
        .select(*table.columns)
    )


def backfill_usernames(table: DataFrame) -> DataFrame:
    """The device table with every missing username taken from its donor, on any date; known
    usernames are never changed."""
    return fill_usernames(table, donors(table))


def backfilled_dates(table: DataFrame) -> DataFrame:
    """``(local_date)`` of the partitions a back-fill would change."""
    return (
        table.where(F.col("username").isNull())
        .join(donors(table), "device_id", "left_semi")
        .select("local_date")
        .distinct()
    )


def resolve_username(devices: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``username`` to rows keyed by ``device_id``, looked up over the whole table whatever
    dates the rows cover."""
    return devices.join(donors(table).withColumnRenamed("donor", "username"), "device_id", "left")


def attribution_counts(aggregated: DataFrame, persisted: DataFrame, per: Sequence[str] = ("local_date",)) -> DataFrame:
    """Per date: device rows with a same-day login, back-filled from another date, still
    without a user, and all. ``aggregated`` is the table before, ``persisted`` after back-fill."""
    same_day = aggregated.groupBy(*per).agg(
        F.count(F.lit(1)).alias("devices_seen"), F.count_if(F.col("username").isNotNull()).alias("same_day")
    )
    unattributed = persisted.groupBy(*per).agg(F.count_if(F.col("username").isNull()).alias("unattributed"))
    return same_day.join(unattributed, list(per)).select(
        *per,
        "devices_seen",
        "same_day",
        (F.col("devices_seen") - F.col("same_day") - F.col("unattributed")).alias("backfilled"),
        "unattributed",
    )
