"""Target local dates, their zone offsets, and the UTC file dates each one needs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def target_dates(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per local date in ``[start, end]``."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("local_date")
    )


def offset_seconds(local_date: Column, time_zone: str) -> Column:
    """Offset from UTC in force at local midnight of ``local_date``, whatever the session zone."""
    midnight = local_date.cast("timestamp_ntz")
    in_utc = F.convert_timezone(F.lit(time_zone), F.lit("UTC"), midnight)
    return (midnight - in_utc).cast("interval second").cast("bigint")


def local_offset(dates: DataFrame, time_zone: str) -> DataFrame:
    """``(local_date, offset_s)``."""
    return dates.select("local_date", offset_seconds(F.col("local_date"), time_zone).alias("offset_s"))


def required_utc_dates(offsets: DataFrame) -> DataFrame:
    """``(local_date, offset_s, utc_date)``: a date west of UTC needs the next UTC day's files
    too, a date east of it the previous day's."""
    d, offset = F.col("local_date"), F.col("offset_s")
    needed = (
        F.when(offset < 0, F.array(d, F.date_add(d, 1)))
        .when(offset > 0, F.array(F.date_sub(d, 1), d))
        .otherwise(F.array(d))
    )
    return offsets.select("local_date", "offset_s", F.explode(needed).alias("utc_date"))


def calendar(spark: SparkSession, start: date, end: date, time_zone: str) -> DataFrame:
    """The files-to-dates map of one run. At most two rows per target date, so always small
    enough to broadcast."""
    return required_utc_dates(local_offset(target_dates(spark, start, end), time_zone))
