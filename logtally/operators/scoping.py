"""Which requests belong to which target local date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_ts(utc_ts: Column, offset_s: Column) -> Column:
    return utc_ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset_s)


def assign_local_date(
    requests: DataFrame, calendar: DataFrame, exact_zone: str | None = None, count_lines: bool = False
) -> DataFrame:
    """Adds ``local_date`` and ``local_ts`` and keeps the requests that fall on a target date.

    A request is seen for a date only if its *file* is among that date's files, hence the equi
    join on the file's date (broadcast: two calendar rows per target date). By default each
    target date has one fixed offset, so around a change of clocks an hour may count for two
    dates or for none. ``exact_zone`` names a zone to convert each instant exactly instead.

    ``count_lines`` adds ``counted``, which is true in just one row of every line, rejected or not
    and on whatever date; lines on no target date then come without one.
    """
    by_file = calendar.withColumnRenamed("utc_date", "file_utc_date")
    if count_lines:
        first = F.min("local_date").over(W.partitionBy("file_utc_date")) == F.col("local_date")
        by_file = by_file.withColumn("counted", first)
    joined = requests.join(F.broadcast(by_file), "file_utc_date")
    if exact_zone:
        local = F.convert_timezone(F.lit("UTC"), F.lit(exact_zone), F.col("utc_ts"))
    else:
        local = local_ts(F.col("utc_ts"), F.col("offset_s"))
    dated = joined.withColumn("local_ts", local)
    on_date = F.to_date("local_ts") == F.col("local_date")
    if not count_lines:
        return dated.where(on_date).drop("offset_s")
    taken = F.col("reason").isNull() & on_date
    return (
        dated.where(taken | F.col("counted"))
        .withColumn("local_date", F.when(taken, F.col("local_date")))
        .drop("offset_s")
    )
