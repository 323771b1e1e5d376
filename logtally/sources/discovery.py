"""Which log files exist for which UTC date, and which target dates have all they need."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: file names are u_ex<yyMMdd><anything>.log
FILE_NAME = r"\Au_ex(\d{6}).*\.log\z"


def file_utc_date(file_name: Column) -> Column:
    """Date in the file name, NULL when the name is not a log file's or the date does not exist."""
    digits = F.regexp_extract(file_name, FILE_NAME, 1)
    return F.when(digits != "", F.to_date(F.try_to_timestamp(F.concat(F.lit("20"), digits), F.lit("yyyyMMdd"))))


def name_filter(utc_dates: Iterable[date]) -> str:
    """Glob for the files of the given UTC dates, applied while listing."""
    return "u_ex{" + ",".join(sorted({d.strftime("%y%m%d") for d in utc_dates})) + "}*.log"


def url_decoded(name: Column) -> Column:
    """A path as it is, from its form in a URL."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _listing(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """``(path)`` of the matching files in the top folder, empty ones included, which any scan would
    leave out. The names that Spark's own file index holds become a table where they are, in the JVM."""
    found = spark.read.option("pathGlobFilter", pattern).text(directory)._jdf.inputFiles()
    names = Column(spark._jvm.org.apache.spark.sql.functions.lit(found))
    encoded = spark.range(1).select(F.explode(names).alias("value"))
    return encoded.select(url_decoded(F.col("value")).alias("path"))


def discover_files(spark: SparkSession, directory: str, utc_dates: Iterable[date]) -> DataFrame:
    """``(path, file, file_utc_date)`` of the needed files in the top folder. Contents are not
    read."""
    return (
        _listing(spark, directory, name_filter(utc_dates))
        .withColumn("file", F.substring_index("path", "/", -1))
        .withColumn("file_utc_date", file_utc_date(F.col("file")))
        .where(F.col("file_utc_date").isNotNull())
    )


def missing_utc_dates(calendar: DataFrame, files: DataFrame) -> DataFrame:
    """``(local_date, utc_date)`` pairs that no file covers; such a local date is refused."""
    present = files.select(F.col("file_utc_date").alias("utc_date")).distinct()
    return calendar.join(present, "utc_date", "left_anti").select("local_date", "utc_date")
