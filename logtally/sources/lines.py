"""Log lines with a position that orders them exactly within their file.

A file is read as independent splits, so its size is no limit: ``block_start`` is the byte at
which a line's split begins and ``line_id`` grows along the split. ``(block_start, line_id)``
therefore orders the lines of a file, and ``(file, block_start)`` names a set of lines that is
never larger than one input split, however uneven the files are.
"""

from __future__ import annotations

import contextlib
from collections.abc import Collection, Iterable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import name_filter, url_decoded


_SPLIT_COUNT = "spark.sql.files.minPartitionNum"


@contextlib.contextmanager
def fixed_splits(spark: SparkSession) -> Iterator[None]:
    """While open, files are cut alike in every scan, whatever cores come and go.

    Spark sizes the splits of small inputs by the cores present when a scan is planned; here that
    number is taken once. Without it positions of one pass would not be those of the next.
    """
    before = spark.conf.get(_SPLIT_COUNT, None)
    if before is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        spark.conf.set(_SPLIT_COUNT, cores or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SPLIT_COUNT)


def unreadable_file(e: Exception) -> tuple[str, str] | None:
    """Name of the file that could not be read, as in a URL, and why, if that is what ``e`` is about."""
    thrown = getattr(e, "java_exception", None) or getattr(e, "_origin", None)
    while thrown is not None:
        # Only Spark's own exceptions have a condition.
        if thrown.getClass().getName().startswith("org.apache.spark.") and hasattr(thrown, "getCondition"):
            if (thrown.getCondition() or "").startswith("FAILED_READ_FILE"):
                path = thrown.getMessageParameters().get("path")
                cause = thrown.getCause() or thrown
                return path.rsplit("/", 1)[1], str(cause.getMessage() or cause.getClass().getName()).splitlines()[0][:500]
        thrown = thrown.getCause()
    return None


def read_log_lines(spark: SparkSession, directory: str, utc_dates: Iterable[date], without: Collection[str] = ()) -> DataFrame:
    """``(file, block_start, line_id, line)`` of the needed files, but those named in ``without`` (as in URLs),
    which are not even opened.

    ``\\r\\n``, ``\\r`` and ``\\n`` end a line; a byte-order mark is dropped. An unreadable file
    fails the job. Use the one returned frame for every pass over the text, inside one
    ``fixed_splits``: the file listing is fixed when the frame is made and files are then cut
    alike, so positions agree between passes.
    """
    text = spark.read.option("pathGlobFilter", name_filter(utc_dates)).text(directory)
    if without:
        text = text.where(~F.col("_metadata.file_name").isin(sorted(without)))
    name = F.col("_metadata.file_name")
    return text.select(
        F.when(name.contains("%"), url_decoded(name)).otherwise(name).alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )
