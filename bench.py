"""Headline queries on the bench tables; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every result is computed in full
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.spark_queries import REGISTRY, SETTINGS, file_dates, log_directory
from logtally.operators import devices
from logtally.plans.harvest import harvest
from logtally.session import build_session, new_scratch_dir, write_scratch
from logtally.sinks.store import AggregateStore

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
DEVICE_ROWS = 650_000

QUERIES = (
    "access_log",
    "aggregate_by_uri",
    "aggregate_by_user_agent",
    "aggregate_by_referer",
    "aggregate_by_forwarded_for_ip",
    "aggregate_by_referer_and_uri",
    "aggregate_by_service",
    "aggregate_by_portal_item",
    "aggregate_by_field_maps_device",
    "aggregate_all",
    "parse_lines",
    "reject_lines",
    "backfill_usernames",
    "device_range_totals",
    "top_uris",
    "top_services_by_avg_failed_time",
    "mart_root_evolution",
    "mart_service_leaderboards",
    "mart_service_detail",
    "mart_device_complete",
    "mart_flat_leaderboards",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def device_rows(spark: SparkSession) -> DataFrame:
    """A device table of about 650,000 rows out of the line items: parts as devices, ship dates as
    days, a username on one row in seven."""
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    times = max(1, -(-DEVICE_ROWS // max(1, items.count())))
    return items.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).select(
        F.md5(F.concat_ws("-", "l_partkey", "copy")).alias("device_id"),
        F.col("l_shipdate").cast("date").alias("local_date"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("user"), F.col("l_suppkey"))).alias("username"),
        F.lit(1).cast("long").alias("hits"),
    ).limit(DEVICE_ROWS)


def timed(action) -> float:
    began = time.monotonic()
    action()
    return round(time.monotonic() - began, 3)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{SF_DIR}/events.parquet"))  # start the executors

    # Inputs derived from the tables are written before the clock starts.
    for name in ("access_log", "parse_lines"):
        run(REGISTRY[name](spark, SF_DIR))
    logs, dates = log_directory(spark, SF_DIR), file_dates(spark, SF_DIR)

    seconds = {name: timed(lambda: run(REGISTRY[name](spark, SF_DIR))) for name in QUERIES}

    table = write_scratch(device_rows(spark), "device_rows")
    run(table)
    seconds["backfill_650k"] = timed(lambda: run(devices.backfill_usernames(table)))

    store = AggregateStore(spark, new_scratch_dir(spark, "store"))
    seconds["harvest_all_dates"] = timed(lambda: harvest(spark, logs, dates[0], dates[-1], store, SETTINGS))

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
