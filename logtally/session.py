"""Session defaults and the shared scratch area for intermediate tables."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "logtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; callers may override any of them."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Lets a small result still use every core; without effect once partitions are large.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    Taken from the session. A private temporary folder is used only in local mode, where driver
    and executors are one process on one machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR)
    if not configured and sc._jsc.sc().getCheckpointDir().isDefined():
        configured = sc._jsc.sc().getCheckpointDir().get()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    return _local_scratch()


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


_run_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("run_folder", default=None)


@contextlib.contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """While open, scratch tables go to one folder, which is deleted at the end."""
    folder = new_scratch_dir(spark, "run")
    token = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def new_scratch_dir(spark: SparkSession, label: str) -> str:
    return f"{_run_folder.get() or scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Materialize ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage: lost executors cost a re-read, not a recomputation from raw text. The
    result also carries real file sizes, so the optimizer's own broadcast limit applies to it.
    """
    spark = df.sparkSession
    path = new_scratch_dir(spark, label)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
