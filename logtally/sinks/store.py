"""The aggregate store: ten tables replaced together, date by date.

Data files are parquet under ``data/batch=<id>/table_name=<t>/local_date=<d>`` and are never
changed once written. A manifest says which batch holds each table's date; a new manifest is
written aside and renamed to the next version number, and that rename is the commit of all tables
at once. A reader that has taken a manifest keeps seeing exactly its state, a failure before the
rename leaves everything as it was, and a date for which a batch holds no rows simply drops out.

The rename is atomic on HDFS and local disks. On an object store whose rename copies, one writer
at a time must be ensured from outside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.aggregates import as_table
from ..session import scratch_run
from .backfill import backfill
from .files import SharedFiles


@dataclass(frozen=True)
class Manifest:
    """Which batch holds each date of each table, and how far streams that end here have come."""

    version: int
    tables: dict[str, dict[str, str]]
    streams: dict[str, dict] = field(default_factory=dict)

    def dates(self, name: str, start: date | None = None, end: date | None = None) -> dict[str, str]:
        low, high = (start or date.min).isoformat(), (end or date.max).isoformat()
        return {d: b for d, b in self.tables.get(name, {}).items() if low <= d <= high}


class AggregateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = SharedFiles(spark, self.root)

    # --- reading ---------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        """The latest committed state; empty when nothing was ever committed."""
        versions = self.files.glob(f"{self.root}/manifest/*.json")
        if not versions:
            return Manifest(0, {})
        made = json.loads(self.files.read_text(versions[-1]))
        # Manifests without streams once held the tables alone.
        held = made if "tables" not in made else made["tables"]
        return Manifest(int(versions[-1].rsplit("/", 1)[1].split(".")[0]), held, made.get("streams", {}) if held is not made else {})

    def read_stored(
        self, name: str, start: date | None = None, end: date | None = None, manifest: Manifest | None = None
    ) -> DataFrame:
        """Rows of one table in the stored layout. Only the folders of the asked dates are even
        listed; a date filter put on the result later still prunes folders."""
        return self._read(name, (manifest or self.manifest()).dates(name, start, end))

    def read_dates(self, name: str, dates: Iterable[date], manifest: Manifest) -> DataFrame:
        """Rows of one table on the given dates; no other folder is listed."""
        held = manifest.dates(name)
        return self._read(name, {d: held[d] for d in {x.isoformat() for x in dates} & held.keys()})

    def _read(self, name: str, held: dict[str, str]) -> DataFrame:
        schema = S.stored_schema()
        if not held:
            return self.spark.createDataFrame([], schema)
        folders = [self._folder(batch, name, d) for d, batch in sorted(held.items())]
        return (
            self.spark.read.schema(schema)
            .option("basePath", self._area(name))
            .parquet(*folders)
            .select(*schema.fieldNames())
        )

    def read_table(
        self, name: str, start: date | None = None, end: date | None = None, manifest: Manifest | None = None
    ) -> DataFrame:
        """One aggregate table; without rows it still has its declared columns."""
        return as_table(self.read_stored(name, start, end, manifest), name)

    # --- writing ---------------------------------------------------------------------------

    def new_batch(self) -> str:
        return uuid.uuid4().hex

    def write(self, df: DataFrame, batch: str, index: bool = False) -> None:
        """Add rows (``table_name``, ``local_date`` and stored columns) to an uncommitted batch; those of
        ``S.INDEX_TABLES`` go to an area of their own. The rebalance sizes files by bytes: small dates share
        a task, a large one gets several."""
        (
            df.hint("rebalance", F.col("table_name"), F.col("local_date"))
            .write.mode("append")
            .partitionBy("table_name", "local_date")
            .parquet(f"{self.root}/{'index' if index else 'data'}/batch={batch}")
        )

    def _area(self, name: str) -> str:
        return f"{self.root}/{'index' if name in S.INDEX_TABLES else 'data'}"

    def table_path(self, batch: str, name: str) -> str:
        return f"{self._area(name)}/batch={batch}/table_name={name}"

    def _folder(self, batch: str, name: str, d: str) -> str:
        return f"{self.table_path(batch, name)}/local_date={d}"

    def dates_in_batch(self, batch: str, name: str) -> set[str]:
        found = self.files.glob(f"{self.table_path(batch, name)}/local_date=*")
        return {f.rsplit("=", 1)[1] for f in found}

    def commit(
        self, base: Manifest, batch: str, replaced: dict[str, Iterable[date]], streams: dict[str, dict] | None = None
    ) -> Manifest:
        """Publish: for each table the given dates now come from ``batch``, or are empty where the
        batch holds nothing for them. Other dates and tables stay, as do streams but the given. Fails if
        another commit happened since ``base`` was read."""
        tables = {name: dict(held) for name, held in base.tables.items()}
        for name, dates in replaced.items():
            held = tables.setdefault(name, {})
            present = self.dates_in_batch(batch, name)
            for d in (x.isoformat() for x in dates):
                held.pop(d, None)
                if d in present:
                    held[d] = batch
        version = base.version + 1
        aside = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        streams = base.streams | (streams or {})
        self.files.write_text(aside, json.dumps({"tables": tables, "streams": streams}, indent=1, sort_keys=True))
        self.files.publish(aside, f"{self.root}/manifest/{version:012d}.json")
        return Manifest(version, tables, streams)

    def delete_by_local_date(self, name: str, d: date) -> Manifest:
        """Remove one date of one table."""
        if name not in S.DEVICE_TABLES:
            return self.commit(self.manifest(), self.new_batch(), {name: [d]})
        return replace_daily_batch(self, {name: self.spark.createDataFrame([], S.stored_schema())}, [d])

    def remove_unreferenced(self) -> None:
        """Delete batches the latest manifest does not use. Not while older readers are at work."""
        used = {b for held in self.manifest().tables.values() for b in held.values()}
        for area in ("data", "index"):
            for path in self.files.glob(f"{self.root}/{area}/batch=*"):
                if path.rsplit("=", 1)[1] not in used:
                    self.files.delete(path)

    def remove_manifests(self, keep: int) -> None:
        """Delete all but the latest manifests. Readers that hold an older one keep what it names."""
        for path in self.files.glob(f"{self.root}/manifest/*.json")[:-keep]:
            self.files.delete(path)


def as_stored(df: DataFrame, table_name: Column) -> DataFrame:
    """Rows in the stored layout; columns they lack are NULL."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in S.STORED_COLUMNS.items()],
        table_name.alias("table_name"),
        "local_date",
    )


def replace_daily_batch(
    store: AggregateStore, batch: dict[str, DataFrame | None], dates: Iterable[date]
) -> Manifest:
    """Replace the given dates of all tables at once from frames in the stored layout. A table
    mapped to ``None`` is left alone; one with no rows for a date loses that date. Usernames of device
    tables are back-filled over all dates in the same commit."""
    base, batch_id, dates = store.manifest(), store.new_batch(), list(dates)
    given = {name: df.where(F.col("local_date").isin(dates)) for name, df in batch.items() if df is not None}
    replaced = {name: dates for name in given}
    devices = [name for name in given if name in S.DEVICE_TABLES]
    parts = [df for name, df in given.items() if name not in devices]
    with scratch_run(store.spark):
        if devices:
            new = reduce(DataFrame.unionByName, [given[name] for name in devices])
            filled = backfill(store, base, new, devices, dates)
            parts.append(filled.rows)
            store.write(filled.index, batch_id, index=True)
            replaced |= {name: [*dates, *filled.changed[name]] for name in devices} | filled.index_dates
        for rows in parts:
            store.write(rows, batch_id)
    return store.commit(base, batch_id, replaced)
