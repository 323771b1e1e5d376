"""All report tables of one year, from the store to parquet and TSV."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import HarvestSettings, ReportSettings, report_boundaries
from ..session import scratch_run
from ..sinks import tsv
from ..sinks.backfill import DeviceIndex
from ..sinks.store import AggregateStore
from . import marts as M
from .harvest import HarvestResult, harvest


def report_tables(
    store: AggregateStore, settings: ReportSettings, now_utc: datetime, year: int
) -> dict[str, DataFrame]:
    """Every report table by name, all read from one committed state of the store. Services, portal items and
    devices are summed once each, for all their tables, into scratch tables."""
    b = report_boundaries(now_utc, settings.local_time_zone, year)
    manifest = store.manifest()

    def table(name: str) -> DataFrame:
        return store.read_table(name, min(b.year_start, b.last7_start), b.today, manifest)

    root, service, item = table(S.BY_ROOT), table(S.BY_SERVICE), table(S.BY_PORTAL_ITEM)
    flat = {
        "forwarded-for-ip": table(S.BY_FORWARDED_FOR_IP),
        "referer": table(S.BY_REFERER),
        "uri": table(S.BY_URI),
        "user-agent": table(S.BY_USER_AGENT),
    }
    tables = {
        "root_evolution": M.mart_root_evolution(root, settings, b),
        "root_complete": M.mart_root_complete(root, settings, b),
        "flat_leaderboards": M.mart_flat_leaderboards(flat, b),
    }
    tables |= M.service_marts(service, settings, b) | M.portal_marts(item, b)
    for prefix, name in (("field_maps", S.BY_FIELD_MAPS_DEVICE), ("survey123", S.BY_SURVEY123_DEVICE)):
        # Usernames are looked up over all dates, in the store's donors.
        names = DeviceIndex(store, manifest, [name]).donors().select("device_id", F.col("username").alias("donor"))
        tables |= M.device_marts(table(name), names, b, prefix)
    return tables


TSV_REPORTS = {
    "root_complete": tsv.ROOT_REPORT,
    "service_complete": tsv.SERVICE_REPORT,
    "portal_complete": tsv.PORTAL_REPORT,
    "field_maps_complete": tsv.DEVICE_REPORT,
    "survey123_complete": tsv.DEVICE_REPORT,
}


def regenerate(
    store: AggregateStore, output: str, settings: ReportSettings, now_utc: datetime, year: int
) -> list[str]:
    """Write ``<output>/<table>`` as parquet, and ``<output>/<table>.tsv`` for the complete views
    that have rows. Gives the names written."""
    written = []
    with scratch_run(store.spark):
        for name, df in report_tables(store, settings, now_utc, year).items():
            path = f"{output.rstrip('/')}/{name}"
            df.write.mode("overwrite").parquet(path)
            written.append(name)
            if name in TSV_REPORTS:
                stored = df.sparkSession.read.schema(df.schema).parquet(path)
                if tsv.export_tsv(stored, f"{path}.tsv", TSV_REPORTS[name]):
                    written.append(f"{name}.tsv")
                else:
                    store.files.delete(f"{path}.tsv")
    return written


def harvest_and_regenerate(
    spark: SparkSession,
    log_dir: str,
    start,
    end,
    store: AggregateStore,
    output: str,
    harvest_settings: HarvestSettings,
    report_settings: ReportSettings,
    now_utc: datetime,
) -> HarvestResult:
    """Harvest, then rebuild the reports of every year it touched, each in ``<output>/<year>``. A
    harvest whose dates are all refused leaves the reports alone."""
    result = harvest(spark, log_dir, start, end, store, harvest_settings)
    for year in sorted({d.year for d in [*result.replaced, *result.backfilled]}):
        regenerate(store, f"{output.rstrip('/')}/{year}", report_settings, now_utc, year)
    return result
