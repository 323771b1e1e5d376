"""Log files to stored aggregates, for any number of local dates in one job.

Two passes over the text. The first condenses each input split to one row; from it come the
skipped files, the field layouts in force and the line counts. The second parses every line once
and computes all tables in one aggregation, so only aggregated rows are shuffled. Lines are counted
in both passes; a date whose files don't come out alike is refused.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import HarvestSettings
from ..operators import aggregates as A
from ..operators import devices as D
from ..operators import headers as H
from ..operators.parsing import parse_lines, reject_lines
from ..operators.scoping import assign_local_date
from ..session import scratch_run, write_scratch
from ..sinks.backfill import backfill
from ..sinks.store import AggregateStore, Manifest, as_stored
from ..sources.calendar import calendar
from ..sources.discovery import discover_files
from ..sources.lines import fixed_splits, read_log_lines, unreadable_file


@dataclass
class HarvestResult:
    """What happened, per local date. All lists hold at most a few rows per date.

    ``unreadable`` has the UTC dates with a file that can't be read, and why. ``backfilled`` are older
    dates whose device rows got a username."""

    status: list[Row] = field(default_factory=list)
    summary: list[Row] = field(default_factory=list)
    attribution: dict[str, list[Row]] = field(default_factory=dict)
    unreadable: dict[date, str] = field(default_factory=dict)
    lost: list[date] = field(default_factory=list)
    backfilled: set[date] = field(default_factory=set)
    manifest: Manifest | None = None
    elapsed_second: float = 0.0

    @property
    def replaced(self) -> list[date]:
        return [r.local_date for r in self.status if r.complete and r.local_date not in self.lost]

    @property
    def refused(self) -> list[date]:
        return [r.local_date for r in self.status if not r.complete or r.local_date in self.lost]


def date_status(cal: DataFrame, files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per target date: its files, the skipped ones, the UTC dates without files, and whether the
    date may be replaced. One skipped file or one missing day refuses it."""
    needed = cal.join(
        files.groupBy("file_utc_date").agg(F.count(F.lit(1)).alias("n_files")),
        F.col("utc_date") == F.col("file_utc_date"),
        "left",
    ).drop("file_utc_date")
    bad = skipped.groupBy("file_utc_date").agg(F.count(F.lit(1)).alias("n_skipped"))
    return (
        needed.join(bad, F.col("utc_date") == F.col("file_utc_date"), "left")
        .groupBy("local_date")
        .agg(
            F.coalesce(F.sum("n_files"), F.lit(0)).alias("files"),
            F.coalesce(F.sum("n_skipped"), F.lit(0)).alias("skipped_files"),
            F.array_sort(F.collect_list(F.when(F.col("n_files").isNull(), F.col("utc_date")))).alias("missing_utc_dates"),
        )
        .withColumn("complete", (F.col("skipped_files") == 0) & (F.size("missing_utc_dates") == 0))
    )


@dataclass
class Text:
    """The log text of one run, with what the first pass found out about it."""

    lines: DataFrame
    files: DataFrame
    splits: DataFrame
    skipped: DataFrame
    layouts: DataFrame

    def parsed(self) -> DataFrame:
        return parse_lines(H.header_blocks(self.lines, self.layouts))


def index_text(lines: DataFrame, files: DataFrame | None = None) -> Text:
    """First pass. The small results are materialized in the shared folder: the text is not
    scanned again for them, and their real sizes are known to the second pass."""
    splits = write_scratch(H.split_index(lines), "splits")
    skipped = H.skipped_files(splits)
    if files is None:
        files = splits.select("file", "file_utc_date").distinct()
    else:
        without_lines = files.join(splits.select("file").distinct(), "file", "left_anti")
        skipped = skipped.unionByName(
            without_lines.select("file", "file_utc_date", F.lit(H.NO_HEADER_REASON).alias("reason"))
        )
    skipped = write_scratch(skipped, "skipped")
    marked = H.split_layouts(splits).join(skipped.select("file", F.lit(True).alias("left_out")), "file", "left")
    return Text(lines, files, splits, skipped, write_scratch(marked, "layouts"))


UNREADABLE_REASON = "cannot be read: "


def open_logs(spark: SparkSession, log_dir: str, utc_dates: list[date]) -> tuple[Text, dict[str, str]]:
    """Files and lines of the UTC dates, and the files that can't be read, each with its reason. Those are skipped
    files: the others are read without them.

    A scan that fails names the file it failed on, and goes on without it: as many short scans as there are such
    files, and one over the rest."""
    files = write_scratch(discover_files(spark, log_dir, utc_dates), "files")
    # By name as in URLs, which is how Spark tells files apart.
    failed: dict[str, str] = {}
    unreadable: dict[str, str] = {}
    while True:
        readable = files.where(~F.col("file").isin(list(unreadable))) if unreadable else files
        try:
            text = index_text(read_log_lines(spark, log_dir, utc_dates, failed.keys()), readable)
            break
        except Exception as e:
            found = unreadable_file(e)
            if not found or found[0] in failed:
                raise
            failed[found[0]] = found[1]
            unreadable = {unquote(name): why for name, why in failed.items()}
    if unreadable:
        reason = F.coalesce(*[F.when(F.col("file") == name, F.lit(UNREADABLE_REASON + why)) for name, why in unreadable.items()])
        bad = files.where(F.col("file").isin(list(unreadable))).select("file", "file_utc_date", reason.alias("reason"))
        text = replace(text, files=files, skipped=write_scratch(text.skipped.unionByName(bad), "skipped"))
    return text, unreadable


def harvest(
    spark: SparkSession,
    log_dir: str,
    start: date,
    end: date,
    store: AggregateStore,
    settings: HarvestSettings = HarvestSettings(),
    before_commit=None,
    diagnostics: str | None = None,
) -> HarvestResult:
    """Recompute and replace the aggregates of every local date in ``[start, end]`` whose files
    are all present and readable; other dates are left as they are and reported.

    With ``diagnostics``, a folder, skipped files go to ``<diagnostics>/skipped`` and rejected lines of
    all other files to ``<diagnostics>/rejects``, each with its reason; that reads the text once more.
    :func:`diagnose` writes these alone.
    """
    began = time.monotonic()
    with fixed_splits(spark), scratch_run(spark):
        result = _harvest(spark, log_dir, calendar(spark, start, end, settings.local_time_zone), store, settings, before_commit, diagnostics)
    result.elapsed_second = time.monotonic() - began
    return result


def diagnose(
    spark: SparkSession,
    log_dir: str,
    start: date,
    end: date,
    diagnostics: str,
    settings: HarvestSettings = HarvestSettings(),
) -> None:
    """The files that ``harvest`` writes to ``diagnostics`` for these dates, and nothing else: the passes for the
    skipped files and for the rejected lines read all of the text as there, no aggregate is made or stored."""
    with fixed_splits(spark), scratch_run(spark):
        text, _ = open_logs(spark, log_dir, _utc_dates(calendar(spark, start, end, settings.local_time_zone)))
        _write_diagnostics(text, diagnostics)


def _utc_dates(cal: DataFrame) -> list[date]:
    return sorted({r.utc_date for r in cal.select("utc_date").collect()})


def _write_diagnostics(text: Text, folder: str) -> None:
    text.skipped.write.mode("overwrite").parquet(f"{folder}/skipped")
    reject_lines(text.parsed()).write.mode("overwrite").parquet(f"{folder}/rejects")


def _harvest(
    spark: SparkSession,
    log_dir: str,
    cal: DataFrame,
    store: AggregateStore,
    settings: HarvestSettings,
    before_commit,
    diagnostics: str | None,
) -> HarvestResult:
    text, unreadable = open_logs(spark, log_dir, _utc_dates(cal))
    result = HarvestResult(date_status(cal, text.files, text.skipped).orderBy("local_date").collect())
    if unreadable:
        for r in text.skipped.where(F.col("file").isin(list(unreadable))).orderBy("file").collect():
            result.unreadable[r.file_utc_date] = "; ".join(filter(None, [result.unreadable.get(r.file_utc_date), f"{r.file} {r.reason}"]))
    if diagnostics:
        _write_diagnostics(text, diagnostics)
    if not result.replaced:
        return result
    base, batch = store.manifest(), store.new_batch()
    wanted = cal.where(F.col("local_date").isin(result.replaced))
    scoped = assign_local_date(
        text.parsed(), wanted, settings.local_time_zone if settings.exact_zone else None, count_lines=True
    )
    grouped = write_scratch(A.aggregate_all(scoped, settings), "grouped", "table_name")
    by_date = _summary(_line_counts(text, grouped, wanted), wanted).collect()
    result.lost = [r.local_date for r in by_date if r.lost]
    dates = result.replaced
    if not dates:
        return result
    result.summary = [Row(local_date=r.local_date, total=r.total, valid=r.valid, invalid=r.invalid) for r in by_date if not r.lost]
    replaced = {
        name: dates
        for name in S.ALL_TABLES
        if settings.compute_by_referer_and_uri or name != S.BY_REFERER_AND_URI
    }
    on_dates = grouped.where(F.col("local_date").isin(dates))
    flat = [name for name in replaced if name not in S.DEVICE_TABLES]
    store.write(as_stored(on_dates.where(F.col("table_name").isin(flat)), F.col("table_name")), batch)
    logins = on_dates.where(F.col("table_name").isin(list(S.DEVICE_TABLES)))
    new = write_scratch(A.first_login(logins, ("table_name", "local_date", "device_id")), "devices")
    found = backfill(store, base, as_stored(new, F.col("table_name")), list(S.DEVICE_TABLES), dates)
    filled = write_scratch(found.rows, "filled")
    store.write(filled, batch)
    store.write(found.index, batch, index=True)
    replaced |= found.index_dates
    attributed = D.attribution_counts(new, filled.where(F.col("local_date").isin(dates)), ("table_name", "local_date"))
    counts = attributed.orderBy("table_name", "local_date").collect()
    for name in S.DEVICE_TABLES:
        replaced[name] = [*dates, *found.changed[name]]
        result.backfilled |= set(found.changed[name])
        result.attribution[name] = [Row(**{k: v for k, v in r.asDict().items() if k != "table_name"}) for r in counts if r.table_name == name]
    if before_commit:
        before_commit()
    result.manifest = store.commit(base, batch, replaced)
    return result


def _line_counts(text: Text, grouped: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(file, file_utc_date, total, valid, invalid)``: lines the first pass has seen and what the second
    made of them, for the files of the wanted dates."""
    needed = wanted.select(F.col("utc_date").alias("file_utc_date")).distinct()
    totals = text.splits.join(F.broadcast(needed), "file_utc_date").groupBy("file", "file_utc_date").agg(F.sum("data_lines").alias("total"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("table_name") == name, F.col("hits"))), F.lit(0))
    seen = (
        grouped.where(F.col("table_name").isin(A.VALID_LINES, A.INVALID_LINES))
        .groupBy("file")
        .agg(of(A.VALID_LINES).alias("valid"), of(A.INVALID_LINES).alias("invalid"))
    )
    return totals.join(seen, "file", "left").select(
        "file", "file_utc_date", "total", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("valid", "invalid")]
    )


def _summary(counts: DataFrame, cal: DataFrame) -> DataFrame:
    """``(local_date, total, valid, invalid, lost)`` over the lines of each date's files; ``lost`` counts
    those on which the two passes differ, file by file."""
    return (
        counts.join(F.broadcast(cal), F.col("file_utc_date") == F.col("utc_date"))
        .groupBy("local_date")
        .agg(
            *[F.sum(c).alias(c) for c in ("total", "valid", "invalid")],
            F.sum(F.abs(F.col("total") - F.col("valid") - F.col("invalid"))).alias("lost"),
        )
        .orderBy("local_date")
    )
