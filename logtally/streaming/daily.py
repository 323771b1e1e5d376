"""Daily totals per root over a stream of requests, kept in the aggregate store.

Each micro-batch is summed and merged in one commit of the store: days that the watermark has passed
are closed and become dates of ``stream_daily_totals``; the open ones are kept in one table that each
commit replaces. The manifest names the last epoch merged, so one that Spark repeats after a failure
changes nothing: every request counts once. What the stream has to remember between micro-batches is
the open days alone, in the store; a new checkpoint or cluster does not lose it.

A running view between batch harvests; a harvest stays the way to rebuild a day. A growing log
file is not re-read by a file stream, so the input is whatever delivers whole requests.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.measures import ms_to_seconds
from ..functions.text import normalize_root
from ..session import scratch_run, write_scratch
from ..sinks.store import AggregateStore, Manifest, as_stored

CLOSED, OPEN = "stream_daily_totals", "stream_open_totals"
DELAY = timedelta(days=1)


def batch_totals(requests: DataFrame, time_zone: str) -> DataFrame:
    """``(local_date, root, hits, time_taken_ms, last_clock)`` of some requests. Dates are those of the zone's
    wall clock; the session's own zone plays no part."""
    clock = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), F.col("utc_ts"))
    return (
        requests.select(clock.alias("clock"), normalize_root(F.col("uri_stem")).alias("root"), F.col("time_taken_ms").cast("long").alias("ms"))
        .where(F.col("clock").isNotNull())
        .groupBy(F.to_date("clock").alias("local_date"), "root")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum("ms").alias("time_taken_ms"), F.max("clock").alias("last_clock"))
    )


def merge_batch(store: AggregateStore, requests: DataFrame, epoch: int, time_zone: str, delay: timedelta = DELAY, stream: str = CLOSED) -> Manifest:
    """Add one micro-batch to the totals. A date is closed once the latest clock seen is ``delay`` past its end;
    requests of dates closed by earlier micro-batches are counted as ``late`` and left out. An epoch that is in
    the store already is ignored."""
    base = store.manifest()
    state = base.streams.get(stream, {})
    if epoch <= state.get("epoch", -1):
        return base
    closed_before = date.fromisoformat(state["closed_before"]) if state.get("closed_before") else None
    before = lambda limit: F.col("local_date") < F.lit(limit) if limit else F.lit(False)
    with scratch_run(store.spark):
        seen = write_scratch(batch_totals(requests, time_zone), "stream-batch")
        is_late = before(closed_before)
        figures = seen.agg(F.max("last_clock").alias("clock"), F.sum(F.when(is_late, F.col("hits"))).alias("late")).first()
        clock = max(filter(None, [figures.clock, datetime.fromisoformat(state["clock"]) if state.get("clock") else None]), default=None)
        open_now = store.read_stored(OPEN, manifest=base)
        columns = ("local_date", "root", "hits", "time_taken_ms")
        totals = (
            seen.where(~is_late)
            .select(*columns)
            .unionByName(open_now.select(*columns))
            .groupBy("local_date", "root")
            .agg(F.sum("hits").alias("hits"), F.sum("time_taken_ms").alias("time_taken_ms"))
        )
        after = max(filter(None, [closed_before, (clock - delay).date() if clock else None]), default=None)
        batch = store.new_batch()
        store.write(as_stored(totals, F.when(before(after), F.lit(CLOSED)).otherwise(F.lit(OPEN))), batch)
        written = {name: {date.fromisoformat(d) for d in store.dates_in_batch(batch, name)} for name in (CLOSED, OPEN)}
        replaced = {CLOSED: written[CLOSED], OPEN: written[OPEN] | {date.fromisoformat(d) for d in base.dates(OPEN)}}
        new_state = {
            "epoch": epoch,
            "clock": clock.isoformat() if clock else None,
            "closed_before": after.isoformat() if after else None,
            "late": state.get("late", 0) + (figures.late or 0),
            "open_batches": [*state.get("open_batches", [])[-1:], batch],
        }
        done = store.commit(base, batch, replaced, {stream: new_state})
    # Readers of the state before this one keep theirs; what is older goes.
    for old in state.get("open_batches", [])[:-1]:
        store.files.delete(store.table_path(old, OPEN))
        if not store.files.glob(f"{store.root}/data/batch={old}/table_name=*"):
            store.files.delete(f"{store.root}/data/batch={old}")
    return done


#: Manifests that a stream leaves behind it.
KEPT_MANIFESTS = 20


def stream_daily_totals(
    requests: DataFrame, path: str, checkpoint: str, time_zone: str, delay: timedelta = DELAY, stream: str = CLOSED
) -> StreamingQuery:
    """Run over what has arrived and keep the totals in the store at ``path`` up to date. ``stream`` names the
    input: epochs of one name must come from one checkpoint."""
    store = AggregateStore(requests.sparkSession, path)

    def merge(batch: DataFrame, epoch: int) -> None:
        merge_batch(store, batch, epoch, time_zone, delay, stream)
        store.remove_manifests(KEPT_MANIFESTS)

    return requests.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of each date and root, closed and open."""
    store = AggregateStore(spark, path)
    manifest = store.manifest()
    both = store.read_stored(CLOSED, manifest=manifest).unionByName(store.read_stored(OPEN, manifest=manifest))
    return both.select("local_date", "root", ms_to_seconds(F.col("time_taken_ms")).alias("time_taken_second"), "hits")


def late_requests(spark: SparkSession, path: str, stream: str = CLOSED) -> int:
    """Requests left out because their date was closed."""
    return AggregateStore(spark, path).manifest().streams.get(stream, {}).get("late", 0)
