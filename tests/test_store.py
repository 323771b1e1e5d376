"""The store's index of donors and unnamed devices, and the stream that ends in the store."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from logtally import schemas as S
from logtally.sinks.store import AggregateStore, replace_daily_batch
from logtally.streaming import daily

FIELD, SURVEY = S.DEVICE_TABLES
DAY = [date(2024, 3, 1) + timedelta(days=i) for i in range(9)]


def rows(spark, name, values):
    """values: (device, username, date)"""
    df = spark.createDataFrame([(d, u, 1, 5, at) for d, u, at in values], "device_id string, username string, hits long, time_taken_ms long, local_date date")
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in S.STORED_COLUMNS.items()],
        F.lit(name).alias("table_name"),
        "local_date",
    )


def replaced(held, new, dates):
    """The plain rule: all rows, the earliest name of a device fills its missing ones."""
    held = {k: v for k, v in held.items() if k[1] not in dates} | {(d, at): u for d, u, at in new}
    donors = {}
    for (d, at), u in sorted(held.items(), key=lambda x: x[0][1]):
        if u is not None:
            donors.setdefault(d, u)
    return {k: u if u is not None else donors.get(k[0]) for k, u in held.items()}


def stored(store, name):
    return {(r.device_id, r.local_date): r.username for r in store.read_table(name).collect()}


def test_index_follows_any_replacement(spark, tmp_path):
    rng = random.Random(4)
    store, want = AggregateStore(spark, str(tmp_path / "s")), {FIELD: {}, SURVEY: {}}
    for step in range(7):
        dates = rng.sample(DAY, rng.choice([1, 1, 2, 3]))
        names = rng.choice([[FIELD], [FIELD, SURVEY]])
        batch = {}
        for name in names:
            new = [(d, rng.choice([None, None, "ann", "bob"]), at) for at in dates for d in "abcde" if rng.random() < 0.6]
            want[name] = replaced(want[name], new, dates)
            batch[name] = rows(spark, name, new)
        if step == 5:
            store.delete_by_local_date(FIELD, dates[0])
            want[FIELD] = replaced(want[FIELD], [], dates[:1])
        else:
            replace_daily_batch(store, batch, dates)
        if step == 5:
            want[SURVEY] = stored(store, SURVEY)
        for name in (FIELD, SURVEY):
            got = stored(store, name)
            assert got == want[name], (step, name)
            donors = {r.device_id: (r.local_date, r.username) for r in store.read_stored(S.DONORS[name]).collect()}
            unnamed = {(r.device_id, r.local_date) for r in store.read_stored(S.UNNAMED[name]).collect()}
            assert unnamed == {k for k, u in got.items() if u is None}
            first = {}
            for (d, at), u in sorted(got.items(), key=lambda x: x[0][1]):
                if u is not None:
                    first.setdefault(d, (at, u))
            assert donors == first


def test_new_date_reads_no_history(spark, tmp_path, monkeypatch):
    store = AggregateStore(spark, str(tmp_path / "s"))
    for at in DAY[:6]:
        replace_daily_batch(store, {FIELD: rows(spark, FIELD, [("x", None, at), ("y", "yan" if at == DAY[2] else None, at), ("z", None, at)])}, [at])
    read = []
    inner = AggregateStore._read
    monkeypatch.setattr(AggregateStore, "_read", lambda self, name, held: (read.append((name, sorted(held))), inner(self, name, held))[1])
    replace_daily_batch(store, {FIELD: rows(spark, FIELD, [("x", None, DAY[6]), ("w", "wes", DAY[6])])}, [DAY[6]])
    assert {name for name, held in read if held} <= {S.DONORS[FIELD], S.UNNAMED[FIELD]}
    # The latest date once more: no date after it, so no history either.
    read.clear()
    replace_daily_batch(store, {FIELD: rows(spark, FIELD, [("x", None, DAY[6]), ("w", None, DAY[6])])}, [DAY[6]])
    assert FIELD not in {name for name, held in read if held}
    # A name for a device seen on every date rewrites those dates, and no others are read.
    read.clear()
    replace_daily_batch(store, {FIELD: rows(spark, FIELD, [("x", "xia", DAY[8])])}, [DAY[8]])
    assert [held for name, held in read if name == FIELD and held] == [[d.isoformat() for d in DAY[:7]]]
    monkeypatch.undo()
    got = stored(store, FIELD)
    assert {got[("x", d)] for d in [*DAY[:7], DAY[8]]} == {"xia"} and got[("z", DAY[0])] is None and got[("y", DAY[0])] == "yan"


def test_store_without_index_gets_one(spark, tmp_path):
    store = AggregateStore(spark, str(tmp_path / "s"))
    batch = store.new_batch()
    store.write(rows(spark, FIELD, [("x", None, DAY[0]), ("y", "yan", DAY[0]), ("y", "yan", DAY[1])]), batch)
    store.commit(store.manifest(), batch, {FIELD: DAY[:2]})
    replace_daily_batch(store, {FIELD: rows(spark, FIELD, [("x", "xia", DAY[2]), ("y", None, DAY[2])])}, [DAY[2]])
    assert stored(store, FIELD) == {("x", DAY[0]): "xia", ("y", DAY[0]): "yan", ("y", DAY[1]): "yan", ("x", DAY[2]): "xia", ("y", DAY[2]): "yan"}
    assert {(r.device_id, r.local_date) for r in store.read_stored(S.DONORS[FIELD]).collect()} == {("x", DAY[0]), ("y", DAY[0])}


# --- stream ---------------------------------------------------------------------------------------


def requests(spark, *values):
    """values: (day of March, hour, uri, ms)"""
    made = [(datetime(2024, 3, d, h), uri, ms) for d, h, uri, ms in values]
    return spark.createDataFrame(made, "utc_ts timestamp_ntz, uri_stem string, time_taken_ms int")


def totals(spark, path):
    return {(r.local_date.day, r.root): (r.hits, r.time_taken_second) for r in daily.read_daily_totals(spark, path).collect()}


def test_days_close_and_late_requests_are_counted(spark, tmp_path):
    path = str(tmp_path / "s")
    store = AggregateStore(spark, path)
    merge = lambda epoch, *values: daily.merge_batch(store, requests(spark, *values), epoch, "UTC")
    merge(0, (1, 5, "/a/x", 10), (2, 5, "/a/x", 10))
    merge(1, (1, 6, "/a/y", 10), (3, 5, "/b", 10))
    assert totals(spark, path) == {(1, "a"): (2, 0.02), (2, "a"): (1, 0.01), (3, "b"): (1, 0.01)}
    assert set(store.manifest().dates(daily.CLOSED)) == {"2024-03-01"}
    before = store.manifest()
    assert merge(1, (9, 5, "/again", 10)).version == before.version
    merge(2, (1, 23, "/a/late", 10), (2, 9, "/a", 10))
    assert totals(spark, path)[(1, "a")] == (2, 0.02) and totals(spark, path)[(2, "a")] == (2, 0.02)
    assert daily.late_requests(spark, path) == 1
    # The open table of the state before is still there for its readers.
    assert store.read_stored(daily.OPEN, manifest=before).count() == 2
    merge(3)
    assert len(totals(spark, path)) == 3


def test_folders_do_not_grow_with_micro_batches(spark, tmp_path):
    schema = requests(spark, (1, 0, "/a", 1)).schema
    source, path = str(tmp_path / "in"), str(tmp_path / "s")
    (tmp_path / "in").mkdir()
    for i in range(50):
        requests(spark, (1 + i // 17, i % 17, "/a", 1)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    daily.stream_daily_totals(stream, path, str(tmp_path / "check"), "UTC").awaitTermination()
    assert {k: v[0] for k, v in totals(spark, path).items()} == {(1, "a"): 17, (2, "a"): 17, (3, "a"): 16}
    store = AggregateStore(spark, path)
    assert store.manifest().streams[daily.CLOSED]["epoch"] == 49
    held = [p for p in (tmp_path / "s" / "data").rglob("local_date=*")]
    # Each closed date once, and the open dates of two states.
    assert len(held) <= 3 + 2 * 2
    assert len(list((tmp_path / "s" / "data").glob("batch=*"))) <= 3 + 2
    assert len(list((tmp_path / "s" / "manifest").glob("*.json"))) <= daily.KEPT_MANIFESTS
