"""Aggregates, devices, the store and whole harvests, on files written by the tests."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtally import schemas as S
from logtally.config import HarvestSettings, ReportSettings
from logtally.operators import aggregates as A
from logtally.operators import devices as D
from logtally.plans.harvest import diagnose, harvest
from logtally.plans.regenerate import regenerate
from logtally.sinks.store import AggregateStore, replace_daily_batch

HEADER = "#Fields: date time cs-uri-stem cs(User-Agent) cs(Referer) sc-status time-taken X-Forwarded-For"
GUID = "0a1b2c3d-0000-1111-2222-333344445555"
APP = f"ArcGIS-FieldMaps/24+(iOS)+({GUID})"
LOGIN = "/portal/sharing/rest/community/users/"
FIELD = S.BY_FIELD_MAPS_DEVICE
UTC = HarvestSettings("UTC", compute_by_referer_and_uri=True)


def log(tmp_path, day, *requests, name="x", header=HEADER):
    """requests: (time, uri, user agent, status, ms)"""
    folder = tmp_path / "logs"
    folder.mkdir(exist_ok=True)
    lines = [header] + [f"{day} {t} {uri} {ua} - {status} {ms} -" for t, uri, ua, status, ms in requests]
    (folder / f"u_ex{day[2:].replace('-', '')}_{name}.log").write_text("\n".join(lines) + "\n")
    return str(folder)


def run(spark, tmp_path, first, last=None, settings=UTC, store=None, **kw):
    store = store or AggregateStore(spark, str(tmp_path / "store"))
    start, end = date.fromisoformat(first), date.fromisoformat(last or first)
    return store, harvest(spark, str(tmp_path / "logs"), start, end, store, settings, **kw)


def usernames(store):
    return {str(r.local_date): r.username for r in store.read_table(FIELD).collect()}


def test_login_attribution(spark, tmp_path):
    log(
        tmp_path, "2024-03-05",
        ("09:00:00", "/a", APP, 200, 10),
        ("10:00:00", LOGIN + "rejected", APP, 401, 10),
        ("12:00:00", LOGIN + "second", APP, 200, 10),
        ("11:00:00", LOGIN + "First%40x", APP, 200, 5),
        ("11:00:00", LOGIN + "tie", APP, 200, 5),
        ("08:00:00", LOGIN + "stranger", "Browser", 200, 10),
    )
    log(tmp_path, "2024-03-05", ("11:00:00", LOGIN + "earlier-file", APP, 200, 1), name="a")
    store, result = run(spark, tmp_path, "2024-03-05")
    rows = store.read_table(FIELD).collect()
    assert [tuple(r) for r in rows] == [(date(2024, 3, 5), GUID, "earlier-file", 0.041, 6)]
    assert [tuple(r) for r in result.attribution[FIELD]] == [(date(2024, 3, 5), 1, 1, 0, 0)]


def test_backfill_across_dates_and_harvests(spark, tmp_path):
    log(tmp_path, "2024-03-04", ("09:00:00", "/a", APP, 200, 10))
    store, first = run(spark, tmp_path, "2024-03-04")
    assert usernames(store) == {"2024-03-04": None}
    log(tmp_path, "2024-03-05", ("09:00:00", LOGIN + "ann", APP, 200, 10))
    log(tmp_path, "2024-03-06", ("09:00:00", "/a", APP, 200, 10))
    _, second = run(spark, tmp_path, "2024-03-05", "2024-03-06", store=store)
    assert usernames(store) == {"2024-03-04": "ann", "2024-03-05": "ann", "2024-03-06": "ann"}
    assert [tuple(r)[1:] for r in second.attribution[FIELD]] == [(1, 1, 0, 0), (1, 0, 1, 0)]
    # Harvesting again changes nothing, and a later user does not overwrite.
    run(spark, tmp_path, "2024-03-04", "2024-03-06", store=store)
    log(tmp_path, "2024-03-07", ("09:00:00", LOGIN + "zoe", APP, 200, 10))
    run(spark, tmp_path, "2024-03-07", store=store)
    assert usernames(store) == {"2024-03-04": "ann", "2024-03-05": "ann", "2024-03-06": "ann", "2024-03-07": "zoe"}


def test_donor_is_the_earliest_then_alphabetical(spark):
    rows = [(date(2024, 1, 2), "d", "bob"), (date(2024, 1, 2), "d", "abe"), (date(2024, 1, 1), "d", None), (date(2024, 1, 3), "d", "aaa"), (date(2024, 1, 1), "e", None)]
    table = spark.createDataFrame(rows, "local_date date, device_id string, username string")
    once = D.backfill_usernames(table)
    got = sorted((r.local_date.day, r.device_id, r.username or "") for r in once.collect())
    assert got == [(1, "d", "abe"), (1, "e", ""), (2, "d", "abe"), (2, "d", "bob"), (3, "d", "aaa")]
    assert sorted(map(tuple, D.backfill_usernames(once).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert [r.local_date for r in D.backfilled_dates(table).collect()] == [date(2024, 1, 1)]


def test_twice_is_once_and_tables_conserve_hits(spark, tmp_path):
    reqs = [(f"{i % 24:02d}:00:00", f"/r{i % 3}/rest/services/s{i % 5}/MapServer", "UA", 200 if i % 4 else 500, i) for i in range(200)]
    log(tmp_path, "2024-03-05", *reqs)
    store, result = run(spark, tmp_path, "2024-03-05")
    before = {n: sorted(map(str, store.read_table(n).collect())) for n in S.ALL_TABLES}
    run(spark, tmp_path, "2024-03-05", store=store)
    assert before == {n: sorted(map(str, store.read_table(n).collect())) for n in S.ALL_TABLES}
    assert [tuple(r) for r in result.summary] == [(date(2024, 3, 5), 200, 200, 0)]
    for name in (S.BY_URI, S.BY_ROOT, S.BY_USER_AGENT, S.BY_REFERER, S.BY_FORWARDED_FOR_IP, S.BY_REFERER_AND_URI, S.BY_SERVICE):
        row = store.read_table(name).agg(F.sum("hits")).first()
        assert row[0] == 200, name
    bad = store.read_table(S.BY_SERVICE).where("hits <> successful_hits + failed_hits").count()
    assert bad == 0
    assert store.read_table(S.BY_SERVICE).schema == S.table_schema(S.BY_SERVICE)
    assert store.read_table(S.BY_PORTAL_ITEM).schema == S.table_schema(S.BY_PORTAL_ITEM)


def test_refused_dates_stay_as_they_are(spark, tmp_path):
    log(tmp_path, "2024-03-05", ("09:00:00", "/a", "UA", 200, 10))
    store, _ = run(spark, tmp_path, "2024-03-05")
    log(tmp_path, "2024-03-05", ("10:00:00", "/b", "UA", 200, 10), name="y", header="#Fields: date time")
    log(tmp_path, "2024-03-06", ("09:00:00", "/c", "UA", 200, 10))
    _, result = run(spark, tmp_path, "2024-03-05", "2024-03-07", store=store)
    assert result.replaced == [date(2024, 3, 6)]
    assert result.refused == [date(2024, 3, 5), date(2024, 3, 7)]
    assert {r.uri_stem for r in store.read_table(S.BY_URI).collect()} == {"/a", "/c"}


def test_local_date_needs_both_utc_days(spark, tmp_path):
    zone = HarvestSettings("America/Phoenix")
    log(tmp_path, "2024-03-05", ("03:00:00", "/before", "UA", 200, 1), ("12:00:00", "/in", "UA", 200, 1))
    _, result = run(spark, tmp_path, "2024-03-05", settings=zone)
    assert result.refused == [date(2024, 3, 5)]
    log(tmp_path, "2024-03-06", ("06:59:59", "/late", "UA", 200, 1), ("07:00:00", "/after", "UA", 200, 1), ("x", "/bad", "UA", 200, 1))
    store, result = run(spark, tmp_path, "2024-03-05", settings=zone)
    assert {r.uri_stem for r in store.read_table(S.BY_URI).collect()} == {"/in", "/late"}
    # Lines are counted over the whole of the date's files.
    assert [tuple(r) for r in result.summary] == [(date(2024, 3, 5), 5, 4, 1)]


def test_optional_table_is_untouched_when_off(spark, tmp_path):
    log(tmp_path, "2024-03-05", ("09:00:00", "/a", "UA", 200, 10))
    store, _ = run(spark, tmp_path, "2024-03-05")
    log(tmp_path, "2024-03-05", ("09:00:00", "/b", "UA", 200, 10))
    run(spark, tmp_path, "2024-03-05", settings=HarvestSettings("UTC"), store=store)
    assert [r.uri_stem for r in store.read_table(S.BY_REFERER_AND_URI).collect()] == ["/a"]
    assert [r.uri_stem for r in store.read_table(S.BY_URI).collect()] == ["/b"]


def test_failure_before_commit_changes_nothing(spark, tmp_path):
    log(tmp_path, "2024-03-05", ("09:00:00", "/a", "UA", 200, 10))
    store, _ = run(spark, tmp_path, "2024-03-05")
    open_reader = store.read_table(S.BY_URI)
    log(tmp_path, "2024-03-05", ("09:00:00", "/b", "UA", 200, 10))

    def fail():
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        run(spark, tmp_path, "2024-03-05", store=store, before_commit=fail)
    assert [r.uri_stem for r in store.read_table(S.BY_URI).collect()] == ["/a"]
    store.remove_unreferenced()
    run(spark, tmp_path, "2024-03-05", store=store)
    assert [r.uri_stem for r in open_reader.collect()] == ["/a"]
    assert [r.uri_stem for r in store.read_table(S.BY_URI).collect()] == ["/b"]


def stored(spark, name, rows):
    df = spark.createDataFrame(rows, "root string, hits long, time_taken_ms long, local_date date")
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in S.STORED_COLUMNS.items()],
        F.lit(name).alias("table_name"),
        "local_date",
    )


def test_replace_empty_none_and_conflict(spark, tmp_path):
    store, d, e = AggregateStore(spark, str(tmp_path / "s")), date(2024, 3, 5), date(2024, 3, 6)
    full = stored(spark, S.BY_ROOT, [("a", 1, 5, d), ("b", 2, 5, e)])
    assert store.read_table(S.BY_ROOT).count() == 0
    replace_daily_batch(store, {S.BY_ROOT: full}, [d, e])
    replace_daily_batch(store, {S.BY_ROOT: None}, [d])
    assert store.read_table(S.BY_ROOT).count() == 2
    stale = store.manifest()
    replace_daily_batch(store, {S.BY_ROOT: full.where("false")}, [d])
    assert [r.root for r in store.read_table(S.BY_ROOT).collect()] == ["b"]
    with pytest.raises(Exception, match="exist"):
        store.commit(stale, store.new_batch(), {S.BY_ROOT: [e]})
    assert [r.root for r in store.read_table(S.BY_ROOT, start=e).collect()] == ["b"]
    assert store.read_table(S.BY_ROOT, end=d).count() == 0
    store.delete_by_local_date(S.BY_ROOT, e)
    assert store.read_table(S.BY_ROOT).count() == 0


def test_date_filter_prunes_folders(spark, tmp_path):
    store, days = AggregateStore(spark, str(tmp_path / "s")), [date(2024, 3, 5) + timedelta(days=i) for i in range(4)]
    replace_daily_batch(store, {S.BY_ROOT: stored(spark, S.BY_ROOT, [("a", 1, 5, d) for d in days])}, days)
    df = store.read_table(S.BY_ROOT).where(F.col("local_date") == F.lit(days[1])).select("hits")
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "local_date" in filters and "table_name" in filters and "ReadSchema: struct<hits:bigint>" in plan


def test_all_in_one_pass_equals_one_by_one(spark, tmp_path):
    rows = [
        (date(2024, 3, 5), "f.log", 0, i, datetime(2024, 3, 5, i % 24), uri, ua, ref, 500 if i % 3 == 0 else 200, i, xff)
        for i, (uri, ua, ref, xff) in enumerate(
            [
                ("/a/rest/services/f/s/MapServer", "UA", "-", None),
                ("/a/rest/services/s/MapServer", "UA", "http://r/0004x", "10.0.0.1:1"),
                ("/portal/sharing/rest/content/items/I", APP, "+", "-"),
                (LOGIN + "ann", APP, "r", "zz"),
                (LOGIN + "bob", APP, "r", None),
                ("", "", "", ""),
            ]
            * 9
        )
    ]
    schema = "local_date date, file string, block_start long, line_id long, utc_ts timestamp_ntz, uri_stem string, user_agent string, referer string, status int, time_taken_ms int, forwarded_for string"
    requests = spark.createDataFrame(rows, schema)
    every = A.aggregate_all(requests, UTC)
    for name, one in {
        S.BY_URI: A.aggregate_by_uri(requests),
        S.BY_ROOT: A.aggregate_by_root(requests),
        S.BY_USER_AGENT: A.aggregate_by_user_agent(requests),
        S.BY_REFERER: A.aggregate_by_referer(requests),
        S.BY_FORWARDED_FOR_IP: A.aggregate_by_forwarded_for_ip(requests),
        S.BY_REFERER_AND_URI: A.aggregate_by_referer_and_uri(requests),
        S.BY_SERVICE: A.aggregate_by_service(requests),
        S.BY_PORTAL_ITEM: A.aggregate_by_portal_item(requests),
    }.items():
        columns = S.table_columns(name)
        assert sorted(map(str, A.as_table(every, name).collect())) == sorted(map(str, one.select(*columns).collect())), name
    device = A.first_login(every.where(F.col("table_name") == FIELD)).collect()
    assert [(r.username, r.hits) for r in device] == [(r.username, r.hits) for r in A.aggregate_by_field_maps_device(requests).collect()]
    # No partial aggregation by sorting, nothing row-at-a-time.
    plan = every._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortAggregate" not in plan and "Python" not in plan and plan.count("Exchange") == 1


def test_regenerate_writes_tables_and_tsv(spark, tmp_path):
    log(tmp_path, "2024-03-05", ("09:00:00", "/mimas/rest/services/b/MapServer", "UA", 200, 1500), ("09:00:00", "/mimas/rest/services/-f/s/MapServer", "UA", 404, 250))
    store, _ = run(spark, tmp_path, "2024-03-05")
    written = regenerate(store, str(tmp_path / "out"), ReportSettings("UTC", ("oberon", "mimas")), datetime(2024, 3, 6), 2024)
    assert "service_complete.tsv" in written and "portal_complete.tsv" not in written
    parts = sorted((tmp_path / "out" / "service_complete.tsv").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == (
        "Site\tFolder\tService Name\tService Type\tHits\tTotal Time Taken (s)\tAverage Time Taken (s)\tSuccessful Hits\tFailed Hits\n"
        "mimas\t\tb\tmapserver\t1\t1.5\t1.5\t1\t0\n"
        "mimas\t'-f\ts\tmapserver\t1\t0.25\t0.25\t0\t1\n"
    )
    parts = sorted((tmp_path / "out" / "root_complete.tsv").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines()[1:] == ["mimas\t2\t1.75\t0.875", "oberon\t0\t0\t0"]
    evolution = spark.read.parquet(str(tmp_path / "out" / "root_evolution")).orderBy("range").collect()
    assert [(r["range"], r.mimas, r.oberon) for r in evolution] == [("all", 2, None), ("last-7-days", 2, None)]


def zone(spark, name):
    spark.conf.set("spark.sql.session.timeZone", name)


def test_login_order_does_not_depend_on_the_session_zone(spark, tmp_path):
    """02:30 does not exist in Edmonton on that day."""
    log(tmp_path, "2024-03-10", ("02:30:00", LOGIN + "first", APP, 200, 10), ("03:10:00", LOGIN + "second", APP, 200, 10))
    try:
        for name in ("UTC", "America/Edmonton"):
            zone(spark, name)
            store, _ = run(spark, tmp_path, "2024-03-10", store=AggregateStore(spark, str(tmp_path / name)))
            assert usernames(store) == {"2024-03-10": "first"}
    finally:
        zone(spark, "UTC")


def test_cores_that_come_between_the_passes_lose_no_line(spark, tmp_path, monkeypatch):
    from logtally.operators import headers as H
    from logtally.plans import harvest as plan

    log(tmp_path, "2024-03-05", *[("09:00:00", f"/{i % 50}", "UA", 200, 1) for i in range(30_000)])
    index = plan.index_text

    def cores_arrive(*args):
        text = index(*args)
        assert text.splits.count() > 1
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "32")
        return text

    monkeypatch.setattr(plan, "index_text", cores_arrive)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        store, result = run(spark, tmp_path, "2024-03-05")
        assert [tuple(r) for r in result.summary] == [(date(2024, 3, 5), 30_000, 30_000, 0)]
        assert store.read_table(S.BY_URI).agg(F.sum("hits")).first()[0] == 30_000
        # Without the fixed plan the lines are not lost but the job fails.
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
        text = index(plan.read_log_lines(spark, str(tmp_path / "logs"), [date(2024, 3, 5)]))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "32")
        with pytest.raises(Exception, match=H.UNKNOWN_SPLIT):
            text.parsed().select("uri_stem", "reason").collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_that_differ_between_passes_refuse_the_date(spark, tmp_path, monkeypatch):
    from logtally.plans import harvest as plan

    log(tmp_path, "2024-03-05", ("09:00:00", "/a", "UA", 200, 1))
    log(tmp_path, "2024-03-06", ("09:00:00", "/a", "UA", 200, 1), ("09:00:00", "/b", "UA", 200, 1))
    parsed = plan.Text.parsed
    monkeypatch.setattr(plan.Text, "parsed", lambda self: parsed(self).where("uri_stem <> '/b'"))
    store, result = run(spark, tmp_path, "2024-03-05", "2024-03-06")
    assert (result.replaced, result.refused) == ([date(2024, 3, 5)], [date(2024, 3, 6)])
    assert set(store.manifest().dates(S.BY_URI)) == {"2024-03-05"}


def break_file(folder, name):
    """Leaves a checksum that does not fit, so reading the file fails."""
    path = f"{folder}/.{name}.crc"
    with open(path, "wb") as f:
        f.write(b"crc\x00\x00\x00\x02\x00" + b"\x01\x02\x03\x04")


def test_unreadable_file_refuses_its_dates_only(spark, tmp_path):
    for day in ("2024-03-05", "2024-03-06", "2024-03-07"):
        folder = log(tmp_path, day, ("09:00:00", "/a", "UA", 200, 1))
    break_file(folder, "u_ex240306_x.log")
    store, result = run(spark, tmp_path, "2024-03-05", "2024-03-07")
    assert (result.replaced, result.refused) == ([date(2024, 3, 5), date(2024, 3, 7)], [date(2024, 3, 6)])
    assert list(result.unreadable) == [date(2024, 3, 6)] and "u_ex240306_x.log" in result.unreadable[date(2024, 3, 6)]
    # A day that no wanted date needs is not even opened.
    _, one = run(spark, tmp_path, "2024-03-05", store=store)
    assert one.replaced == [date(2024, 3, 5)] and not one.unreadable


def test_two_unreadable_files_are_skipped_files(spark, tmp_path, monkeypatch):
    """Two bad files of the days cost two scans more, and the others are read without them."""
    from logtally.plans import harvest as plan

    for day in ("2024-03-05", "2024-03-06", "2024-03-07", "2024-03-08"):
        for name in ("a b%25+", "y"):
            folder = log(tmp_path, day, ("09:00:00", "/" + name[0], "UA", 200, 1), name=name)
    break_file(folder, "u_ex240306_a b%25+.log")
    break_file(folder, "u_ex240308_y.log")
    scans = []
    index = plan.index_text
    monkeypatch.setattr(plan, "index_text", lambda *args: (scans.append(1), index(*args))[1])
    why = str(tmp_path / "why")
    store, result = run(spark, tmp_path, "2024-03-05", "2024-03-08", diagnostics=why)
    assert len(scans) == 3
    assert (result.replaced, result.refused) == ([date(2024, 3, d) for d in (5, 7)], [date(2024, 3, d) for d in (6, 8)])
    status = {r.local_date.day: (r.files, r.skipped_files, list(r.missing_utc_dates)) for r in result.status}
    assert status == {5: (2, 0, []), 6: (2, 1, []), 7: (2, 0, []), 8: (2, 1, [])}
    skipped = {r.file: r.reason for r in spark.read.parquet(f"{why}/skipped").collect()}
    assert skipped.keys() == {"u_ex240306_a b%25+.log", "u_ex240308_y.log"}
    assert all(reason.startswith(plan.UNREADABLE_REASON) for reason in skipped.values())
    assert {str(d) for d in result.unreadable} == {"2024-03-06", "2024-03-08"}
    assert {r.uri_stem for r in store.read_table(S.BY_URI).collect()} == {"/a", "/y"}


def test_nothing_is_left_behind(spark, tmp_path):
    from logtally.session import scratch_root

    log(tmp_path, "2024-03-05", ("09:00:00", LOGIN + "ann", APP, 200, 10), ("x", "/bad", "UA", 200, 1))
    store, result = run(spark, tmp_path, "2024-03-05", diagnostics=str(tmp_path / "why"))
    tables = {p.name.split("=")[1] for p in (tmp_path / "store" / "data").glob("batch=*/table_name=*")}
    assert tables <= set(S.ALL_TABLES)
    import pathlib

    assert not list(pathlib.Path(scratch_root(spark)).glob("run-*"))
    rejects = spark.read.parquet(str(tmp_path / "why" / "rejects")).collect()
    assert [(r.line_no, r.reason) for r in rejects] == [(3, "unparseable date/time '2024-03-05 x'")]
    assert spark.read.parquet(str(tmp_path / "why" / "skipped")).count() == 0


def test_reports_of_every_touched_year(spark, tmp_path):
    from logtally.plans.regenerate import harvest_and_regenerate

    for day in ("2023-12-31", "2024-01-01"):
        log(tmp_path, day, ("09:00:00", "/mimas/rest/services/b/MapServer", "UA", 200, 1500))
    store = AggregateStore(spark, str(tmp_path / "store"))
    harvest_and_regenerate(
        spark, str(tmp_path / "logs"), date(2023, 12, 31), date(2024, 1, 1), store, str(tmp_path / "out"), UTC,
        ReportSettings("UTC", ("mimas",)), datetime(2024, 1, 2),
    )
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"2023", "2024"}


def test_backfill_inside_replace_daily_batch(spark, tmp_path):
    d, e = date(2024, 3, 5), date(2024, 3, 6)

    def rows(name, *values):
        df = spark.createDataFrame(list(values), "device_id string, username string, hits long, time_taken_ms long, local_date date")
        return df.select(
            *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in S.STORED_COLUMNS.items()],
            F.lit(name).alias("table_name"),
            "local_date",
        )

    for order in ((d, e), (e, d)):
        store = AggregateStore(spark, str(tmp_path / str(order[0])))
        for day in order:
            batch = {name: rows(name, ("x", "ann" if day == e else None, 1, 5, day), ("y", None, 1, 5, day)) for name in S.DEVICE_TABLES}
            replace_daily_batch(store, batch, [day])
        for name in S.DEVICE_TABLES:
            got = {(r.local_date, r.device_id): r.username for r in store.read_table(name).collect()}
            assert got == {(d, "x"): "ann", (e, "x"): "ann", (d, "y"): None, (e, "y"): None}


def test_diagnostics_alone_are_those_of_a_harvest(spark, tmp_path, monkeypatch):
    log(tmp_path, "2024-03-05", ("09:00:00", "/a", APP, "2x0", 10), ("09:00:01", "/a", APP, 200, "1.5"), ("09:00:02", "/a", APP, 200, 1))
    log(tmp_path, "2024-03-06", ("09:00:00", "/a", APP, 200, 10), header="#Fields: date time cs-uri-stem")
    log(tmp_path, "2024-03-06", name="empty", header="")
    whole, alone = str(tmp_path / "whole"), str(tmp_path / "alone")
    run(spark, tmp_path, "2024-03-05", "2024-03-06", diagnostics=whole)
    # No aggregate is made for them.
    monkeypatch.setattr(A, "aggregate_all", None)
    diagnose(spark, str(tmp_path / "logs"), date(2024, 3, 5), date(2024, 3, 6), alone, UTC)
    for name, count in (("skipped", 2), ("rejects", 2)):
        found = [sorted(map(tuple, spark.read.parquet(f"{path}/{name}").collect())) for path in (whole, alone)]
        assert found[0] == found[1] and len(found[0]) == count
