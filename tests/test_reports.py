"""Leaderboards, ranges, username lookup, streaming."""

from datetime import date, datetime

from pyspark.sql import functions as F

from logtally.config import report_boundaries
from logtally.operators.filters import tag_ranges
from logtally.plans import leaderboards as L
from logtally.plans import marts as M
from logtally.plans import queries as Q
from logtally.streaming import daily

DAY = date(2026, 1, 2)
RANGE = (date(2026, 1, 1), date(2026, 1, 31))


def services(spark, rows):
    schema = "local_date date, site string, folder string, service_name string, service_type string, successful_time_taken_second double, failed_time_taken_second double, hits long, successful_hits long, failed_hits long"
    return spark.createDataFrame([(DAY, *r) for r in rows], schema)


def test_more_than_k_services_are_cut_per_site_and_ties_follow_the_key(spark):
    rows = [(site, None if i % 2 else "f", f"s{i:03d}", "mapserver", 1.0 * i, 0.0, i, i, 0) for site in ("a", "b") for i in range(120)]
    top = L.top_services_by_successful_hits(services(spark, rows), *RANGE).orderBy("site", "rank").collect()
    assert len(top) == 100
    assert [r.hits for r in top if r.site == "b"] == list(range(119, 69, -1))
    tied = services(spark, [("a", "z", "s", "t", 0.0, 1.0, 2, 0, 2), ("a", None, "s", "t", 0.0, 1.0, 2, 0, 2), ("a", "b", "s", "t", 0.0, 9.0, 2, 2, 0)])
    ranked = L.top_services_by_avg_failed_time(tied, *RANGE).orderBy("rank").collect()
    assert [(r.folder, r.total_time_taken_second, r.hits) for r in ranked] == [(None, 1.0, 2), ("z", 1.0, 2)]


def test_null_folder_matches_only_folderless(spark):
    table = services(spark, [("a", None, "s", "t", 1.0, 0.0, 1, 1, 0), ("a", "f", "s", "t", 1.0, 0.0, 5, 5, 0)])
    assert [r.hits for r in Q.service_detail_daily_hits(table, *RANGE, "a", None, "s", "t").collect()] == [1]
    assert [r.hits for r in Q.service_detail_daily_hits(table, *RANGE, "a", "f", "s", "t").collect()] == [5]
    assert [r.folder for r in Q.service_range_totals(table, *RANGE, ["a"]).collect()] == [None, "f"]


def test_username_is_sought_beyond_the_range(spark):
    rows = [(date(2025, 12, 1), "d", "ann", 1.0, 1), (date(2026, 1, 5), "d", None, 2.0, 3), (date(2026, 1, 6), "e", None, 2.0, 4)]
    table = spark.createDataFrame(rows, "local_date date, device_id string, username string, time_taken_second double, hits long")
    top = sorted(map(tuple, L.top_devices(table, *RANGE).collect()))
    assert top == [("d", "ann", 3), ("e", None, 4)]
    totals = sorted(map(tuple, Q.device_range_totals(table, *RANGE).collect()))
    assert totals == [("d", "ann", 3, 2.0, date(2026, 1, 5)), ("e", None, 4, 2.0, date(2026, 1, 6))]


def test_last_seven_days_over_the_turn_of_the_year(spark):
    b = report_boundaries(datetime(2026, 1, 3, 12), "UTC", 2026)
    rows = [(date(2025, 12, 27), "d", None, 1.0, 1), (date(2025, 12, 28), "d", None, 1.0, 10), (date(2026, 1, 2), "d", None, 1.0, 100)]
    table = spark.createDataFrame(rows, "local_date date, device_id string, username string, time_taken_second double, hits long")
    # The leaderboard reaches back over the new year, the series does not.
    board = {r["range"]: r.hits for r in M.mart_device_leaderboard(table, b).collect()}
    assert board == {"all": 100, "last-7-days": 110}
    detail = sorted((r["range"], r.hits) for r in M.mart_device_detail(table, b).collect())
    assert detail == [("all", 100), ("last-7-days", 100)]
    past = report_boundaries(datetime(2026, 1, 20, 12), "UTC", 2025)
    assert {r["range"] for r in M.mart_device_leaderboard(table, past).collect()} == {"all"}
    assert tag_ranges(table, b.year_start, b.last7_start, b.today).count() == 3


def test_averages_of_services_without_hits(spark):
    table = services(spark, [("a", None, "s", "t", 0.0, 5.0, 2, 0, 2)])
    b = report_boundaries(datetime(2026, 1, 20, 12), "UTC", 2026)
    settings = M.ReportSettings("UTC", ("a",))
    row = M.mart_service_evolution(table, settings, b).first()
    assert (row.average_successful_second, row.average_failed_second) == (None, 2.5)
    metrics = {r.metric for r in M.mart_service_leaderboards(table, settings, b).collect()}
    assert metrics == {"failed-hits", "average-failed-time"}


def test_stream_keeps_totals_up_to_date(spark, tmp_path):
    schema = "utc_ts timestamp_ntz, uri_stem string, time_taken_ms int"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(*rows):
        spark.createDataFrame([(datetime.fromisoformat(t), u, ms) for t, u, ms in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        daily.stream_daily_totals(stream, out, check, time_zone="America/Phoenix").awaitTermination()
        got = daily.read_daily_totals(spark, out).select(F.col("local_date").cast("string"), "root", "hits", "time_taken_second")
        return sorted(map(tuple, got.collect()))

    assert arrive(("2024-03-05 06:59:59", "/a/x", 10), ("2024-03-05 07:00:00", "/a/y", 20)) == [
        ("2024-03-04", "a", 1, 0.01), ("2024-03-05", "a", 1, 0.02),
    ]
    assert arrive(("2024-03-05 20:00:00", "/A", 30), ("2024-03-05 20:00:00", "/b", 5)) == [
        ("2024-03-04", "a", 1, 0.01), ("2024-03-05", "a", 2, 0.05), ("2024-03-05", "b", 1, 0.005),
    ]
