"""Dates: offsets, needed UTC files, changes of clocks, report boundaries."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from logtally.config import report_boundaries
from logtally.operators.scoping import assign_local_date
from logtally.sources import calendar as C

ZONE = "America/Edmonton"


@pytest.mark.parametrize("session_zone", ["UTC", "Europe/Berlin", "America/Edmonton"])
def test_offset_at_local_midnight_in_any_session_zone(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        dates = spark.createDataFrame([(date(2026, 3, 8),), (date(2026, 3, 9),), (date(2026, 11, 1),), (date(2026, 11, 2),)], "local_date date")
        got = C.local_offset(dates, ZONE).orderBy("local_date").collect()
        assert [r.offset_s for r in got] == [-25200, -21600, -21600, -25200]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "zone, needed", [(ZONE, [5, 6]), ("UTC", [5]), ("Asia/Tokyo", [4, 5])]
)
def test_required_utc_dates(spark, zone, needed):
    rows = C.calendar(spark, date(2024, 3, 5), date(2024, 3, 5), zone).orderBy("utc_date").collect()
    assert [r.utc_date.day for r in rows] == needed


def requests(spark, *stamps):
    rows = [(f"{s[:10]}", datetime.fromisoformat(s)) for s in stamps]
    return spark.createDataFrame(rows, "d string, utc_ts timestamp_ntz").select(
        F.col("d").cast("date").alias("file_utc_date"), "utc_ts"
    )


def local_dates(spark, stamp, exact=None):
    cal = C.calendar(spark, date(2026, 1, 1), date(2026, 12, 31), ZONE)
    return sorted(r.local_date for r in assign_local_date(requests(spark, stamp), cal, exact).collect())


def test_change_of_clocks(spark):
    # Fixed offset per date: an hour counts twice in spring and not at all in autumn.
    assert local_dates(spark, "2026-03-09 06:30:00") == [date(2026, 3, 8), date(2026, 3, 9)]
    assert local_dates(spark, "2026-11-02 06:30:00") == []
    assert local_dates(spark, "2026-03-09 06:30:00", ZONE) == [date(2026, 3, 9)]
    assert local_dates(spark, "2026-11-02 06:30:00", ZONE) == [date(2026, 11, 1)]


def test_local_date_is_the_day_before_in_the_morning(spark):
    assert local_dates(spark, "2026-06-10 03:00:00") == [date(2026, 6, 9)]
    assert local_dates(spark, "2026-06-10 06:00:00") == [date(2026, 6, 10)]


def test_scope_is_the_file_not_the_line(spark):
    stray = requests(spark, "2026-06-10 12:00:00").withColumn("file_utc_date", F.lit(date(2026, 6, 20)))
    cal = C.calendar(spark, date(2026, 6, 1), date(2026, 6, 30), ZONE)
    assert assign_local_date(stray, cal).count() == 0


def test_calendar_join_is_a_broadcast_equi_join(spark):
    cal = C.calendar(spark, date(2026, 1, 1), date(2026, 12, 31), ZONE)
    plan = assign_local_date(requests(spark, "2026-06-10 12:00:00"), cal)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_report_boundaries():
    now = datetime(2026, 1, 3, 5, 0)  # still 2 January in the zone
    b = report_boundaries(now, ZONE, 2026)
    assert (b.today, b.year_start, b.last7_start) == (date(2026, 1, 2), date(2026, 1, 1), date(2025, 12, 27))
    past = report_boundaries(now, ZONE, 2025)
    assert (past.today, past.last7_start) == (date(2025, 12, 31), date(2025, 12, 27))
    with pytest.raises(ValueError):
        report_boundaries(now, ZONE, 2027)
