"""Report tables: everything the report pages show, for both ranges, one job per table.

``range`` is ``all`` (the year so far) or ``last-7-days``. Series cover the last seven days only
as far as they lie in the year; leaderboards cover them also across the turn of the year.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReportBoundaries, ReportSettings
from ..functions.measures import (
    average_time,
    average_time_or_null,
    device_heading,
    device_label,
    round3,
    service_label,
)
from ..operators import filters
from ..operators.devices import donors
from ..operators.filters import RANGE_ALL, RANGE_LAST_7, tag_ranges
from ..session import write_scratch
from . import leaderboards as L
from . import queries as Q


def _all() -> Column:
    return F.lit(RANGE_ALL).alias("range")


def _series(table: DataFrame, b: ReportBoundaries) -> DataFrame:
    return tag_ranges(table, b.year_start, max(b.year_start, b.last7_start), b.today)


def _ranked(table: DataFrame, b: ReportBoundaries) -> DataFrame:
    return tag_ranges(table, b.year_start, b.last7_start, b.today)


def _average(total: str, hits: str = "hits") -> Column:
    return round3(average_time(F.col(total), F.col(hits)))


def dense_root_grid(series: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """One row per range and date that has any traffic, one column per root, NULL where a root
    has none. The roots are given, so the pivot needs no pass to find them."""
    return series.groupBy("range", "local_date").pivot("root", list(roots)).agg(F.sum("hits"))


def complete_roots(totals: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """Every included root, with zeros where it has no traffic."""
    spark = totals.sparkSession
    wanted = spark.createDataFrame([(r,) for r in roots], "root string")
    return wanted.join(totals, "root", "left").select(
        "root",
        F.coalesce("hits", F.lit(0).cast("long")).alias("hits"),
        F.coalesce("total_time_taken_second", F.lit(0.0)).alias("total_time_taken_second"),
    )


def mart_root_evolution(by_root: DataFrame, settings: ReportSettings, b: ReportBoundaries) -> DataFrame:
    included = filters.filter_included_roots(by_root, settings.included_roots)
    return dense_root_grid(_series(included, b), settings.included_roots)


def mart_root_complete(by_root: DataFrame, settings: ReportSettings, b: ReportBoundaries) -> DataFrame:
    totals = Q.root_range_totals(by_root, b.year_start, b.today, settings.included_roots)
    return complete_roots(totals, settings.included_roots).select(
        _all(),
        "root",
        "hits",
        round3(F.col("total_time_taken_second")).alias("total_time_taken_second"),
        _average("total_time_taken_second").alias("average_time_taken_second"),
    )


# Columns are made when asked for: there is no session yet.
Sums = Mapping[str, Callable[[], Column]]
SERVICE_SUMS = {
    "hits": lambda: F.sum("hits"),
    "successful_hits": lambda: F.sum("successful_hits"),
    "failed_hits": lambda: F.sum("failed_hits"),
    "ok_second": lambda: Q.sum_seconds("successful_time_taken_second"),
    "failed_second": lambda: Q.sum_seconds("failed_time_taken_second"),
    "total_second": lambda: Q.sum_seconds("successful_time_taken_second", "failed_time_taken_second"),
}
ITEM_SUMS = {
    "hits": lambda: F.sum("hits"),
    "successful_hits": lambda: F.sum("successful_hits"),
    "failed_hits": lambda: F.sum("failed_hits"),
    "total_second": lambda: Q.sum_seconds("time_taken_second"),
}
DEVICE_SUMS = {"hits": lambda: F.sum("hits"), "total_second": lambda: Q.sum_seconds("time_taken_second"), "last_seen": lambda: F.max("local_date")}


def _sums(rows: DataFrame, keys: Sequence[str], sums: Sums, *wanted: str) -> DataFrame:
    return rows.groupBy("range", *keys).agg(*[sums[c]().alias(c) for c in wanted or sums])


class Cube:
    """Sums of one aggregate table for all its reports, from one scan: by entity and date, by entity, and, where
    asked for, by group (all entities, or those of one site) and date. ``at`` gives those of one kind.

    Ranges are those of leaderboards; a series leaves out what lies before the year."""

    def __init__(self, table: DataFrame, b: ReportBoundaries, entity: Sequence[str], sums: Sums, group: Sequence[str] | None = None):
        self.b, self.entity, self.group = b, list(entity), None if group is None else list(group)
        kinds = {"detail": [*self.entity, "local_date"], "total": self.entity}
        if group is not None:
            kinds["group"] = [*self.group, "local_date"]
        every = ["range", *self.entity, "local_date"]
        sets = [["range", *keys] for keys in kinds.values()]
        rows = _ranked(table, b).groupingSets(sets, *every).agg(F.grouping_id().alias("grouping"), *[c().alias(n) for n, c in sums.items()])
        # A bit for each column of ``every``, set where it is left out.
        self.ids = {kind: int("".join("0" if c in ("range", *keys) else "1" for c in every), 2) for kind, keys in kinds.items()}
        self.rows = write_scratch(rows, "cube")

    def at(self, kind: str) -> DataFrame:
        rows = self.rows.where(F.col("grouping") == self.ids[kind]).drop("grouping")
        return rows if kind == "total" else rows.where(F.col("local_date") >= F.lit(self.b.year_start))

    def totals(self) -> DataFrame:
        """By entity, of the year."""
        return self.at("total").where(F.col("range") == RANGE_ALL)


def _service_averages(totals: DataFrame, *keys: str) -> DataFrame:
    return totals.select(
        "range",
        *keys,
        "local_date",
        "successful_hits",
        "failed_hits",
        round3(average_time_or_null(F.col("ok_second"), F.col("successful_hits"))).alias("average_successful_second"),
        round3(average_time_or_null(F.col("failed_second"), F.col("failed_hits"))).alias("average_failed_second"),
    )


def _service_series(rows: DataFrame, *keys: str) -> DataFrame:
    wanted = ("successful_hits", "failed_hits", "ok_second", "failed_second")
    return _service_averages(_sums(rows, [*keys, "local_date"], SERVICE_SUMS, *wanted), *keys)


def _included_sites(by_service: DataFrame, settings: ReportSettings) -> DataFrame:
    return filters.filter_included_roots(by_service, settings.included_roots, "site")


def mart_service_evolution(by_service: DataFrame, settings: ReportSettings, b: ReportBoundaries) -> DataFrame:
    return _service_series(_series(_included_sites(by_service, settings), b), "site")


def mart_service_detail(by_service: DataFrame, settings: ReportSettings, b: ReportBoundaries) -> DataFrame:
    return _labelled(_service_series(_series(_included_sites(by_service, settings), b), *Q.SERVICE))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "label", service_label(F.col("folder"), F.col("service_name"), F.col("service_type"))
    )


def mart_service_leaderboards(by_service: DataFrame, settings: ReportSettings, b: ReportBoundaries) -> DataFrame:
    """Four metrics per site and range out of one grouping: each service becomes one row per
    metric it qualifies for, and all metrics are ranked together."""
    wanted = ("successful_hits", "failed_hits", "ok_second", "failed_second")
    return _service_ranking(_sums(_ranked(_included_sites(by_service, settings), b), Q.SERVICE, SERVICE_SUMS, *wanted))


def _service_ranking(totals: DataFrame) -> DataFrame:
    def metric(name: str, hits: str, value: Column) -> Column:
        return F.when(
            F.col(hits) > 0, F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        )

    metrics = F.array_compact(
        F.array(
            metric("successful-hits", "successful_hits", F.col("successful_hits")),
            metric("failed-hits", "failed_hits", F.col("failed_hits")),
            metric("average-successful-time", "successful_hits", F.col("ok_second") / F.col("successful_hits")),
            metric("average-failed-time", "failed_hits", F.col("failed_second") / F.col("failed_hits")),
        )
    )
    rows = totals.select("range", *Q.SERVICE, F.inline(metrics))
    return L.top_k(rows, ["range", "site", "metric"], "value", L.SERVICE_IN_SITE, L.BAR_SIZE).select(
        "range",
        "site",
        "metric",
        "rank",
        service_label(F.col("folder"), F.col("service_name"), F.col("service_type")).alias("label"),
        round3(F.col("value")).alias("value"),
    )


def mart_service_complete(by_service: DataFrame, settings: ReportSettings, b: ReportBoundaries) -> DataFrame:
    totals = Q.service_range_totals(by_service, b.year_start, b.today, settings.included_roots)
    return _service_listing(totals.withColumnRenamed("total_time_taken_second", "total_second"))


def _listing(totals: DataFrame, *keys: str) -> list[Column]:
    return [
        _all(),
        *[F.col(k) for k in keys],
        F.col("hits"),
        round3(F.col("total_second")).alias("total_time_taken_second"),
        _average("total_second").alias("average_time_taken_second"),
    ]


def _service_listing(totals: DataFrame) -> DataFrame:
    return totals.select(*_listing(totals, *Q.SERVICE), "successful_hits", "failed_hits")


def service_marts(by_service: DataFrame, settings: ReportSettings, b: ReportBoundaries) -> dict[str, DataFrame]:
    """The four service tables from one scan."""
    cube = Cube(_included_sites(by_service, settings), b, Q.SERVICE, SERVICE_SUMS, group=["site"])
    return {
        "service_evolution": _service_averages(cube.at("group"), "site"),
        "service_leaderboards": _service_ranking(cube.at("total")),
        "service_complete": _service_listing(cube.totals().orderBy("site", F.col("folder").asc_nulls_first(), "service_name", "service_type")),
        "service_detail": _labelled(_service_averages(cube.at("detail"), *Q.SERVICE)),
    }


def mart_portal_evolution(by_item: DataFrame, b: ReportBoundaries) -> DataFrame:
    return _sums(_series(by_item, b), ["local_date"], ITEM_SUMS, "successful_hits", "failed_hits")


def mart_portal_detail(by_item: DataFrame, b: ReportBoundaries) -> DataFrame:
    return _sums(_series(by_item, b), ["portal_item_id", "local_date"], ITEM_SUMS, "successful_hits", "failed_hits")


def mart_portal_leaderboards(by_item: DataFrame, b: ReportBoundaries) -> DataFrame:
    return _portal_ranking(_sums(_ranked(by_item, b), ["portal_item_id"], ITEM_SUMS, "successful_hits", "failed_hits"))


def _portal_ranking(totals: DataFrame) -> DataFrame:
    metrics = F.array(
        F.struct(F.lit("successful-hits").alias("metric"), F.col("successful_hits").alias("hits")),
        F.struct(F.lit("failed-hits").alias("metric"), F.col("failed_hits").alias("hits")),
    )
    rows = totals.select("range", "portal_item_id", F.inline(metrics)).where(F.col("hits") > 0)
    return L.top_k(rows, ["range", "metric"], "hits", ["portal_item_id"], L.BAR_SIZE).select(
        "range", "metric", "rank", "portal_item_id", "hits"
    )


def mart_portal_complete(by_item: DataFrame, b: ReportBoundaries) -> DataFrame:
    totals = Q.portal_item_range_totals(by_item, b.year_start, b.today)
    return _portal_listing(totals.withColumnRenamed("total_time_taken_second", "total_second"))


def _portal_listing(totals: DataFrame) -> DataFrame:
    return totals.select(*_listing(totals, "portal_item_id"), "successful_hits", "failed_hits")


def portal_marts(by_item: DataFrame, b: ReportBoundaries) -> dict[str, DataFrame]:
    """The four portal tables from one scan."""
    cube = Cube(by_item, b, ["portal_item_id"], ITEM_SUMS, group=[])
    hits = ("successful_hits", "failed_hits")
    return {
        "portal_evolution": cube.at("group").select("range", "local_date", *hits),
        "portal_leaderboards": _portal_ranking(cube.at("total")),
        "portal_complete": _portal_listing(cube.totals().orderBy("portal_item_id")),
        "portal_detail": cube.at("detail").select("range", "portal_item_id", "local_date", *hits),
    }


def mart_device_leaderboard(by_device: DataFrame, b: ReportBoundaries) -> DataFrame:
    totals = _sums(_ranked(by_device, b), ["device_id"], DEVICE_SUMS, "hits")
    top = L.top_k(totals, ["range"], "hits", ["device_id"], L.BAR_SIZE)
    return _device_bars(L.name_top_devices(top, by_device))


def _device_bars(top: DataFrame) -> DataFrame:
    return top.select("range", "rank", device_label(F.col("username"), F.col("device_id")).alias("label"), "hits")


def mart_device_complete(by_device: DataFrame, b: ReportBoundaries) -> DataFrame:
    totals = Q.device_range_totals(by_device, b.year_start, b.today)
    return _device_listing(totals.withColumnRenamed("total_time_taken_second", "total_second"))


def _device_listing(totals: DataFrame) -> DataFrame:
    return totals.select(*_listing(totals, "username", "device_id"), "last_seen")


def mart_device_detail(by_device: DataFrame, b: ReportBoundaries) -> DataFrame:
    daily = _sums(_series(by_device, b), ["device_id", "local_date"], DEVICE_SUMS, "hits")
    return _device_series(daily, donors(by_device))


def _device_series(daily: DataFrame, names: DataFrame) -> DataFrame:
    return daily.join(names, "device_id", "left").select(
        "range",
        "device_id",
        device_heading(F.col("donor"), F.col("device_id")).alias("heading"),
        "local_date",
        "hits",
    )


def device_marts(by_device: DataFrame, names: DataFrame, b: ReportBoundaries, prefix: str) -> dict[str, DataFrame]:
    """The three tables of one kind of device from one scan; ``names`` (device_id, donor) of all named devices."""
    cube = Cube(by_device, b, ["device_id"], DEVICE_SUMS)
    top = L.top_k(cube.at("total"), ["range"], "hits", ["device_id"], L.BAR_SIZE)
    named = lambda rows: rows.join(names.withColumnRenamed("donor", "username"), "device_id", "left")
    return {
        f"{prefix}_leaderboard": _device_bars(named(top)),
        f"{prefix}_complete": _device_listing(named(cube.totals())),
        f"{prefix}_detail": _device_series(cube.at("detail"), names),
    }


# The four flat dimensions and the key column each ranks.
FLAT_DIMENSIONS = {
    "forwarded-for-ip": "forwarded_for_ip",
    "referer": "referer",
    "uri": "uri_stem",
    "user-agent": "user_agent",
}


def mart_flat_leaderboards(tables: dict[str, DataFrame], b: ReportBoundaries) -> DataFrame:
    """``tables`` holds the aggregate of each name in ``FLAT_DIMENSIONS``."""
    parts = []
    for dimension, key in FLAT_DIMENSIONS.items():
        table = tables[dimension]
        if dimension == "referer":
            table = filters.filter_referer_present(table)
        parts.append(_both_ranges(table, key, b).withColumn("dimension", F.lit(dimension)))
    totals = reduce(DataFrame.unionByName, parts)
    top = L.top_k(totals, ["dimension", "range"], "hits", ["value"], L.FLAT_SIZE, L.TOP_BUCKETS)
    return top.select(
        "dimension",
        "range",
        "rank",
        "value",
        "hits",
        round3(F.col("second")).alias("total_time_taken_second"),
        _average("second").alias("average_time_taken_second"),
    )


def _both_ranges(table: DataFrame, key: str, b: ReportBoundaries) -> DataFrame:
    """Totals of each key in both ranges, its rows grouped once."""
    rows = filters.filter_date_range(table, min(b.year_start, b.last7_start), b.today)
    ms = F.round(F.col("time_taken_second") * 1000).cast("long")
    starts = {RANGE_ALL: b.year_start, RANGE_LAST_7: b.last7_start}
    inside = {name: F.col("local_date") >= F.lit(start) for name, start in starts.items()}
    sums = rows.groupBy(F.col(key).alias("value")).agg(
        *[F.sum(F.when(now, c)).alias(f"{what} {name}") for name, now in inside.items() for what, c in (("hits", F.col("hits")), ("ms", ms))]
    )
    each = [
        F.struct(
            F.lit(name).alias("range"),
            F.col(f"`hits {name}`").alias("hits"),
            (F.col(f"`ms {name}`").cast("double") / F.lit(1000.0)).alias("second"),
        )
        for name in starts
    ]
    return sums.select("value", F.inline(F.array(*each))).where(F.col("hits").isNotNull())
