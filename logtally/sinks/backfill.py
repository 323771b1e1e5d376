"""Usernames of stored device tables, filled in without reading their history.

Every commit leaves a device named on all its dates or on none. So a store need only keep, in the same
manifest as the tables:

- **donors**: one row per named device, under its earliest date, with its name there;
- **unnamed**: the devices without a name, under each date they were seen on.

New dates then change what is stored for devices that had no name and get one, and for no others: the
older dates to rewrite are a join of those devices with the unnamed ones. The history itself is read only
where a donor's own date is replaced, and then only dates after it, for the devices it was the donor of.
Both tables are kept by date, so that a commit writes the dates that change.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.devices import fill_usernames
from ..session import write_scratch

if TYPE_CHECKING:
    from .store import AggregateStore, Manifest

#: A device, across the tables of both kinds.
TABLE_DEVICE = ("table_name", "device_id")


@dataclass(frozen=True)
class Backfill:
    """What a commit has to write and replace for the device tables.

    ``rows``: all rows of the replaced dates and of ``changed``, the older dates on which a missing username
    is now filled, by table. ``index``: rows of the index tables for ``index_dates``.
    """

    rows: DataFrame
    changed: dict[str, list[date]]
    index: DataFrame
    index_dates: dict[str, list[date]]


def _first_name() -> Column:
    """The earliest date and its name; the alphabetically first of several."""
    return F.min(F.struct("local_date", "username"))


class DeviceIndex:
    """Donors and unnamed devices of the given tables, as of one manifest."""

    def __init__(self, store: AggregateStore, base: Manifest, names: Sequence[str]):
        self.store, self.base, self.names = store, base, names
        #: Tables from before there was an index; theirs is made from their rows, once.
        self.missing = [n for n in names if base.tables.get(n) and S.DONORS[n] not in base.tables]

    def _union(self, of: dict[str, str], from_rows) -> DataFrame:
        parts = []
        for name in self.names:
            if name in self.missing:
                parts.append(from_rows(self.store.read_stored(name, manifest=self.base)).withColumn("table_name", F.lit(name)))
            else:
                parts.append(self.store.read_stored(of[name], manifest=self.base).withColumn("table_name", F.lit(name)))
        return reduce(DataFrame.unionByName, [p.select(*TABLE_DEVICE, "local_date", "username") for p in parts])

    def donors(self) -> DataFrame:
        def first(rows: DataFrame) -> DataFrame:
            named = rows.where(F.col("username").isNotNull()).groupBy("device_id").agg(_first_name().alias("first"))
            return named.select("device_id", "first.*")

        return self._union(S.DONORS, first)

    def unnamed(self) -> DataFrame:
        return self._union(S.UNNAMED, lambda rows: rows.where(F.col("username").isNull()))

    def dates_of(self, index: dict[str, str], name: str) -> list[date]:
        """Dates that the index may hold rows of."""
        held = self.base.dates(name if name in self.missing else index[name])
        return [date.fromisoformat(d) for d in held]

    def recovered(self, lost: DataFrame, dates: Sequence[date]) -> DataFrame | None:
        """The donors that remain for the devices ``lost``, whose earliest date is among the replaced ``dates``.
        All their names are on later dates."""
        parts = []
        for name in self.names:
            gone = [d for d in self.dates_of(S.DONORS, name) if d in set(dates)]
            later = [x for d in self.base.dates(name) if gone and (x := date.fromisoformat(d)) > min(gone) and x not in set(dates)]
            if later:
                rows = self.store.read_dates(name, later, self.base)
                parts.append(rows.select(*TABLE_DEVICE, "local_date", "username"))
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts).where(F.col("username").isNotNull())
        wanted = lost.select(*TABLE_DEVICE)
        return rows.join(wanted, list(TABLE_DEVICE), "left_semi").groupBy(*TABLE_DEVICE).agg(_first_name().alias("first")).select(*TABLE_DEVICE, "first.*")


def backfill(store: AggregateStore, base: Manifest, new: DataFrame, names: Sequence[str], dates: Sequence[date]) -> Backfill:
    """What to write when ``new`` (stored layout) takes the place of ``dates`` in the named device tables."""
    index, columns = DeviceIndex(store, base, names), new.columns
    narrow = (*TABLE_DEVICE, "local_date", "username")
    outside = ~F.col("local_date").isin(list(dates)) if dates else F.lit(True)
    held = index.donors()
    kept = held.where(outside).withColumn("kept_date", F.col("local_date"))
    known = kept
    recovered = index.recovered(held.where(~outside), dates)
    if recovered is not None:
        known = known.unionByName(recovered.withColumn("kept_date", F.lit(None).cast("date")))
    known = known.withColumn("was_named", F.lit(True))
    named = new.where(F.col("username").isNotNull()).select(*narrow)
    fresh = named.withColumns({"kept_date": F.lit(None).cast("date"), "was_named": F.lit(False)})
    best = known.unionByName(fresh).groupBy(*TABLE_DEVICE).agg(
        _first_name().alias("first"), F.max("kept_date").alias("kept_date"), F.max("was_named").alias("was_named")
    )
    best = write_scratch(best.select(*TABLE_DEVICE, F.col("first.username").alias("donor"), F.col("first.local_date").alias("first_date"), "kept_date", "was_named"), "donors")

    unnamed = index.unnamed().where(outside).select(*TABLE_DEVICE, "local_date")
    gained = best.where(~F.col("was_named")).select(*TABLE_DEVICE)
    found = write_scratch(unnamed.join(gained, list(TABLE_DEVICE), "left_semi"), "found")
    # A row per table and date.
    changed = _by_table(found, names)
    parts = [new] + [store.read_dates(name, changed[name], base).select(*columns) for name in names if changed[name]]
    rows = fill_usernames(reduce(DataFrame.unionByName, parts), best.select(*TABLE_DEVICE, "donor"), TABLE_DEVICE)

    seen_unnamed = new.where(F.col("username").isNull()).select(*TABLE_DEVICE, "local_date")
    filled = found.unionByName(seen_unnamed).groupBy(*TABLE_DEVICE).agg(F.min("local_date").alias("filled_date"))
    donors = best.join(filled, list(TABLE_DEVICE), "left").select(
        *TABLE_DEVICE, F.least("first_date", "filled_date").alias("local_date"), F.col("donor").alias("username"), "kept_date"
    )
    donors = write_scratch(donors, "donors-after")
    moved = donors.where(~F.col("local_date").eqNullSafe(F.col("kept_date")))
    touched = _by_table(moved.select("table_name", "local_date").unionByName(moved.where(F.col("kept_date").isNotNull()).select("table_name", F.col("kept_date").alias("local_date"))), names)
    donor_dates, unnamed_dates = {}, {}
    for name in names:
        whole = name in index.missing
        donor_dates[name] = sorted({*dates, *touched[name], *(index.dates_of(S.DONORS, name) if whole else ())})
        unnamed_dates[name] = sorted({*dates, *changed[name], *(index.dates_of(S.UNNAMED, name) if whole else ())})
    still = unnamed.unionByName(seen_unnamed).where(_on(unnamed_dates)).join(best, list(TABLE_DEVICE), "left_anti")
    index_rows = [
        _index_rows(donors.where(_on(donor_dates)), S.DONORS),
        _index_rows(still.withColumn("username", F.lit(None).cast("string")), S.UNNAMED),
    ]
    index_dates = {S.DONORS[n]: donor_dates[n] for n in names} | {S.UNNAMED[n]: unnamed_dates[n] for n in names}
    return Backfill(rows, changed, reduce(DataFrame.unionByName, index_rows), index_dates)


def _by_table(rows: DataFrame, names: Sequence[str]) -> dict[str, list[date]]:
    found = rows.select("table_name", "local_date").distinct().collect()
    return {name: sorted(r.local_date for r in found if r.table_name == name) for name in names}


def _on(dates: dict[str, list[date]]) -> Column:
    return reduce(Column.__or__, [(F.col("table_name") == n) & F.col("local_date").isin(ds) for n, ds in dates.items() if ds], F.lit(False))


def _index_rows(rows: DataFrame, index: dict[str, str]) -> DataFrame:
    name = F.coalesce(*[F.when(F.col("table_name") == n, F.lit(t)) for n, t in index.items()])
    columns = [F.col(c) if c in ("device_id", "username") else F.lit(None).cast(t).alias(c) for c, t in S.STORED_COLUMNS.items()]
    return rows.select(*columns, name.alias("table_name"), "local_date")
