"""Parameters that change results. Plain values, passed explicitly to the jobs that use them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

LAST_DAYS = 7


@dataclass(frozen=True)
class HarvestSettings:
    """How log lines become daily aggregates."""

    local_time_zone: str = "UTC"
    portal_web_adaptor_name: str = "portal"
    compute_by_referer_and_uri: bool = False
    # True: convert each line with the zone rules of its own instant. False (default): one
    # offset per target date, the one in force at that date's local midnight.
    exact_zone: bool = False


@dataclass(frozen=True)
class ReportSettings:
    """Which sites the root and service reports cover."""

    local_time_zone: str = "UTC"
    included_roots: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReportBoundaries:
    """Inclusive dates of the two report ranges; both end at ``today``."""

    today: date
    year_start: date
    last7_start: date


def report_boundaries(now_utc: datetime, local_time_zone: str, year: int) -> ReportBoundaries:
    """Report ranges for ``year`` as seen at ``now_utc``.

    ``last7_start`` always counts back from the real local date, so a past year has an empty
    last-seven-days range, and early January reaches into the year before.
    """
    if now_utc.tzinfo is None:
        now_utc = now_utc.replace(tzinfo=timezone.utc)
    local_today = now_utc.astimezone(ZoneInfo(local_time_zone)).date()
    if year > local_today.year:
        raise ValueError(f"year {year} is after the current local year {local_today.year}")
    return ReportBoundaries(
        today=min(local_today, date(year, 12, 31)),
        year_start=date(year, 1, 1),
        last7_start=local_today - timedelta(days=LAST_DAYS - 1),
    )
