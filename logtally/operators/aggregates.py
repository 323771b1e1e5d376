"""The ten daily aggregates of ``requests``.

Each takes requests already placed on a ``local_date`` and gives one row per date and key. They
are plain partial-then-final hash aggregations: all measures are fixed-width, so a key holding a
third of all rows is reduced to one row per task before anything is shuffled.
:func:`aggregate_all` computes the ten together from a single pass over the requests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import HarvestSettings
from ..functions.address import normalize_forwarded_for
from ..functions.identity import (
    field_maps_device_id,
    login_username,
    portal_item_id,
    service_fields,
    service_key,
    survey123_device_id,
)
from ..functions.measures import is_failed, is_success, ms_to_seconds
from ..functions.text import (
    REFERER_LENGTH,
    normalize_referer,
    normalize_root,
    normalize_uri_stem,
    normalize_user_agent,
)
from . import filters


def _ok() -> Column:
    return is_success(F.col("status"))


def _time() -> Column:
    return F.col("time_taken_ms").cast("long")


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("long"))


def _flat(requests: DataFrame, *keys: str) -> DataFrame:
    return requests.groupBy("local_date", *keys).agg(
        ms_to_seconds(F.sum(_time())).alias("time_taken_second"), F.count(F.lit(1)).alias("hits")
    )


def aggregate_by_uri(requests: DataFrame) -> DataFrame:
    return _flat(requests.withColumn("uri_stem", normalize_uri_stem(F.col("uri_stem"))), "uri_stem")


def aggregate_by_root(requests: DataFrame) -> DataFrame:
    return _flat(requests.withColumn("root", normalize_root(F.col("uri_stem"))), "root")


def aggregate_by_user_agent(requests: DataFrame) -> DataFrame:
    return _flat(requests.withColumn("user_agent", normalize_user_agent(F.col("user_agent"))), "user_agent")


def aggregate_by_referer(requests: DataFrame) -> DataFrame:
    return _flat(requests.withColumn("referer", normalize_referer(F.col("referer"))), "referer")


def aggregate_by_forwarded_for_ip(requests: DataFrame) -> DataFrame:
    declared = filters.filter_forwarded_declared(requests)
    return _flat(
        declared.withColumn("forwarded_for_ip", normalize_forwarded_for(F.col("forwarded_for"))), "forwarded_for_ip"
    )


def aggregate_by_referer_and_uri(requests: DataFrame) -> DataFrame:
    keyed = requests.withColumn("referer", normalize_referer(F.col("referer"))).withColumn(
        "uri_stem", normalize_uri_stem(F.col("uri_stem"))
    )
    return _flat(keyed, "referer", "uri_stem")


def aggregate_by_service(requests: DataFrame) -> DataFrame:
    """Grouped by one key text, taken apart into its four columns on the few grouped rows."""
    keyed = requests.withColumn("service", service_key(F.col("uri_stem")))
    failed = is_failed(F.col("status"))
    grouped = (
        filters.filter_identity_matched(keyed, "service")
        .groupBy("local_date", "service")
        .agg(
            ms_to_seconds(_sum(F.when(_ok(), _time()))).alias("successful_time_taken_second"),
            ms_to_seconds(_sum(F.when(failed, _time()))).alias("failed_time_taken_second"),
            F.count(F.lit(1)).alias("hits"),
            F.count_if(_ok()).alias("successful_hits"),
            F.count_if(failed).alias("failed_hits"),
        )
    )
    return grouped.select("local_date", *service_fields(F.col("service")), *S.MEASURES[S.BY_SERVICE])


def aggregate_by_portal_item(requests: DataFrame, settings: HarvestSettings = HarvestSettings()) -> DataFrame:
    keyed = requests.withColumn(
        "portal_item_id", portal_item_id(F.col("uri_stem"), settings.portal_web_adaptor_name)
    )
    return (
        filters.filter_identity_matched(keyed, "portal_item_id")
        .groupBy("local_date", "portal_item_id")
        .agg(
            ms_to_seconds(F.sum(_time())).alias("time_taken_second"),
            F.count(F.lit(1)).alias("hits"),
            F.count_if(_ok()).alias("successful_hits"),
            F.count_if(is_failed(F.col("status"))).alias("failed_hits"),
        )
    )


# --- devices -------------------------------------------------------------------------------

# Fixed-width fields of a login's order, and the character between its parts.
_SECONDS_WIDTH, _POSITION_WIDTH, _SEPARATOR = 12, 19, "\u0001"
_LOGIN_PARTS = rf"(?s)\A[^{_SEPARATOR}]*{_SEPARATOR}[^{_SEPARATOR}]*{_SEPARATOR}.{{{2 * _POSITION_WIDTH}}}(.*)\z"


def _seconds_of_era(ts: Column) -> Column:
    """Seconds since the year 1 of a time without zone: never negative, the same in any session zone."""
    days = F.datediff(F.to_date(ts), F.lit("0001-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def with_login(requests: DataFrame, settings: HarvestSettings) -> DataFrame:
    """Adds ``login``: a successful login as one text that sorts by time, file and place in the
    file and ends in the username; NULL for any other request."""
    name = F.when(_ok(), login_username(F.col("uri_stem"), settings.portal_web_adaptor_name))
    text = F.format_string(
        f"%0{_SECONDS_WIDTH}d{_SEPARATOR}%s{_SEPARATOR}%0{_POSITION_WIDTH}d%0{_POSITION_WIDTH}d%s",
        _seconds_of_era(F.col("utc_ts")),
        F.col("file"),
        F.col("block_start"),
        F.col("line_id"),
        F.col("login_username"),
    )
    return requests.withColumn("login_username", name).withColumn(
        "login", F.when(F.col("login_username").isNotNull(), text)
    )


def first_login(per_login: DataFrame, keys: Sequence[str] = ("local_date", "device_id")) -> DataFrame:
    """Device rows at login grain to one row per device and date: hits and time add up, and the
    earliest login of the date names the user.

    Two steps, because a minimum over texts makes Spark sort its input. Putting the login into
    the grouping key first leaves that sort only one row per device, date and login; the large
    step before it stays a hash aggregation.
    """
    return per_login.groupBy(*keys).agg(
        F.regexp_extract(F.min("login"), _LOGIN_PARTS, 1).alias("username"),
        F.sum("time_taken_ms").alias("time_taken_ms"),
        F.sum("hits").alias("hits"),
    )


def _by_device(requests: DataFrame, device_id: Column, settings: HarvestSettings) -> DataFrame:
    device_requests = filters.filter_identity_matched(requests.withColumn("device_id", device_id), "device_id")
    per_login = (
        with_login(device_requests, settings)
        .groupBy("local_date", "device_id", "login")
        .agg(F.sum(_time()).alias("time_taken_ms"), F.count(F.lit(1)).alias("hits"))
    )
    return first_login(per_login).select(
        "local_date",
        "device_id",
        "username",
        ms_to_seconds(F.col("time_taken_ms")).alias("time_taken_second"),
        "hits",
    )


def aggregate_by_field_maps_device(
    requests: DataFrame, settings: HarvestSettings = HarvestSettings()
) -> DataFrame:
    return _by_device(requests, field_maps_device_id(F.col("user_agent")), settings)


def aggregate_by_survey123_device(
    requests: DataFrame, settings: HarvestSettings = HarvestSettings()
) -> DataFrame:
    return _by_device(requests, survey123_device_id(F.col("user_agent")), settings)


# --- all ten in one pass ---------------------------------------------------------------------

INVALID_LINES, VALID_LINES = "invalid_lines", "valid_lines"
_LENGTH_WIDTH = len(str(REFERER_LENGTH))


def _packed_keys(settings: HarvestSettings) -> dict[str, Column]:
    """The key of each table as one text, NULL where the request does not belong to it."""
    referer = F.col("k_referer")
    keys = {
        S.BY_URI: F.col("k_uri"),
        S.BY_ROOT: normalize_root(F.col("uri_stem")),
        S.BY_USER_AGENT: normalize_user_agent(F.col("user_agent")),
        S.BY_REFERER: referer,
        S.BY_FORWARDED_FOR_IP: normalize_forwarded_for(F.col("forwarded_for")),
        S.BY_REFERER_AND_URI: F.concat(
            F.lpad(F.length(referer).cast("string"), _LENGTH_WIDTH, "0"), referer, F.col("k_uri")
        ),
        S.BY_SERVICE: service_key(F.col("uri_stem")),
        S.BY_PORTAL_ITEM: portal_item_id(F.col("uri_stem"), settings.portal_web_adaptor_name),
        S.BY_FIELD_MAPS_DEVICE: F.concat(F.col("k_field"), F.lit(_SEPARATOR), F.coalesce("login", F.lit(""))),
        S.BY_SURVEY123_DEVICE: F.concat(F.col("k_survey"), F.lit(_SEPARATOR), F.coalesce("login", F.lit(""))),
    }
    if not settings.compute_by_referer_and_uri:
        del keys[S.BY_REFERER_AND_URI]
    return keys


def _unpacked_keys() -> list[Column]:
    """Stored key columns out of ``table_name`` and the packed ``key``."""
    key = F.col("key")

    def of(*tables: str, value: Column) -> Column:
        return F.when(F.col("table_name").isin(*tables), value)

    pair = of(S.BY_REFERER_AND_URI, value=F.substring(key, 1, _LENGTH_WIDTH).try_cast("int"))
    after = F.lit(_LENGTH_WIDTH + 1)
    of_pair = F.col("table_name") == S.BY_REFERER_AND_URI
    device, login = F.substring_index(key, _SEPARATOR, 1), F.substr(key, F.instr(key, _SEPARATOR) + 1)
    return [
        F.when(of_pair, F.substr(key, after + pair)).otherwise(of(S.BY_URI, value=key)).alias("uri_stem"),
        of(S.BY_ROOT, value=key).alias("root"),
        of(S.BY_USER_AGENT, value=key).alias("user_agent"),
        F.when(of_pair, F.substr(key, after, pair)).otherwise(of(S.BY_REFERER, value=key)).alias("referer"),
        of(S.BY_FORWARDED_FOR_IP, value=key).alias("forwarded_for_ip"),
        *service_fields(of(S.BY_SERVICE, value=key)),
        of(S.BY_PORTAL_ITEM, value=key).alias("portal_item_id"),
        of(*S.DEVICE_TABLES, value=device).alias("device_id"),
        of(*S.DEVICE_TABLES, value=F.nullif(login, F.lit(""))).alias("login"),
        of(INVALID_LINES, VALID_LINES, value=key).alias("file"),
    ]


def aggregate_all(requests: DataFrame, settings: HarvestSettings) -> DataFrame:
    """All aggregates from one pass over the requests, as ``table_name`` plus the union of their
    key columns. Device rows come at login grain and still need :func:`first_login`.

    Every key is packed into one text and the ten are unpivoted, so the aggregation sees narrow
    rows ``(table, date, key)`` and one hash map, combines them within each task, and shuffles
    grouped rows once. Keys are taken apart again on the grouped rows.

    ``requests`` may include rejected lines (``reason`` set) and lines without ``local_date``. Those
    marked ``counted`` are counted per file, under the names ``valid_lines`` and ``invalid_lines``.
    """
    if "counted" not in requests.columns:
        requests = requests.withColumns({"reason": F.lit(None).cast("string"), "counted": F.lit(False)})
    prepared = with_login(requests, settings).select(
        "*",
        normalize_uri_stem(F.col("uri_stem")).alias("k_uri"),
        normalize_referer(F.col("referer")).alias("k_referer"),
        field_maps_device_id(F.col("user_agent")).alias("k_field"),
        survey123_device_id(F.col("user_agent")).alias("k_survey"),
    )
    keys = _packed_keys(settings) | {
        INVALID_LINES: F.when(F.col("counted") & F.col("reason").isNotNull(), F.col("file")),
        VALID_LINES: F.when(F.col("counted") & F.col("reason").isNull(), F.col("file")),
    }
    tags = {t: str(i) for i, t in enumerate(keys)}
    wide = prepared.select("local_date", "status", _time().alias("ms"), *[k.alias(tags[t]) for t, k in keys.items()])
    grouped = (
        wide.unpivot(["local_date", "status", "ms"], list(tags.values()), "tag", "key")
        .where(F.col("key").isNotNull() & (F.col("local_date").isNotNull() | F.col("tag").isin(tags[INVALID_LINES], tags[VALID_LINES])))
        .groupBy("tag", "local_date", "key")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.count_if(_ok()).alias("successful_hits"),
            _sum(F.col("ms")).alias("time_taken_ms"),
            _sum(F.when(_ok(), F.col("ms"))).alias("successful_time_taken_ms"),
        )
    )
    name = F.coalesce(*[F.when(F.col("tag") == tag, F.lit(t)) for t, tag in tags.items()])
    measures = ("hits", "successful_hits", "time_taken_ms", "successful_time_taken_ms")
    return grouped.select(name.alias("table_name"), "local_date", "key", *measures).select(
        "table_name", "local_date", *_unpacked_keys(), *measures
    )


def as_table(stored: DataFrame, name: str) -> DataFrame:
    """One aggregate table, with its own columns, out of rows in the stored layout."""
    failed_ms = F.col("time_taken_ms") - F.col("successful_time_taken_ms")
    derived = {
        "time_taken_second": ms_to_seconds(F.col("time_taken_ms")),
        "successful_time_taken_second": ms_to_seconds(F.col("successful_time_taken_ms")),
        "failed_time_taken_second": ms_to_seconds(failed_ms),
        "failed_hits": F.col("hits") - F.col("successful_hits"),
    }
    return stored.where(F.col("table_name") == name).select(
        *[derived[c].alias(c) if c in derived else F.col(c) for c in S.table_columns(name)]
    )
