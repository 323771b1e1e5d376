"""Names and types of the persisted aggregate tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The names of the ten aggregate tables.
BY_URI = "aggregated_by_uri"
BY_ROOT = "aggregated_by_root"
BY_USER_AGENT = "aggregated_by_user_agent"
BY_REFERER = "aggregated_by_referer"
BY_FORWARDED_FOR_IP = "aggregated_by_forwarded_for_ip"
BY_REFERER_AND_URI = "aggregated_by_referer_and_uri"
BY_SERVICE = "aggregated_by_arcgis_service"
BY_PORTAL_ITEM = "aggregated_by_portal_item"
BY_FIELD_MAPS_DEVICE = "aggregated_by_field_maps_device"
BY_SURVEY123_DEVICE = "aggregated_by_survey123_device"

DEVICE_TABLES = (BY_FIELD_MAPS_DEVICE, BY_SURVEY123_DEVICE)

# What a store keeps beside the device tables: per device the earliest date with a username (and the name),
# and the dates on which a device without any was seen.
DONORS = {name: f"{name}_donors" for name in DEVICE_TABLES}
UNNAMED = {name: f"{name}_unnamed" for name in DEVICE_TABLES}
INDEX_TABLES = (*DONORS.values(), *UNNAMED.values())

# Key columns of each table, after local_date.
KEYS: dict[str, tuple[str, ...]] = {
    BY_URI: ("uri_stem",),
    BY_ROOT: ("root",),
    BY_USER_AGENT: ("user_agent",),
    BY_REFERER: ("referer",),
    BY_FORWARDED_FOR_IP: ("forwarded_for_ip",),
    BY_REFERER_AND_URI: ("referer", "uri_stem"),
    BY_SERVICE: ("site", "folder", "service_name", "service_type"),
    BY_PORTAL_ITEM: ("portal_item_id",),
    BY_FIELD_MAPS_DEVICE: ("device_id",),
    BY_SURVEY123_DEVICE: ("device_id",),
}
ALL_TABLES = tuple(KEYS)

_FLAT = ("time_taken_second", "hits")
MEASURES: dict[str, tuple[str, ...]] = {
    name: _FLAT for name in ALL_TABLES
} | {
    BY_SERVICE: (
        "successful_time_taken_second",
        "failed_time_taken_second",
        "hits",
        "successful_hits",
        "failed_hits",
    ),
    BY_PORTAL_ITEM: ("time_taken_second", "hits", "successful_hits", "failed_hits"),
    BY_FIELD_MAPS_DEVICE: ("username",) + _FLAT,
    BY_SURVEY123_DEVICE: ("username",) + _FLAT,
}


def table_columns(name: str) -> tuple[str, ...]:
    return ("local_date", *KEYS[name], *MEASURES[name])


def _type_of(column: str) -> T.DataType:
    if column == "local_date":
        return T.DateType()
    if column.endswith("_second"):
        return T.DoubleType()
    if column.endswith("hits"):
        return T.LongType()
    return T.StringType()


def table_schema(name: str) -> T.StructType:
    """Declared type of one aggregate table."""
    return T.StructType([T.StructField(c, _type_of(c)) for c in table_columns(name)])


# One physical layout holds all ten tables: the union of their columns, seconds kept as whole
# milliseconds so that sums are exact and independent of the order of addition.
STORED_COLUMNS: dict[str, T.DataType] = {
    "uri_stem": T.StringType(),
    "root": T.StringType(),
    "user_agent": T.StringType(),
    "referer": T.StringType(),
    "forwarded_for_ip": T.StringType(),
    "site": T.StringType(),
    "folder": T.StringType(),
    "service_name": T.StringType(),
    "service_type": T.StringType(),
    "portal_item_id": T.StringType(),
    "device_id": T.StringType(),
    "username": T.StringType(),
    "hits": T.LongType(),
    "successful_hits": T.LongType(),
    "time_taken_ms": T.LongType(),
    "successful_time_taken_ms": T.LongType(),
}


def stored_schema() -> T.StructType:
    return T.StructType(
        [T.StructField(c, t) for c, t in STORED_COLUMNS.items()]
        + [T.StructField("table_name", T.StringType()), T.StructField("local_date", T.DateType())]
    )
