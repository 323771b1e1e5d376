"""What a request is about: a map service, a portal item, a login, a device.

Each rule is one anchored pattern over the raw field, so a row that does not match costs one
quick failed comparison, and the value can sit inside a filter or a grouping key without its
parts being evaluated again and again. Repeated slashes count as one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path shapes, product tokens and lengths that identify requests.
PORTAL_SEGMENT = "portal"
SERVICE_TYPE_SUFFIX = "server"
SITE_LENGTH = 16
PORTAL_ITEM_ID_LENGTH = 64
FIELD_MAPS_TOKEN = "arcgis-fieldmaps"
SURVEY_FRAMEWORK_TOKEN = "appframework/"
SURVEY_PRODUCT_TOKEN = "survey123"

_GUID_AT_END = r"(?i)\(([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\)\z"
# The group that follows the first framework token, and in it the item after the last ";+".
_GUID_IN_GROUP = rf"(?is)\A(?>.*?{SURVEY_FRAMEWORK_TOKEN})[^(]*+\((?:[^)]*;\+)?([0-9a-f]{{32}})\)"

# site / rest / services / [folder /] name / type [/ anything]; a folder is preferred.
_SERVICE = (
    rf"(?is)\A/*+(?!{PORTAL_SEGMENT}(?:/|\z))([^/]{{1,{SITE_LENGTH}}})[^/]*+/+rest/+services/+"
    rf"(?:([^/]+)/+([^/]+)/+([^/]*{SERVICE_TYPE_SUFFIX})|([^/]+)/+([^/]*{SERVICE_TYPE_SUFFIX}))(?:/.*)?\z"
)
_SERVICE_PARTS = "$1/$2/$3$5/$4$6"


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def service_key(uri_stem: Column) -> Column:
    """``site/folder/name/type`` in lower case, the folder empty if there is none; NULL when the
    request is not for a service. One text to group by; :func:`service_fields` takes it apart.

    The exclusion of portal traffic is a fixed name, unlike the configurable adaptor name below.
    """
    return F.when(uri_stem.rlike(_SERVICE), F.lower(F.regexp_replace(uri_stem, _SERVICE, _SERVICE_PARTS)))


def service_fields(key: Column) -> list[Column]:
    """``site, folder, service_name, service_type`` of a service key."""
    parts = F.split(key, "/")
    return [
        F.get(parts, F.lit(0)).alias("site"),
        _or_null(F.get(parts, F.lit(1))).alias("folder"),
        F.get(parts, F.lit(2)).alias("service_name"),
        F.get(parts, F.lit(3)).alias("service_type"),
    ]


def portal_item_id(uri_stem: Column, adaptor_name: str) -> Column:
    """Item id of a portal content request, in its own case; NULL otherwise."""
    pattern = (
        rf"(?i)\A/*+\Q{adaptor_name}\E/+sharing/+rest/+content/+"
        r"(?:items|users/+[^/]+/+items|users/+[^/]+/+[^/]+/+items)/+([^/]+)"
    )
    return _or_null(F.substring(F.regexp_extract(uri_stem, pattern, 1), 1, PORTAL_ITEM_ID_LENGTH))


def login_username(uri_stem: Column, adaptor_name: str) -> Column:
    """User name of a portal community request, percent-decoded and lower-cased; NULL otherwise.

    A ``+`` is literal, and a ``%`` that starts no valid escape stays as it is. A name whose escapes
    are not UTF-8 stays as it is too.
    """
    pattern = rf"(?i)\A/*+\Q{adaptor_name}\E/+sharing/+rest/+community/+users/+([^/]+)"
    name = _or_null(F.regexp_extract(uri_stem, pattern, 1))
    escaped = F.regexp_replace(F.replace(name, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(escaped)
    # The decoder puts a replacement character for bytes that are not UTF-8.
    spoilt = decoded.contains("\ufffd") & ~name.rlike("(?i)%EF%BF%BD|\ufffd")
    return F.lower(F.when(spoilt, name).otherwise(decoded))


def field_maps_device_id(user_agent: Column) -> Column:
    """Install id of the field app: a hyphenated GUID in the last parentheses."""
    is_app = user_agent.endswith(")") & user_agent.rlike(f"(?i){FIELD_MAPS_TOKEN}")
    return F.when(is_app, F.lower(_or_null(F.regexp_extract(user_agent, _GUID_AT_END, 1))))


def survey123_device_id(user_agent: Column) -> Column:
    """Install id of the survey app: last ``;+`` item of the first group after the framework token."""
    is_app = user_agent.rlike(f"(?i){SURVEY_PRODUCT_TOKEN}")
    return F.when(is_app, F.lower(_or_null(F.regexp_extract(user_agent, _GUID_IN_GROUP, 1))))
