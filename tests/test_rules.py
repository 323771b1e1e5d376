"""Rule cases: input and expected value, positive and negative."""

import pytest
from pyspark.sql import functions as F

from logtally.functions import address, identity, measures, text
from logtally.operators import parsing

GUID = "0A1B2C3D-0000-1111-2222-333344445555"
HEX = "0a1b2c3d" + "e" * 24
FM = "ArcGIS-FieldMaps/24.1"


def evaluate(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = {
    "root": (
        text.normalize_root,
        [
            ("/Mimas/rest/services/A", "mimas"),
            ("//foo/bar", "foo"),
            ("foo", "foo"),
            ("/", "-"),
            ("", "-"),
            ("///", "-"),
            ("/" + "a" * 16, "a" * 16),
            ("/" + "a" * 17 + "/x", "a" * 16),
        ],
    ),
    "uri_stem": (
        text.normalize_uri_stem,
        [("/A\\b", "/A\\b"), ("", ""), ("x" * 1024, "x" * 1024), ("x" * 1025, "x" * 1024)],
    ),
    "user_agent": (
        text.normalize_user_agent,
        [("Moz/5.0+(X)+", "moz/5.0 (x) "), ("A" * 1025, "a" * 1024), ("-", "-")],
    ),
    "referer": (
        text.normalize_referer,
        [
            ("", "-"),
            ("-", "-"),
            ("+++", "-"),
            ("+-+", "-"),
            ("  Https://A/B+C　", "https://a/b c"),
            ("not a url", "not a url"),
            ("x" * 4097, "x" * 4096),
            (" " * 5 + "y" * 4096, "y" * 4096),
        ],
    ),
    "forwarded_for": (
        address.normalize_forwarded_for,
        [
            (None, None),
            ("", "127.0.0.1"),
            ("-", "127.0.0.1"),
            ("203.0.113.9", "203.0.113.9"),
            ("203.0.113.9:51514", "203.0.113.9"),
            ("203.0.113.9:5:6", "203.0.113.9"),
            ("203.0.113.9,+10.0.0.1", "203.0.113.9"),
            (",,203.0.113.9", "203.0.113.9"),
            ("+203.0.113.9+", "203.0.113.9"),
            (" 203.0.113.9 ,x", "203.0.113.9"),
            (" ,203.0.113.9", "-"),
            ("::1", "::1"),
            ("::", "::"),
            ("::ffff:203.0.113.1", "::ffff:203.0.113.1"),
            ("2001:db8:0:0:0:0:0:1", "2001:db8:0:0:0:0:0:1"),
            ("2001:DB8::7,10.0.0.1", "2001:DB8::7"),
            ("1:2:3:4:5:6:7::", "1:2:3:4:5:6:7::"),
            ("[2001:db8::1]:443", "2001:db8::1"),
            ("[2001:db8::1]", "2001:db8::1"),
            ("[2001:db8::1", "-"),
            ("2001:db8::1]", "-"),
            ("[203.0.113.9]:80", "-"),
            ("[not-an-ip]", "-"),
            ("1:2:3:4:5:6:7:8:9", "-"),
            ("not-an-ip", "-"),
            ("999.999.999.999", "-"),
            ("203.0.113.9x", "-"),
            ("2001:zz", "-"),
            ("+", "-"),
            (",", "-"),
        ],
    ),
    "service": (
        identity.service_key,
        [
            ("/Mimas/REST/services/Hosted/Roads/FeatureServer/0/query", "mimas/hosted/roads/featureserver"),
            ("/mimas/rest/services/Base/MapServer", "mimas//base/mapserver"),
            ("/mimas/rest/services/Base/MapServer/export", "mimas//base/mapserver"),
            ("//mimas//rest/services/F/S/GPServer", "mimas/f/s/gpserver"),
            ("/" + "m" * 20 + "/rest/services/S/MapServer", "m" * 16 + "//s/mapserver"),
            # Third segment decides first, so a folder may itself look like a type.
            ("/mimas/rest/services/a/bServer/cServer", "mimas/a/bserver/cserver"),
            ("/mimas/rest/services/a/bServer/c", "mimas//a/bserver"),
            ("/mimas/rest/services", None),
            ("/mimas/rest/services/Base", None),
            ("/mimas/rest/services/a/b/c/dServer", None),
            ("/mimas/rest/servicesnot/Base/MapServer", None),
            ("/mimas/admin/services/Base/MapServer", None),
            ("/Portal/rest/services/Base/MapServer", None),
            ("/portalx/rest/services/Base/MapServer", "portalx//base/mapserver"),
            ("/", None),
            ("", None),
        ],
    ),
    "portal_item": (
        lambda c: identity.portal_item_id(c, "Portal"),
        [
            ("/portal/sharing/rest/content/items/AbC/data", "AbC"),
            ("/PORTAL/Sharing/REST/Content/Items/x", "x"),
            ("/portal/sharing/rest/content/users/u/items/I9", "I9"),
            ("/portal/sharing/rest/content/users/u/f/items/I9/update", "I9"),
            ("/portal/sharing/rest/content/users/u/items/items/z", "items"),
            ("/portal/sharing/rest/content/items/" + "q" * 65, "q" * 64),
            ("/portal/sharing/rest/content/items", None),
            ("/portal/sharing/rest/content/users/u/items", None),
            ("/portal/sharing/rest/content/users/u/f/g/items/I9", None),
            ("/portal/sharing/rest/content/users/u/deleteItems", None),
            ("/other/sharing/rest/content/items/x", None),
        ],
    ),
    "login": (
        lambda c: identity.login_username(c, "portal"),
        [
            ("/portal/sharing/rest/community/users/Ann%40X.org", "ann@x.org"),
            ("/Portal/Sharing/Rest/Community/Users/bob/notifications", "bob"),
            ("/portal/sharing/rest/community/users/a+b", "a+b"),
            ("/portal/sharing/rest/community/users/50%_%41%4", "50%_a%4"),
            ("/portal/sharing/rest/community/users", None),
            ("/portal/sharing/rest/community/self", None),
            ("/other/sharing/rest/community/users/ann", None),
        ],
    ),
    "field_app": (
        identity.field_maps_device_id,
        [
            (f"{FM}+(iOS+17;+iPhone)+({GUID})", GUID.lower()),
            (f"arcgis-FIELDMAPS+(Pad+(2nd+gen))+({GUID})", GUID.lower()),
            (f"{FM}+({GUID})+more", None),
            (f"{FM}+({GUID[:-1]})", None),
            (f"Other/1+({GUID})", None),
            ("-", None),
        ],
    ),
    "survey_app": (
        identity.survey123_device_id,
        [
            (f"Survey123/3.1+AppFramework/5.6+(Android+13;+en;+{HEX.upper()})", HEX),
            (f"AppFramework/5.6+({HEX})+Survey123", HEX),
            (f"survey123+appframework/1+(x;+{HEX})+AppFramework/2+(y)", HEX),
            (f"Survey123+AppFramework/1+(x)+AppFramework/2+({HEX})", None),
            (f"Survey123+AppFramework/1+({HEX};+en)", None),
            (f"Survey123+AppFramework/1+(x;+{HEX}0)", None),
            (f"Survey123+AppFramework/1+(x;+{HEX[:-1]})", None),
            (f"Survey123+AppFramework/1+(x;+{HEX}", None),
            (f"Survey123+AppFramework/1+(x;+{GUID})", None),
            (f"Survey123+(x;+{HEX})", None),
            (f"AppFramework/1+(x;+{HEX})", None),
        ],
    ),
    "int32": (
        parsing.parse_int32,
        [("12", 12), ("+7", 7), ("-3", -3), ("2x0", None), ("1.5", None), ("7L", None), ("2147483648", None), ("", None)],
    ),
    "tsv_text": (
        lambda c: measures.tsv_cell(c, is_text=True),
        [("a\tb\r\nc", "a b  c"), ("=1", "'=1"), ("+1", "'+1"), ("-1", "'-1"), ("@x", "'@x"), ("x=1", "x=1"), (None, "")],
    ),
    "tsv_number": (lambda c: measures.tsv_cell(c.cast("int"), is_text=False), [("-5", "-5"), (None, "")]),
    "round3": (
        lambda c: measures.round3(c.cast("double")),
        [("0.0005", 0.0), ("0.0015", 0.002), ("32.6675", 32.667), ("-1.2345", -1.234), ("7", 7.0)],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    column, cases = CASES[name]
    got = evaluate(spark, column, [c[0] for c in cases])
    assert list(zip([c[0] for c in cases], got)) == cases


def test_utc_timestamp_is_strict(spark):
    good = [("2024-02-29", "23:59:59"), ("0001-01-01", "00:00:00")]
    bad = [
        ("2024-02-30", "00:00:00"), ("2024-2-003", "00:00:00"), ("+024-01-01", "00:00:00"), ("0000-01-01", "00:00:00"),
        ("2024-01-01", "24:00:00"), ("2024-01-01", "1:02:03"), ("2024-01-01", "01:02:3Z"), ("2024-01-01", "01:02:60"),
        ("2024-01-01", "01:02:03.5"), ("-", "-"),
    ]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(good + bad)], "i int, d string, t string")
    got = rows.select("i", parsing.parse_utc_ts(F.col("d"), F.col("t")).cast("string").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [f"{d} {t}" for d, t in good] + [None] * len(bad)


def test_labels_and_averages(spark):
    row = spark.range(1).select(
        measures.service_label(F.lit(None), F.lit("s"), F.lit("mapserver")).alias("plain"),
        measures.service_label(F.lit("f"), F.lit("s"), F.lit("mapserver")).alias("foldered"),
        measures.device_label(F.lit(None).cast("string"), F.lit("d")).alias("unnamed"),
        measures.device_label(F.lit("ann"), F.lit("d")).alias("named"),
        measures.device_heading(F.lit(None).cast("string"), F.lit("d")).alias("heading"),
        measures.average_time(F.lit(3.0), F.lit(0)).alias("table_average"),
        measures.average_time_or_null(F.lit(3.0), F.lit(0)).alias("series_average"),
    ).first()
    assert tuple(row) == ("s (mapserver)", "f/s (mapserver)", "d", "ann · d", "Unattributed » d", 0.0, None)


def test_login_name_that_is_not_utf8_stays_raw(spark):
    names = [("a%FFb", "a%ffb"), ("a%C3%A9", "aé"), ("a%EF%BF%BDb", "a\ufffdb"), ("a%FEb", "a%feb")]
    got = evaluate(spark, lambda c: identity.login_username(F.concat(F.lit("/portal/sharing/rest/community/users/"), c), "portal"), [n for n, _ in names])
    assert got == [want for _, want in names]
