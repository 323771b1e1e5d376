"""Client address out of a forwarded-for field.

An address is a dotted-quad IPv4 (decimal octets) or an IPv6 text form of RFC 4291, with or
without an embedded IPv4 tail. Shortened, octal and hexadecimal IPv4 spellings are not taken
for addresses, nor are IPv6 zone suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ADDRESS_LENGTH = 48
UNDECLARED_CLIENT = "127.0.0.1"
NO_ADDRESS = "-"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """Alternation over the place of ``::`` (or none), each with a plain or an IPv4 tail."""
    group = "[0-9A-Fa-f]{1,4}"
    shapes = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{IPV4}"]
    for left in range(8):
        head = "" if left == 0 else rf"{group}(?::{group}){{{left - 1}}}"
        room = 7 - left
        tail = rf"(?:{group}(?::{group}){{0,{room - 1}}})?" if room else ""
        shapes.append(f"{head}::{tail}")
        if room >= 2:
            shapes.append(rf"{head}::(?:{group}:){{0,{room - 2}}}{IPV4}")
    return "(?:" + "|".join(shapes) + ")"


IPV6 = _ipv6_pattern()


# The first non-empty item of the list: an IPv4 address up to a port or the item's end, an IPv6
# address up to the item's end, or one in brackets followed by anything.
_END = r"\s*(?:,|\z)"
_FIRST_ADDRESS = (
    rf"(?U)\A,*+\s*+\[?((?<!\[)(?:{IPV4}(?=:|{_END})|{IPV6}(?={_END}))|(?<=\[){IPV6}(?=\]))"
)


def normalize_forwarded_for(c: Column) -> Column:
    """First address of the list, without its port; NULL stays NULL (field not declared)."""
    address = F.nullif(F.regexp_extract(F.replace(c, F.lit("+"), F.lit("")), _FIRST_ADDRESS, 1), F.lit(""))
    return F.when((c == "") | (c == "-"), UNDECLARED_CLIENT).when(
        c.isNotNull(), F.substring(F.coalesce(address, F.lit(NO_ADDRESS)), 1, ADDRESS_LENGTH)
    )
