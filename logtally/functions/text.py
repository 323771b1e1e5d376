"""Normalization of the text fields of a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored lengths and placeholders.
URI_STEM_LENGTH = 1024
ROOT_LENGTH = 16
USER_AGENT_LENGTH = 1024
REFERER_LENGTH = 4096
EMPTY = "-"

# Every Unicode white-space character, by code point.
WHITE_SPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def trim_white_space(c: Column) -> Column:
    """Strip all Unicode white space from both ends (plain ``trim`` strips only spaces)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def non_empty_parts(c: Column, separator: str) -> Column:
    """Split on a one-character separator, dropping empty parts. No lambda, so codegen holds."""
    return F.array_remove(F.split(c, separator), "")


def path_segments(uri_stem: Column) -> Column:
    return non_empty_parts(uri_stem, "/")


def normalize_uri_stem(c: Column) -> Column:
    return F.substring(c, 1, URI_STEM_LENGTH)


def normalize_root(c: Column) -> Column:
    """First path segment, lower case; ``-`` when the path has none."""
    first = F.substring_index(F.ltrim(c, F.lit("/")), "/", 1)
    return F.when(first == "", EMPTY).otherwise(F.substring(F.lower(first), 1, ROOT_LENGTH))


def _spaces_for_plus(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("+"), F.lit(" ")))


def _visible(character: Column) -> Column:
    return character.between("!", "~") & (character != "+")


def normalize_user_agent(c: Column) -> Column:
    return F.substring(_spaces_for_plus(c), 1, USER_AGENT_LENGTH)


def normalize_referer(c: Column) -> Column:
    """Trimmed only when an end may be white space; nothing left becomes ``-``."""
    bare = _visible(F.substring(c, 1, 1)) & _visible(F.substring(c, -1, 1))
    text = _spaces_for_plus(c)
    trimmed = F.when(bare, text).otherwise(trim_white_space(text))
    return F.substring(F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(EMPTY)), 1, REFERER_LENGTH)
