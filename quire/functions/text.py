"""Scalar text functions (P2, P4, P9-P13) as native Column expressions.

All run inside whole-stage codegen / the JVM regex engine; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes: every code point whose isspace() is true.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ustrip(s: str | Column) -> Column:
    """Strip white space at both ends exactly as str.strip() does (a linear trim
    over a fixed character set, no regex)."""
    return F.trim(_c(s), F.lit(PY_WHITESPACE))


def sender_address(s: str | Column) -> Column:
    """The address inside the first ``<...>``, else the whole value; NULL or '' -> ''."""
    s = _c(s)
    inner = F.regexp_extract(s, r"<([^>]+)>", 1)
    return (F.when(s.isNull() | (s == ""), F.lit(""))
             .when(s.rlike(r"<[^>]+>"), ustrip(inner))
             .otherwise(ustrip(s)))


def preview_words(s: str | Column, n: int = 5) -> Column:
    """P10: the first n white-space separated words joined by one space."""
    words = F.filter(F.split(_c(s), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def preview_chars(s: str | Column, n: int = 500) -> Column:
    """The first n characters."""
    return F.substring(_c(s), 1, n)


def safe_name(s: str | Column, max_len: int = 255) -> Column:
    """Characters not allowed in folder names -> '_', stripped, cut to max_len."""
    return F.substring(ustrip(F.regexp_replace(_c(s), r'[\\/:*?"<>|]', "_")), 1, max_len)


def mail_date(s: str | Column) -> Column:
    """RFC 2822 date header -> UTC TIMESTAMP; NULL when missing or not a date.

    The weekday is optional and ignored; zones as ``+hhmm`` or a name such as ``GMT``; a
    trailing comment such as ``(UTC)`` is dropped.
    """
    core = F.regexp_replace(ustrip(_c(s)), r"^[A-Za-z]{3},\s*", "")
    core = F.regexp_replace(core, r"\s*\([^)]*\)$", "")  # a trailing zone comment such as (UTC)
    return F.coalesce(F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm:ss XX")),
                      F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm:ss z")),
                      F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm XX")))


def body_decode(s: str | Column) -> Column:
    """base64url text -> UTF-8 string; bad bytes become U+FFFD."""
    raw = F.try_to_binary(F.translate(_c(s), "-_", "+/"), F.lit("base64"))
    return F.make_valid_utf8(raw.cast("string"))
