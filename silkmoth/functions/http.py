"""Headers, dates and outcomes of HTTP requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def http_date(at: Column) -> Column:
    """RFC 1123 date in GMT; sessions run in UTC."""
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def iso_time(at: Column) -> Column:
    """Date and time to the second, ``2024-03-01T13:05:09``."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def headers(block: Column) -> Column:
    """Map of lower-cased names to values; folded lines belong to the line before, of equal names the last holds.

    For header blocks, which servers bound to some hundred lines.
    """
    unfolded = F.regexp_replace(block, r"\r?\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


#: Outcomes of a request (fixed values); a page's outcome is its type.
ERROR, NOT_MODIFIED, REDIRECT, UNDESIRED = "error", "not_modified", "redirect", "undesired"


def head_outcome(status: Column, location: Column, length: Column, kind: Column, most: int) -> Column:
    """What a HEAD request tells: ``error``, ``not_modified``, ``redirect``, ``undesired`` or the type of a page.

    The codes are those of http and https alike; a redirect's targets differ, see
    :func:`redirect_targets`.
    """
    page = F.contains(kind, F.lit("text/html"))
    fits = F.coalesce(length <= most, F.lit(True))
    ok = (status >= 200) & (status < 300)
    return (
        F.when(status >= 400, ERROR)
        .when(status == 304, NOT_MODIFIED)
        .when((status >= 300) & location.isNotNull(), REDIRECT)
        .when(status >= 300, ERROR)
        .when(ok & fits & F.coalesce(page, F.lit(False)), kind)
        .otherwise(UNDESIRED)
    )


def redirect_targets(location: Column, secure: Column) -> Column:
    """Urls of a Location header: over http a list by commas, over https one url; null gives none."""
    parts = F.transform(F.split(location, ",", -1), lambda x: F.trim(x))
    return F.when(location.isNull(), F.array().cast("array<string>")).when(secure, F.array(F.trim(location))).otherwise(parts)
