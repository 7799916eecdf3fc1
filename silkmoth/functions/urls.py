"""URL parsing, normalising and filtering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of paths worth following (fixed values, compared with case).
DESIRED = (".htm", ".html", ".xml", ".rss")
#: Ports by scheme (fixed values).
HTTP_PORT, HTTPS_PORT = 80, 443


def parse_url(url: Column) -> Column:
    """``struct<protocol, host, port, path>`` of an absolute http(s) URL, else null.

    Blanks around it do not count; the scheme is compared with case. The authority
    ends at the first ``/`` only, so a query before it stays in the host. Without a
    slash the path is ``/``; without an authority host is null and port 0. A port
    that is no number gives the scheme's.
    """
    s = F.trim(url)
    protocol = F.regexp_extract(s, "^(https?)://", 1)
    rest = F.regexp_replace(s, "^https?://", "")
    authority = F.substring_index(rest, "/", 1)
    path = F.when(F.contains(rest, F.lit("/")), F.substr(rest, F.length(authority) + 1)).otherwise("/")
    number = F.regexp_extract(authority, "^[^:]*:([+-]?[0-9]+)$", 1)
    default = F.when(protocol == "https", F.lit(HTTPS_PORT)).otherwise(F.lit(HTTP_PORT))
    port = F.when(authority == "", F.lit(0)).otherwise(F.coalesce(number.try_cast("int"), default))
    host = F.when(authority == "", F.lit(None)).otherwise(F.substring_index(authority, ":", 1))
    parts = F.struct(protocol.alias("protocol"), host.alias("host"), port.alias("port"), path.alias("path"))
    return F.when((protocol != "") & (F.length(s) >= 8), parts)


def normalize(parts: Column) -> Column:
    """``protocol://host:port/path`` with the port written out; null without a host."""
    return F.concat(parts["protocol"], F.lit("://"), parts["host"], F.lit(":"), parts["port"].cast("string"), parts["path"])


def is_desired(path: Column) -> Column:
    """Whether a path has no dot or ends like a page; false for null."""
    ends = F.lit(False)
    for e in DESIRED:
        ends = ends | F.endswith(path, F.lit(e))
    return F.coalesce(~F.contains(path, F.lit(".")) | ends, F.lit(False))


def absolutise(href: Column, base: Column) -> Column:
    """``href`` of a page as an absolute URL; ``base`` is the page's parsed URL.

    Other schemes than http(s) give null, and so does a reference that is empty or
    names a place in the page itself.
    """
    h = F.trim(href)
    origin = F.concat(base["protocol"], F.lit("://"), base["host"], F.when(base["port"] == F.when(base["protocol"] == "https", F.lit(HTTPS_PORT)).otherwise(F.lit(HTTP_PORT)), F.lit("")).otherwise(F.concat(F.lit(":"), base["port"].cast("string"))))
    page = F.regexp_replace(base["path"], "[?#].*$", "")
    folder = F.regexp_replace(page, "[^/]*$", "")
    return (
        F.when(h.rlike("(?i)^https?://"), h)
        .when(h.rlike("^//"), F.concat(base["protocol"], F.lit(":"), h))
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when((h == "") | h.rlike("^#"), F.lit(None))
        .when(h.rlike("^[?]"), F.concat(origin, page, h))
        .when(h.rlike("^/"), F.concat(origin, h))
        .otherwise(F.concat(origin, folder, h))
    )


def host_port(parts: Column) -> Column:
    """Key of robots rules and politeness."""
    return F.concat(parts["host"], F.lit(":"), parts["port"].cast("string"))
