"""Column expressions that word numbers and urls for a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(share: Column) -> Column:
    """A share as a whole percentage, half-even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def ratio(value: Column) -> Column:
    return F.concat(F.bround(value, 0).cast("long").cast("string"), F.lit(":1"))


def size(count: Column) -> Column:
    """Bytes with one decimal from a kilobyte on."""
    mega, kilo = 1024 * 1024, 1024
    return (
        F.when(count >= mega, F.format_string("%.1f MB", F.bround(count / mega, 1))).when(count >= kilo, F.format_string("%.1f KB", F.bround(count / kilo, 1))).otherwise(F.concat(count.cast("string"), F.lit(" B")))
    )


def short_url(url: Column) -> Column:
    """Host, path without closing slashes and query, at most 120 characters; what has no host as it is."""
    host, path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1), F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    return F.substring(F.when(host == "", url).otherwise(F.concat(host, path, query)), 1, 120)


def root_url(base: Column, path: Column) -> Column:
    """A path at the root of an url's site; null where the url has none."""
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)", 1)
    return F.when(origin != "", F.concat(origin, F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))))
