"""Column expressions over urls and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _flat(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.filter(parts, lambda p: p != "."), F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(p)))
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def urljoin(base: Column, ref: Column) -> Column:
    """A reference made absolute against an absolute url; null where the reference is null, the base where it is empty."""
    scheme, host = F.regexp_extract(base, _SCHEME, 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    origin = F.concat(scheme, F.lit("://"), host)
    own, rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(ref.isNull(), F.lit(None).cast("string"))
        .when(ref == "", base)
        .when(F.lower(F.regexp_extract(ref, _SCHEME, 1)) == F.lower(scheme), F.concat(F.lower(scheme), F.regexp_replace(ref, "^[^:]*", "")))
        .when(ref.rlike(_SCHEME), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, _flat(own), rest))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, path, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .otherwise(F.concat(origin, _flat(F.concat(folder, own)), rest))
    )


def hostname(url: Column) -> Column:
    """The host without user and port, lower-cased; empty if the url has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def same_site(a: Column, b: Column) -> Column:
    """Whether two urls are of one host but for ``www.``."""
    x, y = (F.regexp_replace(hostname(u), r"^www\.", "") for u in (a, b))
    return (x != "") & (x == y)


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://[^/?#]"), F.lit(False))


def page_url(url: Column) -> Column:
    """An http(s) url with scheme and host lower-cased, no fragment and no closing slash but that of the root; null for others."""
    scheme, host = F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query)))


def plain_url(url: Column) -> Column:
    """An http(s) url without query, fragment, default port and closing slash but that of the root; null for others."""
    scheme, host = F.lower(F.regexp_extract(url, _SCHEME, 1)), hostname(url)
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path)))


def clean(text: Column) -> Column:
    """White space as one blank, trimmed; null stays."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))


def tokens(text: Column, pattern: str, least: int, stop: tuple[str, ...]) -> Column:
    """The distinct tokens of the lower-cased text that have ``least`` characters and are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) >= least)), F.array(*map(F.lit, stop)))


def codes(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in the rules' order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules]), lambda x: x.isNotNull())


def joined(found: Column) -> Column:
    return F.array_join(found, " ")
