"""Operators over fetched side documents: llms.txt, response headers, sitemap and feed bodies, agent catalogs, discovered surfaces.

Null bodies count as empty and null headers say nothing. Repeated rows give a row each, or count each in sums; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import hostname

LEAST_LLMS, STALE_DAYS, CATALOG_BYTES = 20, 180, 500 * 1024
SEMVER = r"^[0-9]+\.[0-9]+(\.[0-9]+)?([\-+][0-9A-Za-z.\-]+)?$"


def llms(rows: DataFrame) -> DataFrame:
    """Validity of every llms.txt body: long enough, titled, with an address or a Markdown link."""
    t = F.regexp_replace(F.coalesce("body", F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    short, title = F.length(t) < LEAST_LLMS, F.startswith(t, F.lit("#"))
    link = t.rlike(r"""https?://[^ \t\r\n)>"]+""") | t.rlike(r"\[[^\]]+\]\([^)]+\)")
    valid = ~short & title & link
    return rows.select("site_id", short.alias("short"), title.alias("titled"), link.alias("linked"), F.when(valid, 2).when(t != "", 1).otherwise(0).cast("long").alias("points"))


def headers(rows: DataFrame) -> DataFrame:
    """From response headers (site_id, name, value): negotiation by Accept, and hints at a text version."""
    name, value = F.lower("name"), F.lower("value")
    other = ~name.isin("content-type", "vary", "link", "content-location", "content-signal", "content-signals")
    link = (name == "link") & F.contains(value, F.lit("alternate")) & value.rlike(r"text/markdown|text/plain|\.md|llms")
    return rows.groupBy("site_id").agg(
        F.bool_or((name == "vary") & F.exists(F.split(value, ","), lambda v: F.trim(v).isin("accept", "*"))).alias("vary_accept"), F.bool_or(link).alias("link_hint"),
        F.bool_or((name == "content-location") & value.rlike(r"\.(md|markdown|txt)$")).alias("location_hint"), F.bool_or(name.isin("content-signal", "content-signals")).alias("signal"),
        F.bool_or(other & F.concat(name, F.lit(": "), value).rlike("llms|markdown|agent|token")).alias("other_hint"),
    )


def _part(tag: str) -> str:
    return rf"(?is)<(?:[a-z]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[a-z]+:)?{tag}\s*>"


def feed_freshness(rows: DataFrame, as_of: str) -> DataFrame:
    """Items, dated items, faulty dates and the latest date of every feed, and whether it is stale on a given day."""
    today = F.to_date(F.lit(as_of))
    items = F.size(F.regexp_extract_all("body", F.lit(r"(?i)<(item|entry)[\s>]"), F.lit(1))).cast("long")
    texts = F.flatten(F.array(*[F.regexp_extract_all("body", F.lit(_part(t)), F.lit(1)) for t in ("pubDate", "updated", "published")]))

    def day(x):
        mail = F.try_to_date(F.regexp_extract(x, r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", 1), "d MMM yyyy")
        return F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")).otherwise(mail)

    dated = rows.select("site_id", items.alias("items"), F.transform(texts, lambda x: day(F.trim(x))).alias("d"))
    good = F.filter("d", lambda x: x.isNotNull() & (x <= today))
    latest = F.array_max(good)
    return dated.select(
        "site_id", "items", F.size(good).cast("long").alias("dated"), (F.size("d") - F.size(good)).cast("long").alias("faulty"), latest.alias("latest"), F.coalesce(F.datediff(today, latest) > STALE_DAYS, F.lit(True)).alias("stale")
    )


def catalogs(rows: DataFrame) -> DataFrame:
    """Faults of every agent catalog: not an object, version, host, entries, and entries whose identifier is not the host's urn."""
    m = F.from_json("body", "map<string,string>")
    rows = rows.select("site_id", "host", F.when(F.startswith(F.ltrim("body"), F.lit("{")) & (F.octet_length("body") <= CATALOG_BYTES), m).alias("m"))
    version = F.trim(F.col("m")["specVersion"])
    domain = F.lower(F.from_json(F.col("m")["host"], "map<string,string>")["domain"])
    own = lambda d: (d == F.col("host")) | F.endswith(d, F.concat(F.lit("."), F.col("host")))
    entries = F.when(F.startswith(F.col("m")["entries"], F.lit("[")), F.from_json(F.col("m")["entries"], "array<map<string,string>>"))
    rows = rows.select("site_id", "host", F.coalesce(F.size("m") > 0, F.lit(False)).alias("object"), F.coalesce(version.rlike(SEMVER), F.lit(False)).alias("version"), F.coalesce(own(domain), F.lit(False)).alias("own_host"), entries.alias("e"))
    urn = lambda x: F.coalesce(x["identifier"].rlike("^urn:air:[^:]+:.") & own(F.split_part(x["identifier"], F.lit(":"), F.lit(3))), F.lit(False))
    return rows.select("site_id", "object", "version", "own_host", F.coalesce(F.size("e"), F.lit(-1)).cast("long").alias("entries"), F.coalesce(F.size(F.filter("e", lambda x: ~urn(x))), F.lit(0)).cast("long").alias("foreign_entries"))


def orphan_surfaces(surfaces: DataFrame, links: DataFrame) -> DataFrame:
    """Surfaces (site_id, host, path) that were found but that no link to the site's own host leads to (but for ``www.``; compared by path)."""
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract("href", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    linked = links.select("site_id", bare(hostname(F.col("href"))).alias("own"), path.alias("path")).distinct()
    return surfaces.where("found").withColumn("own", bare(F.lower("host"))).join(linked, ["site_id", "own", "path"], "left_anti").select("site_id", "path")


def readiness(passes: DataFrame, probes: DataFrame) -> DataFrame:
    """Half-even percentage of the passed probes of each site in the widest and in the core scope, with its label."""
    rows = passes.join(F.broadcast(probes), "ordinal")
    totals = F.broadcast(probes.agg(F.count("*").alias("n"), F.count_if(F.col("scope") == "core").alias("c")))  # one row
    out = rows.groupBy("site_id").agg(F.count("*").alias("earned"), F.count_if(F.col("scope") == "core").alias("core_earned")).join(totals)
    out = out.select("site_id", "earned", "core_earned", F.bround(F.col("earned") / F.col("n") * 100, 0).cast("long").alias("score"), F.bround(F.col("core_earned") / F.col("c") * 100, 0).cast("long").alias("core_score"))
    return out.withColumn("label", F.when(F.col("score") >= 70, "strong").when(F.col("score") >= 40, "developing").otherwise("limited"))
