"""The bounded crawl of a site's sitemaps over recorded responses: candidates, a frontier of child files, budgets of files and urls.

Responses (``fetch``: site_id, url, final_url, status, body, ...) are joined by site and url, first for what robots.txt names, then for the children of
index files; a url that was never fetched counts as a failed response. What one site may ask for is bounded (``FILES`` names and ``FILES`` - 1 children of each
candidate), so the order of the crawl, its seen-set and its budgets are folds over short arrays of the site's own row. Null bodies count as empty; a site
without robots.txt names no file; of repeated responses to one url the first by final url and body is taken.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import hostname, urljoin
from sitegauge.runtime import cut
from sitegauge.sources.xml import below, child_text, root, xml

from .site_evidence import sitemap_references

#: Fixed values.
SPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
FILES, URLS, PAGES = 4, 25, 5
_ENTRY = "struct<loc:string,lastmod:string>"
_FILE = f"struct<url:string,final_url:string,ok:boolean,valid:boolean,is_index:boolean,locations:int,dated:boolean,missing:int,bad:int,future:int,entries:array<{_ENTRY}>,children:array<string>>"


def lastmod_day(value: Column) -> Column:
    """The day of a lastmod: a date, or a time, which counts in UTC; null where it is none."""
    v = F.trim(value)
    timed = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([01][0-9]|2[0-3]):([0-5][0-9])(?::[0-5][0-9](?:[.,][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
    part = lambda k: F.regexp_extract(v, timed, k)
    zone = part(4)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    day = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")
    shift = F.floor((part(2).try_cast("int") * 60 + part(3).try_cast("int") - minutes) / 1440).cast("int")
    whole = F.contains(v, F.lit("T")) | F.endswith(v, F.lit("Z"))
    return F.when(~v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(None).cast("date")).when(~whole, day).when(v.rlike(timed), F.date_add(day, shift))


def parsed(fetches: DataFrame, as_of: str, most_urls: int = URLS, most_files: int = FILES) -> DataFrame:
    """(site_id, url, file): each response as a sitemap: whether it is one, its locations, the faults of all its dates, its first entries and children.

    Of an index the children are its locations, of a urlset the entries; elements without a location do not count.
    """
    first = fetches.select("site_id", "url", F.coalesce("final_url", "url").alias("final_url"), F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False)).alias("ok"), F.coalesce("body", F.lit("")).alias("body"))
    first = first.groupBy("site_id", "url").agg(F.min(F.struct("final_url", "ok", "body")).alias("x")).select("site_id", "url", "x.*")
    today = F.to_date(F.lit(as_of))
    d = xml(first, deepest=1).withColumn("is_index", F.coalesce(root() == "sitemapindex", F.lit(False)))
    told = F.when(F.col("is_index"), below(1, "sitemap")).when(root() == "urlset", below(1, "url"))
    located = F.filter(F.transform(told, lambda n: F.struct(child_text(n, "loc", SPACE).alias("loc"), child_text(n, "lastmod", SPACE).alias("lastmod"))), lambda e: e["loc"].isNotNull())
    d = d.withColumn("e", F.coalesce(located, F.array().cast(f"array<{_ENTRY}>"))).drop("xml_nodes")
    d = d.withColumn("entries", F.when(F.col("is_index"), F.array().cast(f"array<{_ENTRY}>")).otherwise(F.col("e"))).withColumn("days", F.transform("entries", lambda e: F.struct(e["lastmod"].isNull().alias("missing"), lastmod_day(e["lastmod"]).alias("day"))))
    count = lambda test: F.size(F.filter("days", test))
    file = F.struct(
        F.col("url"), F.col("final_url"), F.col("ok"), (F.col("ok") & (F.size("e") > 0)).alias("valid"), F.col("is_index"), F.size("e").alias("locations"), F.exists("entries", lambda e: e["lastmod"].isNotNull()).alias("dated"),
        count(lambda x: x["missing"]).alias("missing"), count(lambda x: ~x["missing"] & x["day"].isNull()).alias("bad"), count(lambda x: F.coalesce(x["day"] > today, F.lit(False))).alias("future"),
        F.slice("entries", 1, most_urls).alias("entries"), F.when(F.col("is_index"), F.slice(F.transform("e", lambda x: x["loc"]), 1, max(most_files - 1, 1))).otherwise(F.array().cast("array<string>")).alias("children"),
    )
    return d.select("site_id", "url", file.cast(_FILE).alias("file"))


def _failed(url: Column) -> Column:
    """The response of a url that was never fetched."""
    none = {"url": url, "final_url": url, "ok": F.lit(False), "valid": F.lit(False), "is_index": F.lit(False), "dated": F.lit(False), "entries": F.array(), "children": F.array()}
    return F.struct(*[none.get(c, F.lit(0)).alias(c) for c in ("url", "final_url", "ok", "valid", "is_index", "locations", "dated", "missing", "bad", "future", "entries", "children")]).cast(_FILE)


def candidates(sites: DataFrame, robots: DataFrame, files: DataFrame, most_files: int = FILES) -> DataFrame:
    """(site_id, root, named, asked, seen, files): per site (site_id, root) the sitemaps that answered: its usual one, then those that robots.txt names, the first ``most_files`` of them.

    A name is passed over if it, or a response so far, was that url. ``robots``: (site_id, body) of robots.txt files that answered; ``files``: parsed().
    """
    named = sitemap_references(robots).groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("names"))
    asked = sites.join(named, "site_id", "left").select(
        "site_id", "root", F.col("names").isNotNull().alias("named"), F.posexplode(F.concat(F.array(F.concat("root", F.lit("/sitemap.xml"))), F.transform(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, most_files), lambda n: urljoin(F.col("root"), n)))).alias("ordinal", "url")
    )
    got = asked.join(files, ["site_id", "url"], "left").select("site_id", "root", "named", "ordinal", F.coalesce("file", _failed(F.col("url"))).alias("file"))
    rows = got.groupBy("site_id", "root", "named").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "file"))), lambda x: x["file"]).alias("asked"))
    none = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{_FILE}>").alias("files"), F.lit(0).alias("fetched"))

    def step(acc: Column, f: Column) -> Column:
        usual = acc["fetched"] == 0  # the usual one is always asked for
        skip = F.array_contains(acc["seen"], f["url"])
        take = f["ok"] & (usual | ~F.array_contains(acc["seen"], f["final_url"]))
        more = F.struct(F.concat(acc["seen"], F.array(f["url"], f["final_url"])).alias("seen"), F.when(take, F.concat(acc["files"], F.array(f))).otherwise(acc["files"]).alias("files"), (acc["fetched"] + 1).alias("fetched"))
        return F.when(skip, acc).otherwise(more)

    return rows.withColumn("x", F.aggregate("asked", none, step)).select("site_id", "root", "named", "x.seen", "x.files", "x.fetched")


def crawl(candidate_files: DataFrame, files: DataFrame, most_files: int = FILES, most_urls: int = URLS) -> DataFrame:
    """Per site the sample of its sitemaps: files, is_index, invalid (files that are none), missing, bad and future dates of all entries of the files read, and the first ``most_urls`` entries.

    The first ``most_files`` candidates are read in order, a broken one uses up its place. Children of an index are read while files are left
    and were not seen; reading ends with the last url of the budget.
    """
    c = candidate_files.withColumn("files", F.slice("files", 1, most_files))
    index = c.select("site_id", F.posexplode("files").alias("c", "f")).where("f.is_index")
    asked = index.select("site_id", "c", "f.final_url", F.posexplode("f.children").alias("i", "loc")).select("site_id", "c", "i", urljoin(F.col("final_url"), F.col("loc")).alias("url"))
    kids = asked.join(files, ["site_id", "url"], "left").groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("c", "i", F.coalesce("file", _failed(F.col("url"))).alias("file")))).alias("kids"))
    rows = c.join(kids, "site_id", "left")
    state = F.struct(
        F.lit(0).alias("files"), F.lit(False).alias("is_index"), F.lit(0).alias("invalid"), *[F.lit(0).cast("long").alias(n) for n in ("missing", "bad", "future")], F.array().cast(f"array<{_ENTRY}>").alias("entries"), F.col("seen"), F.lit(0).alias("c")
    )

    def read(acc: Column, f: Column, at: Column, seen: Column) -> Column:
        good = f["valid"]
        plus = lambda n: (acc[n] + F.when(good, f[n]).otherwise(0)).cast("long").alias(n)
        left = F.greatest(F.lit(most_urls) - F.size(acc["entries"]), F.lit(0))
        return F.struct(
            (acc["files"] + good.cast("int")).alias("files"), (acc["is_index"] | (good & f["is_index"] & at.isNotNull())).alias("is_index"), (acc["invalid"] + (~good).cast("int")).alias("invalid"), plus("missing"), plus("bad"), plus("future"),
            F.when(good, F.concat(acc["entries"], F.slice(f["entries"], F.lit(1), left))).otherwise(acc["entries"]).alias("entries"), seen.alias("seen"), F.coalesce(at, acc["c"]).alias("c"),
        )

    def child(acc: Column, k: Column) -> Column:
        f = k["file"]
        return F.when(F.array_contains(acc["seen"], f["url"]) | (F.size(acc["entries"]) >= most_urls), acc).otherwise(read(acc, f, F.lit(None).cast("int"), F.concat(acc["seen"], F.array(f["url"], f["final_url"]))))

    def candidate(acc: Column, f: Column) -> Column:
        after = read(acc, f, acc["c"] + 1, acc["seen"])
        own = F.filter(F.coalesce("kids", F.array().cast(f"array<struct<c:int,i:int,file:{_FILE}>>")), lambda k: (k["c"] == acc["c"]))
        # one pass over an array of one, so that what is read is there by name
        inner = F.transform(F.array(after), lambda a: F.aggregate(F.filter(own, lambda k: f["valid"] & f["is_index"] & (F.size(a["entries"]) < most_urls) & (k["i"] < F.lit(most_files) - a["files"])), a, child))
        return F.when(F.size(acc["entries"]) >= most_urls, acc).otherwise(F.get(inner, F.lit(0)))

    return rows.withColumn("s", F.aggregate("files", state, candidate)).select("site_id", "root", "named", "s.files", "s.is_index", "s.invalid", "s.missing", "s.bad", "s.future", "s.entries")


def sitemap_sample(crawled: DataFrame) -> DataFrame:
    """A row a site of crawl(): files, index, faults of dates and of the sampled urls, and whether the sample is clean: of this site, by https, without a repeat."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    urls, entries = F.size("entries").cast("long"), F.col("entries")
    count = lambda test: F.size(F.filter(entries, test)).cast("long")
    out = crawled.select(
        "site_id", F.col("files").cast("long").alias("files"), "is_index", F.col("invalid").cast("long").alias("invalid_files"), "named", urls.alias("urls"), (urls - F.size(F.array_distinct(F.transform(entries, lambda e: e["loc"])))).alias("duplicates"),
        count(lambda e: (hostname(e["loc"]) != "") & (bare(hostname(e["loc"])) == bare(hostname(F.col("root"))))).alias("same_site"), count(lambda e: ~F.lower(e["loc"]).startswith("https:")).alias("non_https"), count(lambda e: e["lastmod"].isNotNull()).alias("dated"),
        F.col("missing").alias("undated"), F.col("bad").alias("bad_dates"), F.col("future").alias("future_dates"),
    )
    return out.withColumn("clean", (F.col("urls") > 0) & (F.col("same_site") == F.col("urls")) & (F.col("non_https") == 0) & (F.col("duplicates") == 0))


def best_sitemap(candidate_files: DataFrame) -> DataFrame:
    """Per site the candidate with the most locations, the first of equals: valid, urls, dated, is_index; and whether robots.txt names any."""
    rated = F.transform("files", lambda f, k: F.struct(F.when(f["valid"], f["locations"]).otherwise(0).alias("n"), (-k).alias("k"), f["dated"].alias("dated"), f["is_index"].alias("is_index")))
    best = candidate_files.select("site_id", "named", F.array_max(rated).alias("x")).withColumn("valid", F.coalesce(F.col("x.n") > 0, F.lit(False)))
    return best.select("site_id", "valid", F.when(F.col("valid"), F.col("x.n")).otherwise(0).cast("long").alias("urls"), (F.col("valid") & F.col("x.dated")).alias("dated"), (F.col("valid") & F.col("x.is_index")).alias("is_index"), F.col("named").alias("in_robots"))


def sampled_pages(crawled: DataFrame, most: int = PAGES) -> DataFrame:
    """(site_id, place, loc, lastmod) of the first ``most`` sampled entries of each site: the pages that are looked at."""
    return crawled.select("site_id", F.posexplode(F.slice("entries", 1, most)).alias("place", "e")).select("site_id", F.col("place").cast("long").alias("place"), "e.loc", "e.lastmod")


def sitemap_entries(fetches: DataFrame) -> DataFrame:
    """(site_id, url, is_index, ordinal, loc, lastmod) of all entries of all sitemaps and indexes, by their elements and namespaces; elements without a location are none."""
    d = xml(fetches.where("status >= 200 and status < 400").select("site_id", "url", "body"), deepest=1)
    told = F.when(root() == "sitemapindex", below(1, "sitemap")).when(root() == "urlset", below(1, "url"))
    entries = F.filter(F.transform(told, lambda n: F.struct(child_text(n, "loc", SPACE).alias("loc"), child_text(n, "lastmod", SPACE).alias("lastmod"))), lambda e: e["loc"].isNotNull())
    d = d.select("site_id", "url", (root() == "sitemapindex").alias("is_index"), F.posexplode(entries).alias("ordinal", "e"))
    return d.select("site_id", "url", "is_index", F.col("ordinal").cast("long").alias("ordinal"), "e.loc", "e.lastmod")


class Maps(NamedTuple):
    """What a crawl of sitemaps reads: sites (site_id, root), robots.txt bodies that answered, responses, and the day that dates are held against."""

    sites: DataFrame
    robots: DataFrame
    fetches: DataFrame
    as_of: str

    def crawled(self) -> DataFrame:
        files = cut(parsed(self.fetches, self.as_of))  # joined twice, parsed once
        return crawl(candidates(self.sites, self.robots, files), files)

    def candidates(self) -> DataFrame:
        return candidates(self.sites, self.robots, parsed(self.fetches, self.as_of))
