"""The whole audit from recorded responses: a registry of thirteen checks with one contract, and a row for every site and check.

A check takes the evidence of all sites and gives (site_id, score, state, evidence), at most a row a site. What a check cannot judge it has no row for: a site whose
homepage was not reached, or whose evidence a parser refuses. Such a site gets that check's fallback row (``warn``, of unknown evidence, no points) and
nothing else changes: the other checks of that site, and all checks of the others, go on. Requests are told apart by agent and url; of repeated responses to one request the least by
status and body counts. Null bodies are empty and null statuses failed requests; a site of which nothing was fetched has thirteen fallback rows or those that absence earns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.urls import hostname
from sitegauge.runtime import cut
from sitegauge.sources.dom import dom

from . import forms, markup, robots, site_checks, site_evidence, site_search, site_surfaces, sitemaps
from .pages import readability

FRESH_SHARE = 0.8
SEARCHERS = ("Googlebot", "Bingbot")
CONTRACT = "site_id long, check_name string, score long, state string, evidence string"


class Evidence:
    """What the checks read: sites (site_id, root), their responses, and the fixed dimensions by name. Shared parts are made once and cut."""

    def __init__(self, sites: DataFrame, fetch: DataFrame, dimensions: dict[str, DataFrame], as_of: str):
        self.sites, self.fetch, self.dimensions, self.as_of = sites, fetch, dimensions, as_of

    def asked(self, path: str, agent: str = "auditor", scheme: str | None = None) -> DataFrame:
        """A row a site (left null where nothing was fetched): the response to a path of its root, by one agent; with ``scheme`` in place of the root's ``https://``."""
        url = F.concat("root", F.lit(path)) if scheme is None else F.concat(F.lit(scheme), F.regexp_replace("root", "^https://", ""), F.lit(path))
        got = self.fetch.where(F.col("agent") == agent).groupBy("site_id", "url").agg(F.min(F.struct("status", "body", "final_url", "error", "elapsed_ms", F.to_json("headers").alias("headers"))).alias("r"))
        rows = self.sites.withColumn("url", url).join(got, ["site_id", "url"], "left").select("site_id", "root", "url", "r.*")
        ok = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False))
        return rows.withColumns({"ok": ok, "headers": F.coalesce(F.from_json("headers", "map<string,string>"), F.create_map().cast("map<string,string>"))})

    @cached_property
    def home(self) -> DataFrame:
        return cut(self.asked("/"))

    @cached_property
    def pages(self) -> DataFrame:
        """The DOM relation of the homepages that were reached and could be read; site_id as page_id."""
        rows = self.home.where("ok").select(F.col("site_id").alias("page_id"), F.col("final_url").alias("url"), F.col("body").alias("html"), "elapsed_ms", "headers")
        return cut(site_checks.with_json_ld(dom(rows).where("fault is null").drop("fault")))

    @cached_property
    def robots(self) -> DataFrame:
        """(site_id, body): null where there is no robots.txt."""
        return cut(self.asked("/robots.txt").select("site_id", F.when(F.col("ok"), F.coalesce("body", F.lit(""))).alias("body")))

    @cached_property
    def maps(self) -> tuple[DataFrame, DataFrame]:
        """Candidates and crawl of the sitemaps."""
        files = cut(sitemaps.parsed(self.fetch.where("agent = 'auditor' and headers['content-type'] rlike 'xml'"), self.as_of))
        found = cut(sitemaps.candidates(self.sites, self.robots.where("body is not null"), files))
        return found, sitemaps.crawl(found, files)


def _rows(d: DataFrame, evidence: str | Column, key: str = "site_id") -> DataFrame:
    return d.select(F.col(key).alias("site_id"), F.col("score").cast("long").alias("score"), "state", (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence"))


def robots_txt(e: Evidence) -> DataFrame:
    signals = e.home.where("ok").select("site_id", F.element_at("headers", F.lit("content-signal")).alias("value"))
    return _rows(site_evidence.robots_check(e.robots, signals, e.dimensions["crawler"], e.dimensions["purpose"], e.dimensions["access"]), F.col("evidence"))


def bot_access(e: Evidence) -> DataFrame:
    """Crawlers that get the browser's page: on a scale of six, half-even."""
    rows = e.fetch.where(~F.col("agent").isin("auditor", "markdown", "lookup")).select(
        "site_id", F.col("agent").alias("bot"), "status", "error", F.col("body").alias("html"), F.array_join(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n").alias("headers")
    )
    seen = site_evidence.bot_challenges(rows).groupBy("site_id").agg(F.count_if(F.col("reason").isNull()).alias("open"), F.count("*").alias("n"))
    state = F.when(F.col("open") == F.col("n"), "pass").when(F.col("open") > 0, "partial").otherwise("fail")
    return _rows(seen.select("site_id", F.bround(F.col("open") / F.col("n") * 6, 0).alias("score"), state.alias("state")), "inferred")


def llms_txt(e: Evidence) -> DataFrame:
    """Text access with its inputs from the responses: llms.txt, the best sitemap, robots.txt, and the negotiated or linked text."""
    text = e.asked("/llms.txt").select("site_id", F.when(F.col("ok"), F.coalesce("body", F.lit(""))).alias("llms"), F.col("error").isNotNull().alias("a"))
    lost = e.asked("/robots.txt").select("site_id", F.col("error").isNotNull().alias("b")).join(e.asked("/sitemap.xml").select("site_id", F.col("error").isNotNull().alias("c")), "site_id")
    found = sitemaps.best_sitemap(e.maps[0]).select("site_id", F.col("valid").alias("sitemap_valid"), F.col("dated").alias("has_lastmod"), "in_robots")
    told = e.fetch.where("agent = 'markdown'").join(e.sites, "site_id").select(
        "site_id", F.when(F.col("url") == F.concat("root", F.lit("/")), "negotiated").otherwise(F.expr("substring(url, length(root) + 1)")).alias("label"), "status", F.element_at("headers", F.lit("content-type")).alias("content_type"), F.element_at("headers", F.lit("vary")).alias("vary"), "body"
    )
    markdown = site_evidence.text_access(told).select("site_id", F.col("available").alias("markdown"))
    rows = text.join(lost, "site_id").join(found, "site_id").join(markdown, "site_id", "left").fillna(False, ["markdown"]).withColumn("reached", ~(F.col("a") & F.col("b") & F.col("c")))
    return _rows(site_evidence.llms_check(rows), F.col("evidence"))


def machine_surfaces(e: Evidence) -> DataFrame:
    """Discovery surfaces of the site's scope among the responses, with the hints of headers, names and robots.txt."""
    kinds = e.dimensions["surface_kind"]
    fetched = e.fetch.where("agent = 'auditor'").join(e.sites, "site_id").select("site_id", F.expr("substring(url, length(root) + 1)").alias("path"), F.startswith("url", F.col("root")).alias("own"), "status", "body").where("own")
    return _rows(site_surfaces.surface_check(e.dimensions["scope"], fetched.join(F.broadcast(kinds.select("path", "surface").distinct()), "path"), e.dimensions["hint"], kinds), "verified")


def canonical(e: Evidence) -> DataFrame:
    """The canonical link of the homepage, what plain http answers, and whether another host of the site answers as itself."""
    link = site_checks.canonical_link(e.pages).select(F.col("page_id").alias("site_id"), "canonical")
    plain = e.asked("/", scheme="http://").select("site_id", F.when(F.col("ok"), F.col("final_url")).alias("http_final"))
    other = e.asked("/", scheme="https://www.").select("site_id", F.when(F.col("ok"), F.nullif(hostname(F.col("final_url")), F.lit(""))).alias("other"))
    rows = e.home.where("ok").select("site_id", "root", "final_url").join(link, "site_id").join(plain, "site_id").join(other, "site_id")
    twin = F.when(F.col("other") != hostname(F.col("root")), F.col("other"))
    return _rows(markup.canonical(rows.select("site_id", "final_url", "canonical", F.coalesce("http_final", F.lit("https://")).alias("http_final"), twin.alias("other_host"))), "verified")


def search_discovery(e: Evidence) -> DataFrame:
    """Search discovery with its inputs from the responses: robots.txt for two searchers, the sitemaps' sample, signs of upkeep, and of the pages of the
    homepage's host in the evidence their metadata, blurbs, alternates and trust pages."""
    blocked = robots.access(e.robots, e.dimensions["crawler"]).where(F.col("bot").isin(*SEARCHERS) & F.col("access").endswith("blocked")).select("site_id").distinct().withColumn("blocked", F.lit(True))
    maps = sitemaps.sitemap_sample(e.maps[1])
    good = (F.col("urls") > 0) & (F.col("dated") / F.greatest("urls", F.lit(1)) >= FRESH_SHARE) & (F.col("bad_dates") == 0) & (F.col("future_dates") == 0)
    maps = maps.select("site_id", (F.col("urls") > 0).alias("sitemap_valid"), good.alias("lastmod_good"), F.col("clean").alias("sitemap_clean"))
    fresh = site_search.freshness(e.pages).select(F.col("page_id").alias("site_id"), F.col("available").alias("freshness"))
    host = e.pages.select(F.col("page_id").alias("site_id"), hostname(F.col("url")).alias("host"))
    b = site_search.blurb_issues(e.pages)
    faultless = F.lit(True)
    for c in b.columns[2:]:
        faultless = faultless & (F.col(c) == 0)
    h = site_search.hreflang_sets(e.pages)
    by_host = host.join(site_search.sampled_metadata(e.pages).select("host", F.col("ok").alias("metadata_ok")), "host", "left").join(b.select("host", faultless.alias("blurbs_ok")), "host", "left")
    by_host = by_host.join(site_search.trust_pages(e.pages).select("host", F.col("ok").alias("trust_ok")), "host", "left").join(h.select("host", ((F.col("invalid") + F.col("no_href") + F.col("relative") + F.col("twice") + F.col("no_self")) == 0).alias("hreflang_ok")), "host", "left")
    rows = e.sites.select("site_id").join(blocked, "site_id", "left").join(maps, "site_id").join(fresh, "site_id", "left").join(by_host.drop("host"), "site_id", "left")
    rows = rows.fillna(False, ["blocked", "freshness", "metadata_ok", "blurbs_ok", "trust_ok"]).fillna(True, ["hreflang_ok"]).withColumn("crawlers_allowed", ~F.col("blocked"))
    return _rows(site_search.discovery_score(rows), "inferred")


def wikipedia(e: Evidence) -> DataFrame:
    """The entity's answer in the entity sources; the least of several lookups by name."""
    asked = e.fetch.where("agent = 'lookup'").groupBy("site_id").agg(F.min(F.struct(F.regexp_extract("url", r"[?&]q=([^&]*)", 1).alias("name"), "status")).alias("x")).select("site_id", "x.name", F.col("x.status").cast("long").alias("status"))
    d = forms.entity_score(asked, e.dimensions["entity"])
    return _rows(d, F.col("evidence"))


def _on_page(check: Callable[[DataFrame], DataFrame], evidence: str) -> Callable[[Evidence], DataFrame]:
    return lambda e: _rows(check(e.pages), evidence, "page_id")


def ssr(e: Evidence) -> DataFrame:
    d = readability(e.home.where("ok").select(F.col("site_id").alias("page_id"), F.col("body").alias("html")).join(e.pages.select("page_id"), "page_id", "left_semi"))
    return _rows(d, F.when(F.col("state") == "pass", "verified").otherwise("inferred"), "page_id")


#: The checks by the rubric's names.
REGISTRY: dict[str, Callable[[Evidence], DataFrame]] = {
    "robots_txt": robots_txt, "bot_access": bot_access, "html_structure": _on_page(site_checks.html_structure, "inferred"), "schema_ld": _on_page(site_checks.structured_data, "inferred"), "llms_txt": llms_txt, "ssr": ssr,
    "machine_surfaces": machine_surfaces, "pagespeed": _on_page(site_checks.crawl_efficiency, "inferred"), "canonical": canonical, "indexing": _on_page(site_checks.indexing, "inferred"), "search_discovery": search_discovery,
    "social": _on_page(site_checks.entity_coherence, "verified"), "wikipedia": wikipedia,
}


def check_rows(e: Evidence, registry: dict[str, Callable[[Evidence], DataFrame]] = REGISTRY) -> DataFrame:
    """``CONTRACT`` rows of all checks; a check whose rows are of another shape is refused before anything runs."""
    out = None
    for name, check in registry.items():
        rows = check(e)
        if [f.simpleString() for f in rows.schema] != ["site_id:bigint", "score:bigint", "state:string", "evidence:string"]:
            raise TypeError(f"{name} gives {rows.schema.simpleString()}")
        rows = rows.select("site_id", F.lit(name).alias("check_name"), "score", "state", "evidence")
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_rows(e: Evidence, rubric: DataFrame, registry: dict[str, Callable[[Evidence], DataFrame]] = REGISTRY) -> DataFrame:
    """A row for every site and check of the rubric (a fixed dimension of 13 rows): the check's, else its fallback row. Points beyond the rubric's or below zero are no row of the check."""
    every = e.sites.select("site_id").distinct().join(F.broadcast(rubric))
    rows = every.join(check_rows(e, registry), ["site_id", "check_name"], "left")
    good = F.col("score").between(0, F.col("max_score")) & F.col("state").isin("pass", "partial", "fail", "warn")
    held = lambda c, other: F.coalesce(F.when(good, F.col(c)), F.lit(other)).alias(c)
    return rows.select("site_id", "pillar", "check_name", held("score", 0).cast("long").alias("score"), "max_score", held("state", "warn"), held("evidence", "unknown"))


def site_scores(rows: DataFrame) -> DataFrame:
    """Per site the points, checks of unknown evidence, half-even percentage of the known points, and the inclusive percentile of that among all sites (from at most 101 counts)."""
    known = F.col("evidence") != "unknown"
    share = F.sum(F.when(known, F.col("score"))) / F.sum(F.when(known, F.col("max_score"))) * 100
    sites = rows.groupBy("site_id").agg(F.sum("score").alias("overall"), F.count_if(~known).alias("unknown_checks"), F.bround(F.coalesce(share, F.lit(0.0)), 0).cast("long").alias("percent"))
    counts = sites.groupBy("percent").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("percent").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())
    ranks = counts.select("percent", F.bround(upto * 100, 0).cast("long").alias("percentile"))
    return sites.join(F.broadcast(ranks), "percent").select("site_id", "overall", "unknown_checks", "percent", "percentile")
