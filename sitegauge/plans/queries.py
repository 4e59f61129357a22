"""The registered queries of the site-readiness operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions import labels
from sitegauge.operators import audit, crawl, documents, evidence, forms, markup, pages, robots, scope, scoring, site_checks, site_evidence, site_report, site_search, site_surfaces, sitemaps, texts
from sitegauge.runtime import cut, shared_dir
from sitegauge.sources import fetches, recorded, surface
from sitegauge.sources import page_relations as found
from sitegauge.sources.dom import dom
from sitegauge.sources.evidence import dealt, evidence_pages, fed
from sitegauge.sources.fixtures import relation, sites_of
from sitegauge.streaming import limits

AS_OF = "2024-06-01"


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: The key of relations that have no site, by which each page brings one of their things.
KEYS = {"peer": "name", "snapshot": "name", "peer_probe": "name", "probe": "label", "cache": "cache_key"}


def _fed(f: Callable[..., DataFrame], *names: str, by: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    """An operator over literal relations, those of ``by`` at the size of the pages, those of sites dealt."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
        return f(*(fed(spark, ids, n, KEYS[n]) if n in by else dealt(spark, ids, n, sites_of(*names)) for n in names))

    return run


def _of(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """An operator over literal relations, those of sites dealt over all pages."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
        return f(*(dealt(spark, ids, n, sites_of(*names)) for n in names))

    return run


def _page(f: Callable[[DataFrame], DataFrame], ld: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """An operator over the DOM relation of all pages with their planted markup and response (``ld``: with the JSON-LD objects)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = dom(evidence_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
        return f(site_checks.with_json_ld(d) if ld else d)

    return run


def _maps(f: Callable[[sitemaps.Maps], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """An operator over the sitemap files and robots names of all sites that ``pages`` makes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = fetches.sites(spark.read.parquet(f"{sf_dir}/pages.parquet"))
        return f(sitemaps.Maps(s.select("site_id", "root"), fetches.robots_bodies(s), fetches.sitemap_responses(s), AS_OF))

    return run


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Spark SQL over the table functions and a view of all pages with their planted markup."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return surface.register(spark, page=evidence_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).sql(text)

    return run


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses of all sites, written as WARC files and read back: answers and failures by agent, of those that were asked for on a site's root."""
    recorded.register(spark)
    folder = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    made = fetches.responses(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("agent", "url", "final_url", "status", "headers", "body", "error", "elapsed_ms")
    made.write.format("recorded").mode("append").save(folder)
    rows = spark.read.format("recorded").load(folder).where("status >= 200 and status < 400")
    return rows.groupBy("agent").agg(F.count("*").alias("answers"), F.count_if(F.size("redirects") > 0).alias("moved"))


def _report(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """An operator over the rows of all thirteen checks of all sites, from the fetch relation that ``pages`` makes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages_ = spark.read.parquet(f"{sf_dir}/pages.parquet")
        sites = cut(fetches.sites(pages_).select("site_id", "root"))
        fixed = {n: relation(spark, n) for n in ("crawler", "purpose", "access", "entity", "surface_kind")}
        own = {k: dealt(spark, pages_.select("page_id"), n, sites_of(n)).distinct() for k, n in (("scope", "site_scope"), ("hint", "hint"))}
        return f(site_report.audit_rows(site_report.Evidence(sites, cut(fetches.responses(spark, pages_)), fixed | own, AS_OF), relation(spark, "rubric")))

    return run


def _against(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _of(lambda rows, rubric, peers: f(scoring.evidence_score(rows, rubric).select("site_id", "percent"), scoring.peer_scores(peers, rubric)), "check_row", "rubric", "peer")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "site_audit": lambda spark, sf_dir: audit.site_audit(spark.read.parquet(f"{sf_dir}/pages.parquet"), relation(spark, "rubric")),
    "audit_rows": _report(lambda rows: rows),
    "fetched_audit": _report(site_report.site_scores),
    "ssr_readability": _on("pages", pages.readability),
    "extraction_efficiency": _on("pages", lambda p: pages.text_metrics(p).drop("app_shell", "boilerplate_ratio", "navigation_ratio", "script_style_ratio", "html_text_ratio")),
    "html_structure": _page(site_checks.html_structure),
    "sql_structure": _sql(surface.STRUCTURE),
    "sql_form_fields": _sql(surface.FORM_FIELDS),
    "sql_schema_types": _sql(surface.SCHEMA_TYPES),
    "recorded_responses": _recorded,
    "crawl_efficiency": _page(site_checks.crawl_efficiency),
    "indexing_directives": _page(site_checks.indexing),
    "structured_data": _page(site_checks.structured_data, True),
    "structured_data_shop": _page(lambda d: site_checks.structured_data(d, True), True),
    "entity_coherence": _page(site_checks.entity_coherence, True),
    "canonical_links": _page(site_checks.canonical_link),
    "blurb_issues": _page(site_search.blurb_issues),
    "sampled_metadata": _page(site_search.sampled_metadata, True),
    "trust_pages": _page(site_search.trust_pages),
    "freshness_signals": _page(site_search.freshness),
    "text_alternates": _page(site_search.text_alternate),
    "extraction_readiness": _page(site_search.extraction_readiness, True),
    "homepages": _on("pages", pages.homepages),
    "sitemap_hygiene": _on("pages", pages.sitemap_hygiene),
    "duplicate_titles": _on("pages", pages.duplicate_titles),
    "language_path_mismatch": _on("pages", pages.language_mismatch),
    "host_top_pages": _on("pages", pages.host_rank),
    "page_url_normalise": _on("pages", lambda p: forms.normal_urls(found.urls(p))),
    "page_trust_surfaces": _on("pages", lambda p: markup.trust_surfaces(found.links(evidence_pages(p)))),
    "page_social_profiles": _on("pages", lambda p: markup.social_profiles(found.links(evidence_pages(p)))),
    "page_form_affordances": _on("pages", lambda p: forms.form_faults(found.forms(evidence_pages(p)))),
    "page_viewport_tokens": _on("pages", lambda p: markup.viewport(found.viewports(evidence_pages(p)))),
    "page_jsonld_types": _on("pages", lambda p: markup.json_ld_nodes(found.scripts(evidence_pages(p))).selectExpr("site_id", "script_no", "array_join(types, ' ') as types", "cast(size(fields) as bigint) as n_fields")),
    "markdown_body_quality": _on("documents", texts.markdown_quality),
    "opening_token_coverage": _on("documents", texts.opening_coverage),
    "text_flags_by_source": _on("documents", texts.flags_by_source),
    "robots_groups": _of(lambda r: robots.groups(r).selectExpr("site_id", "group_id", "array_join(agents, ' ') as agents", "array_join(rules, ' ') as rules"), "robots"),
    "robots_access_matrix": _of(robots.access, "robots", "crawler"),
    "robots_access_score": _of(robots.access_score, "robots", "crawler", "purpose", "access"),
    "robots_quality": _of(robots.quality, "robots"),
    "content_signals": _of(robots.content_signals, "robots"),
    "bot_blocked_reasons": _of(crawl.bot_access, "bot_fetch"),
    "bot_access_score": _of(crawl.bot_score, "bot_fetch"),
    "indexing_precedence": _of(crawl.indexing, "x_robots"),
    "x_robots_scopes": _of(crawl.directives, "x_robots"),
    "hreflang_reciprocity": _of(crawl.hreflang, "hreflang"),
    "brand_names": _page(site_surfaces.brand_names, True),
    "surface_hints": _page(site_surfaces.page_hints),
    "surface_reach": _page(lambda d: site_surfaces.page_reach(d, ("/blog", "/about", "/contact", "/privacy", "/returns", "/feed.xml", "/a.css"))),
    "surface_check": _of(site_surfaces.surface_check, "site_scope", "surface_fetch", "hint", "surface_kind"),
    "conventional_paths": _of(site_surfaces.conventional_paths, "site_scope", "surface_fetch", "usual_path"),
    "catalog_issues": _of(site_surfaces.catalog_issues, "full_catalog"),
    "website_variants": _of(site_surfaces.website_variants, "dns_site"),
    "scope_labels": _of(site_surfaces.scope_labels, "site_scope"),
    "nested_report": _of(site_surfaces.report, "check_row", "rubric", "pillar_cap", "site_scope"),
    "bot_challenges": _of(site_evidence.bot_challenges, "bot_page"),
    "robots_check": _of(site_evidence.robots_check, "robots", "signal_header", "crawler", "purpose", "access"),
    "sitemap_references": _of(site_evidence.sitemap_references, "robots"),
    "text_responses": _of(site_evidence.text_response, "text_fetch"),
    "llms_check": _of(site_evidence.llms_check, "text_site"),
    "json_documents": _of(site_evidence.json_documents, "json_document"),
    "auth_texts": _of(site_evidence.auth_texts, "auth_text"),
    "agent_links": _of(site_evidence.agent_links, "header"),
    "dns_names": _of(site_evidence.dns_names, "dns_site"),
    "json_feeds": _of(lambda f: site_evidence.json_feed(f, AS_OF), "json_feed"),
    "readiness_categories": _of(site_evidence.readiness_categories, "site_scope", "probe_pass", "probe"),
    "scope_keys": _of(site_evidence.scope_key, "site_scope"),
    "agent_peers": _fed(site_evidence.agent_peers, "peer_probe", "probe", "site_scope", by=("peer_probe",)),
    "agent_peer_position": _of(site_evidence.agent_position, "site_scope", "probe_pass", "probe", "peer_probe"),
    "scope_faults": _of(site_evidence.scope_faults, "scope_fault", "preset", "override_key"),
    "public_targets": _of(site_evidence.public_targets, "target"),
    "bounded_bodies": _of(lambda b: site_evidence.bounded(b, 9), "body"),
    "text_access": _of(site_evidence.text_access, "text_fetch"),
    "readiness_summary": _of(site_evidence.readiness_summary, "site_scope", "probe_pass", "probe"),
    "agent_nearest3": _of(site_evidence.agent_nearest, "site_scope", "probe_pass", "probe", "peer_probe"),
    "resolved_targets": _of(site_evidence.resolved_targets, "resolved"),
    "robots_codes": _of(site_evidence.robots_codes, "robots"),
    "discovery_score": _of(site_search.discovery_score, "discovery"),
    "viewer_open_rows": _of(scoring.viewer_filter, "check_row", "rubric"),
    "peer_bars": _fed(lambda p, r: scoring.peer_bars(scoring.peer_scores(p, r), "corporate"), "peer", "rubric", by=("peer",)),
    "metric_labels": _on("pages", lambda p: pages.text_metrics(p, "url").select("page_id", labels.percent(F.col("boilerplate_ratio")).alias("boilerplate"), labels.ratio(F.col("html_text_ratio")).alias("html_text"), labels.size(F.col("html_bytes")).alias("bytes"), labels.short_url(F.col("url")).alias("shown"), labels.root_url(F.col("url"), F.lit("robots.txt")).alias("robots"))),
    "pillar_scores": _of(scoring.pillar_scores, "check_row", "rubric", "pillar_cap"),
    "evidence_score": _of(scoring.evidence_score, "check_row", "rubric"),
    "action_order": _of(scoring.action_order, "check_row", "rubric"),
    "attention_top5": _of(scoring.attention, "check_row", "rubric"),
    "check_counts": _of(scoring.check_counts, "check_row"),
    "peer_essentials": _fed(scoring.peer_scores, "peer", "rubric", by=("peer",)),
    "peer_position": _against(scoring.against_peers),
    "peer_nearest3": _against(scoring.nearest_peers),
    "scope_resolution": _of(scope.resolve, "scope_request", "preset", "override_key"),
    "probe_scope_matrix": _fed(scope.probe_scopes, "probe", by=("probe",)),
    "readiness_cube": _of(scope.readiness_cube, "site_scope", "probe_pass", "probe"),
    "jsonld_types": _of(lambda j: markup.json_ld_nodes(j).selectExpr("site_id", "script_no", "array_join(types, ' ') as types", "cast(size(fields) as bigint) as n_fields"), "json_ld"),
    "jsonld_best_schema": _of(markup.json_ld_best, "json_ld", "ld_field"),
    "sitemap_lastmod_quality": _of(lambda r: markup.lastmod_quality(r, AS_OF), "lastmod"),
    "viewport_tokens": _of(markup.viewport, "viewport"),
    "canonical_check": _of(markup.canonical, "canonical"),
    "trust_surfaces": _of(markup.trust_surfaces, "link"),
    "social_profiles": _of(markup.social_profiles, "link"),
    "price_normalise": _of(markup.prices, "price"),
    "public_addresses": _of(markup.public_addresses, "address"),
    "llms_validity": _of(documents.llms, "llms"),
    "header_hints": _of(documents.headers, "header"),
    "sitemap_sample": _maps(lambda m: sitemaps.sitemap_sample(m.crawled())),
    "sitemap_pages": _maps(lambda m: sitemaps.sampled_pages(m.crawled())),
    "best_sitemap": _maps(lambda m: sitemaps.best_sitemap(m.candidates())),
    "sitemap_entries": _maps(lambda m: sitemaps.sitemap_entries(m.fetches)),
    "feed_freshness": _of(lambda f: documents.feed_freshness(f, AS_OF), "feed"),
    "catalog_quality": _of(documents.catalogs, "catalog"),
    "orphan_surfaces": _of(documents.orphan_surfaces, "surface", "surface_link"),
    "agent_readiness": _of(documents.readiness, "probe_pass", "probe"),
    "peer_validation": _fed(scoring.snapshot_faults, "snapshot", "rubric", by=("snapshot",)),
    "viewer_pillars": _of(scoring.viewer, "check_row", "rubric"),
    "viewer_order": _of(scoring.viewer_order, "check_row", "rubric"),
    "report_summary": _of(scoring.summary, "check_row", "rubric", "pillar_cap"),
    "form_affordances": _of(forms.form_faults, "form_page"),
    "url_normalise": _of(forms.normal_urls, "url"),
    "entity_lookup_score": _of(forms.entity_score, "lookup", "entity"),
    "search_blurb_issues": _of(forms.blurb_faults, "blurb"),
    "locked_rows": _of(forms.with_locked, "check_row", "rubric", "locked"),
    "routing_differences": _of(evidence.routing, "route"),
    "dns_discovery": _of(evidence.dns_discovery, "dns"),
    "surface_validity": _of(evidence.surface_validity, "surface_body"),
    "commerce_mismatch": _of(evidence.commerce_mismatches, "commerce"),
    "cached_lookups": _fed(lambda c: evidence.cached(c, AS_OF), "cache", by=("cache",)),
    "report_checks_json": _of(evidence.report_json, "check_row", "rubric"),
    "top_gap_per_pillar": _of(evidence.best_per_pillar, "check_row", "rubric"),
    "rate_window_admission": _on("events", limits.admissions),
    "rate_window_rows": _on("events", limits.admitted_rows),
    "entity_cache_upsert": _on("events", limits.latest),
    "stored_upsert": _on("events", limits.stored),
    "ttl_cache_hits": _on("events", limits.fresh_lookups),
}
