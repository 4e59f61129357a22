"""Discovery surfaces, catalogs, names and the nested report, against values worked out by hand."""

import json

from sitegauge.operators import site_checks as checks
from sitegauge.operators import site_surfaces as surfaces
from sitegauge.sources.dom import dom
from sitegauge.sources.evidence import evidence_pages
from sitegauge.sources.fixtures import relation


def by(frame, key="site_id"):
    return {r[key]: r for r in frame.collect()}


def test_surface_check(spark):
    got = by(surfaces.surface_check(*(relation(spark, n) for n in ("site_scope", "surface_fetch", "hint", "surface_kind"))))
    assert (got[1].found, got[1].families, got[1].score, got[1].state) == ("DNS-AID TXT discovery; Link header discovery; content feed", 5, 3, "pass")
    # site 2: protocols only, so its auth.md does not count
    assert got[2].found == "API description; NLWeb /ask endpoint; legacy ai-plugin.json" and got[2].families == 14
    assert got[3].found == "auth.md" and got[3].state == "partial" and got[5].found == "catalog JSON" and got[6].state == "warn"
    assert got[8].found == "MCP server card; llms-full text export" and got[8].families == 19


def test_usual_paths(spark):
    got = by(surfaces.conventional_paths(*(relation(spark, n) for n in ("site_scope", "surface_fetch", "usual_path"))))
    assert tuple(got[1])[1:] == ("/docs", "", "/api /integrations /pricing") and tuple(got[8])[1:] == ("/integrations", "/api /docs /pricing", "")


def test_catalogs(spark):
    got = by(surfaces.catalog_issues(relation(spark, "full_catalog")))
    assert (got[1].valid, got[1].version, got[1].entries, got[1].trusted, got[1].codes) == (True, "1.0", 1, True, "")
    assert got[2].codes == "version host entries" and got[3].codes == "no_object" and got[4].codes == "empty" and got[6].codes == "host_domain" and got[8].codes == "no_object"
    assert got[5].codes.split()[:2] == ["version_shape", "other_host"] and got[5].codes.split()[-2:] == ["1.object", "2.foreign_identifier"] and got[5].entries == 3
    assert got[7].codes.split() == ["0.url_or_data", "0.description", "0.capabilities", "0.queries", "0.updated"] and got[7].trusted
    assert got[9].codes == "0.data"


def test_names_and_hints(spark):
    pages = spark.createDataFrame([(k, "https://www.shop.example.com/x", "<html><head><title>Corner Shop | Home</title></head><body><footer>x</footer></body></html>") for k in range(8)], "page_id long, url string, html string")
    d = checks.with_json_ld(dom(evidence_pages(pages)))
    names = by(surfaces.brand_names(d), "page_id")
    assert names[0].names == "Corner Shop | shop" and names[2].names == names[0].names and names[7].names == "Blue Harbour | Corner Shop | shop"
    assert by(surfaces.page_hints(d), "page_id")[6].hints == "content_feed"
    assert {(r.page_id, r.path) for r in surfaces.page_reach(d, ("/blog", "/a.css", "/returns")).collect()} == {(6, "/blog"), (1, "/a.css"), (3, "/a.css"), (4, "/returns")}
    variants = [r.variant for r in surfaces.website_variants(relation(spark, "dns_site")).where("site_id = 1").orderBy("ordinal").collect()]
    assert variants == ["https://www.a.example/", "https://www.a.example", "https://a.example/", "https://a.example"]


def test_report(spark):
    got = by(surfaces.report(*(relation(spark, n) for n in ("check_row", "rubric", "pillar_cap", "site_scope"))))
    assert got[1].overall == 40 and json.loads(got[1].pillars) == [{"pillar": "off_site", "points": 3}, {"pillar": "scrapability", "points": 24}, {"pillar": "seo", "points": 13}]
    order = [c["check_name"] for c in json.loads(got[1].checks)]
    # gaps per effort: robots 2, llms 2, then the ones in their own order
    assert order[:2] == ["robots_txt", "llms_txt"] and order[2:6] == ["bot_access", "schema_ld", "canonical", "indexing"] and len(order) == 13
    assert got[1].label == "General website" and got[2].label == "General website + API/protocol"
