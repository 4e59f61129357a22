"""Operators over fetched evidence, against values worked out by hand or by the standard library."""

import ipaddress

from pyspark.sql import functions as F

from sitegauge.operators import site_evidence as evidence
from sitegauge.sources.fixtures import relation
from sitegauge.streaming.limits import fresh_lookups


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_challenges(spark):
    got = {(r.site_id, r.bot): r.reason for r in evidence.bot_challenges(relation(spark, "bot_page")).collect()}
    assert {b: r for (s, b), r in got.items() if s == 1} == {
        "Googlebot": "challenge page", "GPTBot": "challenge page", "CCBot": "HTTP 403", "Bingbot": "fetch error", "ClaudeBot": "challenge page", "OAI-SearchBot": "thin response", "PerplexityBot": None,
    }
    assert got[2, "Googlebot"] is None and got[2, "GPTBot"] == "HTTP 429" and got[3, "Googlebot"] == "challenge page" and got[4, "CCBot"] is None


def test_robots_check(spark):
    got = {r.site_id: r for r in evidence.robots_check(*(relation(spark, n) for n in ("robots", "signal_header", "crawler", "purpose", "access"))).collect()}
    assert (got[6].state, got[6].score, got[6].evidence) == ("warn", 3, "unknown")
    assert got[2].state == "fail" and got[2].score == 0 and got[5].schema_map and not got[1].schema_map
    assert got[1].blocked == "training and corpus: CCBot, GPTBot" and got[1].named == 2


def test_texts(spark):
    got = {(r.site_id, r.label): r for r in evidence.text_response(relation(spark, "text_fetch")).collect()}
    assert [got[k, "negotiated"].available for k in range(1, 9)] == [True, False, True, False, False, False, False, False]
    assert got[2, "negotiated"].codes == "too_short html_body other_content_type no_vary_accept" and got[5, "negotiated"].codes == "too_short" and got[4, "negotiated"].codes == "no_content_type no_vary_accept"
    assert got[1, "/index.md"].available and got[1, "/index.md"].structured and got[2, "/index.md"].available
    assert rows(evidence.llms_check(relation(spark, "text_site")), "site_id", "score", "state") == [(1, 5, "pass"), (2, 3, "partial"), (3, 1, "partial"), (4, 0, "fail"), (5, 0, "warn"), (6, 4, "pass")]


def test_documents(spark):
    assert rows(evidence.json_documents(relation(spark, "json_document")), "site_id", "label", "available") == [
        (1, "API Catalog", True), (1, "MCP Server Card", False), (2, "Agent Skills index", False), (2, "MCP Server Card", True), (3, "API Catalog", False), (3, "WebMCP manifest", False), (3, "catalog", True), (3, "other", True),
    ]
    assert rows(evidence.auth_texts(relation(spark, "auth_text")), "site_id", "available") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    assert rows(evidence.dns_names(relation(spark, "dns_site")).where("site_id = 1"), "ordinal", "name")[3] == (3, "_index._agents.a.example")


def test_json_feeds(spark):
    feeds = {r.site_id: r for r in evidence.json_feed(relation(spark, "json_feed"), "2024-06-01").collect()}
    assert (feeds[1].items, feeds[1].dated, feeds[1].faulty, str(feeds[1].latest)) == (3, 2, 0, "2024-05-03") and (feeds[2].items, feeds[2].faulty) == (2, 2) and feeds[3].items == 0 and feeds[4].items is None


def test_addresses(spark):
    texts = ["::1", "::", "fe80::1", "fc00::1", "ff02::1", "2001:db8::1", "::ffff:127.0.0.1", "::ffff:8.8.8.8", "2606:4700::1111", "8.8.8.8", "10.0.0.1", "100.64.0.1", "0.0.0.0", "169.254.1.1", "224.0.0.1", "no", "", "1.2.3"]
    got = dict(rows(evidence.public_targets(spark.createDataFrame([(1, t) for t in texts], "site_id long, ip string")), "ip", "public"))
    for t in texts:
        try:
            ip = ipaddress.ip_address(t)
            ip = getattr(ip, "ipv4_mapped", None) or ip
            assert got[t] == (ip.is_global and not ip.is_multicast), t
        except ValueError:
            assert not got[t]


def test_bounded(spark):
    texts = ["abcdefgh", "abcdefghij", "abcdefghä", "abcdefg€", "abcdef😀", "ääääää", "", None, "abcdefg😀x", "😀😀😀"]
    frame = spark.createDataFrame(list(enumerate(texts)), "site_id long, body string")
    for most in (4, 9, 10):
        got = dict(rows(evidence.bounded(frame, most), "site_id", "body"))
        for k, t in enumerate(texts):
            assert got[k] == (t or "").encode()[:most].decode(errors="ignore"), (t, most)


def test_scopes(spark):
    got = dict(rows(evidence.scope_faults(*(relation(spark, n) for n in ("scope_fault", "preset", "override_key"))), "site_id", "codes"))
    assert got == {1: "overrides_without_preset", 2: "unknown_preset", 3: "unknown_key", 4: "protocols_without_family", 5: "auth_without_family", 6: "commerce_without_family", 7: "", 8: "", 9: "", 10: "unknown_key protocols_without_family commerce_without_family"}
    keys = rows(evidence.scope_key(relation(spark, "site_scope")), "site_id", "scope_key", "most")
    assert keys[0] == (1, "p0_a0_c0", 8) and keys[-1] == (8, "p1_a1_c1", 21)
    one = evidence.readiness_categories(*(relation(spark, n) for n in ("site_scope", "probe_pass", "probe"))).where("site_id = 1")
    assert {r.category: (r.earned, r.most) for r in one.collect()} == {"Discoverability": (2, 4), "Content Accessibility": (1, 1), "Bot Access Control": (0, 3), "Protocol Discovery": (0, 0), "Commerce": (0, 0)}


def test_alternate_host(spark):
    urls = ["https://a.example/x", "http://www.a.example:80/", "mailto:x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(evidence.alternate_host(F.col("u")).alias("a")).collect()
    assert [r.a for r in got] == ["https://www.a.example/x", "http://a.example:80/", None]


def test_time_to_live(spark):
    """A hit does not renew the entry: lookups on days 0, 20 and 40 are miss, hit, miss; an age of just the time to live is a miss."""
    days = {1: [0, 20, 40, 69, 70], 2: [0, 30], 3: [5], 4: [0, 29.999]}
    events = [(k * 10 + i, u, "t", float(d)) for k, (u, ds) in enumerate(days.items()) for i, d in enumerate(ds)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, event_type string, day double").withColumn("ts", F.timestamp_seconds((F.col("day") * 86400).cast("long")))
    r = fresh_lookups(frame.unionByName(frame.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))).first()
    assert (r.lookups, r.hits) == (10, 1 + 1 + 0 + 0 + 1)


def test_summaries(spark):
    robots = relation(spark, "robots")
    text = {r.site_id: r for r in evidence.text_access(relation(spark, "text_fetch")).collect()}
    assert (text[1].available, text[1].label) == (True, "negotiated") and (text[2].available, text[2].label) == (True, "/index.md") and (text[8].available, text[8].label, text[8].codes) == (False, None, "not_ok")
    assert rows(evidence.resolved_targets(relation(spark, "resolved")), "site_id", "host", "ip") == [(1, "a.example", "8.8.8.8"), (2, "b.example", None), (3, "c.example", "2a00:1450:4001:81b::200e"), (3, "d.example", None), (4, "e.example", None)]
    codes_ = dict(rows(evidence.robots_codes(robots), "site_id", "codes"))
    assert codes_[1] == "" and codes_[3] == "malformed_lines empty_groups bad_sitemaps bad_delays"


def test_labels(spark):
    from sitegauge.functions import labels

    one = spark.createDataFrame([(0.125, 12.5, 3328, 5 * 1024 * 1024 + 60000, "https://A.example/x//?q=1#f")], "p double, r double, k long, m long, u string")
    got = one.select(labels.percent(F.col("p")), labels.ratio(F.col("r")), labels.size(F.col("k")), labels.size(F.col("m")), labels.size(F.lit(12)), labels.short_url(F.col("u")), labels.root_url(F.col("u"), F.lit("/llms.txt"))).first()
    assert tuple(got) == ("12%", "12:1", "3.2 KB", "5.1 MB", "12 B", "A.example/x?q=1", "https://A.example/llms.txt")
