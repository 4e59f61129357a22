"""Small evidence relations, written once for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The scored check groups (pillar, check, most points).
RUBRIC = [
    ("off_site", "social", 2), ("off_site", "wikipedia", 4), ("scrapability", "robots_txt", 6), ("scrapability", "bot_access", 6), ("scrapability", "html_structure", 4),
    ("scrapability", "schema_ld", 5), ("scrapability", "llms_txt", 5), ("scrapability", "ssr", 4), ("scrapability", "machine_surfaces", 3), ("seo", "pagespeed", 3),
    ("seo", "canonical", 5), ("seo", "indexing", 5), ("seo", "search_discovery", 4),
]
PILLAR_CAPS = [("off_site", 30), ("scrapability", 40), ("seo", 30)]
#: Crawler, purpose, scored in robots.txt, probed by fetch.
CRAWLERS = [
    ("Googlebot", "search and retrieval", True, True), ("Bingbot", "search and retrieval", True, True), ("DuckDuckBot", "search and retrieval", True, True),
    ("DuckAssistBot", "search and retrieval", True, True), ("OAI-SearchBot", "search and retrieval", True, True), ("Claude-SearchBot", "search and retrieval", True, False),
    ("PerplexityBot", "search and retrieval", True, True), ("GPTBot", "training and corpus", True, True), ("ClaudeBot", "training and corpus", True, True),
    ("CCBot", "training and corpus", True, True), ("Google-Extended", "training and corpus", True, False), ("ChatGPT-User", "user-triggered agents", True, False),
    ("Claude-User", "user-triggered agents", True, False), ("Perplexity-User", "user-triggered agents", True, False), ("Googlebot-Image", "media search", True, False),
    ("Googlebot-Video", "media search", False, False), ("Googlebot-News", "media search", False, False),
]
PURPOSES = [("search and retrieval", 2.5), ("training and corpus", 1.5), ("user-triggered agents", 1.0), ("media search", 1.0)]
ACCESS = [("explicit_allowed", 1.0), ("wildcard_allowed", 0.8), ("not_mentioned", 0.7), ("explicit_blocked", 0.0), ("wildcard_blocked", 0.0)]

ROBOTS = [
    (1, "User-agent: *\nDisallow:\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nSitemap: https://a.example/s.xml"),
    (2, "User-agent: *\nDisallow: /\n"),
    (3, "# nothing\n\njust words\nUser-agent: ClaudeBot\nSitemap: /relative.xml\nCrawl-delay: soon"),
    (4, "User-agent: bingbot\nAllow: /\nDisallow: /private\nContent-Signal: search=yes, ai-train=no\nUser-agent: Googlebot\nDisallow: /x # comment\nCrawl-delay: 5"),
    (5, "Allow: /orphan\nUser-agent: PerplexityBot\n\nDisallow: /\nSchemamap: https://e.example/map\nCrawl-delay: -2"),
    (6, ""),
]
X_ROBOTS = [
    (1, ""), (2, "noindex, nofollow"), (3, "googlebot: noindex"), (4, "max-snippet:0"), (5, "max-image-preview: standard"), (6, "nofollow"),
    (7, "unavailable_after: 25 Jun 2030"), (8, "max-image-preview:large, noarchive"), (9, "NONE"), (10, "all"), (11, "nosnippet, bingbot: noarchive"),
]
BOT_FETCHES = [
    (1, "browser", 1, 200, 400, ""), (1, "Googlebot", 1, 200, 390, ""), (1, "GPTBot", 1, 403, 0, ""), (1, "CCBot", 1, 429, 0, ""), (1, "CCBot", 2, 200, 380, ""),
    (1, "Bingbot", 1, 200, 30, ""), (1, "ClaudeBot", 1, 200, 400, "please solve the captcha"), (2, "browser", 1, 200, 60, ""), (2, "Googlebot", 1, 200, 5, ""),
    (2, "GPTBot", 1, None, None, ""), (2, "CCBot", 1, 429, 0, ""), (2, "CCBot", 2, 429, 0, ""), (3, "browser", 1, 200, 100, "captcha"), (3, "Googlebot", 1, 200, 100, "captcha"),
]
HREFLANG = [
    (1, "https://a.example/en", "en", "https://a.example/en"), (1, "https://a.example/en", "de", "https://a.example/de/"), (1, "https://a.example/de", "de", "https://a.example/de"),
    (1, "https://a.example/de", "en", "https://a.example/en?x=1"), (1, "https://a.example/en", "fr", "https://a.example/fr"), (1, "https://a.example/fr", "fr", "https://a.example/fr"),
    (2, "https://b.example/", "en", "https://b.example/"), (2, "https://b.example/", "xx-toolong-q", "https://b.example/q"), (2, "https://b.example/", "x-default", "https://b.example/"),
    (2, "https://b.example/", "en", "/relative"), (2, "https://b.example/q", "es", "https://b.example/"),
]
#: Invented peers: name, group, size, points of each check in the rubric's order.
PEERS = [
    ("Harbour Lamps", "ecommerce", "boutique", [0, 1, 3, 5, 3, 2, 1, 4, 1, 2, 4, 5, 1]), ("Kestrel Bikes", "ecommerce", "specialty", [2, 2, 6, 4, 2, 4, 3, 3, 0, 1, 5, 4, 2]),
    ("Marble and Oak", "ecommerce", "boutique", [1, 0, 2, 6, 3, 1, 0, 2, 1, 3, 1, 5, 2]), ("Northwind Tea", "ecommerce", "enterprise", [2, 4, 5, 6, 4, 5, 4, 4, 2, 3, 5, 5, 4]),
    ("Quill Office", "ecommerce", "enterprise", [1, 3, 4, 3, 3, 3, 2, 3, 1, 2, 3, 2, 3]), ("Ridge Outfitters", "ecommerce", "specialty", [0, 2, 1, 2, 1, 0, 1, 1, 0, 0, 3, 3, 0]),
    ("Alder Insurance", "corporate", "enterprise", [2, 4, 6, 5, 4, 3, 2, 4, 0, 3, 5, 5, 3]), ("Beacon Systems", "corporate", "enterprise", [1, 4, 3, 6, 4, 5, 5, 4, 3, 2, 5, 4, 4]),
    ("Civic Works", "corporate", "specialty", [0, 3, 5, 5, 3, 2, 0, 3, 0, 2, 3, 5, 1]), ("Delta Freight", "corporate", "boutique", [1, 1, 4, 1, 2, 1, 1, 2, 0, 1, 1, 0, 1]),
    ("Evergreen Clinic", "services", "specialty", [2, 0, 6, 6, 3, 4, 1, 4, 1, 3, 5, 3, 3]), ("Foxglove Studio", "services", "boutique", [2, 2, 5, 3, 4, 4, 3, 3, 2, 2, 3, 5, 4]),
]
#: (site, check, points, state, evidence, effort, place in the report)
CHECK_ROWS = [
    (s, check, max(0, points - (s - 1) * k % 3), state if s == 1 or (k + s) % 4 else "warn", "unknown" if s > 1 and not (k + s) % 4 else "inferred", effort, k)
    for s in (1, 2, 3)
    for k, (check, points, state, effort) in enumerate(
        [
            ("robots_txt", 4, "partial", "low"), ("bot_access", 4, "partial", "medium"), ("html_structure", 4, "pass", "medium"), ("schema_ld", 3, "partial", "medium"), ("llms_txt", 3, "partial", "low"),
            ("ssr", 4, "pass", "high"), ("machine_surfaces", 2, "partial", "medium"), ("pagespeed", 2, "partial", "medium"), ("canonical", 4, "partial", "low"), ("indexing", 4, "partial", "low"),
            ("search_discovery", 3, "partial", "low"), ("social", 1, "partial", "low"), ("wikipedia", 2, "partial", "high"),
        ]
    )
]

#: Probe label, category, scope.
PROBES = [
    ("robots.txt published", "Discoverability", "core"), ("valid sitemap discovery", "Discoverability", "core"), ("agent discovery Link headers", "Discoverability", "core"),
    ("DNS-AID records", "Discoverability", "core"), ("llms.txt or Markdown negotiation", "Content Accessibility", "core"), ("AI-specific robots.txt rules", "Bot Access Control", "core"),
    ("Content Signals in robots.txt", "Bot Access Control", "core"), ("Web Bot Auth directory", "Bot Access Control", "core"), ("auth.md", "Protocol Discovery", "account_auth"),
    ("API Catalog", "Protocol Discovery", "protocols"), ("OAuth/OIDC discovery metadata", "Protocol Discovery", "account_auth"), ("OAuth Protected Resource metadata", "Protocol Discovery", "account_auth"),
    ("MCP Server Card", "Protocol Discovery", "protocols"), ("A2A Agent Card", "Protocol Discovery", "protocols"), ("Agent Skills index", "Protocol Discovery", "protocols"),
    ("WebMCP manifest", "Protocol Discovery", "protocols"), ("ARD static catalog", "Protocol Discovery", "protocols"), ("x402 payment metadata", "Commerce", "commerce"),
    ("MPP commerce metadata", "Commerce", "commerce"), ("UCP commerce metadata", "Commerce", "commerce"), ("ACP commerce metadata", "Commerce", "commerce"),
]
#: Preset, protocols, account/auth, commerce, families that are on.
PRESETS = [
    ("blog", False, False, False, "feed_discovery article_schema"), ("corporate", False, False, False, ""), ("services", False, False, False, "localbusiness_schema"),
    ("ecommerce", True, True, True, "feed_discovery product_offer_schema commerce_fields api_catalog mcp a2a agent_skills webmcp oauth_oidc ard_catalog auth_md"),
    ("news", False, False, False, "feed_discovery article_schema news_article_schema claimreview_schema"), ("saas", True, True, False, "api_catalog mcp a2a agent_skills webmcp oauth_oidc ard_catalog auth_md"),
]
#: Override key, the dimension it implies (empty: none).
OVERRIDE_KEYS = [
    ("protocols", "protocols"), ("account_auth", "account_auth"), ("ecommerce", "ecommerce"), ("feed_discovery", ""), ("article_schema", ""), ("localbusiness_schema", ""), ("news_article_schema", ""),
    ("claimreview_schema", ""), ("product_offer_schema", "ecommerce"), ("commerce_fields", "ecommerce"), ("api_catalog", "protocols"), ("mcp", "protocols"), ("a2a", "protocols"), ("agent_skills", "protocols"),
    ("webmcp", "protocols"), ("oauth_oidc", "account_auth"), ("ard_catalog", ""), ("auth_md", "account_auth"),
]
SCOPE_REQUESTS = [
    (1, "blog", ""), (2, "saas", "mcp=false"), (3, "corporate", "mcp=true"), (4, "ecommerce", "ecommerce=false"), (5, "news", "commerce_fields=true auth_md=true"), (6, "blog", "nonsense=true"),
    (7, "services", "protocols=false webmcp=true"), (8, "saas", "ard_catalog=false feed_discovery=true"),
]
#: JSON-LD type, field, whether it is required.
LD_FIELDS = [
    ("Organization", "name", True), ("Organization", "url", True), ("Organization", "logo", False), ("Organization", "sameAs", False), ("LocalBusiness", "name", True), ("LocalBusiness", "address", True),
    ("LocalBusiness", "telephone", True), ("LocalBusiness", "url", False), ("LocalBusiness", "sameAs", False), ("Product", "name", True), ("Product", "description", True), ("Product", "offers", True),
    ("Product", "image", False), ("Product", "brand", False), ("Offer", "price", True), ("Offer", "priceCurrency", True), ("Offer", "availability", True), ("WebSite", "name", True), ("WebSite", "url", True),
    ("WebSite", "description", False), ("SoftwareApplication", "name", True), ("SoftwareApplication", "applicationCategory", True), ("SoftwareApplication", "operatingSystem", True),
    ("SoftwareApplication", "description", False), ("SoftwareApplication", "offers", False), ("Article", "headline", True), ("Article", "author", True), ("Article", "datePublished", True),
    ("Article", "dateModified", False), ("Article", "image", False), ("BreadcrumbList", "itemListElement", True), ("FAQPage", "mainEntity", True), ("MerchantReturnPolicy", "applicableCountry", True),
    ("MerchantReturnPolicy", "returnPolicyCategory", True),
]
JSON_LD = [
    (1, 0, '{"@type": "Organization", "name": "A", "url": "https://a.example", "logo": "l.png", "sameAs": ["x"]}'), (1, 1, '{"@type": "WebSite", "name": " "}'), (2, 0, "{not json"),
    (3, 0, '{"@graph": [{"@type": "Product", "name": "P", "description": "d", "offers": {"price": 1}}, {"@type": "Thing"}]}'), (3, 1, "[]"), (4, 0, '[{"@type": ["Thing", "Article"], "headline": "h"}]'),
    (4, 1, "nope"), (5, 0, '{"@type": "Event", "name": "e"}'), (6, 0, '{"@type": "FAQPage", "mainEntity": []}'), (6, 1, '{"@type": "BreadcrumbList", "itemListElement": [1]}'),
]
LASTMODS = [(1, "2024-01-05"), (1, "2024-01-05T10:00:00Z"), (1, "2024-13-05"), (1, ""), (1, "2999-01-01"), (2, None), (2, "yesterday"), (2, "2023-06-30T23:30:00+00:00"), (3, "2022-02-29"), (3, "2022-02-28")]
VIEWPORTS = [
    (1, "width=device-width, initial-scale=1"), (2, "width=1024"), (3, "width=device-width, user-scalable=no"), (4, "width=device-width,maximum-scale=1.0"), (5, ""), (6, "WIDTH=Device-Width, maximum-scale=5"),
    (7, "maximum-scale=abc, width=device-width"),
]
LINKS = [
    (1, "https://a.example/about-us", "Our Story"), (1, "https://a.example/contact", "Contact"), (1, "https://a.example/legal/privacy", "Privacy"), (1, "https://www.instagram.com/acme", "Instagram"),
    (1, "https://x.com/acme", "X"), (2, "https://b.example/help", "FAQ"), (2, "https://b.example/returns", "Return policy"), (2, "https://www.linkedin.com/company/b", ""), (2, "https://b.example/delivery", "Delivery"),
    (3, "https://c.example/team", "Team"), (3, "https://medium.com/@c", "Blog"), (3, "https://c.substack.com", "News"), (3, "https://c.example/x", "Refunds"),
]
CANONICALS = [
    (1, "https://a.example/", "https://a.example", "https://a.example/", None), (2, "https://b.example/p?q=1", "https://b.example/p", "http://b.example/p", None), (3, "https://c.example/", None, "https://c.example/", "www.c.example"),
    (4, "https://www.d.example/", "https://d.example/", "http://www.d.example/", "d.example"), (5, "https://e.example/a/", "https://e.example/a#x", "https://e.example/a/", "e.example"),
]
PRICES = [(1, "$1,299.00", "1299"), (2, "1.299,00 EUR", "1299.00"), (3, "12,50", "12.5"), (4, "free", "0"), (5, "1 299", "1299"), (6, "99.9", "99.90"), (7, None, "5"), (8, "1,299", "1.299")]
ADDRESSES = [
    (1, "127.0.0.1"), (2, "10.1.2.3"), (3, "172.16.0.1"), (4, "172.32.0.1"), (5, "192.168.9.9"), (6, "169.254.1.1"), (7, "100.64.0.1"), (8, "100.128.0.1"), (9, "8.8.8.8"), (10, "0.0.0.0"), (11, "224.0.0.1"),
    (12, "256.1.1.1"), (13, "198.18.0.1"), (14, "203.0.113.9"), (15, "240.0.0.1"), (16, "not an address"), (17, "1.2.3.4"),
]

LLMS = [
    (1, "# Acme\n\n- [Docs](https://a.example/docs)"), (2, "Acme without a title https://b.example"), (3, "# Short"), (4, "   # Padded title of a site\nno address at all   "), (5, ""), (6, "# Site with a plain address http://c.example/x"),
]
HEADERS = [
    (1, "vary", "Accept-Encoding, Accept"), (1, "link", '</index.md>; rel="alternate"; type="text/markdown"'), (2, "vary", "*"), (2, "content-location", "/page.MD"), (3, "vary", "Accept-Language"),
    (3, "content-signal", "search=yes"), (4, "x-agent-hint", "see llms.txt"), (4, "link", "<https://x.example>; rel=canonical"), (5, "content-type", "text/markdown"), (6, "server", "token-ring"),
    (5, "link", '</.well-known/api-catalog>; rel="api-catalog", </auth.md>; rel="describedby"'), (6, "LINK", "</.well-known/agent.json>; rel=agent"),
]
FEEDS = [
    (1, "<rss><channel><item><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item><item><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"),
    (2, "<feed><entry><updated>2023-05-06T07:08:09Z</updated></entry></feed>"), (3, "<rss><channel><item><pubDate>soon</pubDate></item></channel></rss>"), (4, "<rss><channel></channel></rss>"),
    (5, "<feed><entry><updated>2999-01-01T00:00:00Z</updated></entry><entry><updated>2024-03-01T00:00:00Z</updated></entry></feed>"),
]
#: What is wrong with each peer of a snapshot: the check it is in and the row there (None: no row).
SNAPSHOT_FAULTS = {
    "ok": {}, "too much": {"robots_txt": (7, 6, "pass", "inferred")}, "wrong max": {"robots_txt": (4, 5, "pass", "inferred")}, "odd state": {"robots_txt": (4, 6, "great", "inferred"), "ssr": (4, 4, "pass", "guessed")},
    "unknown check": {"magic": (1, 1, "pass", "verified"), "ssr": None}, "one missing": {"wikipedia": None}, "below zero": {"social": (-1, 2, "fail", "verified")},
}
SNAPSHOT = [
    (name, check, *row) for name, faults in SNAPSHOT_FAULTS.items() for check, row in ({c: (m - 1, m, "partial", "inferred") for _, c, m in RUBRIC} | faults).items() if row is not None
]
CATALOGS = [
    (1, "a.example", '{"specVersion": "1.0", "host": {"domain": "a.example"}, "entries": [{"identifier": "urn:air:a.example:agent:x"}]}'), (2, "b.example", '{"specVersion": "one", "host": {"domain": "other.example"}, "entries": []}'),
    (3, "c.example", "[1]"), (4, "d.example", "{broken"), (5, "e.example", '{"specVersion": "2.1.0-beta", "host": {"domain": "www.e.example"}, "entries": [{"identifier": "urn:air:evil.example:a:b"}, {"identifier": "x"}]}'),
    (6, "f.example", '{"entries": {"a": 1}}'), (7, "g.example", ""),
]
SURFACES = [
    (1, "a.example", "/openapi.json", True), (1, "a.example", "/llms.txt", True), (1, "a.example", "/mcp.json", False), (2, "www.b.example", "/feed.xml", True), (2, "www.b.example", "/.well-known/agent.json", True), (3, "c.example", "/openapi.json", True),
    (4, "elsewhere.example", "/openapi.json", True),
]
SURFACE_LINKS = [
    (1, "https://a.example/openapi.json?v=1"), (1, "https://a.example/other"), (2, "https://b.example/feed.xml#top"), (3, "https://elsewhere.example/openapi.json"), (2, "https://b.example/.well-known/agent.json/"), (4, "https://elsewhere.example/openapi.json"),
    (1, "https://notes.example/llms.txt"),
]
PROBE_PASSES = [(1, k) for k in (0, 1, 4, 9, 12)] + [(2, k) for k in range(0, 20, 3)] + [(3, k) for k in range(8)]

#: Rows that are not scored here (pillar, check, most points).
LOCKED = [
    ("off_site", "earned_mentions_backlinks", 8), ("off_site", "owned_social_presence", 6), ("off_site", "social_traction_reviews", 6), ("off_site", "ai_citation_share", 4), ("scrapability", "extraction_fidelity", 4),
    ("scrapability", "agent_task_simulation", 3), ("seo", "multi_engine_index_coverage", 5), ("seo", "core_web_vitals", 5), ("seo", "keyword_competitor_gap", 3),
]
FORMS = [
    (1, '<form action="/search" method="get"><input name="q"><button>Go</button></form>'), (2, '<form><input type="email" name="mail"><input type="hidden" name="t"></form>'),
    (3, '<form action="javascript:send()" method="put"><textarea name="field1"></textarea><select name=""></select><input type="submit" value="Send"></form>'), (4, "<p>No form here</p>"),
    (5, '<form action="#" method="post"><input type="tel" name="phone" autocomplete="tel"><input type="password" name="secret" autocomplete="off"></form><form action="/b" method="POST"><input name="input"></form>'),
]
URLS = [
    (1, "HTTPS://A.Example:443/Path/?q=1#f"), (2, "http://b.example:8080"), (3, "http://b.example:80/"), (4, "ftp://c.example/x"), (5, "https://d.example//"), (6, "not a url"), (7, "https://e.example/a/b/?x"), (8, None), (9, "https://a.example/Path"),
]
ENTITIES = [("acme", True, True), ("bolt", True, False), ("corp", False, True), ("dome", False, False)]
LOOKUPS = [(1, "acme", 200), (2, "bolt", 200), (3, "corp", 200), (4, "dome", 200), (5, "acme", 429), (6, "none", 200), (7, "bolt", None)]
BLURBS = [
    (1, 1, "Acme", "Buy the best anvils in town from Acme, since 1990, with free delivery to every canyon."), (1, 2, "Acme", "Short."), (1, 3, None, "Buy the best anvils in town from Acme, since 1990, with free delivery to every canyon."), (2, 1, "B", None),
    (2, 2, "C", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt."), (3, 1, "D", "Coming soon" + " and more" * 30),
]

ROUTES = [
    (1, "browser", 200, "https://a.example/", "https://a.example", 20000, 500), (1, "Googlebot", 200, "https://a.example/", "https://a.example", 21000, 480), (1, "GPTBot", 403, "https://a.example/", None, 900, 10),
    (1, "CCBot", 200, "https://a.example/en", "https://a.example/en", 40000, 900), (2, "browser", 200, "https://b.example/", None, 800, 20), (2, "Googlebot", 200, "https://b.example/", "https://b.example", 100, 2), (2, "GPTBot", None, "https://b.example/", None, 0, 0),
]
DNS = [
    (1, "a.example", "TXT", "v=spf1 -all"), (1, "_agent.a.example", "TXT", "agent=https://a.example/agent.json"), (2, "b.example", "TXT", "mcp endpoint"), (2, "b.example", "MX", "agent"), (3, "_dns-aid.c.example", "TXT", "AID=1"), (4, "d.example", "TXT", "nothing here"),
]
SURFACE_BODIES = [
    (1, "MCP server card", '{"name": "server", "tools": []}'), (1, "auth.md", "# Authorization\nUse a key here."), (1, "content feed", "<rss><channel><title>x</title></channel></rss>"), (2, "MCP server card", "not json at all, sadly"),
    (2, "content feed", "<html><body>nothing</body></html>"), (2, "auth.md", "no heading but Authorization is named"), (3, "llms.txt", "short"), (3, "llms.txt", "# A title and some more text"), (3, "API catalog", '[{"linkset": "1234567890"}]'), (4, "API catalog", ""),
]
COMMERCE = [
    (1, "visible", "product_name", "Red Anvil"), (1, "schema", "product_name", "red  anvil"), (1, "visible", "price", "10.00"), (1, "schema", "price", "12.00"), (1, "visible", "shipping", "free"), (2, "schema", "availability", "InStock"),
    (2, "visible", "returns", "30 days"), (2, "schema", "returns", "none"), (3, "visible", "sku_or_gtin", ""), (3, "schema", "sku_or_gtin", "A1"), (3, "visible", "availability", "in stock"), (3, "schema", "availability", "In Stock"),
]
CACHE = [("a", "2024-01-01", 4), ("a", "2024-03-01", 3), ("b", "2024-05-02", 2), ("c", "2024-05-31", 0), ("d", "2024-06-01", 4)]

_LONG = "<p>" + "word " * 100 + "</p>"
BOT_PAGES = [
    (1, "browser", 200, None, "<title>Shop</title>" + _LONG, ""), (1, "Googlebot", 200, None, "<title>Just a moment...</title><p>Checking your browser</p>", "server: x"), (1, "GPTBot", 200, None, "<title>reCAPTCHA</title>" + _LONG, ""),
    (1, "CCBot", 403, None, "", ""), (1, "Bingbot", None, "timeout", None, None), (1, "ClaudeBot", 200, None, "<title>Shop</title>" + _LONG, "cf-chl-bypass: 1"), (1, "OAI-SearchBot", 200, None, "<p>few words here</p>", ""), (1, "PerplexityBot", 200, None, _LONG, ""),
    (2, "browser", 200, None, "<title>Captcha art</title><p>Access denied is our new song</p>", ""), (2, "Googlebot", 200, None, "<title>Captcha art</title><p>Access denied is our new song</p>", ""), (2, "GPTBot", 429, None, "", ""),
    (3, "Googlebot", 200, None, "<p>DataDome</p>", ""), (4, "browser", 200, None, None, None), (4, "CCBot", 200, None, None, None),
]
SIGNAL_HEADERS = [(1, "search=yes, ai-train=no"), (2, "nothing"), (6, "AI-Input=yes"), (3, None)]
JSON_DOCUMENTS = [
    (1, "API Catalog", 404, "application/json", "{}", "linkset api-catalog"), (1, "API Catalog", 200, "application/linkset+json", '{"linkset": []}', "linkset api-catalog"), (1, "MCP Server Card", 200, "application/json", '{"error": "not found", "code": 404}', "name"),
    (2, "MCP Server Card", 200, "text/html", '{"name": "x"}', "name"), (2, "MCP Server Card", 200, "application/json; charset=utf-8", ' {"name": "x"} ', "name"), (2, "Agent Skills index", 200, "application/json", "[1, 2]", "skills"),
    (3, "WebMCP manifest", 200, "application/json", "not json", "name tools"), (3, "catalog", 200, "application/json", "[]", ""), (3, "other", 200, "application/json", '{"a": 1}', ""), (3, "API Catalog", None, None, None, "linkset"),
]
AUTH_TEXTS = [(1, 200, "# Authentication\nAsk for a key."), (1, 404, "# Authentication for all agents"), (2, 200, "Agents authenticate with a key of theirs"), (3, 200, "# short"), (4, 500, "# Authentication\nAsk for a key."), (5, 200, "Nothing of the sort is told here.")]
DNS_SITES = [(1, "https://www.a.example/x"), (2, "https://b.example:8443"), (3, "not a url"), (4, "https://WWW.Long.Name.example")]
_PROSE = "Plain words of some length that tell of the shop and its goods, of the people in it and of the days on which it is open to all who like to come and see what there is to be had. "
TEXT_FETCHES = [
    (1, "negotiated", 200, "text/markdown; charset=utf-8", "Accept-Encoding, ACCEPT", "# Shop\n\n" + _PROSE * 2), (2, "negotiated", 200, "text/html", "", "<!DOCTYPE html><p>no</p>"), (3, "negotiated", 200, "", "*", "- one\n- two\n\n" + _PROSE * 2),
    (4, "negotiated", 200, "", None, _PROSE * 2), (5, "negotiated", 200, "text/plain", "Accept", "Short."), (6, "negotiated", 404, "text/plain", "Accept", _PROSE * 2), (7, "negotiated", 200, "application/json", "Accept", _PROSE * 2), (8, "negotiated", None, None, None, None),
    (1, "/index.md", 200, "text/x-markdown", "", "| a | b |\n|---|---|\n" + _PROSE), (2, "/index.md", 200, "text/plain", "", "   " + _PROSE + "  "),
]
TEXT_SITES = [
    (1, "# Acme\n\n- [Docs](https://a.example/docs)", True, True, True, True, True), (2, None, True, True, True, False, True), (3, "too short", False, False, False, False, True), (4, None, False, False, False, False, True), (5, None, False, False, False, False, False),
    (6, "Acme without a title https://b.example", True, False, True, True, True),
]


JSON_FEEDS = [
    (1, '{"items": [{"date_published": "2024-05-01T10:00:00Z"}, {"date_modified": "2024-05-03", "date_published": "2024-04-01"}, {"title": "no date"}]}'), (2, '{"items": [{"date_published": "soon"}, {"updated": "2999-01-01"}]}'), (3, '{"items": []}'),
    (4, '{"title": "no items"}'), (5, "not json"), (6, None),
]
SITE_SCOPES = [(k + 1, bool(k & 1), bool(k & 2), bool(k & 4)) for k in range(8)]
#: Which probes each peer passed: every n-th from the k-th, and one label that is no probe.
PEER_PROBES = [(name, PROBES[i][0]) for n, (name, *_) in enumerate(PEERS) for i in range(n % 3, len(PROBES), n % 5 + 1)] + [("Harbour Lamps", "a probe of old")]
SCOPE_FAULTS = [
    (1, None, "mcp=true"), (2, "nonsense", "mcp=true"), (3, "blog", "magic=true"), (4, "blog", "protocols=true"), (5, "saas", "account_auth=true oauth_oidc=false auth_md=false"), (6, "ecommerce", "ecommerce=true product_offer_schema=false commerce_fields=false"),
    (7, "saas", "protocols=true"), (8, "blog", ""), (9, None, ""), (10, "blog", "protocols=true ecommerce=true nothing=false"),
]
TARGETS = [
    (1, "::1"), (2, "::"), (3, "fe80::1"), (4, "fc00::1"), (5, "fd12:3456::1"), (6, "ff02::1"), (7, "2001:db8::1"), (8, "::ffff:127.0.0.1"), (9, "::ffff:8.8.8.8"), (10, "2606:4700:4700::1111"), (11, "2a00:1450:4001:81b::200e"), (12, "8.8.4.4"), (13, "10.0.0.1"), (14, "x"), (15, None),
]
RESOLVED = [
    (1, "a.example", 0, "2606:4700:4700::1111"), (1, "a.example", 1, "8.8.8.8"), (1, "a.example", 2, "8.8.4.4"), (2, "b.example", 0, "9.9.9.9"), (2, "b.example", 1, "127.0.0.1"), (3, "c.example", 0, "2a00:1450:4001:81b::200e"), (3, "d.example", 0, "::1"), (4, "e.example", 0, None),
]
#: Every combination of the nine findings.
DISCOVERIES = [(k + 1, *(bool(k & 1 << b) for b in range(9))) for k in range(512)]
BODIES = [(1, "abcdefgh"), (2, "abcdefghij"), (3, "abcdefghä"), (4, "abcdefg€"), (5, "abcdef😀"), (6, "ääääää"), (7, ""), (8, None), (9, "abcdefg😀x")]

#: Discovery surface, its usual paths, scope.
SURFACE_PATHS = {
    "llms-full text export": ("core", "/llms-full.txt"), "API description": ("protocols", "/openapi.json /api/openapi.json /swagger.json"),
    "API catalog": ("protocols", "/.well-known/api-catalog /.well-known/api-catalog.json /api-catalog.json"), "ARD catalog": ("protocols", "/.well-known/ai-catalog.json"),
    "OAuth authorization metadata": ("account_auth", "/.well-known/oauth-authorization-server /.well-known/openid-configuration"), "OAuth protected resource metadata": ("account_auth", "/.well-known/oauth-protected-resource"),
    "Web Bot Auth directory": ("core", "/.well-known/http-message-signatures-directory"),
    "MCP server card": ("protocols", "/.well-known/mcp/server-card.json /.well-known/mcp.json /.well-known/mcp-server /.well-known/mcp-server.json"),
    "A2A agent card": ("protocols", "/.well-known/agent-card.json /.well-known/a2a-agent.json /.well-known/agent.json"),
    "Agent skills": ("protocols", "/.well-known/agent-skills/index.json /.well-known/agent-skills.json /.well-known/skills.json"), "WebMCP manifest": ("protocols", "/.well-known/webmcp.json /.well-known/webmcp"),
    "auth.md": ("account_auth", "/auth.md /.well-known/auth.md"),
    "agentic commerce metadata": ("commerce", "/.well-known/x402 /.well-known/x402.json /.well-known/mpp.json /.well-known/ucp.json /.well-known/acp.json /.well-known/payments.json"), "content feed": ("core", "/feed.xml /rss.xml /atom.xml"),
    "catalog JSON": ("commerce", "/products.json /catalog.json /collections/all/products.json"), "legacy ai-plugin.json": ("protocols", "/.well-known/ai-plugin.json"), "NLWeb /ask endpoint": ("protocols", "/ask"),
}
USUAL_PATHS = [("/docs", "core"), ("/pricing", "commerce"), ("/integrations", "commerce"), ("/api", "protocols")]
SURFACE_FETCHES = [
    (1, "content feed", "/feed.xml", 200, "<rss><channel><title>x</title></channel></rss>"), (1, "API description", "/openapi.json", 200, '{"openapi": "3.1", "info": 1}'), (2, "API description", "/openapi.json", 200, '{"openapi": "3.1", "info": 1}'),
    (2, "legacy ai-plugin.json", "/.well-known/ai-plugin.json", 200, '{"api": {"url": "https://b.example/api"}}'), (2, "NLWeb /ask endpoint", "/ask", 200, None), (2, "auth.md", "/auth.md", 200, "# Authentication\nAsk for a key."),
    (3, "auth.md", "/auth.md", 200, "# Authentication\nAsk for a key."), (3, "API catalog", "/api-catalog.json", 404, '{"linkset": "a long enough body"}'), (4, "legacy ai-plugin.json", "/.well-known/ai-plugin.json", 200, '{"name": "no plugin at all"}'),
    (5, "catalog JSON", "/products.json", 200, '[{"product": "lamp", "price": 3}]'), (8, "catalog JSON", "/catalog.json", 200, "not json, but long enough to tell"), (8, "llms-full text export", "/llms-full.txt", 200, "A text of more than twenty characters"),
    (8, "MCP server card", "/.well-known/mcp.json", 200, '{"name": "server", "tools": []}'), (8, "A2A agent card", "/.well-known/agent.json", 200, '{"a": 1}'), (8, "content feed", "/atom.xml", 200, "<html><body>nothing here</body></html>"),
    (1, "usual", "/docs", 200, "Docs"), (1, "usual", "/pricing", 404, "no"), (2, "usual", "/api", 200, "API"), (6, "usual", "/docs", 200, "  "), (8, "usual", "/integrations", 200, "x"),
]
HINTS = [(1, "Link header discovery"), (1, "DNS-AID TXT discovery"), (4, "ARD HTML link discovery"), (4, "ARD HTML link discovery"), (7, "NLWeb Schemamap robots directive")]
_ENTRY = '{"identifier": "urn:air:%s:agent:x", "displayName": "X", "mediaType": "application/json", "url": "https://a.example/x", "description": "d", "tags": ["t"], "representativeQueries": ["q"], "updated": "2024-05-01T10:00:00Z"}'
FULL_CATALOGS = [
    (1, "a.example", '{"specVersion": "1.0", "host": {"domain": "www.a.example"}, "trustManifest": {}, "entries": [%s]}' % (_ENTRY % "a.example")), (2, "b.example", '{"specVersion": " ", "entries": "none"}'), (3, "c.example", "[1]"), (4, "d.example", "  "),
    (5, "e.example", '{"specVersion": "one", "host": {"hostname": "other.example"}, "entries": [{}, 3, %s]}' % (_ENTRY % "evil.example")), (6, "f.example", '{"specVersion": "2.0.1-rc", "host": {"name": "x"}, "entries": []}'),
    (7, "www.g.example", '{"specVersion": "1.2", "host": {"domain": "g.example"}, "entries": [{"identifier": "urn:air:api.g.example:a", "displayName": "d", "type": "t", "data": {"a": 1}, "url": "ftp://x", "description": "", "capabilities": [" "], "representativeQueries": [""], "updated": "soon", "trustManifest": 1}]}'),
    (8, "h.example", "{broken"), (9, "i.example", '{"specVersion": "1.0", "host": {"domain": "i.example"}, "entries": [{"identifier": "urn:air:i.example:a", "displayName": "d", "mediaType": "t", "data": 5, "description": "x", "capabilities": ["c"], "representativeQueries": ["q", "r"], "lastUpdated": "2024-05-01"}]}'),
]

RELATIONS: dict[str, tuple[list[tuple], str]] = {
    "surface_kind": ([(s, p, scope) for s, (scope, paths) in SURFACE_PATHS.items() for p in paths.split()], "surface string, path string, scope string"),
    "usual_path": (USUAL_PATHS, "path string, scope string"),
    "surface_fetch": (SURFACE_FETCHES, "site_id long, surface string, path string, status long, body string"),
    "hint": (HINTS, "site_id long, hint string"),
    "full_catalog": (FULL_CATALOGS, "site_id long, host string, body string"),
    "bot_page": (BOT_PAGES, "site_id long, bot string, status long, error string, html string, headers string"),
    "signal_header": (SIGNAL_HEADERS, "site_id long, value string"),
    "json_document": (JSON_DOCUMENTS, "site_id long, label string, status long, content_type string, body string, keys string"),
    "auth_text": (AUTH_TEXTS, "site_id long, status long, body string"),
    "dns_site": (DNS_SITES, "site_id long, url string"),
    "text_fetch": (TEXT_FETCHES, "site_id long, label string, status long, content_type string, vary string, body string"),
    "text_site": (TEXT_SITES, "site_id long, llms string, sitemap_valid boolean, has_lastmod boolean, in_robots boolean, markdown boolean, reached boolean"),
    "json_feed": (JSON_FEEDS, "site_id long, body string"),
    "site_scope": (SITE_SCOPES, "site_id long, protocols boolean, account_auth boolean, commerce boolean"),
    "peer_probe": (PEER_PROBES, "name string, label string"),
    "scope_fault": (SCOPE_FAULTS, "site_id long, preset string, overrides string"),
    "target": (TARGETS, "site_id long, ip string"),
    "resolved": (RESOLVED, "site_id long, host string, ordinal long, ip string"),
    "discovery": (DISCOVERIES, "site_id long, crawlers_allowed boolean, sitemap_valid boolean, lastmod_good boolean, freshness boolean, sitemap_clean boolean, metadata_ok boolean, blurbs_ok boolean, hreflang_ok boolean, trust_ok boolean"),
    "body": (BODIES, "site_id long, body string"),
    "rubric": (RUBRIC, "pillar string, check_name string, max_score long"),
    "pillar_cap": (PILLAR_CAPS, "pillar string, cap long"),
    "crawler": ([(k, *r) for k, r in enumerate(CRAWLERS)], "ordinal long, bot string, purpose string, scored boolean, probed boolean"),
    "purpose": (PURPOSES, "purpose string, weight double"),
    "access": (ACCESS, "access string, points double"),
    "robots": (ROBOTS, "site_id long, body string"),
    "x_robots": (X_ROBOTS, "site_id long, value string"),
    "bot_fetch": (BOT_FETCHES, "site_id long, bot string, attempt long, status long, words long, title string"),
    "hreflang": (HREFLANG, "site_id long, src string, lang string, href string"),
    "peer": ([(n, g, s, RUBRIC[k][1], p) for n, g, s, points in PEERS for k, p in enumerate(points)], "name string, grp string, size string, check_name string, score long"),
    "probe": ([(k, *r) for k, r in enumerate(PROBES)], "ordinal long, label string, category string, scope string"),
    "preset": (PRESETS, "preset string, protocols boolean, account_auth boolean, ecommerce boolean, families string"),
    "override_key": (OVERRIDE_KEYS, "key string, dimension string"),
    "scope_request": (SCOPE_REQUESTS, "site_id long, preset string, overrides string"),
    "ld_field": (LD_FIELDS, "type string, field string, required boolean"),
    "json_ld": (JSON_LD, "site_id long, script_no long, body string"),
    "lastmod": (LASTMODS, "site_id long, value string"),
    "viewport": (VIEWPORTS, "site_id long, content string"),
    "link": (LINKS, "site_id long, href string, label string"),
    "canonical": (CANONICALS, "site_id long, final_url string, canonical string, http_final string, other_host string"),
    "price": (PRICES, "site_id long, shown string, declared string"),
    "address": (ADDRESSES, "site_id long, ip string"),
    "llms": (LLMS, "site_id long, body string"),
    "header": (HEADERS, "site_id long, name string, value string"),
    "feed": (FEEDS, "site_id long, body string"),
    "snapshot": (SNAPSHOT, "name string, check_name string, score long, max long, state string, evidence string"),
    "catalog": (CATALOGS, "site_id long, host string, body string"),
    "surface": (SURFACES, "site_id long, host string, path string, found boolean"),
    "surface_link": (SURFACE_LINKS, "site_id long, href string"),
    "probe_pass": (PROBE_PASSES, "site_id long, ordinal long"),
    "locked": (LOCKED, "pillar string, check_name string, max_score long"),
    "form_page": (FORMS, "site_id long, html string"),
    "url": (URLS, "site_id long, url string"),
    "entity": (ENTITIES, "name string, in_wikidata boolean, in_wikipedia boolean"),
    "lookup": (LOOKUPS, "site_id long, name string, status long"),
    "blurb": (BLURBS, "site_id long, page long, title string, description string"),
    "route": (ROUTES, "site_id long, bot string, status long, final_url string, canonical string, bytes long, words long"),
    "dns": (DNS, "site_id long, name string, rtype string, txt string"),
    "surface_body": (SURFACE_BODIES, "site_id long, kind string, body string"),
    "commerce": (COMMERCE, "site_id long, side string, field string, value string"),
    "cache": (CACHE, "cache_key string, checked string, score long"),
    "check_row": (CHECK_ROWS, "site_id long, check_name string, score long, state string, evidence string, effort string, ordinal long"),
}


def relation(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = RELATIONS[name]
    return spark.createDataFrame(rows, schema)


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"{value}::double" if isinstance(value, float) else str(value)


def sites_of(*names: str) -> int:
    """How many sites the literal relations with site_id tell of; none if there is no such."""
    return max((r[0] for n in names if RELATIONS[n][1].startswith("site_id ") for r in RELATIONS[n][0]), default=0)


def with_relations(sql: str, *names: str, fed: dict[str, str] | None = None) -> str:
    """DuckDB SQL with the named relations as common table expressions before it, those with site_id dealt over all pages (see evidence.dealt), those in ``fed`` by their key (evidence.fed)."""
    kinds = {"string": "varchar", "long": "bigint", "double": "double", "boolean": "boolean"}
    out = []
    for name in names:
        rows, schema = RELATIONS[name]
        columns = [c.split() for c in schema.split(", ")]
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        cast = ", ".join(f"{c}::{kinds[k]} as {c}" for c, k in columns)
        sites = sites_of(name) and sites_of(*names)
        key = (fed or {}).get(name)
        out.append(f"{'literal_' * bool(sites or key)}{name} as (select {cast} from (values {values}) v({', '.join(c for c, _ in columns)}))")
        if sites:
            out.append(f"{name} as (select p.page_id as site_id, l.* exclude (site_id) from pages p join literal_{name} l on l.site_id = p.page_id % {sites} + 1 where p.page_id is not null)")
        if key:
            out.append(
                f"{name} as (select l.* exclude ({key}, no_), l.{key} || ' ' || p.page_id as {key} from pages p join (select *, dense_rank() over (order by {key}) - 1 as no_ from literal_{name}) l "
                f"on l.no_ = p.page_id % (select count(distinct {key}) from literal_{name}) where p.page_id is not null)"
            )
    sql = sql.strip()
    recursive = sql.startswith("with recursive ")
    sql = sql.replace("with recursive ", "with ", 1) if recursive else sql
    return "with " + "recursive " * recursive + ",\n".join(out) + (",\n" + sql[5:] if sql.startswith("with ") else "\n" + sql)
