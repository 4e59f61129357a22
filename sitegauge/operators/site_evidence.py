"""Operators over fetched evidence of sites: crawler challenges, robots and text checks in full, discovery documents, readiness by scope.

Null bodies count as empty and null headers as absent. Rows that repeat count as often as they stand there, but where a site has one row
by contract (robots, text access) it gives one row each.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import html as H
from sitegauge.functions.urls import codes, hostname, joined, urljoin

from . import robots as R
from .scoring import first_names, histogram, nearest, position, standing

#: Fixed values.
BLOCK_SIGNATURES = ("just a moment", "checking your browser", "cf-chl", "cloudflare ray id", "verify you are human", "access denied", "datadome", "perimeterx", "akamai bot manager")
BLOCK_STATUS = (401, 403, 429, 503)
SCANNED = 20_000
LINK_TOKENS = ("api-catalog", "oauth-authorization-server", "oauth-protected-resource", "mcp", "agent", "webmcp", "auth.md")
ERROR_KEYS = ("error", "message", "status", "code")
DNS_PREFIXES = ("_index._agents", "_a2a._agents", "_mcp._agents")
PROTOCOL_FAMILIES, AUTH_FAMILIES, SHOP_FAMILIES = ("api_catalog", "mcp", "a2a", "agent_skills", "webmcp"), ("oauth_oidc", "auth_md"), ("product_offer_schema", "commerce_fields")
CATEGORIES = ("Discoverability", "Content Accessibility", "Bot Access Control", "Protocol Discovery", "Commerce")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def bot_challenges(rows: DataFrame) -> DataFrame:
    """Why each crawler's fetch (site_id, bot, status, error, html, headers as text) is a blocked one; null if it is not.

    Marks of protection services in the first ``SCANNED`` characters or the headers, or a captcha in the title, make a challenge, unless the browser's
    fetch of the site has the same. A body is thin below a quarter of the browser's words (20 at least) where that has 80.
    """
    sample = F.lower(F.concat(F.substring(_blank("html"), 1, SCANNED), F.lit(" "), _blank("headers")))
    marked = F.lit(False)
    for s in BLOCK_SIGNATURES:
        marked = marked | F.contains(sample, F.lit(s))
    title = F.lower(F.regexp_extract(_blank("html"), H.content_of("title"), 1))
    r = rows.select("site_id", "bot", "status", "error", marked.alias("marked"), F.contains(title, F.lit("captcha")).alias("captcha"), H.words(H.visible_text(_blank("html"))).alias("words"))
    base = r.where("bot = 'browser'").groupBy("site_id").agg(F.bool_or("marked").alias("b_marked"), F.bool_or("captcha").alias("b_captcha"), F.max("words").alias("b_words"))
    r = r.where("bot <> 'browser'").join(base, "site_id", "left").fillna(False, ["b_marked", "b_captcha"]).fillna(0, ["b_words"])
    challenge = (F.col("marked") | F.col("captcha")) & ~(F.col("marked") & F.col("b_marked")) & ~(F.col("captcha") & F.col("b_captcha"))
    thin = (F.col("b_words") >= 80) & (F.col("words") < F.greatest(F.lit(20.0), F.col("b_words") * 0.25))
    reason = F.when(F.col("error").isNotNull(), "fetch error").when(F.col("status").isin(*BLOCK_STATUS), F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(challenge, "challenge page").when(thin, "thin response")
    return r.select("site_id", "bot", "words", reason.alias("reason"))


def signal_tokens(value: Column) -> Column:
    """The content-signal tokens that a header or directive names, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, R.SIGNALS)), lambda t: F.contains(F.lower(F.coalesce(value, F.lit(""))), t)))


def robots_check(robots: DataFrame, signals: DataFrame, crawlers: DataFrame, purposes: DataFrame, points: DataFrame) -> DataFrame:
    """The whole robots check of every site: points of access, one more for content signals in the body or a response header, less the penalty for its
    faults; state; blocked crawlers by purpose, crawlers named, and whether a schema map is named. ``signals``: (site_id, value) of Content-Signal headers."""
    access = R.access(robots, crawlers)
    blocked = F.col("access").endswith("blocked")
    groups = access.where(blocked).groupBy("site_id", "purpose").agg(F.sort_array(F.collect_set("bot")).alias("bots"))
    groups = groups.groupBy("site_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("purpose"), F.lit(": "), F.array_join("bots", ", ")))), "; ").alias("blocked"))
    per = access.groupBy("site_id").agg(F.count("*").alias("tracked"), F.count_if(blocked).alias("n_blocked"), F.count_if(F.col("access").startswith("explicit")).alias("named"), F.count_if(F.col("access") == "explicit_allowed").alias("n_explicit"))
    scores = R.access_score(robots, crawlers, purposes, points).select("site_id", F.col("score").alias("points"))
    faults = R.quality(robots).select("site_id", "penalty", (F.col("penalty") > 0).alias("faulty"))
    told = R.content_signals(robots).select("site_id").distinct().withColumn("in_body", F.lit(True))
    sent = signals.where(F.size(signal_tokens(F.col("value"))) > 0).select("site_id").distinct().withColumn("in_header", F.lit(True))
    schema = R.lines(robots).where("key = 'schemamap'").select("site_id").distinct().withColumn("schema_map", F.lit(True))
    rows = robots.select("site_id", (F.trim(_blank("body")) != "").alias("there"))
    for other in (scores, per, groups, faults, told, sent, schema):
        rows = rows.join(other, "site_id", "left")
    rows = rows.fillna(False, ["in_body", "in_header", "schema_map", "faulty"]).fillna(0, ["points", "penalty", "tracked", "n_blocked", "n_explicit", "named"]).fillna("", ["blocked"])
    bonus = (F.col("in_body") | F.col("in_header")).cast("int")
    score = F.when(F.col("there"), F.greatest(F.least(F.col("points") + bonus, F.lit(6)) - F.col("penalty"), F.lit(0))).otherwise(2 + F.col("in_header").cast("int"))
    whole = (F.col("n_blocked") == 0) & (F.col("n_explicit") == F.col("tracked")) & ~F.col("faulty")
    state = F.when(~F.col("there"), "warn").when(whole, "pass").when((F.col("tracked") > 0) & (F.col("n_blocked") == F.col("tracked")), "fail").otherwise("partial")
    return rows.select("site_id", score.cast("long").alias("score"), state.alias("state"), F.when(F.col("there"), "inferred").otherwise("unknown").alias("evidence"), "blocked", F.col("named").cast("long").alias("named"), "schema_map")


def sitemap_references(robots: DataFrame) -> DataFrame:
    """(site_id, ordinal, value) of the Sitemap lines of robots bodies, comments and all."""
    lines = F.posexplode(F.split(_blank("body"), "\r\n|\n|\r"))
    r = robots.select("site_id", lines.alias("line_no", "line")).where(F.contains("line", F.lit(":")))
    r = r.where(F.lower(F.trim(F.substring_index("line", ":", 1))) == "sitemap")
    return r.select("site_id", F.col("line_no").cast("long").alias("ordinal"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def text_response(rows: DataFrame) -> DataFrame:
    """Whether each fetched text (site_id, label, status, content_type, vary, body) would do as Markdown, with the codes of what is wrong with it."""
    body = F.substring(F.regexp_replace(_blank("body"), r"^\s+|\s+$", ""), 1, 6000)
    low, kind = F.lower(body), F.lower(_blank("content_type"))
    is_html = low.rlike("^(<!doctype html|<html)")
    words = F.size(F.regexp_extract_all(body, F.lit("[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0)))
    meaningful = ((words >= 30) | (F.length(body) >= 200)) & ~is_html
    marks = F.startswith(body, F.lit("#")) | body.rlike(r"\[[^\]]+\]\([^)]+\)") | body.rlike(r"(?dm)^[-*]\s+\S") | body.rlike(r"(?dm)^```") | body.rlike(r"(?dm)^\|.+\|$")
    structured = marks & ~is_html
    typed = kind.rlike("text/markdown|text/x-markdown|text/plain")
    varies = F.exists(F.split(_blank("vary"), ","), lambda t: F.lower(F.trim(t)).isin("accept", "*"))
    ok = (F.col("status") >= 200) & (F.col("status") < 400)
    r = rows.select("site_id", "label", F.coalesce(ok, F.lit(False)).alias("ok"), is_html.alias("is_html"), meaningful.alias("meaningful"), structured.alias("structured"), typed.alias("typed"), (kind == "").alias("untyped"), varies.alias("varies"), (F.length(body) < 80).alias("short"))
    available = F.col("ok") & F.col("meaningful") & (F.col("typed") | (F.col("untyped") & F.col("structured")))
    found = codes((~F.col("ok"), "not_ok"), (F.col("ok") & (F.col("short") | (~F.col("meaningful") & ~F.col("is_html"))), "too_short"), (F.col("ok") & F.col("is_html"), "html_body"), (F.col("ok") & ~F.col("typed") & F.col("untyped"), "no_content_type"), (F.col("ok") & ~F.col("typed") & ~F.col("untyped"), "other_content_type"), (F.col("ok") & ~F.col("varies"), "no_vary_accept"))
    return r.select("site_id", "label", available.alias("available"), "structured", joined(found).alias("codes"))


def llms_check(rows: DataFrame) -> DataFrame:
    """The whole text-access check (0 to 5) from the site's findings: llms (body or null), sitemap_valid, has_lastmod, in_robots, markdown.

    A site whose every fetch failed (``reached`` false) is of unknown evidence.
    """
    t = F.regexp_replace(_blank("llms"), r"^\s+|\s+$", "")
    valid = (F.length(t) >= 20) & F.startswith(t, F.lit("#")) & (t.rlike(r"""https?://[^\s)>"]+""") | t.rlike(r"\[[^\]]+\]\([^)]+\)"))
    points = F.when(F.col("llms").isNull(), 0).when(valid, 2).otherwise(1) + sum((F.col(c).cast("int") for c in ("sitemap_valid", "has_lastmod", "in_robots", "markdown")), F.lit(0))
    score = F.when(F.col("reached"), F.least(points, F.lit(5))).otherwise(0)
    r = rows.select("site_id", "reached", score.cast("long").alias("score"), F.coalesce(valid & F.col("llms").isNotNull(), F.lit(False)).alias("valid"))
    state = F.when(~F.col("reached"), "warn").when(F.col("score") >= 4, "pass").when(F.col("score") > 0, "partial").otherwise("fail")
    return r.select("site_id", "score", state.alias("state"), F.when(F.col("reached"), "inferred").otherwise("unknown").alias("evidence"), "valid")


def json_documents(rows: DataFrame) -> DataFrame:
    """For each site and surface: whether one of its fetches (status, content_type, body, keys wanted) is a JSON document of its kind.

    An object whose keys are all of an error answer is none, and a list is one only where no keys are wanted.
    """
    kind, t = F.lower(_blank("content_type")), F.trim(F.regexp_replace(_blank("body"), r"^\s+|\s+$", ""))
    keys = F.map_keys(F.from_json(t, "map<string,string>"))
    wanted = F.filter(F.split("keys", " "), lambda k: k != "")
    object_ = F.startswith(t, F.lit("{")) & keys.isNotNull() & ((F.size(keys) == 0) | (F.size(F.array_except(keys, F.array(*map(F.lit, ERROR_KEYS)))) > 0)) & ((F.size(wanted) == 0) | F.arrays_overlap(keys, wanted))
    listed = F.startswith(t, F.lit("[")) & F.from_json(t, "array<string>").isNotNull() & (F.size(wanted) == 0)
    ok = (F.col("status") >= 200) & (F.col("status") < 400) & (F.contains(kind, F.lit("json")) | F.contains(kind, F.lit("linkset")))
    return rows.groupBy("site_id", "label").agg(F.coalesce(F.bool_or(F.coalesce(ok & (object_ | listed), F.lit(False))), F.lit(False)).alias("available"))


def auth_texts(rows: DataFrame) -> DataFrame:
    """Per site whether an auth.md was found: a titled text, or one that speaks of agents and of authorisation."""
    t = F.regexp_replace(_blank("body"), r"^\s+|\s+$", "")
    sample = F.lower(F.substring(t, 1, 3000))
    good = (F.length(sample) >= 20) & (F.startswith(t, F.lit("#")) | (F.contains(sample, F.lit("auth")) & F.contains(sample, F.lit("agent"))))
    ok = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False))
    return rows.groupBy("site_id").agg(F.bool_or(ok & good).alias("available"))


def agent_links(rows: DataFrame) -> DataFrame:
    """Per site the agent tokens that its Link headers (site_id, name, value) name."""
    low = F.lower(_blank("value"))
    found = codes(*[(F.contains(low, F.lit(t)), t) for t in LINK_TOKENS])
    links = rows.where(F.lower("name") == "link").select("site_id", F.explode(found).alias("t"))
    return links.groupBy("site_id").agg(F.array_join(F.sort_array(F.collect_set("t")), " ").alias("tokens"))


def dns_names(rows: DataFrame) -> DataFrame:
    """(site_id, ordinal, name): the names to ask for a site's agent records, for its host and for it without ``www.``."""
    host = hostname(F.col("url"))
    roots = F.array_distinct(F.array(host, F.regexp_replace(host, r"^www\.", "")))
    names = F.flatten(F.transform(roots, lambda r: F.array(*[F.concat(F.lit(f"{p}."), r) for p in DNS_PREFIXES])))
    r = rows.where(host != "").select("site_id", F.posexplode(names).alias("ordinal", "name"))
    return r.select("site_id", F.col("ordinal").cast("long").alias("ordinal"), "name")


def alternate_host(url: Column) -> Column:
    """The url with ``www.`` before its host, or without it where it is there."""
    return F.when(hostname(url) != "", F.regexp_replace(F.regexp_replace(url, r"(?i)^([a-z][a-z0-9+.\-]*://)", "$1www."), r"(?i)^([a-z][a-z0-9+.\-]*://)www\.www\.", "$1"))


def json_feed(rows: DataFrame, as_of: str) -> DataFrame:
    """Items, dated items, faulty dates and the latest date of every JSON Feed body; null items where it is none."""
    feed = F.from_json(_blank("body"), "struct<items:array<struct<date_modified:string,date_published:string,updated:string,published:string>>>")
    today = F.to_date(F.lit(as_of))
    texts = lambda i: F.filter(F.array(i["date_modified"], i["date_published"], i["updated"], i["published"]), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    day = lambda x: F.when(F.trim(x).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd"))
    good = lambda i: F.filter(F.transform(texts(i), day), lambda d: F.coalesce(d <= today, F.lit(False)))
    r = rows.select("site_id", feed["items"].alias("i"))
    every = F.flatten(F.transform("i", good))
    return r.select(
        "site_id", F.when(F.col("i").isNotNull(), F.size("i")).cast("long").alias("items"), F.size(F.filter("i", lambda i: F.size(good(i)) > 0)).cast("long").alias("dated"),
        (F.size(F.flatten(F.transform("i", texts))) - F.size(every)).cast("long").alias("faulty"), F.array_max(every).alias("latest"),
    ).withColumns({c: F.when(F.col("items").isNotNull(), F.col(c)) for c in ("dated", "faulty")})


def included(scopes: DataFrame) -> Column:
    """Whether a probe's scope is in for a site with the flags protocols, account_auth and commerce."""
    return (F.col("scope") == "core") | ((F.col("scope") == "protocols") & F.col("protocols")) | ((F.col("scope") == "account_auth") & F.col("account_auth")) | ((F.col("scope") == "commerce") & F.col("commerce"))


def readiness_categories(scopes: DataFrame, passes: DataFrame, probes: DataFrame) -> DataFrame:
    """By site (with its scope's flags) and category: probes passed, included, the half-even share, and the labels passed, missing and left out."""
    rows = scopes.join(F.broadcast(probes)).join(passes.withColumn("passed", F.lit(True)), ["site_id", "ordinal"], "left")
    rows = rows.withColumns({"in": included(rows), "passed": F.coalesce("passed", F.lit(False))})
    names = lambda test: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("ordinal", "label")))), lambda x: x["label"]), "; ")
    out = rows.groupBy("site_id", "category").agg(
        F.count_if(F.col("in") & F.col("passed")).alias("earned"), F.count_if("in").alias("most"), names(F.col("in") & F.col("passed")).alias("passed"), names(F.col("in") & ~F.col("passed")).alias("missing"), names(~F.col("in")).alias("excluded")
    )
    return out.withColumn("score", F.when(F.col("most") > 0, F.bround(F.col("earned") / F.col("most") * 100, 0)).otherwise(0).cast("long"))


def scope_key(scopes: DataFrame) -> DataFrame:
    """Every site's scope as a key, with the most probes it can pass."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    most = 8 + 6 * F.col("protocols").cast("int") + 3 * F.col("account_auth").cast("int") + 4 * F.col("commerce").cast("int")
    return scopes.select("site_id", F.concat(F.lit("p"), flag("protocols"), F.lit("_a"), flag("account_auth"), F.lit("_c"), flag("commerce")).alias("scope_key"), most.cast("long").alias("most"))


def agent_peers(peers: DataFrame, probes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each peer's passed probes (name, label) in each distinct scope, and their half-even share; labels that are no probe count for nothing."""
    kinds = scopes.select("protocols", "account_auth", "commerce").distinct().join(F.broadcast(probes))
    kinds = kinds.withColumn("in", included(kinds)).where("in").select("protocols", "account_auth", "commerce", "label")
    names = peers.select("name").distinct()
    # at most 8 scopes of some dozens of probes are broadcast; the peers are joined by name and label
    rows = names.join(F.broadcast(kinds)).join(peers.select("name", "label").distinct().withColumn("hit", F.lit(True)), ["name", "label"], "left")
    out = rows.groupBy("protocols", "account_auth", "commerce", "name").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("earned"), F.count("*").alias("most"))
    return out.withColumn("percent", F.bround(F.col("earned") / F.col("most") * 100, 0).cast("long"))


def agent_position(scopes: DataFrame, passes: DataFrame, probes: DataFrame, peers: DataFrame) -> DataFrame:
    """Each site's share of its scope's probes among the peers in the same scope: percentile, median, position. The peers of a scope are at most 101 counts."""
    flags = ["protocols", "account_auth", "commerce"]
    rows = scopes.join(F.broadcast(probes)).withColumn("in", included(scopes)).where("in").join(passes.withColumn("hit", F.lit(1)), ["site_id", "ordinal"], "left")
    own = rows.groupBy("site_id", *flags).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("earned"), F.count("*").alias("most")).withColumn("score", F.bround(F.col("earned") / F.col("most") * 100, 0).cast("long"))
    s = histogram(agent_peers(peers, probes, scopes), *flags)
    score = F.col("score")
    out = own.join(F.broadcast(s), flags).select("site_id", "score", *[c.alias(n) for n, c in standing(score).items()])
    return out.select("site_id", "score", "percentile", "median", position(score).alias("position"))


def scope_faults(requests: DataFrame, presets: DataFrame, keys: DataFrame) -> DataFrame:
    """The codes of what is wrong with each request (site_id, preset, overrides): overrides without or with an unknown preset, unknown keys, and dimensions switched on of which no family is."""
    o = F.filter(F.split("overrides", " "), lambda x: x != "")
    on = lambda value: F.transform(F.filter("o", lambda x: F.endswith(x, F.lit(f"={value}"))), lambda x: F.substring_index(x, "=", 1))
    every = F.broadcast(keys.agg(F.collect_set("key").alias("known")))  # one row of a fixed dimension
    known = F.col("known")
    r = requests.join(F.broadcast(presets.select("preset", "families")), "preset", "left").join(every).withColumn("o", o)
    r = r.withColumns({"yes": on("true"), "no": on("false")}).withColumn("live", F.array_except(F.array_union(F.split(F.coalesce("families", F.lit("")), " "), "yes"), "no"))
    alone = lambda d, families: F.array_contains("yes", d) & ~F.arrays_overlap("live", F.array(*map(F.lit, families)))
    given = F.size("o") > 0
    found = codes(
        (given & F.col("preset").isNull(), "overrides_without_preset"), (given & F.col("preset").isNotNull() & F.col("families").isNull(), "unknown_preset"),
        (F.col("families").isNotNull() & (F.size(F.array_except(F.transform("o", lambda x: F.substring_index(x, "=", 1)), known)) > 0), "unknown_key"),
        (F.col("families").isNotNull() & alone("protocols", PROTOCOL_FAMILIES), "protocols_without_family"), (F.col("families").isNotNull() & alone("account_auth", AUTH_FAMILIES), "auth_without_family"),
        (F.col("families").isNotNull() & alone("ecommerce", SHOP_FAMILIES), "commerce_without_family"),
    )
    return r.select("site_id", joined(found).alias("codes"))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is named once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ipv4(text: Column) -> Column:
    """An IPv4 address as a number; null for what is none."""
    parts = F.transform(F.split(F.when(text.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"), text), r"\."), lambda p: p.try_cast("long"))
    return _let(parts, lambda p: F.when(~F.exists(p, lambda x: x > 255), F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)))


def _in_ranges(number: Column, ranges: tuple[str, ...]) -> Column:
    """Whether an IPv4 number lies in one of the networks."""
    out = F.lit(False)
    for r in ranges:
        net = ipaddress.ip_network(r)
        out = out | number.between(int(net.network_address), int(net.broadcast_address))
    return out


def _ipv6_groups(text: Column) -> Column:
    """The eight groups of an IPv6 address as numbers (``::`` filled, a closing IPv4 address as two groups); null for what is none."""
    hex_ = lambda n: F.lower(F.lpad(F.hex(n.cast("long")), 4, "0"))
    closing = r"^(.*:)([0-9]+\.[0-9.]+)$"
    flat = F.when(~text.rlike(closing), F.lower(text)).otherwise(_let(_ipv4(F.regexp_extract(text, closing, 2)), lambda n: F.concat(F.regexp_extract(F.lower(text), closing, 1), hex_(F.floor(n / 65536)), F.lit(":"), hex_(n % 65536))))
    shape = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$"
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    parted = _let(F.when(flat.rlike(shape), F.split(flat, "::")), lambda h: F.struct(F.size(h).alias("n"), groups(F.get(h, F.lit(0))).alias("left"), groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("right")))

    def filled(p: Column) -> Column:
        gap = 8 - F.size(p["left"]) - F.size(p["right"])
        zeros = F.when(p["n"] == 2, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        fits = F.when(p["n"] == 2, gap >= 1).otherwise(gap == 0)
        return F.when(F.coalesce(fits, F.lit(False)), F.transform(F.concat(p["left"], zeros, p["right"]), lambda g: F.conv(g, 16, 10).cast("int")))

    return _let(parted, filled)


#: IPv4 networks that are not public, those in them that are, and IPv6 networks by their leading groups (value, bits).
PRIVATE_4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
PUBLIC_4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_6 = ("::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8")
PUBLIC_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _in_nets(groups: Column, nets: tuple[str, ...]) -> Column:
    """Whether the groups of an IPv6 address lie in one of the networks."""
    out = F.lit(False)
    for r in nets:
        net = ipaddress.ip_network(r)
        value, fits, bits = int(net.network_address), F.lit(True), net.prefixlen
        for k in range(-(-bits // 16)):
            used = min(16, bits - 16 * k)
            fits = fits & (F.shiftright(F.get(groups, F.lit(k)), 16 - used) == (value >> (112 - 16 * k) & 0xFFFF) >> (16 - used))
        out = out | fits
    return out


def is_public(address: Column) -> Column:
    """Whether an address is a public one; mapped IPv4 counts as itself, and what is no address is not public. Ranges of numbers, all in built-in functions."""

    def judged(x: Column) -> Column:
        groups = x["groups"]
        mapped = F.forall(F.slice(groups, 1, 5), lambda g: g == 0) & (F.get(groups, F.lit(5)) == 0xFFFF)
        inner = F.get(groups, F.lit(6)).cast("long") * 65536 + F.get(groups, F.lit(7))
        good_6 = ~_in_nets(groups, PRIVATE_6) | _in_nets(groups, PUBLIC_6)
        return _let(F.coalesce(x["four"], F.when(mapped, inner)), lambda n: F.when(n.isNotNull(), ~_in_ranges(n, PRIVATE_4) | _in_ranges(n, PUBLIC_4)).when(groups.isNotNull(), good_6))

    return F.coalesce(_let(F.struct(_ipv4(address).alias("four"), _let(F.regexp_replace(address, "%.*$", ""), lambda t: _ipv6_groups(F.when(F.contains(t, F.lit(":")), t))).alias("groups")), judged), F.lit(False))


def public_targets(rows: DataFrame) -> DataFrame:
    """Whether each address (IPv4 or IPv6) may be fetched: global, and neither mapped, carrier-shared, unspecified nor multicast."""
    return rows.select("site_id", "ip", is_public(F.col("ip")).alias("public"))


def bounded(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Bodies (site_id, body) cut to ``most_bytes`` bytes at a character, and whether they were longer."""
    raw = F.encode(_blank("body"), "utf-8")
    at = lambda k: F.expr(f"conv(hex(substring(encode(coalesce(body, ''), 'utf-8'), {most_bytes} + {k}, 1)), 16, 10)").cast("int")
    inside = lambda k: F.coalesce(at(k).bitwiseAND(F.lit(0xC0)) == 0x80, F.lit(False))
    # the first byte beyond the bound begins a character, or up to three bytes before it go as well
    back = F.when(~inside(1), 0).when(~inside(0), 1).when(~inside(-1), 2).otherwise(3)
    long_ = F.octet_length("body") > most_bytes
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(most_bytes) - back), "utf-8")
    return rows.select("site_id", F.when(long_, cut).otherwise(_blank("body")).alias("body"), F.coalesce(long_, F.lit(False)).alias("cut"))


def hreflang_targets(links: DataFrame) -> DataFrame:
    """Same-site alternates (of hreflang links: site_id, src, lang, href) made absolute against their page."""
    return links.select("site_id", "src", "lang", urljoin(F.col("src"), F.col("href")).alias("target"))


def text_access(rows: DataFrame) -> DataFrame:
    """Per site the first of its text fetches (negotiated, then by label) that would do, else the codes of the negotiated one."""
    order = F.struct((F.col("label") != "negotiated").cast("int"), F.col("label"))
    r = text_response(rows)
    return r.groupBy("site_id").agg(F.bool_or("available").alias("available"), F.min_by("label", F.when(F.col("available"), order)).alias("label"), F.coalesce(F.min_by("codes", order), F.lit("")).alias("codes"))


def readiness_summary(scopes: DataFrame, passes: DataFrame, probes: DataFrame) -> DataFrame:
    """Per site the probes of its scope: passed, most, half-even share, label, and the names passed and missing in the probes' order. A site without any passed probe is a row like any other."""
    rows = scopes.join(F.broadcast(probes)).join(passes.withColumn("passed", F.lit(True)), ["site_id", "ordinal"], "left")
    rows = rows.withColumns({"in": included(rows), "passed": F.coalesce("passed", F.lit(False))}).where("in")
    names = lambda test: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("ordinal", "label")))), lambda x: x["label"]), "; ")
    out = rows.groupBy("site_id").agg(F.count_if("passed").alias("earned"), F.count("*").alias("most"), names(F.col("passed")).alias("passed"), names(~F.col("passed")).alias("missing"))
    out = out.withColumn("score", F.bround(F.col("earned") / F.col("most") * 100, 0).cast("long"))
    return out.withColumn("label", F.when(F.col("score") >= 70, "strong").when(F.col("score") >= 40, "developing").otherwise("limited"))


def agent_nearest(scopes: DataFrame, passes: DataFrame, probes: DataFrame, peers: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` peers nearest to each site's share in its scope; ties by the higher share, then by name. Of a scope's peers the first of each percentage are one array."""
    flags = ["protocols", "account_auth", "commerce"]
    own = readiness_summary(scopes, passes, probes).select("site_id", "score").join(scopes, "site_id")
    near = first_names(agent_peers(peers, probes, scopes), top, *flags)
    out = own.join(F.broadcast(near), flags).select("site_id", F.posexplode(nearest(F.col("score"), top)).alias("k", "x"))
    return out.select("site_id", (F.col("k") + 1).cast("long").alias("place"), F.col("x.name").alias("name"), (-F.col("x.neg")).alias("percent"))


def resolved_targets(rows: DataFrame) -> DataFrame:
    """Per host of a site (site_id, host, ordinal, ip) the address to fetch: the first IPv4 one, else the first; none where any address is not public."""
    r = rows.withColumns({"public": is_public(F.col("ip")), "later": F.contains("ip", F.lit(":"))})
    out = r.groupBy("site_id", "host").agg(F.bool_and(F.coalesce("public", F.lit(False))).alias("public"), F.min_by("ip", F.struct("later", "ordinal")).alias("ip"))
    return out.select("site_id", "host", F.when(F.col("public"), F.col("ip")).alias("ip"))


def robots_codes(robots: DataFrame) -> DataFrame:
    """The codes of the faults of each robots body, in the order of their weight."""
    q = R.quality(robots)
    found = codes((F.col("bytes") > R.OVERSIZE, "oversized"), (F.col("malformed") > 0, "malformed_lines"), (F.col("empty_groups") > 0, "empty_groups"), (F.col("bad_sitemaps") > 0, "bad_sitemaps"), (F.col("bad_delays") > 0, "bad_delays"))
    return q.select("site_id", joined(found).alias("codes"), (F.col("delays") > 0).alias("paced"))
