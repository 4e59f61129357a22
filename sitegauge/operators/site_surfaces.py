"""Discovery surfaces, catalogs, names and labels of sites, and the nested report.

Literal dimensions (surfaces and their paths, some dozens of rows) are broadcast. A site without evidence of a kind has none of its findings; null bodies are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import clean, codes, hostname, joined, urljoin
from sitegauge.sources.dom import attr, first, rel_has, said, tags, text_of

from .scoring import EFFORT, _map, with_rubric
from .site_checks import FIELDS
from .site_evidence import agent_links

#: Fixed values.
JSON_SURFACES = (
    "API description", "API catalog", "ARD catalog", "OAuth authorization metadata", "OAuth protected resource metadata", "Web Bot Auth directory", "MCP server card", "A2A agent card", "Agent skills", "WebMCP manifest",
    "agentic commerce metadata", "catalog JSON",
)
PLUGIN_KEYS = ("schema_version", "name_for_model", "name_for_human", "description_for_model")
FEED_TYPES, TEXT_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json"), ("text/markdown", "text/plain")
CATALOG_BYTES = 500 * 1024
SEMVER = r"^[0-9]+\.[0-9]+(\.[0-9]+)?([\-+][0-9A-Za-z.\-]+)?$"
NAMED_TYPES = ("Organization", "LocalBusiness", "WebSite")


def _in(scope: Column) -> Column:
    return (scope == "core") | ((scope == "protocols") & F.col("protocols")) | ((scope == "account_auth") & F.col("account_auth")) | ((scope == "commerce") & F.col("commerce"))


def valid_surface(kind: Column, body: Column) -> Column:
    """Whether a body is what its kind of surface holds."""
    t = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    keys = F.map_keys(F.from_json(t, FIELDS))
    json = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>").isNotNull()).when(F.startswith(t, F.lit("{")), (F.size(keys) > 0) | (F.replace(t, F.lit(" "), F.lit("")) == "{}"))
    api = F.from_json(F.element_at(F.from_json(t, FIELDS), F.lit("api")), FIELDS)
    plugin = F.arrays_overlap(F.transform(keys, F.lower), F.array(*map(F.lit, PLUGIN_KEYS))) | F.coalesce(F.map_contains_key(api, "url"), F.lit(False))
    feed = t.rlike(r"(?i)^(<\?xml[^>]*>\s*)?<(?:[a-z]+:)?(rss|feed|rdf)[\s>]")
    right = (
        F.when(kind.isin(*JSON_SURFACES), json).when(kind == "legacy ai-plugin.json", F.startswith(t, F.lit("{")) & plugin).when(kind == "content feed", feed)
        .when(kind == "auth.md", F.startswith(t, F.lit("#")) | F.contains(F.lower(t), F.lit("authorization"))).otherwise(F.lit(True))
    )
    return (F.length(t) >= 20) & F.coalesce(right, F.lit(False))


def surface_check(scopes: DataFrame, fetches: DataFrame, hints: DataFrame, surfaces: DataFrame) -> DataFrame:
    """The whole check of discovery surfaces (0 to 3): the surfaces of each site's scope that one of its fetches (site_id, surface, path, status, body)
    shows, with its hints (site_id, hint: a label of what headers, DNS, robots or the homepage tell), and how many families were asked for."""
    kinds = surfaces.select("surface", "scope").distinct()
    ok = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False))
    good = fetches.where(ok & ((F.col("surface") == "NLWeb /ask endpoint") | valid_surface(F.col("surface"), F.col("body")))).select("site_id", "surface").distinct()
    asked = scopes.join(F.broadcast(kinds)).where(_in(F.col("scope")))
    seen = asked.join(good.withColumn("hit", F.lit(True)), ["site_id", "surface"], "left").groupBy("site_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("surface")))).alias("a"))
    told = hints.groupBy("site_id").agg(F.sort_array(F.collect_set("hint")).alias("b"))
    r = seen.join(told, "site_id", "left").withColumn("f", F.concat(F.coalesce("b", F.array().cast("array<string>")), "a"))
    r = r.select("site_id", (F.col("n") + 2).cast("long").alias("families"), F.array_join("f", "; ").alias("found"), F.least(F.size("f"), F.lit(3)).cast("long").alias("score"))
    return r.withColumn("state", F.when(F.col("score") >= 3, "pass").when(F.col("score") > 0, "partial").otherwise("warn"))


def page_hints(d: DataFrame) -> DataFrame:
    """What each page's links, metas and Link header tell of machine-readable surfaces."""
    kind = lambda k: F.lower(F.coalesce(attr(k, "type"), F.lit("")))
    alternates = F.filter(tags("link"), lambda k: rel_has(k, "alternate") & said(k, "href"))
    link = F.lower(F.coalesce(F.element_at("headers", F.lit("link")), F.lit("")))
    found = codes(
        (link.rlike(r"api-catalog|oauth-authorization-server|oauth-protected-resource|mcp|agent|webmcp|auth\.md"), "link_header"), (F.exists(alternates, lambda k: kind(k).isin(*FEED_TYPES)), "content_feed"), (F.exists(alternates, lambda k: kind(k).isin(*TEXT_TYPES)), "text_alternate"),
        (F.exists(tags("link"), lambda k: F.contains(F.coalesce(attr(k, "rel"), F.lit("")), F.lit("ai-catalog")) & said(k, "href")), "catalog_link"),
        (F.exists(tags("meta"), lambda m: attr(m, "name") == "nlweb") | F.exists(tags("link"), lambda k: F.contains(F.lower(F.coalesce(attr(k, "rel"), F.lit(""))), F.lit("nlweb"))), "nlweb"),
    )
    return d.select("page_id", joined(found).alias("hints"))


def page_reach(d: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """(page_id, path) of the given paths of its site that a page links to, by an anchor or a link element."""
    linked = F.filter(tags("a", "link"), lambda n: said(n, "href"))
    r = d.select("page_id", "url", F.explode(linked).alias("k"))
    target = urljoin(F.col("url"), F.trim(attr(F.col("k"), "href")))
    path = F.regexp_replace(F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return r.where(hostname(target) == hostname(F.col("url"))).select("page_id", F.when(path == "", "/").otherwise(path).alias("path")).where(F.col("path").isin(*paths)).distinct()


def conventional_paths(scopes: DataFrame, fetches: DataFrame, paths: DataFrame) -> DataFrame:
    """Per site which of the usual paths (path, scope) were found, which are missing within its scope, and which its scope leaves out."""
    ok = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400) & (F.trim(F.coalesce("body", F.lit(""))) != ""), F.lit(False))
    good = fetches.where(ok).select("site_id", "path").distinct().withColumn("hit", F.lit(True))
    r = scopes.join(F.broadcast(paths)).join(good, ["site_id", "path"], "left")
    r = r.withColumns({"hit": F.coalesce("hit", F.lit(False)), "in": _in(F.col("scope"))})
    names = lambda test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col("path")))), " ")
    return r.groupBy("site_id").agg(names(F.col("hit")).alias("found"), names(~F.col("hit") & F.col("in")).alias("missing"), names(~F.col("hit") & ~F.col("in")).alias("not_asked"))


def _own(domain: Column, host: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")
    return (bare(domain) == bare(host)) | F.endswith(bare(domain), F.concat(F.lit("."), bare(host)))


def catalog_issues(rows: DataFrame) -> DataFrame:
    """Every agent catalog (site_id, host, body): valid or not, version, entries, trust manifest, and the codes of what is wrong, those of entries with their place."""
    t = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")
    m = F.from_json(t, FIELDS)
    filled = lambda v: F.coalesce(F.trim(v) != "", F.lit(False))
    at = lambda o, k: F.element_at(o, F.lit(k))
    rows = rows.select("site_id", F.lower("host").alias("host"), t.alias("t"), (F.octet_length(F.coalesce("body", F.lit(""))) > CATALOG_BYTES).alias("large"), F.when(F.startswith(t, F.lit("{")) & (F.size(m) > 0), m).alias("m"))
    rows = rows.withColumns({"entries": F.when(F.startswith(F.trim(at(F.col("m"), "entries")), F.lit("[")), F.from_json(at(F.col("m"), "entries"), "array<string>")), "h": F.when(F.startswith(F.trim(at(F.col("m"), "host")), F.lit("{")), F.from_json(at(F.col("m"), "host"), FIELDS))})
    domain = F.coalesce(at(F.col("h"), "domain"), at(F.col("h"), "hostname"), at(F.col("h"), "url"))

    def entry(text: Column, k: Column) -> Column:
        e = F.from_json(text, FIELDS)
        object_ = F.startswith(F.trim(text), F.lit("{")) & e.isNotNull()
        urn = F.coalesce(at(e, "identifier"), at(e, "id"))
        updated = F.coalesce(F.when(filled(at(e, "updated")), at(e, "updated")), F.when(filled(at(e, "updatedAt")), at(e, "updatedAt")), at(e, "lastUpdated"))
        some = lambda v: F.exists(F.from_json(v, "array<string>"), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
        has_url, has_data = F.map_contains_key(e, "url"), F.map_contains_key(e, "data")
        queries = F.from_json(at(e, "representativeQueries"), "array<string>")
        found = codes(
            (~filled(urn), "identifier"), (filled(urn) & ~(F.trim(urn).rlike(r"^urn:air:[^:]+:.+") & _own(F.split_part(F.trim(urn), F.lit(":"), F.lit(3)), F.col("host"))), "foreign_identifier"), (~filled(at(e, "displayName")), "display_name"),
            (~filled(F.coalesce(at(e, "mediaType"), at(e, "type"))), "media_type"), (has_url == has_data, "url_or_data"), (has_url & ~has_data & ~F.coalesce(F.trim(at(e, "url")).rlike("(?i)^https?://[^/?#]"), F.lit(False)), "url"),
            (has_data & ~has_url & ~F.coalesce(F.startswith(F.trim(at(e, "data")), F.lit("{")), F.lit(False)), "data"), (~filled(at(e, "description")), "description"), (~(F.coalesce(some(at(e, "capabilities")), F.lit(False)) | F.coalesce(some(at(e, "tags")), F.lit(False))), "capabilities"),
            (~F.coalesce((F.size(queries) > 0) & F.forall(queries, lambda q: F.coalesce(F.trim(q) != "", F.lit(False))), F.lit(False)), "queries"), (~F.coalesce(F.trim(updated).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?$"), F.lit(False)), "updated"),
        )
        named = F.transform(found, lambda c: F.concat(k.cast("string"), F.lit("."), c))
        return F.when(object_, named).otherwise(F.array(F.concat(k.cast("string"), F.lit(".object"))))

    whole = F.col("m").isNotNull() & ~F.col("large")
    issues = F.when(F.col("large"), F.array(F.lit("too_large"))).when(F.col("t") == "", F.array(F.lit("empty"))).when(F.col("m").isNull(), F.array(F.lit("no_object"))).otherwise(
        F.concat(
            codes(
                (~filled(at(F.col("m"), "specVersion")), "version"), (filled(at(F.col("m"), "specVersion")) & ~F.trim(at(F.col("m"), "specVersion")).rlike(SEMVER), "version_shape"), (F.col("h").isNull(), "host"), (F.col("h").isNotNull() & domain.isNull(), "host_domain"),
                (F.coalesce(~_own(domain, F.col("host")), F.lit(False)), "other_host"), (F.col("entries").isNull(), "entries"),
            ),
            F.coalesce(F.flatten(F.transform("entries", entry)), F.array().cast("array<string>")),
        )
    )
    trusted = F.map_contains_key(F.col("m"), "trustManifest") | F.coalesce(F.map_contains_key(F.col("h"), "trustManifest"), F.lit(False)) | F.coalesce(F.exists("entries", lambda x: F.map_contains_key(F.from_json(x, FIELDS), "trustManifest")), F.lit(False))
    return rows.select(
        "site_id", (F.size(issues) == 0).alias("valid"), F.when(whole & filled(at(F.col("m"), "specVersion")), F.trim(at(F.col("m"), "specVersion"))).alias("version"), F.when(whole, F.coalesce(F.size("entries"), F.lit(0))).otherwise(0).cast("long").alias("entries"),
        F.coalesce(whole & trusted, F.lit(False)).alias("trusted"), joined(issues).alias("codes"),
    )


def brand_names(d: DataFrame, most: int = 4) -> DataFrame:
    """The names under which a page's entity is looked up, the surest first, at most ``most`` (the lookup's own limit): site name, schema names, title, host. Takes with_json_ld()."""
    meta = first(F.transform(F.filter(tags("meta"), lambda m: attr(m, "property") == "og:site_name"), lambda m: attr(m, "content")))
    schema = F.transform(F.filter("objects", lambda o: o["top"] & (F.size("objects") > 0) & F.coalesce(F.element_at(o["fields"], F.lit("@type")).isin(*NAMED_TYPES), F.lit(False))), lambda o: F.element_at(o["fields"], F.lit("name")))
    title = F.substring_index(F.substring_index(text_of(first(tags("title"))), "|", 1), " - ", 1)
    parts = F.filter(F.split(hostname(F.col("url")), r"\."), lambda p: ~p.isin("www", "com", "net", "org", "io", "co"))
    names = F.filter(F.transform(F.concat(F.array(meta), schema, F.array(title, F.coalesce(F.get(parts, F.lit(0)), hostname(F.col("url"))))), lambda c: clean(c)), lambda c: F.coalesce(c != "", F.lit(False)))
    once = F.filter(F.transform(names, lambda c, k: F.struct(c.alias("c"), k.alias("k"))), lambda x: F.array_position(F.transform(names, F.lower), F.lower(x["c"])) == x["k"] + 1)
    return d.select("page_id", F.array_join(F.slice(F.transform(once, lambda x: x["c"]), 1, most), " | ").alias("names"))


def website_variants(rows: DataFrame) -> DataFrame:
    """(site_id, ordinal, variant): the forms of a site's address that a directory may hold."""
    scheme, host = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    name = hostname(F.col("url"))
    other = F.when(F.startswith(name, F.lit("www.")), F.substring(name, 5, 1000)).otherwise(F.concat(F.lit("www."), name))
    own, alt = F.concat(scheme, F.lit("://"), host), F.concat(scheme, F.lit("://"), other)
    out = rows.where(name != "").select("site_id", F.posexplode(F.array(F.concat(own, F.lit("/")), own, F.concat(alt, F.lit("/")), alt)).alias("ordinal", "variant"))
    return out.select("site_id", F.col("ordinal").cast("long").alias("ordinal"), "variant")


def scope_labels(scopes: DataFrame) -> DataFrame:
    """A reader's label of each scope, and the optional surfaces in it and left out."""
    label = F.concat_ws(" + ", F.when(F.col("commerce"), "Commerce storefront").otherwise("General website"), F.when(F.col("protocols"), F.lit("API/protocol")), F.when(F.col("account_auth"), F.lit("account/auth")))
    parts = lambda yes: F.array_join(codes((F.col("protocols") == yes, "API and protocol discovery"), (F.col("account_auth") == yes, "Account/auth discovery"), (F.col("commerce") == yes, "Commerce protocol metadata"), (F.col("commerce") == yes, "Catalog JSON")), "; ")
    depth = F.when(F.col("protocols") | F.col("account_auth") | F.col("commerce"), "full").otherwise("common-contextual")
    return scopes.select("site_id", label.alias("label"), parts(F.lit(True)).alias("included"), parts(F.lit(False)).alias("excluded"), depth.alias("surfaces"))


def report(rows: DataFrame, rubric: DataFrame, caps: DataFrame, scopes: DataFrame) -> DataFrame:
    """One nested row per site: scope, points of each pillar (held to its cap) and overall, and its checks by missing points per effort, ties in the report's order."""
    r = with_rubric(rows, rubric)
    gap = (F.col("max_score") - F.col("score")) / _map(EFFORT, "effort", 2)
    sums = r.groupBy("site_id", "pillar").agg(F.sum("score").alias("points")).join(F.broadcast(caps), "pillar").select("site_id", "pillar", F.least("points", "cap").alias("points"))
    sums = sums.groupBy("site_id").agg(F.sum("points").alias("overall"), F.sort_array(F.collect_list(F.struct("pillar", "points"))).alias("pillars"))
    item = F.struct((-F.round(gap, 9)).alias("g"), "ordinal", "check_name", "state", "score", "max_score")
    lists = r.groupBy("site_id").agg(F.sort_array(F.collect_list(item)).alias("c"))  # thirteen checks a site
    checks = F.transform("c", lambda c: F.struct(c["check_name"].alias("check_name"), c["state"].alias("state"), c["score"].alias("score"), c["max_score"].alias("max_score")))
    out = sums.join(lists, "site_id").join(scope_labels(scopes).select("site_id", "label"), "site_id", "left")
    return out.select("site_id", "label", "overall", F.to_json("pillars").alias("pillars"), F.to_json(checks).alias("checks"))


def header_hints(headers: DataFrame) -> DataFrame:
    """Hints for surface_check() from Link headers."""
    return agent_links(headers).select("site_id", F.lit("Link header discovery").alias("hint"))

