"""Checks of single pages over the DOM relation (sources/dom.py): structure, crawl efficiency, indexing, structured data, entity coherence.

Every check takes the DOM relation (page_id, url, nodes, ...) and gives a row per page with score, state and the codes of its issues in
the order of its rules. All rules are built-in functions over the page's own row: no shuffle, and repeated or null ids are rows like any other. A page without HTML
has no nodes and so all the issues of absence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import clean, codes, joined, page_url, same_site, tokens, urljoin
from sitegauge.sources.dom import around, attr, first, has_text, json_ld, rel_has, said, tags, text_of

from .markup import SOCIAL

#: Fixed values.
LANDMARKS = ("header", "nav", "main", "article", "section", "footer", "aside")
VAGUE = ("", "here", "click here", "more", "learn more", "read more")
NO_FIELD = ("hidden", "submit", "button", "reset", "image")
GENERIC_NAMES = ("", "field", "input", "value", "data", "form", "formfield", "form_field")
METHODS = ("get", "post", "dialog")
FILLED_TYPES = ("email", "tel", "url", "password")
PURPOSES = ("address", "city", "company", "country", "email", "family-name", "first-name", "given-name", "last-name", "name", "organization", "phone", "postal", "tel", "username", "zip")
FAST_MS, SLOW_MS, MOST_BYTES = 800, 2500, 15 * 1024 * 1024
CRAWLERS = ("googlebot", "bingbot", "duckduckbot", "duckassistbot", "googlebot-news", "googlebot-image", "googlebot-video", "otherbot")
BLOCKING, RESTRICTING, SNIPPETS = ("noindex", "none"), ("nofollow", "noarchive", "notranslate"), ("nosnippet", "noimageindex", "max-snippet:0", "max-image-preview:none", "max-video-preview:0")
ENTITY_TYPES = ("Article", "LocalBusiness", "Organization", "Product", "SoftwareApplication", "WebSite")
STOP = ("about", "and", "are", "for", "from", "home", "into", "official", "our", "that", "the", "this", "with", "your")
REQUIRED = {
    "Organization": ("name", "url"), "LocalBusiness": ("name", "address", "telephone"), "Product": ("name", "description", "offers"), "Offer": ("price", "priceCurrency", "availability"), "WebSite": ("name", "url"),
    "SoftwareApplication": ("name", "applicationCategory", "operatingSystem"), "Article": ("headline", "author", "datePublished"), "BreadcrumbList": ("itemListElement",), "FAQPage": ("mainEntity",),
    "MerchantReturnPolicy": ("applicableCountry", "returnPolicyCategory"),
}
RECOMMENDED = {
    "Organization": ("logo", "sameAs"), "LocalBusiness": ("url", "sameAs"), "Product": ("image", "brand"), "WebSite": ("description",), "SoftwareApplication": ("description", "offers"), "Article": ("dateModified", "image"),
}
OFFER_FIELDS = ("price", "priceCurrency", "availability")
GTINS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14")
RETURN_POLICIES = ("hasMerchantReturnPolicy", "merchantReturnPolicy")
FIELDS = "map<string,string>"


def _lower(node: Column, name: str, other: str = "") -> Column:
    return F.lower(F.trim(F.coalesce(attr(node, name), F.lit(other))))


def _named(n: Column) -> Column:
    """Whether a link or control has a name that a reader without sight gets."""
    return has_text(n) | said(n, "aria-label") | said(n, "title") | n["pictured"]


def _is_field(n: Column) -> Column:
    return n["tag"].isin("select", "textarea") | ((n["tag"] == "input") & ~F.lower(F.coalesce(attr(n, "type"), F.lit("text"))).isin(*NO_FIELD))


def form_codes() -> Column:
    """Issue codes of a page's forms; none where it has no form."""
    forms = F.col("form_nodes")
    action = lambda f: F.coalesce(F.trim(attr(f, "action")), F.lit(""))
    scripted = lambda f: F.lower(action(f)).rlike("^(javascript:|#)")
    method = lambda f: _lower(f, "method")
    fields = F.filter("field_nodes", lambda n: n["form"] >= 0)
    hay = lambda n: F.concat_ws(" ", *[F.lower(F.coalesce(attr(n, a), F.lit(""))) for a in ("name", "id", "aria-label", "placeholder")])
    needs = lambda n: (n["tag"] == "input") & (F.lower(F.coalesce(attr(n, "type"), F.lit("text"))).isin(*FILLED_TYPES) | hay(n).rlike("|".join(PURPOSES)))
    kind = lambda c: F.lower(F.coalesce(attr(c, "type"), F.when(c["tag"] == "button", "submit").otherwise("text")))
    submits = F.filter(tags("button", "input"), lambda c: F.when(c["tag"] == "button", kind(c).isin("", "submit")).otherwise(kind(c).isin("submit", "image")))
    label = lambda c: F.when(c["tag"] == "input", (F.trim(F.coalesce(attr(c, "value"), F.lit(""))) != "") | said(c, "aria-label") | said(c, "title") | said(c, "alt")).otherwise(_named(c))
    return codes(
        (F.exists(forms, lambda f: action(f) == ""), "form_without_action"), (F.exists(forms, lambda f: (action(f) != "") & scripted(f)), "form_script_action"),
        (F.exists(forms, lambda f: ~said(f, "method")), "form_without_method"), (F.exists(forms, lambda f: said(f, "method") & ~method(f).isin(*METHODS)), "form_odd_method"),
        (F.exists(fields, lambda n: _lower(n, "name").isin(*GENERIC_NAMES)), "fields_without_name"), (F.exists(fields, lambda n: needs(n) & _lower(n, "autocomplete").isin("", "off")), "fields_without_autocomplete"),
        (F.size(F.array_except(F.transform(forms, lambda f: f["pre"]), F.transform(F.filter(submits, label), lambda c: c["form"]))) > 0, "form_without_named_submit"),
        ((F.size(forms) > 0) & ~F.exists(forms, lambda f: (action(f) != "") & ~scripted(f) & method(f).isin(*METHODS)), "no_plain_form"),
    )


def html_structure(d: DataFrame) -> DataFrame:
    """Headings, landmarks, title, description, links, fields, forms, images and controls: the semantic-HTML score (1 to 4)."""
    meta = first(F.filter(tags("meta"), lambda m: attr(m, "name") == "description"))
    d = d.select("page_id", "nodes", "deep_text").withColumns(
        {
            "link_nodes": F.filter(tags("a"), lambda a: F.map_contains_key(a["attrs"], "href")), "form_nodes": tags("form"), "field_nodes": F.filter(tags("input", "select", "textarea"), _is_field), "image_nodes": tags("img"),
            "title": F.coalesce(text_of(first(tags("title"))), F.lit("")), "description": F.coalesce(attr(meta, "content"), F.lit("")),
            "label_nodes": tags("label"),
        }
    )
    targets = F.transform(F.filter("label_nodes", lambda n: said(n, "for")), lambda n: attr(n, "for"))
    labelled = lambda n: (
        (said(n, "id") & F.coalesce(F.array_contains(targets, F.coalesce(attr(n, "id"), F.lit(""))), F.lit(False))) | around(n, "label") | said(n, "aria-label") | said(n, "aria-labelledby") | said(n, "placeholder")
    )
    # a character has four bytes at most, so a longer text of a deep link is none of these and need not be made
    vague = F.size(F.filter("link_nodes", lambda a: ~_named(a) | ((a["size"] <= 4 * max(map(len, VAGUE))) & F.lower(F.coalesce(text_of(a), F.lit(""))).isin(*VAGUE))))
    dead = F.size(F.filter("link_nodes", lambda a: _lower(a, "href").rlike("^(javascript:|#)")))
    h1, h2, h3, n = F.size(tags("h1")), F.size(tags("h2")), F.size(tags("h3")), F.size("link_nodes")
    present = sum((F.when(F.size(tags(t)) > 0, 1).otherwise(0) for t in LANDMARKS), F.lit(0))
    many = lambda part, all_, least, share: (all_ >= least) & (part / all_ > share)
    undescribed = F.size(F.filter("image_nodes", lambda i: ~F.map_contains_key(i["attrs"], "alt")))
    found = F.concat(
        codes(
            (h1 == 0, "no_h1"), (h1 > 1, "many_h1"), ((h3 > 0) & (h2 == 0), "h3_without_h2"), (present < 3, "few_landmarks"), (F.col("title") == "", "no_title"), (F.length("title") > 70, "long_title"),
            (F.trim("description") == "", "no_description"), (F.length("description") > 180, "long_description"), (many(vague, n, 8, 0.25), "vague_links"), (many(dead, n, 8, 0.25), "dead_links"),
            (F.exists("field_nodes", lambda f: ~labelled(f)), "fields_without_label"),
        ),
        form_codes(),
        codes((many(undescribed, F.size("image_nodes"), 3, 0.5), "images_without_alt"), (F.exists(tags("button", "summary"), lambda c: ~_named(c)), "controls_without_name")),
    )
    d = d.select("page_id", h1.cast("long").alias("h1"), present.cast("long").alias("landmarks"), n.cast("long").alias("links"), vague.cast("long").alias("vague_links"), dead.cast("long").alias("dead_links"), F.size("form_nodes").cast("long").alias("forms"), found.alias("found"))
    d = d.withColumn("score", F.when(F.size("found") == 0, 4).otherwise(F.greatest(4 - F.size("found"), F.lit(1))).cast("long"))
    return d.withColumn("state", F.when(F.size("found") == 0, "pass").when(F.col("score") >= 2, "partial").otherwise("fail")).withColumn("codes", joined(F.col("found"))).drop("found")


def _points(n: Column, good: int, poor: int) -> Column:
    return F.when(n <= good, 4).when(n <= poor, 2).otherwise(0)


def crawl_efficiency(d: DataFrame) -> DataFrame:
    """Seven signals of four points each (response, validators, stylesheets, media sizes, scripts, body size, viewport) on a scale of three, half-even.

    Takes elapsed_ms and headers (lower-cased names) of the response with the page.
    """
    within = lambda *names: F.filter(tags(*names), lambda n: around(n, "head"))
    sheets = F.size(F.filter(within("link"), lambda k: rel_has(k, "stylesheet") & F.coalesce(attr(k, "media"), F.lit("all")).isin("all", "")))
    sized = lambda n, side: said(n, side) | F.contains(F.coalesce(attr(n, "style"), F.lit("")), F.lit(side))
    unsized = F.size(F.filter(tags("img", "video"), lambda n: ~(sized(n, "width") & sized(n, "height"))))
    scripts = F.size(F.filter(within("script"), lambda s: said(s, "src") & ~said(s, "async") & ~said(s, "defer") & (F.coalesce(attr(s, "type"), F.lit("")) != "module")))
    h = lambda name: F.coalesce(F.element_at("headers", F.lit(name)), F.lit(""))
    size = F.when(h("content-length").rlike("^[0-9]+$"), h("content-length").try_cast("decimal(38,0)")).otherwise(F.col("html_bytes").cast("decimal(38,0)"))
    ports = F.filter(within("meta"), lambda m: _lower(m, "name") == "viewport")
    token = lambda key: first(
        F.transform(F.filter(F.reverse(F.split(F.lower(F.coalesce(attr(first(ports), "content"), F.lit(""))), ",")), lambda p: F.trim(F.substring_index(p, "=", 1)).eqNullSafe(F.lit(key)) & F.contains(p, F.lit("="))), lambda p: F.trim(F.regexp_replace(p, "^[^=]*=", "")))
    )
    zoom = token("user-scalable").isin("no", "0") | (token("maximum-scale").try_cast("double") <= 1)
    port = codes((F.size(ports) == 0, "no_viewport"), (F.size(ports) > 1, "many_viewports"), ((F.size(ports) > 0) & (F.coalesce(token("width"), F.lit("")) != "device-width"), "viewport_width"), ((F.size(ports) > 0) & F.coalesce(zoom, F.lit(False)), "zoom_limited"))
    responsive = (
        (F.size(tags("picture")) > 0) | F.exists(tags("img", "source"), lambda n: F.map_contains_key(n["attrs"], "srcset") | F.map_contains_key(n["attrs"], "sizes"))
        | F.exists(within("link"), lambda k: rel_has(k, "stylesheet") & ~_lower(k, "media").isin("", "all", "screen")) | F.exists(tags("style"), lambda s: F.lower(text_of(s)).rlike("@media|min-width|max-width"))
    )
    d = d.select(
        "page_id", sheets.cast("long").alias("stylesheets"), unsized.cast("long").alias("unsized"), scripts.cast("long").alias("scripts"), _points(F.col("elapsed_ms"), FAST_MS, SLOW_MS).alias("response"),
        F.when((h("etag") != "") | (h("last-modified") != ""), 4).when((h("cache-control") != "") | (h("expires") != ""), 2).otherwise(0).alias("validators"), F.when(size < MOST_BYTES, 4).otherwise(0).alias("body"),
        F.when(F.size(ports) == 0, 0).when(F.size(port) > 0, 2).otherwise(4).alias("mobile"), port.alias("port"), responsive.alias("responsive"),
    )
    d = d.withColumns({"sheet": _points(F.col("stylesheets"), 1, 3), "media": _points(F.col("unsized"), 0, 3), "script": _points(F.col("scripts"), 1, 3)})
    parts = ("response", "validators", "sheet", "media", "script", "body")
    found = F.concat(codes(*[(F.col(p) < 4, c) for p, c in zip(parts, ("slow_response", "no_validator", "blocking_stylesheets", "unsized_media", "sync_scripts", "large_body"))]), F.col("port"))
    total = sum((F.col(p) for p in parts), F.col("mobile"))
    d = d.withColumns({"points": total.cast("long"), "score": F.bround(total / 28 * 3, 0).cast("long"), "found": found})
    state = F.when(F.size("found") == 0, "pass").when(F.col("score") > 0, "partial").otherwise("warn")
    return d.select("page_id", "stylesheets", "unsized", "scripts", "points", "responsive", "score", state.alias("state"), joined(F.col("found")).alias("codes"))


def _directives(value: Column) -> Column:
    parts = F.transform(F.split(F.lower(value), ","), lambda p: F.regexp_replace(clean(p), r"\s*:\s*", ":"))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def indexing(d: DataFrame) -> DataFrame:
    """Directives of robots metas, crawlers' metas and the X-Robots-Tag header by source, data-nosnippet, and the score (0 to 5) by precedence."""
    known = lambda c: c.isin(*CRAWLERS)
    metas = F.transform(
        F.filter(tags("meta"), lambda m: (_lower(m, "name") == "robots") | known(_lower(m, "name"))), lambda m: F.struct(F.concat(F.lit("meta "), _lower(m, "name")).alias("label"), _directives(F.coalesce(attr(m, "content"), F.lit(""))).alias("d"))
    )
    header = _directives(F.coalesce(F.element_at("headers", F.lit("x-robots-tag")), F.lit("")))
    scoped = lambda x: known(F.substring_index(x, ":", 1)) & x.rlike("^[^:]*:.")
    plain = F.array(F.struct(F.lit("X-Robots-Tag").alias("label"), F.filter(header, lambda x: ~scoped(x)).alias("d")))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(header, scoped), lambda x: F.substring_index(x, ":", 1))))
    own = F.transform(names, lambda c: F.struct(F.concat(F.lit("X-Robots-Tag "), c).alias("label"), F.transform(F.filter(header, lambda x: scoped(x) & (F.substring_index(x, ":", 1) == c)), lambda x: F.regexp_replace(x, "^[^:]*:", "")).alias("d")))
    d = d.select("page_id", F.size(F.filter("nodes", lambda n: F.map_contains_key(n["attrs"], "data-nosnippet"))).cast("long").alias("nosnippets"), F.filter(F.concat(metas, plain, own), lambda s: F.size(s["d"]) > 0).alias("s"))
    of = lambda test: F.transform(F.filter("s", lambda s: F.exists(s["d"], test)), lambda s: s["label"])
    d = d.withColumns(
        {
            "blocking": of(lambda x: x.isin(*BLOCKING)), "snippets": of(lambda x: x.isin(*SNIPPETS)), "standard": of(lambda x: x == "max-image-preview:standard"), "large": of(lambda x: x == "max-image-preview:large"),
            "restricting": F.concat(of(lambda x: x.isin(*RESTRICTING)), of(lambda x: F.startswith(x, F.lit("unavailable_after:")))),
        }
    )
    score = F.when(F.size("blocking") > 0, 0).when((F.size("snippets") > 0) | (F.col("nosnippets") > 0), 2).when(F.size("standard") > 0, 4).when(F.size("restricting") > 0, 3).otherwise(5)
    d = d.withColumn("score", score.cast("long"))
    state = F.when(F.col("score") == 5, "pass").when(F.col("score") == 0, "fail").otherwise("partial")
    lists = [F.array_join(c, "; ").alias(c) for c in ("blocking", "snippets", "standard", "large", "restricting")]
    return d.select("page_id", *lists, "nosnippets", "score", state.alias("state"))


def with_json_ld(d: DataFrame) -> DataFrame:
    """The DOM relation with its JSON-LD objects (a second narrow Arrow pass over the scripts' texts alone)."""
    bodies = F.transform(F.filter(tags("script"), lambda s: attr(s, "type") == "application/ld+json"), text_of)
    return json_ld(d.withColumn("bodies", bodies))


def _present(fields: Column, name, strict: bool = False) -> Column:
    """Whether a field is there and not blank or an empty list (``strict``: nor an empty object)."""
    v = F.trim(F.element_at(fields, name if isinstance(name, Column) else F.lit(name)))
    return F.coalesce(~v.isin("", "[]", *(["{}"] if strict else [])), F.lit(False))


def _any(fields: Column, names: tuple[str, ...], strict: bool = False) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | _present(fields, n, strict)
    return out


def _dicts(value: Column) -> Column:
    """The objects of a JSON text: itself, or those of its list."""
    each = F.filter(F.from_json(value, "array<string>"), lambda x: F.startswith(F.trim(x), F.lit("{")))
    none = F.array().cast(f"array<{FIELDS}>")
    listed = F.transform(each, lambda x: F.from_json(x, FIELDS))
    return F.coalesce(F.when(F.startswith(F.trim(value), F.lit("{")), F.array(F.from_json(value, FIELDS))).when(F.startswith(F.trim(value), F.lit("[")), listed), none)


def _absent(fields: Column, names: tuple[str, ...], strict: bool = False) -> list[Column]:
    return [F.when(~_present(fields, n, strict), F.lit(n)) for n in names]


def _offer_details(offer: Column, strict: bool = False) -> list[Column]:
    valid = _present(offer, "priceValidUntil", strict) | F.exists(_dicts(F.element_at(offer, F.lit("priceSpecification"))), lambda s: _present(s, "validThrough", strict))
    return [F.when(~valid, F.lit("priceValidUntil")), *_absent(offer, ("shippingDetails",), strict), F.when(~_any(offer, RETURN_POLICIES, strict), F.lit("hasMerchantReturnPolicy"))]


def _listed(parts: list[Column]) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def best_offer(product: Column, strict: bool = False) -> Column:
    """(n, k, missing, offer): the product's first offer with the fewest missing fields; null without an offer."""
    offers = _dicts(F.element_at(product, F.lit("offers")))
    rated = F.transform(offers, lambda o, k: F.struct(F.size(_listed(_absent(o, OFFER_FIELDS, strict) + _offer_details(o, strict))).alias("n"), k.alias("k"), _listed(_absent(o, OFFER_FIELDS, strict) + _offer_details(o, strict)).alias("missing")))
    return first(F.array_sort(rated))


def offer_gaps(product: Column, strict: bool = False) -> Column:
    """Missing fields of a product's best offer, but for those that the product itself has."""
    every = F.array(*map(F.lit, (*OFFER_FIELDS, "priceValidUntil", "shippingDetails", "hasMerchantReturnPolicy")))
    gaps = F.coalesce(best_offer(product, strict)["missing"], every)
    return F.filter(gaps, lambda g: ~((g == "shippingDetails") & _present(product, "shippingDetails", strict)) & ~((g == "hasMerchantReturnPolicy") & _any(product, RETURN_POLICIES, strict)))


def structured_data(d: DataFrame, ecommerce: bool = False) -> DataFrame:
    """The best object of a page's JSON-LD with its missing fields and score (0 to 5); takes with_json_ld().

    Five less two for each required field missing and one for each recommended one (two at most); one at least, three with all required ones.
    With ``ecommerce`` products and offers go first, and answer for identifiers, ratings, price validity, shipping and returns too. ``speakable`` is
    told but never scored.
    """
    table = lambda t: F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kind = lambda o: first(F.filter(o["raw_types"], lambda t: t.isin(*REQUIRED)))
    none = F.array().cast("array<string>")

    def rate(o, k):
        f, t = o["fields"], kind(o)
        missing = F.filter(F.coalesce(F.element_at(table(REQUIRED), t), none), lambda n: ~_present(f, n))
        wanted = F.filter(F.coalesce(F.element_at(table(RECOMMENDED), t), none), lambda n: ~_present(f, n))
        if ecommerce:
            product = F.concat(
                _listed([*_absent(f, ("sku",)), F.when(~_any(f, GTINS), F.lit("gtin")), F.when(~_any(f, ("aggregateRating", "review")), F.lit("aggregateRating|review"))]), F.transform(offer_gaps(f), lambda g: F.concat(F.lit("offers."), g))
            )
            wanted = F.concat(wanted, F.when(t == "Product", product).when(t == "Offer", _listed(_offer_details(f))).otherwise(none))
        score = F.when(t.isNull(), 2).otherwise(F.greatest(F.when(F.size(missing) > 0, 1).otherwise(3), 5 - 2 * F.size(missing) - F.least(F.size(wanted), F.lit(2))))
        trade = F.lit(1) if not ecommerce else F.when(F.coalesce(t, F.element_at(o["raw_types"], 1)).isin("Product", "Offer"), 0).otherwise(1)
        return F.struct(trade.alias("late"), (-score).alias("neg"), k.alias("k"), F.coalesce(t, F.get(o["raw_types"], F.lit(0)), F.lit("Unknown")).alias("type"), t.isNotNull().alias("known"), F.concat(missing, F.transform(wanted, lambda w: F.concat(F.lit("recommended "), w))).alias("missing"))

    tops = F.filter("objects", lambda o: o["top"])
    speaks = lambda f, types: F.coalesce(~F.trim(F.element_at(f, F.lit("speakable"))).isin("", "[]", "{}", "false", "0"), F.lit(False)) | F.exists(types, lambda t: F.lower(t) == "speakablespecification")
    part = lambda p: speaks(p, F.array(F.coalesce(F.element_at(p, F.lit("@type")), F.lit(""))))
    d = d.select(
        "page_id", F.col("scripts").cast("long").alias("scripts"), F.col("invalid").cast("long").alias("invalid"), F.size(tops).alias("n"), first(F.array_sort(F.transform(tops, rate))).alias("x"),
        F.exists(tops, lambda o: speaks(o["fields"], o["raw_types"]) | F.exists(_dicts(F.element_at(o["fields"], F.lit("hasPart"))), part)).alias("speakable"),
    )
    score = F.when(F.col("scripts") == 0, 0).when(F.col("n") == 0, F.when(F.col("invalid") > 0, 1).otherwise(0)).when(F.col("x.known"), -F.col("x.neg")).otherwise(2)
    d = d.withColumn("score", score.cast("long"))
    state = F.when(F.col("n") == 0, "fail").when((F.col("score") == 5) & (F.size("x.missing") == 0), "pass").otherwise("partial")
    found = codes((F.col("scripts") == 0, "no_schema"), ((F.col("scripts") > 0) & (F.col("n") == 0), "invalid_json"), ((F.col("n") > 0) & ~F.col("x.known"), "unknown_schema"), (F.size("x.missing") > 0, "missing_fields"))
    return d.select("page_id", "scripts", "invalid", F.col("x.type").alias("type"), F.array_join("x.missing", ", ").alias("missing"), "speakable", "score", state.alias("state"), joined(found).alias("codes"))


def spoken(text: Column) -> Column:
    """A text as ``aligned`` compares it: cleaned and lower-cased, with its tokens. Null and blank texts have neither."""
    t = F.lower(F.coalesce(clean(text), F.lit("")))
    return F.struct(t.alias("text"), tokens(t, "[a-z0-9]+", 3, STOP).alias("tokens"))


def texts_align(a: Column, b: Column) -> Column:
    """Whether two texts say the same."""
    return aligned(spoken(a), spoken(b))


def aligned(a: Column, b: Column) -> Column:
    """Whether two ``spoken`` texts say the same: equal, one within the other, or half of the tokens of the shorter one shared."""
    t, u, x, y = a["text"], b["text"], a["tokens"], b["tokens"]
    within = (F.least(F.length(t), F.length(u)) >= 4) & (F.contains(t, u) | F.contains(u, t))
    shared = (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)) >= 0.5)
    return (t != "") & (u != "") & ((t == u) | within | shared)


def _metas() -> Column:
    """The metas that have a content: (name, property, content), names lower-cased."""
    low = lambda m, a: F.lower(F.coalesce(attr(m, a), F.lit("")))
    told = F.transform(tags("meta"), lambda m: F.struct(low(m, "name").alias("name"), low(m, "property").alias("property"), clean(attr(m, "content")).alias("content")))
    return F.filter(told, lambda m: F.coalesce(m["content"] != "", F.lit(False)))


def _meta(name: str, key: str) -> Column:
    """The content of the first of the column ``metas`` of that name; null without."""
    return first(F.filter("metas", lambda m: m[name] == key))["content"]


def _urls(value: Column) -> Column:
    """The addresses in a JSON-LD image or logo: strings, or url, contentUrl and @id of objects, through one list."""
    one = lambda v: F.when(F.startswith(F.trim(v), F.lit("{")), F.array(*[F.element_at(F.from_json(v, FIELDS), F.lit(k)) for k in ("url", "contentUrl", "@id")])).otherwise(F.array(clean(v)))
    many = F.flatten(F.transform(F.from_json(value, "array<string>"), one))
    out = F.when(F.startswith(F.trim(value), F.lit("[")), many).otherwise(one(value))
    return F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda u: F.coalesce(u != "", F.lit(False)))


def _platforms(links: Column) -> Column:
    def any_like(pattern: str) -> Column:
        return F.exists(links, lambda u: u.rlike(f"(?i){pattern}"))

    return codes(*[(any_like(p), k) for k, p in SOCIAL.items()])


def entity_coherence(d: DataFrame) -> DataFrame:
    """Whether share tags, canonical link, JSON-LD entities and profile links tell of one entity: codes of issues and positives, score (0 to 2).

    Takes with_json_ld(); the page's url is the base of its links.
    """
    none = F.array().cast("array<string>")
    at = lambda f, k: F.element_at(f, F.lit(k))
    canonical = first(F.filter(tags("link"), lambda k: F.map_contains_key(k["attrs"], "href") & rel_has(k, "canonical")))
    entities = F.filter("objects", lambda o: o["top"] & F.arrays_overlap(o["raw_types"], F.array(*map(F.lit, ENTITY_TYPES))))
    # what the rules ask of the page more than once has a column of its own, step by step
    d = d.select(
        "page_id", "url", _metas().alias("metas"), F.transform(entities, lambda o: o["fields"]).alias("entities"), clean(text_of(first(tags("title")))).alias("title"), clean(attr(canonical, "href")).alias("href"),
        F.transform(F.filter(tags("a"), lambda a: F.map_contains_key(a["attrs"], "href")), lambda a: F.coalesce(attr(a, "href"), F.lit(""))).alias("links"),
    )
    texts = {"description": ("name", "description"), "og_title": ("property", "og:title"), "og_description": ("property", "og:description"), "og_site": ("property", "og:site_name"), "t_title": ("name", "twitter:title"),
             "t_description": ("name", "twitter:description"), "t_card": ("name", "twitter:card")}
    places = ("canonical", "og_url", "og_image", "t_image")
    found = F.array(F.when(F.col("href") != "", F.col("href")), _meta("property", "og:url"), _meta("property", "og:image"), _meta("name", "twitter:image"))
    same = lambda f: F.when(F.startswith(F.trim(at(f, "sameAs")), F.lit("[")), F.from_json(at(f, "sameAs"), "array<string>")).otherwise(F.array(at(f, "sameAs")))
    named = lambda f: clean(F.coalesce(F.when(at(f, "name") != "", at(f, "name")), at(f, "headline")))
    d = d.select(
        "page_id", "links", F.when(F.col("title") != "", F.col("title")).alias("title"), *[_meta(*k).alias(c) for c, k in texts.items()], F.transform(found, lambda u: page_url(urljoin(F.col("url"), u))).alias("places"),
        F.transform(F.filter(F.transform("entities", named), lambda x: F.coalesce((x != "") & ~F.startswith(x, F.lit("{")), F.lit(False))), spoken).alias("names"), F.filter(F.coalesce(F.flatten(F.transform("entities", same)), none), lambda x: x.isNotNull()).alias("same_as"),
        F.size(F.flatten(F.transform("entities", lambda f: F.flatten(F.transform(F.array(at(f, "logo"), at(f, "image")), _urls))))).alias("images"),
    )
    compared = ("title", "description", "og_title", "og_description", "og_site", "t_title", "t_description")
    spoke = F.transform(F.array(*[F.col(c) for c in compared]), spoken)
    d = d.select("*", spoke.alias("spoke"), *[F.get("places", F.lit(k)).alias(c) for k, c in enumerate(places)], _platforms(F.col("links")).alias("linked"), _platforms(F.col("same_as")).alias("mirrored"))
    said_as = {c: F.get("spoke", F.lit(k)) for k, c in enumerate(compared)}
    agree = lambda a, b: aligned(said_as[a], said_as[b])
    told = F.filter(F.array(*[F.when(F.col(c).isNotNull(), said_as[c]) for c in ("og_site", "og_title", "title")]), lambda x: x.isNotNull())
    d = d.select("*", told.alias("told")).select(
        "*", agree("og_title", "title").alias("titles"), agree("og_description", "description").alias("descriptions"), agree("t_title", "og_title").alias("shares"),
        F.when(F.col("og_description").isNotNull(), agree("t_description", "og_description")).otherwise(agree("t_description", "description")).alias("summaries"), F.exists("names", lambda x: F.exists("told", lambda y: aligned(x, y))).alias("entity"),
        F.arrays_overlap("linked", "mirrored").alias("overlap"),
    )
    has = lambda *c: F.coalesce(*[F.col(x) for x in c]).isNotNull()
    both = lambda a, b: has(a) & has(b)
    card, entity, overlap = has("t_card", "t_title", "t_description", "t_image"), F.col("entity"), F.col("overlap")
    a, b, images, names = F.size("linked") > 0, F.size("mirrored") > 0, F.col("images") > 0, F.size("names") > 0
    issues = codes(
        (both("og_title", "title") & ~F.col("titles"), "og_title_differs"), (~both("og_title", "title"), "no_og_title"), (both("og_description", "description") & ~F.col("descriptions"), "og_description_differs"),
        (~both("og_description", "description"), "no_og_description"), (both("og_url", "canonical") & (F.col("og_url") != F.col("canonical")), "og_url_differs"), (~has("og_url"), "no_og_url"),
        (both("t_title", "og_title") & ~F.col("shares"), "twitter_title_differs"), (has("t_description") & has("og_description", "description") & ~F.col("summaries"), "twitter_description_differs"), (~card, "no_twitter_card"),
        (~has("og_image", "t_image"), "no_social_image"), (~images, "no_schema_image"), (names & ~entity, "schema_name_differs"), (~names, "no_schema_name"),
        (a & b & ~overlap, "profiles_differ"), (a & ~b, "profiles_not_in_schema"), (~a & ~b, "no_profiles"),
    )
    good = codes(
        (both("og_title", "title") & F.col("titles"), "og_title"), (both("og_description", "description") & F.col("descriptions"), "og_description"),
        (has("og_url") & (~has("canonical") | (F.col("og_url") == F.col("canonical"))), "og_url"), (card, "twitter_card"), (has("og_image", "t_image"), "social_image"), (images, "schema_image"),
        (F.coalesce(entity, F.lit(False)), "schema_name"), (a & b & overlap, "profiles_match"), (~a & b, "profiles_in_schema"),
    )
    either = F.filter(F.array(*map(F.lit, SOCIAL)), lambda x: F.array_contains("linked", x) | F.array_contains("mirrored", x))
    d = d.select("page_id", either.alias("p"), issues.alias("i"), good.alias("g"))
    score = F.when((F.size("p") >= 3) & (F.size("i") == 0), 2).when((F.size("p") > 0) | (F.size("g") >= 3), 1).otherwise(0)
    d = d.withColumn("score", score.cast("long"))
    state = F.when(F.col("score") == 2, "pass").when(F.col("score") == 1, "partial").otherwise("warn")
    return d.select("page_id", F.array_join("p", ", ").alias("platforms"), "score", state.alias("state"), joined(F.col("i")).alias("codes"), joined(F.col("g")).alias("positives"))


def canonical_link(d: DataFrame) -> DataFrame:
    """The canonical link of every page against its own url: absent, other site, other page, or itself."""
    tag = first(F.filter(tags("link"), lambda k: rel_has(k, "canonical")))
    href = F.when(clean(attr(tag, "href")) != "", clean(attr(tag, "href")))
    target = urljoin(F.col("url"), href)
    bare = lambda u: F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "")
    kind = F.when(href.isNull(), "none").when(~same_site(target, F.col("url")), "other_site").when(bare(target) != bare(F.col("url")), "other_page").otherwise("self")
    return d.select("page_id", target.alias("canonical"), kind.alias("kind"))
