"""How search engines and extractors find a site, over the DOM relation: blurbs, sampled metadata, trust pages, hreflang, feeds, extraction.

Page rules are built-in functions over the page's own row; what is told of a host (or site) is one partial aggregate by host. Hosts of
pages without a url are empty and have no row. Repeated pages count as often as they stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import clean, codes, hostname, is_http, joined, plain_url, same_site, tokens, urljoin
from sitegauge.runtime import cut
from sitegauge.sources.dom import around, attr, first, has_text, inside, rel_has, said, tags, text_of

from .markup import TRUST
from .pages import HIGH_BOILERPLATE, HIGH_NAVIGATION, HIGH_RATIO, HIGH_SCRIPT, MAIN_WORDS, READABLE_WORDS
from .site_checks import FIELDS, GTINS, OFFER_FIELDS, RETURN_POLICIES, _any, _dicts, _lower, _offer_details, _present, offer_gaps

#: Fixed values.
WORD = "[a-z0-9]+(?:['-][a-z0-9]+)?"
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "our", "that", "the", "this", "to", "we", "with", "you", "your")
PLACEHOLDERS = (
    r"\blorem ipsum\b", r"\b(?:meta )?description (?:goes|comes) here\b", r"\b(?:insert|add|write) (?:a |your )?description\b", r"\bcoming soon\b", r"^welcome to (?:our|my|the) (?:website|site)[.!]?$",
    r"\ball rights reserved\b", r"\bwe use cookies\b", r"\bprivacy policy\b.*\bterms (?:of (?:use|service)|and conditions)\b",
)
SHORTEST, LONGEST, LOW_OVERLAP, SOCIAL_OVERLAP = 50, 200, 0.2, 0.3
LEAST_LEFT, LEAST_RIGHT = 5, 12
FRESH_TERMS = ("blog", "news", "resources", "updates", "changelog", "articles", "insights")
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json", "application/json")
CORE_TRUST, MORE_TRUST, SHOP_TRUST = ("about", "contact", "privacy"), ("terms", "support"), ("returns", "shipping")
LANGUAGE = r"(?i)^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?$"
SAMPLED_WORDS, SAMPLED_BYTES = 40, 15 * 1024 * 1024
APP_ROOTS = ("root", "app", "__next", "__nuxt", "svelte")
COMMERCE = ("product_name", "price", "availability", "variants", "sku_or_gtin", "image", "return_details", "shipping_details")
COMPARED = ("product_name", "price", "availability", "sku_or_gtin")


def placeholder(text: Column) -> Column:
    """Whether a description is a stand-in or boilerplate."""
    out = F.lit(False)
    for p in PLACEHOLDERS:
        out = out | F.coalesce(text.rlike(f"(?is){p}"), F.lit(False))
    return out


def normal(text: Column) -> Column:
    """A text's words alone, lower-cased, hyphens and apostrophes as blanks."""
    return F.array_join(F.regexp_extract_all(F.translate(F.lower(text), "-'", "  "), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def _words(text: Column) -> Column:
    return tokens(text, WORD, 2, STOPWORDS)


def _year(text: Column) -> Column:
    """The latest year that a text names; null without one."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int")))


def _content(name: str, key: str) -> Column:
    """The content of the first meta of exactly that name; null if blank."""
    c = clean(attr(first(F.filter(tags("meta"), lambda m: attr(m, name) == key)), "content"))
    return F.when(c != "", c)


def _filled(c: Column) -> Column:
    return F.when(clean(c) != "", clean(c))


def blurbs(d: DataFrame) -> DataFrame:
    """The page-owned signals of a search result: title, description, h1, main text, canonical url, share descriptions."""
    href = _filled(attr(first(F.filter(tags("link"), lambda k: rel_has(k, "canonical"))), "href"))
    return d.select(
        "page_id", "url", _filled(text_of(first(tags("title")))).alias("title"), _content("name", "description").alias("description"), _filled(text_of(first(tags("h1")))).alias("h1"), "main",
        urljoin(F.col("url"), href).alias("canonical"), _content("property", "og:description").alias("og"), _content("name", "twitter:description").alias("twitter"),
    )


def blurb_issues(d: DataFrame) -> DataFrame:
    """Per host: pages without each signal, descriptions too short, long or stand-in, shared titles and descriptions, canonical links
    astray or shared by pages, descriptions that the page does not speak of or that name an older year, share texts that differ."""
    b = blurbs(d).withColumn("host", hostname(F.col("url"))).where("host <> ''")
    said_ = F.concat_ws(" ", "title", "h1", "main")
    left, right = _words(F.col("description")), _words(said_)
    coverage = F.when((F.size(left) >= LEAST_LEFT) & (F.size(right) >= LEAST_RIGHT), F.size(F.array_intersect(left, right)) / F.size(left))
    seen = _year(said_)
    stale = F.lit(False)
    for c in ("description", "og", "twitter"):
        stale = stale | F.coalesce(_year(F.col(c)) < seen, F.lit(False))

    def astray(c: str) -> Column:
        other = _words(F.col(c))
        differ = (normal(F.col("description")) != normal(F.col(c))) & (F.size(left) >= LEAST_LEFT) & (F.size(other) >= LEAST_LEFT) & (F.size(F.array_intersect(left, other)) / F.size(left) < SOCIAL_OVERLAP)
        return F.coalesce(differ, F.lit(False)).cast("long")

    target, own = plain_url(F.col("canonical")), plain_url(F.col("url"))
    near = F.coalesce(hostname(F.col("canonical")) == F.col("host"), F.lit(False))
    flags = {
        **{f"no_{c}": F.col(c).isNull() for c in ("title", "description", "h1", "canonical")}, "no_main": F.col("main") == "", "short": F.length("description") < SHORTEST, "long": F.length("description") > LONGEST, "placeholder": placeholder(F.col("description")),
        "bad_canonical": F.col("canonical").isNotNull() & target.isNull(), "off_host": target.isNotNull() & ~near, "not_self": target.isNotNull() & near & (target != own), "low_overlap": coverage < LOW_OVERLAP, "stale_year": stale,
    }
    # the pages are read once: what is counted of them, and the keys they may share
    b = cut(b.select("host", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], (astray("og") + astray("twitter")).alias("social"), normal(F.col("description")).alias("d"), normal(F.col("title")).alias("t"), target.alias("target"), own.alias("own")))
    one = b.groupBy("host").agg(F.count("*").alias("pages"), *[F.count_if(n).alias(n) for n in flags], F.sum("social").alias("social_differs"))

    def shared(key: str, name: str) -> DataFrame:
        groups = b.where(F.col(key) != "").groupBy("host", key).agg(F.count("*").alias("n")).where("n > 1")
        return groups.groupBy("host").agg(F.sum("n").alias(name))

    hit = b.where("target is not null and own is not null").select("host", "target", "own").distinct().groupBy("host", "target").agg(F.count("*").alias("n")).where("n > 1").groupBy("host").agg(F.sum("n").alias("collisions"))
    out = one.join(shared("d", "same_description"), "host", "left").join(shared("t", "same_title"), "host", "left").join(hit, "host", "left")
    return out.fillna(0, ["same_description", "same_title", "collisions"])


def _robots(d_headers: bool = True) -> Column:
    """The directives of the robots metas for all, Google and Bing, and of the header."""
    parts = lambda v: F.filter(F.transform(F.split(F.lower(v), ","), lambda p: F.trim(p)), lambda p: p != "")
    metas = F.flatten(F.transform(F.filter(tags("meta"), lambda m: F.lower(F.coalesce(attr(m, "name"), F.lit(""))).isin("robots", "googlebot", "bingbot")), lambda m: parts(F.coalesce(attr(m, "content"), F.lit("")))))
    return F.array_distinct(F.concat(metas, parts(F.coalesce(F.element_at("headers", F.lit("x-robots-tag")), F.lit("")))))


def sampled_metadata(d: DataFrame) -> DataFrame:
    """Per host, its pages taken as the sample of its sitemap: how many lack a title, canonical link, JSON-LD or text, may not be indexed, point elsewhere. Takes with_json_ld()."""
    tag = first(F.filter(tags("link"), lambda k: attr(k, "rel") == "canonical"))
    href = F.when(F.coalesce(attr(tag, "href"), F.lit("")) != "", urljoin(F.col("url"), attr(tag, "href")))
    directives = _robots()
    tops = F.size(F.filter("objects", lambda o: o["top"]))
    rows = d.select(
        hostname(F.col("url")).alias("host"), (F.coalesce(text_of(first(tags("title"))), F.lit("")) == "").alias("no_title"), href.isNull().alias("no_canonical"), (href.isNotNull() & ~same_site(href, F.col("url"))).alias("off_site"),
        (tops == 0).alias("no_schema"), (F.col("invalid") > 0).alias("bad_schema"), F.arrays_overlap(directives, F.array(F.lit("noindex"), F.lit("none"))).alias("blocked"), (F.size(directives) > 0).alias("told"),
        (F.size(F.regexp_extract_all("visible", F.lit("[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0))) < SAMPLED_WORDS).alias("thin"), (F.col("html_bytes") > SAMPLED_BYTES).alias("large"),
    ).where("host <> ''")
    names = ("no_title", "no_canonical", "off_site", "no_schema", "bad_schema", "blocked", "told", "thin", "large")
    out = rows.groupBy("host").agg(F.count("*").alias("pages"), *[F.count_if(F.col(n)).alias(n) for n in names])
    bad = codes(*[(F.col(n) > 0, n) for n in names if n != "told"])
    return out.withColumn("codes", joined(bad)).withColumn("ok", F.col("codes") == "")


def page_links(d: DataFrame) -> DataFrame:
    """Every link of every page, absolute, with the label a reader gets, and whether it stays on its site; a page without links has one row without any."""
    a = F.filter(tags("a"), lambda n: F.map_contains_key(n["attrs"], "href"))
    rows = d.select(hostname(F.col("url")).alias("host"), "url", "deep_text", F.explode_outer(a).alias("a"))
    href = urljoin(F.col("url"), F.coalesce(attr(F.col("a"), "href"), F.lit("")))
    label = F.concat_ws(" ", *[F.when(c != "", c) for c in (text_of(F.col("a")), attr(F.col("a"), "aria-label"), attr(F.col("a"), "title"))])
    rows = rows.select("host", "url", F.when(F.col("a").isNotNull(), href).alias("href"), label.alias("label"))
    return rows.withColumn("own", is_http(F.col("href")) & F.coalesce(same_site(F.col("href"), F.col("url")), F.lit(False)))


def trust_pages(d: DataFrame, ecommerce: bool = False) -> DataFrame:
    """Per host: which pages about the publisher its links lead to, and which are missed (core, recommended, and for shops). One pass over the pages."""
    path = F.url_decode(F.regexp_replace(F.regexp_replace(F.regexp_extract("href", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", path, "label")), "[^a-z0-9]+", " ")), F.lit(" "))
    kinds = codes(*[(F.col("own") & text.rlike(f" ({p}) "), k) for k, p in TRUST.items()])
    hosts = page_links(d).where("host <> ''").select("host", F.explode_outer(kinds).alias("k")).groupBy("host").agg(F.sort_array(F.collect_set("k")).alias("found"))
    lack = lambda names: F.array_join(F.array_except(F.array(*map(F.lit, names)), "found"), " ")
    out = hosts.select("host", joined(F.col("found")).alias("found"), lack(CORE_TRUST).alias("missing_core"), lack(MORE_TRUST).alias("missing_more"), lack(SHOP_TRUST).alias("missing_shop"))
    return out.withColumn("ok", (F.col("missing_core") == "") & (F.lit(not ecommerce) | (F.col("missing_shop") == "")))


def hreflang_links(d: DataFrame) -> DataFrame:
    """(host, page, lang, href, target): the language alternates that pages declare."""
    k = F.filter(tags("link"), lambda n: rel_has(n, "alternate") & F.map_contains_key(n["attrs"], "hreflang"))
    rows = d.select(hostname(F.col("url")).alias("host"), "url", F.explode(k).alias("k"))
    href = F.trim(F.coalesce(attr(F.col("k"), "href"), F.lit("")))
    return rows.select("host", F.regexp_replace("url", "/+$", "").alias("page"), _lower(F.col("k"), "hreflang").alias("lang"), href.alias("href"), F.when(href != "", F.regexp_replace(urljoin(F.col("url"), href), "/+$", "")).alias("target"), "url")


def hreflang_sets(d: DataFrame) -> DataFrame:
    """Per host: pages with alternates, values and hrefs at fault, pages with a language twice, without themselves or without a default."""
    rows = hreflang_links(d)
    page = rows.groupBy("host", "page").agg(
        F.count_if(~((F.col("lang") == "x-default") | F.col("lang").rlike(LANGUAGE))).alias("invalid"), F.count_if(F.col("href") == "").alias("no_href"), F.count_if((F.col("href") != "") & ~is_http(F.col("href"))).alias("relative"),
        (F.count_if(F.col("lang") != "") > F.count_distinct(F.when(F.col("lang") != "", F.col("lang")))).alias("twice"), F.coalesce(F.bool_or(F.col("target") == F.col("page")), F.lit(False)).alias("own"),
        ((F.count_distinct(F.when(F.col("lang") != "x-default", F.col("lang"))) > 1) & ~F.bool_or(F.col("lang") == "x-default")).alias("no_default"),
    )
    return page.groupBy("host").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("invalid", "no_href", "relative")], F.count_if("twice").alias("twice"), F.count_if(~F.col("own")).alias("no_self"), F.count_if("no_default").alias("no_default"))


def freshness(d: DataFrame) -> DataFrame:
    """Per page: a link to a section that is kept up, dated content, and feeds that it links on its own site."""
    day = lambda v: F.try_to_date(F.when(F.trim(v).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(F.trim(v), 1, 10)), "yyyy-MM-dd").isNotNull()
    section = F.exists(F.filter(tags("a"), lambda a: F.map_contains_key(a["attrs"], "href")), lambda a: F.lower(F.concat_ws(" ", attr(a, "href"), text_of(a))).rlike("|".join(FRESH_TERMS)))
    key = lambda m: F.lower(F.coalesce(F.when(said(m, "property"), attr(m, "property")), attr(m, "name"), F.lit("")))
    dated = F.exists(tags("time"), lambda t: day(F.when(said(t, "datetime"), attr(t, "datetime")).otherwise(F.coalesce(text_of(t), F.lit(""))))) | F.exists(
        tags("meta"), lambda m: key(m).isin("article:published_time", "article:modified_time", "date", "last-modified") & day(F.coalesce(attr(m, "content"), F.lit("")))
    )
    kind = lambda k: F.lower(F.trim(F.substring_index(F.coalesce(attr(k, "type"), F.lit("")), ";", 1)))
    href = lambda k: F.trim(F.coalesce(attr(k, "href"), F.lit("")))
    feeds = F.filter(tags("link"), lambda k: rel_has(k, "alternate") & (href(k) != "") & (kind(k).isin(*FEED_TYPES) | F.lower(href(k)).rlike(r"\.(rss|xml|atom|json)$")))
    urls = F.array_distinct(F.filter(F.transform(feeds, lambda k: urljoin(F.col("url"), href(k))), lambda u: is_http(u) & same_site(u, F.col("url"))))
    return d.select("page_id", section.alias("section"), dated.alias("dated"), F.array_join(urls, " ").alias("feeds")).withColumn("available", F.col("section") | F.col("dated"))


def text_alternate(d: DataFrame) -> DataFrame:
    """Where a page says its Markdown or text version is, else the place where one is looked for."""
    k = F.filter(tags("link"), lambda n: rel_has(n, "alternate") & said(n, "href") & (F.lower(F.coalesce(attr(n, "type"), F.lit(""))).isin("text/markdown", "text/x-markdown", "text/plain") | F.lower(attr(n, "href")).rlike(r"\.(md|markdown|txt)$")))
    linked = urljoin(F.col("url"), attr(first(k), "href"))
    return d.select("page_id", F.coalesce(linked, F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/index.md"))).alias("text_url"), linked.isNotNull().alias("linked"))


def discovery_score(rows: DataFrame) -> DataFrame:
    """The search-discovery score (0 to 4) and state of sites from what was found: crawlers_allowed, sitemap_valid, lastmod_good, freshness,
    sitemap_clean, metadata_ok, blurbs_ok, hreflang_ok, trust_ok. Faults of alternates or trust pages cap it at 3."""
    yes = lambda c: F.col(c).cast("int")
    fresh = ((F.col("sitemap_valid") & F.col("lastmod_good")) | F.col("freshness")).cast("int")
    clean_ = (F.col("sitemap_valid") & F.col("sitemap_clean") & F.col("metadata_ok") & F.col("blurbs_ok")).cast("int")
    points = yes("crawlers_allowed") + yes("sitemap_valid") + fresh + clean_
    score = F.when(F.col("hreflang_ok") & F.col("trust_ok"), points).otherwise(F.least(points, F.lit(3)))
    out = rows.select("site_id", score.cast("long").alias("score"))
    return out.withColumn("state", F.when(F.col("score") == 4, "pass").when(F.col("score") > 0, "partial").otherwise("warn"))


def _visible_commerce(d: DataFrame) -> DataFrame:
    """What a reader sees of a product, from microdata, data attributes or the page's text without hidden elements."""
    shown = F.filter("nodes", lambda n: ~n["hidden"])
    value = lambda n: F.coalesce(*[F.when(clean(attr(n, a)) != "", clean(attr(n, a))) for a in ("content", "value", "href", "data-price", "data-sku", "data-gtin")], F.when(clean(text_of(n)) != "", clean(text_of(n))))
    pick = lambda test: first(F.transform(F.slice(F.filter(shown, lambda n: test(n) & (has_text(n) | value(n).isNotNull())), 1, 1), value))
    one = lambda test: value(first(F.filter(shown, test)))
    prop = lambda n, p: F.array_contains(F.split(F.coalesce(attr(n, "itemprop"), F.lit("")), r"\s+"), p)
    has = lambda n, a: F.map_contains_key(n["attrs"], a)
    text = F.col("shown")
    match = lambda p, g: F.when(text.rlike(p), F.regexp_extract(text, p, g))
    like = lambda n, a, *words: F.lower(F.coalesce(attr(n, a), F.lit(""))).rlike("|".join(words))
    choices = F.filter(shown, lambda n: ((n["tag"] == "select") & (like(n, "name", "variant", "size", "color") | like(n, "id", "variant", "size", "color"))) | has(n, "data-variant"))
    options = F.filter(shown, lambda n: (n["tag"] == "option") & F.coalesce(inside(n, first(choices)), F.lit(False)))
    linked = lambda *words: F.exists(shown, lambda n: (n["tag"] == "a") & like(n, "href", *words))
    price = r"(?i)(?:[$€£¥]\s*|\b(?:USD|EUR|GBP|CAD|AUD|JPY)\s*)(\d{1,3}(?:[,.]\d{3})+(?:[,.]\d{2})?|\d{1,7}(?:[,.]\d{1,2})?)"
    present = lambda c: F.when(c, F.lit("present"))
    return d.withColumn(
        "seen",
        F.struct(
            F.coalesce(one(lambda n: prop(n, "name")), one(lambda n: has(n, "data-product-name")), pick(lambda n: (n["tag"] == "h1") & around(n, "main")), pick(lambda n: (n["tag"] == "h1") & around(n, "article")), pick(lambda n: n["tag"] == "h1")).alias("product_name"),
            F.coalesce(one(lambda n: prop(n, "price")), one(lambda n: has(n, "data-price")), match(price, 1)).alias("price"),
            F.coalesce(one(lambda n: prop(n, "availability")), one(lambda n: has(n, "data-availability")), match(r"(?i)\b(in stock|out of stock|sold out|available|pre-?order)\b", 1)).alias("availability"),
            present((F.size(choices) > 0) & (F.size(options) != 1)).alias("variants"),
            F.coalesce(one(lambda n: prop(n, "sku")), one(lambda n: F.startswith(F.coalesce(attr(n, "itemprop"), F.lit("")), F.lit("gtin"))), one(lambda n: has(n, "data-sku")), one(lambda n: has(n, "data-gtin")), match(r"(?i)\b(?:SKU|GTIN|UPC|EAN)\s*[:#-]?\s*([A-Za-z0-9._-]{3,32})\b", 1)).alias("sku_or_gtin"),
            present(F.exists(shown, lambda n: prop(n, "image") | has(n, "data-product-image") | ((n["tag"] == "img") & has(n, "src") & around(n, "main", "article")))).alias("image"),
            present(linked("return", "refund") | text.rlike(r"(?i)\b(returns?|refunds?|exchanges?)\b")).alias("return_details"), present(linked("shipping", "delivery") | text.rlike(r"(?i)\b(shipping|delivery)\b")).alias("shipping_details"),
        ),
    )


def _scalar(v: Column) -> Column:
    """A field as a text, whole: a string or number, or an object's name or value; null for lists and blanks."""
    inner = F.from_json(v, FIELDS)
    got = F.when(F.startswith(F.trim(v), F.lit("{")), F.coalesce(F.element_at(inner, F.lit("name")), F.element_at(inner, F.lit("value")))).when(~F.startswith(F.trim(v), F.lit("[")), v)
    return F.when(~clean(got).isin("", "true", "false"), clean(got))


def _schema_commerce(d: DataFrame) -> DataFrame:
    """What JSON-LD declares of the best product (the one whose best offer lacks least) and its best offer; null without a product."""
    products = F.filter("objects", lambda o: ~o["top"] & F.array_contains(o["types"], "Product"))
    gaps = lambda o, k: F.struct(F.size(F.coalesce(_best(o["fields"])["missing"], F.array(*map(F.lit, range(6))).cast("array<string>"))).alias("n"), k.alias("k"), o["fields"].alias("f"))
    p = first(F.array_sort(F.transform(products, lambda o, k: F.struct(gaps(o, k)["n"].alias("n"), k.alias("k")))))
    d = d.withColumn("product", F.get(F.transform(products, lambda o: o["fields"]), p["k"]))
    d = d.withColumn("offer", F.get(_dicts(F.element_at("product", F.lit("offers"))), _best(F.col("product"))["k"]))
    f, o = F.col("product"), F.coalesce("offer", F.create_map().cast(FIELDS))
    at = lambda m, k: F.element_at(m, F.lit(k))
    present = lambda c: F.when(c, F.lit("present"))
    declared = F.struct(
        _scalar(at(f, "name")).alias("product_name"), _scalar(at(o, "price")).alias("price"), _scalar(at(o, "availability")).alias("availability"), present(_any(f, ("hasVariant", "isVariantOf"), True)).alias("variants"),
        F.coalesce(*[_scalar(at(f, k)) for k in ("sku", *GTINS)]).alias("sku_or_gtin"), present(_present(f, "image", True)).alias("image"), present(_any(f, RETURN_POLICIES, True) | _any(o, RETURN_POLICIES, True)).alias("return_details"),
        present(_present(f, "shippingDetails", True) | _present(o, "shippingDetails", True)).alias("shipping_details"),
    )
    own = codes(*[(~_present(f, n, True), n) for n in ("name", "description", "offers", "image", "brand", "sku")], (~_any(f, GTINS, True), "gtin"), (~_any(f, ("aggregateRating", "review"), True), "aggregateRating|review"))
    missing = F.concat(own, F.transform(offer_gaps(f, True), lambda g: F.concat(F.lit("offers."), g)))
    return d.withColumns({"declared": F.when(f.isNotNull(), declared), "schema_missing": F.when(f.isNull(), F.array(F.lit("Product"))).otherwise(missing)})


def _best(product: Column) -> Column:
    """(n, k, missing) of a product's offer that lacks least."""
    offers = _dicts(F.element_at(product, F.lit("offers")))
    lack = lambda o: F.filter(F.array(*[F.when(~_present(o, n, True), F.lit(n)) for n in OFFER_FIELDS], *_offer_details(o, True)), lambda x: x.isNotNull())
    return first(F.array_sort(F.transform(offers, lambda o, k: F.struct(F.size(lack(o)).alias("n"), k.alias("k"), lack(o).alias("missing")))))


def price_value(text: Column) -> Column:
    """The first amount in a text as a decimal, whichever marks part thousands and decimals; null without one."""
    n = F.regexp_extract(text, r"(\d{1,3}(?:[,.]\d{3})+(?:[,.]\d{1,2})?|\d{1,12}(?:[,.]\d{1,2})?)", 1)
    comma, point = F.contains(n, F.lit(",")), F.contains(n, F.lit("."))
    last_comma = F.length(F.substring_index(n, ",", -1)) < F.length(F.substring_index(n, ".", -1))
    mixed = F.when(last_comma, F.translate(F.replace(n, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(n, F.lit(","), F.lit("")))
    parts = F.split(n, "[,.]")
    tail = F.length(F.element_at(parts, -1))
    joined_ = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ""), F.lit("."), F.element_at(parts, -1))
    single = F.when((F.size(parts) > 2) & tail.isin(1, 2), joined_).when((F.size(parts) > 2) | (tail == 3), F.array_join(parts, "")).otherwise(joined_)
    return F.when(comma & point, mixed).when(comma | point, single).otherwise(n).try_cast("decimal(20,4)")


def _same(name: str, a: Column, b: Column) -> Column:
    if name == "price":
        return price_value(a).eqNullSafe(price_value(b))
    low = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]" if name != "availability" else "[^a-z]", "")
    if name == "availability":
        kind = lambda x: F.coalesce(*[F.when(F.contains(low(x), F.lit(t)), F.lit(t)) for t in ("outofstock", "soldout", "preorder", "instock", "available")], low(x))
        return kind(a) == kind(b)
    return low(a) == low(b)


def millionths(x: Column) -> Column:
    """A double to six places as the nearest number of millionths, as SQL rounds; ``round`` to six places would go by the digits of its shortest text (0.0640625 up, though a million times it is 64062.49999999999)."""
    return F.round(x * 1_000_000, 0) / 1_000_000


def extraction_readiness(d: DataFrame, ecommerce: bool = False) -> DataFrame:
    """What an extractor gets from a page without running it: words without hidden elements, main share, chrome and script shares, rendering,
    JSON-LD types and limits, and with ``ecommerce`` the product's facts as shown and as declared. Takes with_json_ld().

    Byte shares are taken of the HTML as it came.
    """
    mains = F.filter("nodes", lambda n: n["tag"].isin("main", "article") | (attr(n, "role") == "main"))
    chrome = F.filter("nodes", lambda n: n["tag"].isin("nav", "header", "footer", "aside"))
    outer = F.filter(chrome, lambda n: ~around(n, "nav"))
    total = lambda nodes, field: F.aggregate(nodes, F.lit(0), lambda acc, n: acc + n[field])
    words = F.when(F.trim("shown") == "", F.lit(0)).otherwise(F.size(F.split("shown", " ")))
    shell = (F.size(F.filter(tags("script"), lambda s: F.map_contains_key(s["attrs"], "src"))) >= 5) | F.exists("nodes", lambda n: ~n["hidden"] & attr(n, "id").isin(*APP_ROOTS))
    topmost = F.filter("nodes", lambda n: n["hidden"] & ((n["parent"] < 0) | ~F.coalesce(F.get("nodes", n["parent"])["hidden"], F.lit(False))))
    d = d.withColumns(
        {
            "hidden_nodes": F.size(topmost).cast("long"), "words": words.cast("long"), "chrome": total(outer, "shown"), "shell": shell, "script_bytes": total(tags("script", "style"), "bytes"),
            "main_words": F.coalesce(F.array_max(F.transform(mains, lambda n: n["shown"])), words - total(outer, "shown")), "text_bytes": F.octet_length("shown"),
        }
    )
    d = d.withColumn("main_words", F.least("main_words", F.col("words")).cast("long"))
    none = F.col("words") == 0
    d = d.withColumns(
        {
            "boilerplate": F.when(none, 1.0).otherwise((F.col("words") - F.col("main_words")) / F.col("words")), "navigation": F.when(none, 1.0).otherwise(F.col("chrome") / F.col("words")),
            "script_share": F.when(F.col("html_bytes") == 0, 0.0).otherwise(F.col("script_bytes") / F.col("html_bytes")), "html_ratio": F.col("html_bytes") / F.greatest("text_bytes", F.lit(1)),
            "rendering": F.when((F.col("words") < READABLE_WORDS) & F.col("shell"), "probable_js_shell").when(none, "blocked_or_empty").when(F.col("words") >= READABLE_WORDS, "readable").otherwise("thin"),
        }
    )
    found = codes(
        (none, "no_text"), (~none & (F.col("main_words") < MAIN_WORDS), "thin_main"), (F.col("boilerplate") > HIGH_BOILERPLATE, "boilerplate"), (F.col("navigation") > HIGH_NAVIGATION, "navigation"), (F.col("script_share") > HIGH_SCRIPT, "scripts"),
        (F.col("html_ratio") > HIGH_RATIO, "html_ratio"), (F.col("rendering") != "readable", "rendering"), ((F.size("schema_types") == 0) & (F.col("invalid") == 0), "no_schema"), (F.col("invalid") > 0, "bad_schema"),
    )
    caveats = codes((F.col("hidden_nodes") > 0, "hidden_nodes"), (F.col("cut"), "schema_cut"), (F.col("ignored") > 0, "schema_ignored"))
    keep = ["page_id", "hidden_nodes", "words", "main_words", *[millionths(F.col(c)).alias(c) for c in ("boilerplate", "navigation", "script_share", "html_ratio")], "rendering", F.array_join(F.array_sort("schema_types"), " ").alias("schema_types")]
    if not ecommerce:
        return d.select(*keep, joined(found).alias("codes"), joined(caveats).alias("caveats"))
    d = _schema_commerce(_visible_commerce(d))
    v, s = (lambda n: F.col(f"seen.{n}")), (lambda n: F.col(f"declared.{n}"))
    differ = codes(*[((v(n).isNotNull() != s(n).isNotNull()) | (~_same(n, v(n), s(n)) if n in COMPARED else F.lit(False)), n) for n in COMMERCE])
    lacking = codes(*[(v(n).isNull(), n) for n in COMMERCE if n != "variants"])
    more = codes((F.size("schema_missing") > 0, "schema_fields"), (F.size(lacking) > 0, "visible_fields"), (F.size(differ) > 0, "mismatches"))
    return d.select(*keep, F.array_join("schema_missing", " ").alias("schema_missing"), joined(lacking).alias("visible_missing"), joined(differ).alias("mismatches"), joined(F.concat(found, more)).alias("codes"), joined(caveats).alias("caveats"))
