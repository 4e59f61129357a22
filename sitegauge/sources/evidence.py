"""Evidence at the size of the tables: pages with planted markup and responses, and literal relations dealt over all pages.

The tables' pages have no forms, images, JSON-LD or share tags and no response. So page n gets the markup of variant n modulo 8 in its head and
before its footer, and a response by its number; every page of the table is one. The same in SQL stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import relation

_ABOUT = "A plain page about the shop and its many goods for people who like to read."
_ORG = '{"@context": "https://schema.org", "@type": "Organization", "name": "Corner Shop", "url": "https://shop.example/", "logo": {"@type": "ImageObject", "url": "/logo.png"}, "sameAs": ["https://www.instagram.com/corner.shop", "https://www.youtube.com/@cornershop", "https://www.linkedin.com/company/corner"]}'
_PRODUCT = (
    '[{"@type": "Product", "name": "Red Chair", "description": "A chair.", "image": ["/c.png"], "sku": "RC-1", "offers": [{"@type": "Offer", "price": "19.90"}, '
    '{"@type": "Offer", "price": 19.9, "priceCurrency": "EUR", "availability": "https://schema.org/InStock", "priceValidUntil": "2030-01-01"}]}]'
)
_ARTICLE = '{"@graph": [{"@type": ["Article", "Thing"], "headline": "Story", "author": {"@type": "Person", "name": "A"}, "datePublished": "2024-05-01", "speakable": {"cssSelector": [".s"]}}, {"@type": "Person", "name": "A"}]}'


def _ld(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


HEADS = [
    "",
    f'<meta name="description" content="{_ABOUT}"><link rel="canonical" href="@URL@"><meta name="viewport" content="width=device-width, initial-scale=1"><link rel="stylesheet" href="/a.css">',
    f'<meta name="description" content="{_ABOUT}"><meta property="og:title" content="Corner Shop"><meta property="og:site_name" content="Corner Shop"><meta property="og:description" content="{_ABOUT}"><meta property="og:url" content="@URL@">'
    f'<meta property="og:image" content="/share.png"><meta name="twitter:card" content="summary"><link rel="canonical" href="@URL@">{_ld(_ORG)}',
    '<meta name="robots" content="NOINDEX , follow"><meta name="viewport" content="width=device-width, maximum-scale=1.0"><link rel="stylesheet" href="/a.css"><link rel="preload stylesheet" href="/b.css" media="all">'
    '<link rel="stylesheet" href="/c.css"><link rel="stylesheet" href="/d.css" media="print"><link rel="stylesheet" href="/e.css"><script src="/1.js"></script><script src="/2.js"></script><script src="/3.js"></script><script src="/4.js" defer="defer"></script>',
    f'<meta name="googlebot" content="nosnippet"><link rel="canonical" href="https://other.example/x">{_ld(_PRODUCT)}',
    f'<meta name="robots" content="max-image-preview : standard">{_ld("{not json")}<meta name="description" content="{_ABOUT * 3}">',
    f'<link rel="canonical" href="/stories/?p=1"><link rel="alternate" type="application/rss+xml" href="/feed.xml">{_ld(_ARTICLE)}<style>@media (min-width: 3em) {{p{{margin:0}}}}</style>',
    f'<meta name="description" content="{_ABOUT}"><meta property="og:title" content="Quite another thing"><meta property="og:description" content="Nothing of that sort is told here, never mind."><meta name="twitter:title" content="Third heading">'
    f'<meta name="twitter:image" content="https://img.example/t.png">{_ld(_ORG.replace("Corner Shop", "Blue Harbour").replace("/logo.png", ""))}<meta name="viewport" content="initial-scale=1"><meta name="viewport" content="width=device-width">',
]
BODIES = [
    "",
    '<form action="/search" method="get"><label for="q">Find</label><input id="q" name="query" type="search"><button type="submit">Go</button></form>',
    '<p><a href="https://instagram.com/corner.shop">Pictures</a> <a href="https://youtube.com/@cornershop">Films</a> <a href="https://linkedin.com/company/corner">Jobs</a></p>',
    '<form action="javascript:go()"><input type="email" name=""><input type="hidden" name="t"><input type="submit"></form><img src="/1.png"><img src="/2.png"><img src="/3.png" alt=""><button></button>',
    '<div itemprop="name">Red chair</div><span itemprop="price" content="19,90">EUR 19,90</span><p>In stock. SKU: RC-1</p><a href="/returns">Returns</a>',
    '<p hidden>secret words here</p><div style="display: none">more of <b>them</b></div>' + "".join(f'<a href="#{k}">here</a>' for k in range(12)),
    '<div data-nosnippet>Kept to itself</div><time datetime="2024-05-01">May</time><a href="/blog/">Blog</a><a href="/about">About us</a><a href="/contact">Contact</a><a href="/privacy">Privacy</a>',
    '<p><a href="https://tiktok.com/@corner">Clips</a></p><select name="size"><option>S</option><option>M</option></select>',
]
HEADERS = [{}, {"etag": '"x"'}, {"cache-control": "max-age=60"}, {"last-modified": "Wed, 01 May 2024 00:00:00 GMT", "x-robots-tag": "googlebot: noarchive, unavailable_after: 25 Jun 2030"}]
ELAPSED = (200, 700)  # least, and step for each of five kinds


def evidence_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, elapsed_ms, headers) of every page; one without a number counts as 0."""
    number = F.coalesce("page_id", F.lit(0))
    k = F.pmod(number, F.lit(len(HEADS))).cast("int")
    literal = lambda parts: F.replace(F.element_at(F.array(*map(F.lit, parts)), k + 1), F.lit("@URL@"), F.coalesce("url", F.lit("")))
    html = F.replace(F.replace(F.coalesce("html", F.lit("")), F.lit("<head>"), F.concat(F.lit("<head>"), literal(HEADS))), F.lit("<footer>"), F.concat(literal(BODIES), F.lit("<footer>")))
    maps = F.array(*[F.create_map(*[F.lit(x) for kv in h.items() for x in kv]) if h else F.create_map().cast("map<string,string>") for h in HEADERS])
    headers = F.element_at(maps, F.pmod(number, F.lit(len(HEADERS))).cast("int") + 1)
    return pages.select("page_id", "url", html.alias("html"), (ELAPSED[0] + ELAPSED[1] * F.pmod(number, F.lit(5))).cast("long").alias("elapsed_ms"), headers.alias("headers"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(parts: list[str]) -> str:
    return f"replace([{', '.join(map(_q, parts))}][coalesce(page_id, 0) % {len(parts)} + 1], '@URL@', coalesce(url, ''))"


_MAPS = "[" + ", ".join("map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in h.items()) + "}" if h else "map([]::varchar[], []::varchar[])" for h in HEADERS) + "]"
#: The same in SQL, as a common table expression.
PAGES_SQL = f"""evidence as (
  select page_id, url, replace(replace(coalesce(html, ''), '<head>', '<head>' || {_pick(HEADS)}), '<footer>', {_pick(BODIES)} || '<footer>') as html,
    ({ELAPSED[0]} + {ELAPSED[1]} * (coalesce(page_id, 0) % 5))::bigint as elapsed_ms, {_MAPS}[coalesce(page_id, 0) % {len(HEADERS)} + 1] as headers
  from pages)"""


def dealt(spark: SparkSession, pages: DataFrame, name: str, sites: int) -> DataFrame:
    """A literal relation over all pages: each page is a site with the rows of literal site page_id modulo ``sites`` + 1.

    The literal rows are broadcast (fixed, some dozens); relations without site_id stay as they are.
    """
    rows = relation(spark, name)
    if "site_id" not in rows.columns:
        return rows
    ids = pages.where("page_id is not null").select(F.col("page_id").alias("own_site"), (F.pmod("page_id", F.lit(sites)) + 1).cast("long").alias("site_id"))
    return ids.join(F.broadcast(rows), "site_id").select(F.col("own_site").alias("site_id"), *[c for c in rows.columns if c != "site_id"])


def fed(spark: SparkSession, pages: DataFrame, name: str, key: str) -> DataFrame:
    """A literal relation of named things (peers, probes, cached keys) at the size of the pages: each page brings one of them, by its number, under a name of its own."""
    rows = relation(spark, name)
    numbered = rows.join(rows.select(key).distinct().withColumn("no_", F.row_number().over(Window.orderBy(key)) - 1), key)  # some dozens of rows
    ids = pages.where("page_id is not null").select(F.col("page_id").alias("own_"), F.pmod("page_id", F.lit(rows.select(key).distinct().count())).cast("int").alias("no_"))
    return ids.join(F.broadcast(numbered), "no_").select(*[F.concat_ws(" ", key, F.col("own_").cast("string")).alias(c) if c == key else F.col(c) for c in rows.columns])
