"""The ``fetch`` relation: recorded responses of every site, made by rule from the rows of ``pages``.

Every page is a site of its own, ``https://p<page_id>.<host>``, whose homepage is the page with its planted markup. What its other urls answer is drawn by arithmetic on the
page's number, each trait with its own modulus, so the mixtures do not repeat within the tables' sizes. The bodies are whole documents (XML with namespaces,
comments, CDATA and images, or broken); the SQL beside them has the same facts as rows, without any document, so a parser is compared with what was meant.

Columns: site_id, agent (``auditor``, ``markdown`` for requests that ask for text, ``lookup`` for those to an entity source, ``browser`` or a crawler), url, final_url, status (null:
failed), headers (lower-cased names), body, error, elapsed_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.html import host

from .evidence import dealt, evidence_pages
from .fixtures import sites_of

SPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAPS = ("/sitemap.xml", "/maps/a.xml", "/b.xml", "/index.xml", "/c1.xml", "/c2.xml", "/deep/c3.xml")
# What a file is, how many entries it has and what stands in them, for site k, file f (from 1), contents of file g, entry j (from 0); the same words in both dialects.
_T = "((k * (2 * f + 1) + 5 * f) % 10)"
_KIND = (
    f"case when f = 4 then (case when {_T} = 9 then 'broken' else 'index' end) when f = 1 then (case when {_T} < 2 then 'missing' when {_T} < 4 then 'index' when {_T} = 4 then 'moved' when {_T} = 5 then 'page' else 'urls' end) "
    f"when {_T} = 0 then 'missing' when {_T} = 1 then 'broken' when {_T} = 2 then 'empty' when {_T} = 3 then 'down' else 'urls' end"
)
_FINAL = f"case when f = 1 and {_T} = 4 then root || '/b.xml' when f <> 1 and f <> 4 and {_T} = 5 then root || '/moved' || f || '.xml' else root || path end"
_COUNT = "(1 + (k * 3 + g * 11) % 37)"
_H, _D = "((k + 3 * j + g) % 11)", "((k + 5 * j + g) % 9)"
_LOC = (
    f"case {_H} when 0 then 'http://' || h when 1 then 'https://other.example' when 2 then 'https://www.' || h else root end || case when {_H} = 3 then '/p/dup' else '/p/' || g || '/' || j end || case when j % 6 = 5 then '?a=1&b=' || j else '' end"
)
_MOD = f"case {_D} when 0 then null when 1 then '2024-02-30' when 2 then '2999-01-01' when 3 then 'soon' when 4 then '2024-05-31T23:30:00-02:00' when 5 then '2024-06-01T23:30:00-02:00' when 6 then '2024-05-01T10:00:00Z' else '2024-03-0' || (1 + j % 9) end"
_CHILDREN = {1: ("/c2.xml", "/c1.xml", "/sitemap.xml", "/deep/c3.xml"), 4: ("/c1.xml", "/b.xml", "deep/c3.xml", "@/c2.xml", "/old.xml")}
_NAMED = ("@/sitemap.xml", "maps/a.xml", "@/b.xml", "@/index.xml", "@/old.xml", "/b.xml")


def _list(values: tuple[str, ...], open_: str) -> str:
    """A list literal of urls; ``@`` stands for the site's root."""
    return open_ + ", ".join(f"root || '{v[1:]}'" if v[0] == "@" else f"'{v}'" for v in values) + (")" if open_.endswith("(") else "]")


def _turned(values: tuple[str, ...], by: str) -> str:
    """A list turned by a number, in Spark."""
    x, n = _list(values, "array("), len(values)
    return f"concat(slice({x}, cast({by} as int) + 1, {n}), slice({x}, 1, cast({by} as int)))"


def sites(pages: DataFrame) -> DataFrame:
    """(site_id, k, h, root, url, html): every page with a number as a site; of repeated numbers the one of least url and html."""
    rows = pages.where("page_id is not null").groupBy(F.col("page_id").alias("site_id")).agg(F.min(F.struct("url", "html")).alias("x"))
    own = F.concat(F.lit("p"), F.col("site_id").cast("string"), F.lit("."), F.coalesce(F.nullif(host(F.col("x.url")), F.lit("")), F.lit("none.example")))
    out = rows.select("site_id", F.abs("site_id").alias("k"), own.alias("h"), F.concat(F.lit("https://"), own).alias("root"), F.col("x.url").alias("url"), F.col("x.html").alias("html"))
    # few bytes a site make many: the documents are written by all tasks, however small the table
    return out.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site_id")


def sitemap_responses(of: DataFrame) -> DataFrame:
    """The responses to the sitemap files of ``sites()``."""
    paths = F.posexplode(F.array(*map(F.lit, MAPS)))
    d = of.select("site_id", "k", "h", "root", paths.alias("f", "path")).withColumn("f", F.col("f") + 1)
    d = d.withColumns({"kind": F.expr(_KIND), "final_url": F.expr(_FINAL)}).withColumn("g", F.expr("case when kind = 'moved' then 3 else f end"))
    p = "case when g = 3 then 's:' else '' end"
    entry = (
        f"'<' || p || 'url>' || if(j % 5 = 0, '<!-- <url><loc>https://no.example/</loc></url> -->', '') || '<' || p || 'loc> ' || if(j % 3 = 1, '<![CDATA[' || loc || ']]>', replace(loc, '&', '&amp;')) || ' </' || p || 'loc>' "
        "|| coalesce('<' || p || 'lastmod>' || mod || '</' || p || 'lastmod>', '') || if(j % 4 = 0, '<image:image><image:loc>https://img.example/' || j || '.png</image:loc></image:image>', '') || '</' || p || 'url>'"
    )
    entry = entry.replace("|| p ||", f"|| {p} ||").replace("loc ||", f"({_LOC}) ||").replace("replace(loc,", f"replace({_LOC},").replace("|| mod ||", f"|| ({_MOD}) ||")
    d = d.withColumn("urls", F.expr(f"array_join(transform(sequence(0, cast({_COUNT} as int) - 1), j -> {entry}), '')"))
    opened = F.expr(f"case when g = 3 then '<?xml version=\"1.0\"?><s:urlset xmlns:s=\"{SPACE}\"' when g = 6 then '<urlset' else '<urlset xmlns=\"{SPACE}\"' end || ' xmlns:image=\"https://img.example/ns\">'")
    whole = F.concat(opened, F.col("urls"), F.expr(f"'</' || {p} || 'urlset>'"))
    kids = F.expr(f"case when f = 1 then {_turned(_CHILDREN[1], 'k % 4')} else {_turned(_CHILDREN[4], 'k % 5')} end")
    index = F.concat(F.lit(f'<sitemapindex xmlns="{SPACE}">'), F.array_join(F.transform(kids, lambda c: F.concat(F.lit("<sitemap><loc>"), c, F.lit("</loc></sitemap>"))), ""), F.lit("<sitemap><lastmod>2024-01-01</lastmod></sitemap></sitemapindex>"))
    body = (
        F.when(F.col("kind").isin("urls", "moved"), whole).when(F.col("kind") == "broken", F.expr("substring(urls, 1, length(urls) - 3)")).when(F.col("kind") == "index", index).when(F.col("kind") == "empty", "<urlset></urlset>").otherwise("<html><body>not here</body></html>")
    )
    status = F.when(F.col("kind") == "missing", 404).when(F.col("kind") == "down", 503).otherwise(200)
    return _row(d, "auditor", F.concat("root", "path"), status, body, F.create_map(F.lit("content-type"), F.lit("application/xml")), F.col("final_url"))


def robots_names(of: DataFrame) -> DataFrame:
    """(site_id, names): what the sitemap lines of a site's robots.txt name; none where the file is not there."""
    return of.where("k % 12 <> 7").select("site_id", F.expr(f"slice({_turned(_NAMED, '(k * 5) % 6')}, 1, cast(k % 7 as int))").alias("names"))


#: Of so many sites one has no homepage; the literal relations that other responses are dealt from, each by its own number of sites.
DOWN, DOWN_AT = 23, 5
LITERAL = ("robots", "signal_header", "bot_page", "text_fetch", "text_site", "surface_fetch", "lookup")
_NO_HEADERS = "map<string,string>"


def _row(d: DataFrame, agent: str | Column, url: Column, status: Column, body: Column, headers: Column | None = None, final_url: Column | None = None, error: Column | None = None, elapsed: Column | None = None) -> DataFrame:
    """Rows of the relation from rows with site_id."""
    return d.select(
        "site_id", (F.lit(agent) if isinstance(agent, str) else agent).alias("agent"), url.alias("url"), (url if final_url is None else final_url).alias("final_url"), status.cast("int").alias("status"),
        (F.create_map().cast(_NO_HEADERS) if headers is None else headers).alias("headers"), body.alias("body"), (F.lit(None).cast("string") if error is None else error).alias("error"), (F.lit(100) if elapsed is None else elapsed).cast("long").alias("elapsed_ms"),
    )


def responses(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The whole ``fetch`` relation of the sites of ``pages``."""
    of = sites(pages)
    ids = of.select(F.col("site_id").alias("page_id"))
    root = of.select("site_id", "k", "h", "root")
    lit = {name: dealt(spark, ids, name, sites_of(name)) for name in LITERAL}
    at = lambda name: lit[name].join(root, "site_id")
    made = evidence_pages(of.select(F.col("site_id").alias("page_id"), "url", "html")).withColumnRenamed("page_id", "site_id")
    signals = lit["signal_header"].where("value is not null").select("site_id", "value")
    home = made.drop("url").join(root.join(of.select("site_id", F.col("url").alias("page")), "site_id"), "site_id").join(signals, "site_id", "left")
    down = F.col("k") % DOWN == DOWN_AT
    headers = F.when(F.col("value").isNotNull(), F.map_concat("headers", F.create_map(F.lit("content-signal"), F.col("value")))).otherwise(F.col("headers"))
    out = [_row(home, "auditor", F.concat("root", F.lit("/")), F.when(~down, 200), F.when(~down, F.col("html")), headers, F.coalesce("page", F.concat("root", F.lit("/"))), F.when(down, "timeout"), F.col("elapsed_ms"))]
    named = at("robots").join(robots_names(of), "site_id", "left")
    lines = F.concat(F.regexp_replace("body", "Sitemap:[^\n]*", ""), F.lit("\n"), F.array_join(F.transform("names", lambda n: F.concat(F.lit("Sitemap: "), n)), "\n"))
    out.append(_row(named, "auditor", F.concat("root", F.lit("/robots.txt")), F.when(F.col("names").isNull(), 404).otherwise(200), F.when(F.col("names").isNull(), "gone").otherwise(lines)))
    out.append(sitemap_responses(of))
    out.append(_row(at("text_site"), "auditor", F.concat("root", F.lit("/llms.txt")), F.when(F.col("llms").isNull(), 404).otherwise(200), F.col("llms")))
    told = F.map_filter(F.create_map(F.lit("content-type"), F.col("content_type"), F.lit("vary"), F.col("vary")), lambda _, v: v.isNotNull())
    out.append(_row(at("text_fetch"), "markdown", F.concat("root", F.when(F.col("label") == "negotiated", "/").otherwise(F.col("label"))), F.col("status"), F.col("body"), told))
    out.append(_row(at("bot_page"), F.col("bot"), F.concat("root", F.lit("/")), F.col("status"), F.col("html"), F.when(F.col("headers") != "", F.str_to_map("headers", F.lit(";"), F.lit(": "))), error=F.col("error")))
    out.append(_row(at("surface_fetch"), "auditor", F.concat("root", "path"), F.col("status"), F.col("body")))
    out.append(_row(root, "auditor", F.concat(F.lit("http://"), "h", F.lit("/")), F.lit(200), F.lit(""), final_url=F.when(F.col("k") % 3 == 0, F.concat(F.lit("http://"), "h", F.lit("/"))).otherwise(F.concat("root", F.lit("/")))))
    out.append(_row(root, "auditor", F.concat(F.lit("https://www."), "h", F.lit("/")), F.when(F.col("k") % 4 == 2, 404).otherwise(200), F.lit(""), final_url=F.when(F.col("k") % 4 == 1, F.concat(F.lit("https://www."), "h", F.lit("/"))).otherwise(F.concat("root", F.lit("/")))))
    out.append(_row(at("lookup"), "lookup", F.concat(F.lit("https://entities.example/?q="), "name"), F.col("status"), F.lit("")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def robots_bodies(of: DataFrame) -> DataFrame:
    """(site_id, body) of the robots.txt files that answered, with their sitemap lines only."""
    return robots_names(of).select("site_id", F.concat(F.lit("User-agent: *\nDisallow:\n"), F.array_join(F.transform("names", lambda n: F.concat(F.lit("Sitemap: "), n)), "\n")).alias("body"))


# The same facts in SQL, as rows.
_DAY = "case m when '2024-02-30' then null when 'soon' then null when '2024-05-31T23:30:00-02:00' then date '2024-06-01' when '2024-06-01T23:30:00-02:00' then date '2024-06-02' else try_cast(m[1:10] as date) end"


def _turned_sql(values: tuple[str, ...], by: str, absolute: bool) -> str:
    x = "[" + ", ".join(f"root || '/{v.lstrip('@').lstrip('/')}'" if absolute else (f"root || '{v[1:]}'" if v[0] == "@" else f"'{v}'") for v in values) + "]"
    return f"list_concat({x}[{by} + 1:], {x}[1:{by}])"


_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '')"
SITES_SQL = f"""site as (select page_id as site_id, abs(page_id) as k, 'p' || page_id || '.' || coalesce({_HOST}, 'none.example') as h, 'https://p' || page_id || '.' || coalesce({_HOST}, 'none.example') as root
  from (select page_id, min(url) as url from pages where page_id is not null group by 1))"""
MAPS_SQL = f"""{SITES_SQL},
map_file as (select *, {_KIND} as kind, {_FINAL} as final_url from (select site.*, f, ['{"', '".join(MAPS)}'][f] as path from site, (select unnest(range(1, {len(MAPS) + 1})) as f))),
map_entry as (select *, {_LOC} as loc, {_MOD} as m from (select *, unnest(range({_COUNT})) as j from (select *, case when kind = 'moved' then 3 else f end as g from map_file where kind in ('urls', 'moved')))),
map_day as (select *, {_DAY} as day from map_entry),
map_sum as (select site_id, f, count(*) as n, count(m) > 0 as dated, count(*) filter (m is null) as missing, count(*) filter (m is not null and day is null) as bad, count(*) filter (day > date '2024-06-01') as future, list({{'loc': loc, 'lastmod': m}} order by j)[1:25] as entries from map_day group by 1, 2),
map as (
  select a.site_id, a.f, root, root || path as url, final_url, kind not in ('missing', 'down') as ok, kind in ('urls', 'moved', 'index') as valid, kind = 'index' as is_index, case when kind = 'index' then (case when a.f = 1 then 4 else 5 end) else coalesce(n, 0) end as n, coalesce(dated, false) as dated,
    coalesce(missing, 0) as missing, coalesce(bad, 0) as bad, coalesce(future, 0) as future, coalesce(entries, []) as entries, case when kind <> 'index' then [] when a.f = 1 then {_turned_sql(_CHILDREN[1], 'k % 4', True)} else {_turned_sql(_CHILDREN[4], 'k % 5', True)} end as children
  from map_file a left join map_sum using (site_id, f)),
named as (select site_id, root, k % 12 <> 7 and k % 7 > 0 as named, case when k % 12 = 7 then [] else {_turned_sql(_NAMED, '((k * 5) % 6)', True)}[1:k % 7][1:4] end as names from site),
asked as (select site_id, root, named, unnest(list_concat([root || '/sitemap.xml'], names)) as url, unnest(range(len(names) + 1)) as ord from named),
answer as (select a.site_id, a.root, named, ord, a.url, coalesce(final_url, a.url) as final_url, coalesce(ok, false) as ok, f from asked a left join map on map.site_id = a.site_id and map.url = a.url),
picking as (
  select site_id, root, named, ord, [url, final_url] as seen, case when ok then [f] else [] end as files from answer where ord = 0
  union all
  select p.site_id, p.root, p.named, a.ord, case when list_contains(seen, a.url) then seen else list_concat(seen, [a.url, a.final_url]) end, case when a.ok and not list_contains(seen, a.url) and not list_contains(seen, a.final_url) then list_append(files, a.f) else files end
  from picking p join answer a on a.site_id = p.site_id and a.ord = p.ord + 1),
picked as (select site_id, root, named, arg_max(seen, ord) as seen, arg_max(files, ord) as files from picking group by 1, 2, 3)"""
CRAWL_SQL = f"""{MAPS_SQL},
reading as (
  select site_id, root, named, files[1:4] as cands, -1 as step, 0 as files, false as is_index, 0 as invalid, 0::bigint as missing, 0::bigint as bad, 0::bigint as future, []::struct(loc varchar, lastmod varchar)[] as entries, seen, 0 as allowed from picked
  union all
  select r.site_id, r.root, r.named, cands, r.step + 1, r.files + (use_ and coalesce(x.valid, false))::int, r.is_index or (first_ and use_ and coalesce(x.valid and x.is_index, false)), r.invalid + (use_ and not coalesce(x.valid, false))::int,
    r.missing + case when use_ and x.valid then x.missing else 0 end, r.bad + case when use_ and x.valid then x.bad else 0 end, r.future + case when use_ and x.valid then x.future else 0 end,
    case when use_ and x.valid then list_concat(r.entries, x.entries)[1:25] else r.entries end, case when use_ and not first_ then list_concat(r.seen, [want, coalesce(x.final_url, want)]) else r.seen end,
    case when not first_ then r.allowed when use_ and x.valid and x.is_index then 4 - r.files - 1 else 0 end
  from (
    select r.*, (r.step + 1) % 4 = 0 as first_, case when (r.step + 1) % 4 = 0 then cf.url else cf.children[(r.step + 1) % 4] end as want,
      coalesce(len(r.entries) < 25 and case when (r.step + 1) % 4 = 0 then cf.f is not null else (r.step + 1) % 4 <= r.allowed and cf.children[(r.step + 1) % 4] is not null and not list_contains(r.seen, cf.children[(r.step + 1) % 4]) end, false) as use_
    from reading r left join map cf on cf.site_id = r.site_id and cf.f = r.cands[(r.step + 1) // 4 + 1] where r.step < 15) r
  left join map x on x.site_id = r.site_id and x.url = r.want),
crawled as (select * from reading where step = 15)"""
