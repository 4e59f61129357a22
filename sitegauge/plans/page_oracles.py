"""DuckDB SQL for the queries over evidence pages: the rules said again on the markup as text, as the planted markup is regular."""

from __future__ import annotations

from sitegauge.sources.evidence import PAGES_SQL

def attr(tag: str, name: str) -> str:
    return f"regexp_extract({tag}, '\\s{name}=\"([^\"]*)\"', 1)"


def all_(text: str, tag: str) -> str:
    return f"regexp_extract_all({text}, '<(?:{tag})(?:\\s[^>]*)?>')"


def text_of(e: str) -> str:
    e = f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        e = f"replace({e}, '{name}', '{char}')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


#: The page's text without comments, scripts' contents and doctype, and its elements as lists of opening tags.
PAGE = f"""with {PAGES_SQL},
p as (select page_id, url, html, elapsed_ms, headers, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') as m, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<script[^>]*>.*?</script>', ' ', 'g') as b from evidence),
d as (select *, regexp_extract(m, '(?s)<head>(.*?)</head>', 1) as head, {text_of("regexp_extract(m, '(?s)<title>(.*?)</title>', 1)")} as title from p)"""


def meta(name: str, key: str, where: str = "m") -> str:
    return f"nullif(trim(regexp_replace(regexp_extract({where}, '<meta {name}=\"{key}\" content=\"([^\"]*)\"', 1), '\\s+', ' ', 'g')), '')"


def words(e: str) -> str:
    return f"(case when trim({e}) = '' then 0 else len(string_split(trim({e}), ' ')) end)"


def codes(*rules: tuple[str, str]) -> str:
    return "concat_ws(' ', " + ", ".join(f"case when {c} then '{code}' end" for c, code in rules) + ")"


def visible(e: str) -> str:
    for tag in ("head", "style", "script"):
        e = f"regexp_replace({e}, '(?s)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return text_of(e)


#: Elements that the planted markup hides.
HIDDEN = "'<p hidden>[^<]*</p>|<div style=\"display: none\">more of <b>them</b></div>'"
SHOWN = f"regexp_replace(m, {HIDDEN}, ' ', 'g')"
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def host(u: str) -> str:
    return _HOST.format(u)


def absolute(href: str, base: str = "url") -> str:
    """Only the forms of the planted links and the tables' pages: absolute, from the root, or a fragment."""
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    return f"(case when {href} = '' then {base} when regexp_matches({href}, '^[a-z]+:') then {href} when starts_with({href}, '/') then {origin} || {href} when starts_with({href}, '#') then regexp_replace({base}, '#.*$', '') || {href} end)"


LINKS = "regexp_extract_all(b, '(?s)<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>')"
FIELD = "list_filter(regexp_extract_all(b, '<(?:input|select|textarea)(?:\\s[^>]*)?>'), lambda t: not regexp_matches(t, 'type=\"(hidden|submit|button|reset|image)\"'))"
_structure = f"""{PAGE},
e as (
  select *, {all_('b', 'h1')} as h1s, {LINKS} as links, {FIELD} as fields, regexp_extract_all(b, '(?s)<form.*?</form>') as forms, {all_('b', 'img')} as images, regexp_extract_all(b, '(?s)<button.*?</button>') as buttons,
    coalesce({meta('name', 'description')}, '') as description, ({' + '.join(f"regexp_matches(b, '<{t}[\\s>]')::int" for t in ('header', 'nav', 'main', 'article', 'section', 'footer', 'aside'))}) as landmarks from d),
f as (
  select *, len(list_filter(links, lambda a: lower({text_of('a')}) in ('', 'here', 'click here', 'more', 'learn more', 'read more'))) as vague, len(list_filter(links, lambda a: regexp_matches({attr('a', 'href')}, '^(#|javascript:)'))) as dead,
    list_transform(forms, lambda f: regexp_extract(f, '^<form[^>]*>')) as opens, list_concat([], regexp_extract_all(array_to_string(forms, ''), '<(?:input|select|textarea)(?:\\s[^>]*)?>')) as inner_ from e),
g as (
  select *, list_filter(inner_, lambda t: not regexp_matches(t, 'type=\"(hidden|submit|button|reset|image)\"')) as asked,
    list_transform(forms, lambda f: regexp_matches(f, '<button(\\s+type="submit")?>[^<]+</button>')) as named from f),
h as (
  select page_id, len(h1s)::bigint as h1, landmarks::bigint as landmarks, len(links)::bigint as links, vague::bigint as vague_links, dead::bigint as dead_links, len(forms)::bigint as forms,
    {codes(
        ("len(h1s) = 0", "no_h1"), ("len(h1s) > 1", "many_h1"), ("regexp_matches(b, '<h3[\\s>]') and not regexp_matches(b, '<h2[\\s>]')", "h3_without_h2"), ("landmarks < 3", "few_landmarks"), ("title = ''", "no_title"),
        ("length(title) > 70", "long_title"), ("description = ''", "no_description"), ("length(description) > 180", "long_description"), ("len(links) >= 8 and vague / len(links) > 0.25", "vague_links"),
        ("len(links) >= 8 and dead / len(links) > 0.25", "dead_links"), (f"len(list_filter(fields, lambda t: not ({attr('t', 'id')} <> '' and contains(b, 'for=\"' || {attr('t', 'id')} || '\"')))) > 0", "fields_without_label"),
        (f"len(list_filter(opens, lambda t: {attr('t', 'action')} = '')) > 0", "form_without_action"), (f"len(list_filter(opens, lambda t: regexp_matches({attr('t', 'action')}, '^(javascript:|#)'))) > 0", "form_script_action"),
        (f"len(list_filter(opens, lambda t: {attr('t', 'method')} = '')) > 0", "form_without_method"), (f"len(list_filter(opens, lambda t: {attr('t', 'method')} not in ('', 'get', 'post', 'dialog'))) > 0", "form_odd_method"),
        (f"len(list_filter(asked, lambda t: {attr('t', 'name')} in ('', 'field', 'input', 'value', 'data', 'form', 'formfield', 'form_field'))) > 0", "fields_without_name"),
        (f"len(list_filter(asked, lambda t: starts_with(t, '<input') and ({attr('t', 'type')} in ('email', 'tel', 'url', 'password') or regexp_matches({attr('t', 'name')}, 'email|name|phone|address')) and {attr('t', 'autocomplete')} in ('', 'off'))) > 0", "fields_without_autocomplete"),
        ("list_contains(named, false)", "form_without_named_submit"),
        (f"len(forms) > 0 and len(list_filter(opens, lambda t: {attr('t', 'action')} <> '' and not regexp_matches({attr('t', 'action')}, '^(javascript:|#)') and {attr('t', 'method')} in ('get', 'post', 'dialog'))) = 0", "no_plain_form"),
        ("len(images) >= 3 and len(list_filter(images, lambda t: not contains(t, ' alt='))) / len(images) > 0.5", "images_without_alt"), (f"len(list_filter(buttons, lambda t: {text_of('t')} = '')) > 0", "controls_without_name"),
    )} as codes from g),
i as (select *, case when codes = '' then 0 else len(string_split(codes, ' ')) end as n from h)
select page_id, h1, landmarks, links, vague_links, dead_links, forms, greatest(4 - n, case when n = 0 then 4 else 1 end)::bigint as score, case when n = 0 then 'pass' when n <= 2 then 'partial' else 'fail' end as state, codes from i"""

_efficiency = f"""{PAGE},
e as (
  select *, len(list_filter({all_('head', 'link')}, lambda t: regexp_matches(t, 'rel="([^"]* )?stylesheet"') and {attr('t', 'media')} in ('', 'all'))) as sheets, len(list_filter({all_('b', 'img|video')}, lambda t: not regexp_matches(t, '\\swidth='))) as unsized,
    len(list_filter({all_('head', 'script')}, lambda t: {attr('t', 'src')} <> '' and not contains(t, 'defer=') and not contains(t, 'async='))) as scripts, regexp_extract_all(head, '<meta name="viewport" content="([^"]*)"', 1) as ports from d),
f as (
  select *, case when elapsed_ms <= 800 then 4 when elapsed_ms <= 2500 then 2 else 0 end as r, case when headers['etag'] is not null or headers['last-modified'] is not null then 4 when headers['cache-control'] is not null then 2 else 0 end as v,
    case when sheets <= 1 then 4 when sheets <= 3 then 2 else 0 end as s, case when unsized = 0 then 4 when unsized <= 3 then 2 else 0 end as u, case when scripts <= 1 then 4 when scripts <= 3 then 2 else 0 end as j, case when strlen(html) < 15728640 then 4 else 0 end as z,
    len(ports) = 0 as none, len(ports) > 1 as many, len(ports) > 0 and not contains(ports[1], 'width=device-width') as narrow, len(ports) > 0 and regexp_matches(ports[1], 'user-scalable=(no|0)|maximum-scale=(0|1(\\.0)?)(,|$)') as zoom from e),
g as (
  select page_id, sheets::bigint as stylesheets, unsized::bigint as unsized, scripts::bigint as scripts, (r + v + s + u + j + z + case when none then 0 when many or narrow or zoom then 2 else 4 end)::bigint as points,
    regexp_matches(b, '<picture|srcset=|sizes=|media="print"|@media') as responsive,
    {codes(("r < 4", "slow_response"), ("v < 4", "no_validator"), ("s < 4", "blocking_stylesheets"), ("u < 4", "unsized_media"), ("j < 4", "sync_scripts"), ("z < 4", "large_body"), ("none", "no_viewport"), ("many", "many_viewports"), ("narrow", "viewport_width"), ("zoom", "zoom_limited"))} as codes from f)
select page_id, stylesheets, unsized, scripts, points, responsive, round_even(points / 28 * 3, 0)::bigint as score, case when codes = '' then 'pass' when round_even(points / 28 * 3, 0) > 0 then 'partial' else 'warn' end as state, codes from g"""

_BOTS = "'googlebot', 'bingbot', 'duckduckbot', 'duckassistbot', 'googlebot-news', 'googlebot-image', 'googlebot-video', 'otherbot'"
_indexing = f"""{PAGE},
t as (select page_id, unnest(regexp_extract_all(head, '<meta name="(?:robots|googlebot|bingbot)" content="[^"]*"')) as t, unnest(range(99)) as k from d),
t2 as (select page_id, k, 'meta ' || {attr('t', 'name')} as label, string_split(lower({attr('t', 'content')}), ',') as parts from t where t is not null),
x as (select page_id, unnest(string_split(lower(headers['x-robots-tag']), ',')) as part from d where headers['x-robots-tag'] is not null),
x2 as (select page_id, regexp_replace(trim(regexp_replace(part, '\\s+', ' ', 'g')), '\\s*:\\s*', ':', 'g') as part from x),
s as (
  select page_id, k, label, regexp_replace(trim(regexp_replace(unnest(parts), '\\s+', ' ', 'g')), '\\s*:\\s*', ':', 'g') as dir from t2
  union all select page_id, case when split_part(part, ':', 1) in ({_BOTS}) then 200 else 100 end, 'X-Robots-Tag' || case when split_part(part, ':', 1) in ({_BOTS}) then ' ' || split_part(part, ':', 1) else '' end,
    case when split_part(part, ':', 1) in ({_BOTS}) then substr(part, instr(part, ':') + 1) else part end from x2),
l as (
  select page_id, k, label, bool_or(dir in ('noindex', 'none')) as blocking, bool_or(dir in ('nosnippet', 'noimageindex', 'max-snippet:0', 'max-image-preview:none', 'max-video-preview:0')) as snippets, bool_or(dir = 'max-image-preview:standard') as standard,
    bool_or(dir = 'max-image-preview:large') as large, bool_or(dir in ('nofollow', 'noarchive', 'notranslate')) as restricting, bool_or(starts_with(dir, 'unavailable_after:')) as gone from s where dir <> '' group by 1, 2, 3),
g as (
  select page_id, {', '.join(f"coalesce(string_agg(label, '; ' order by k, label) filter ({c}), '') as {c}" for c in ('blocking', 'snippets', 'standard', 'large'))},
    concat_ws('; ', string_agg(label, '; ' order by k, label) filter (restricting), string_agg(label, '; ' order by k, label) filter (gone)) as restricting from l group by 1),
j as (select d.page_id, {', '.join(f"coalesce({c}, '') as {c}" for c in ('blocking', 'snippets', 'standard', 'large', 'restricting'))}, len(regexp_extract_all(b, '\\sdata-nosnippet'))::bigint as nosnippets from d left join g using (page_id)),
r as (select *, (case when blocking <> '' then 0 when snippets <> '' or nosnippets > 0 then 2 when standard <> '' then 4 when restricting <> '' then 3 else 5 end)::bigint as score from j)
select *, case score when 5 then 'pass' when 0 then 'fail' else 'partial' end as state from r"""

#: Typed objects of JSON-LD: each script, through lists and @graph.
OBJECTS = f"""{PAGE.replace('with ', 'with recursive ', 1)},
sc as (select page_id, unnest(regexp_extract_all(m, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1)) as body from d),
js as (select page_id, body, try_cast(body as json) as v from sc),
w as (
  select page_id, v, 0 as depth from js where v is not null
  union all
  select page_id, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') when json_type(v) = 'OBJECT' and json_extract(v, '$."@graph"') is not null then [json_extract(v, '$."@graph"')] else [] end), depth + 1 from w where depth < 8),
o as (
  select page_id, v, case when json_type(json_extract(v, '$."@type"')) = 'ARRAY' then json_extract_string(v, '$."@type"[*]') else [json_extract_string(v, '$."@type"')] end as types, row_number() over () as k
  from w where json_type(v) = 'OBJECT' and json_extract(v, '$."@type"') is not null)"""
_REQUIRED = {"Organization": "name url", "Product": "name description offers", "Article": "headline author datePublished"}
_WANTED = {"Organization": "logo sameAs", "Product": "image brand", "Article": "dateModified image"}


def _lacks(v: str, f: str) -> str:
    return f"coalesce(trim(json_extract_string({v}, '$.{f}')) in ('', '[]'), true)"


def _missing(table: dict[str, str], prefix: str = "") -> str:
    return "case t " + " ".join(f"when '{t}' then list_filter([{', '.join(f'case when {_lacks(chr(118), f)} then {chr(39)}{prefix}{f}{chr(39)} end' for f in fields.split())}], lambda x: x is not null)" for t, fields in table.items()) + " else [] end"


_SHOP = "case t when 'Product' then list_filter([case when {0} then 'recommended sku' end, case when coalesce(json_extract_string(v, '$.gtin'), json_extract_string(v, '$.gtin13')) is null then 'recommended gtin' end, case when coalesce(json_extract_string(v, '$.aggregateRating'), json_extract_string(v, '$.review')) is null then 'recommended aggregateRating|review' end], lambda x: x is not null)".format(
    _lacks("v", "sku")
)


def _structured(shop: bool) -> str:
    offers = f"""
oa as (select k, unnest(case when json_type(json_extract(v, '$.offers')) = 'ARRAY' then json_extract(v, '$.offers[*]') else [json_extract(v, '$.offers')] end) as f, unnest(range(99)) as n from o where json_extract(v, '$.offers') is not null),
ob as (select k, n, list_filter([{', '.join(f"case when {_lacks('f', x)} then 'recommended offers.{x}' end" for x in ('price', 'priceCurrency', 'availability', 'priceValidUntil', 'shippingDetails', 'hasMerchantReturnPolicy'))}], lambda x: x is not null) as gaps from oa where f is not null),
oc as (select k, arg_min(gaps, len(gaps) * 100 + n) as gaps from ob group by 1)""" if shop else "\noc as (select 0 as k, []::varchar[] as gaps where false)"  # fmt: skip
    more = f"list_concat({_missing(_WANTED, 'recommended ')}, case when t = 'Product' then list_concat({_SHOP} else [] end, coalesce(gaps, [])) else [] end)" if shop else _missing(_WANTED, "recommended ")
    return f"""{OBJECTS},{offers},
ty as (select page_id, o.k, v, types, gaps, list_filter(types, lambda x: x in ('Organization', 'Product', 'Article'))[1] as t from o left join oc on oc.k = o.k),
a as (select page_id, k, coalesce(t, types[1]) as type, t is not null as known, {_missing(_REQUIRED)} as req, {more} as rec from ty),
r as (select *, case when not known then 2 else greatest(case when len(req) > 0 then 1 else 3 end, 5 - 2 * len(req) - least(2, len(rec))) end as points, {"(type in ('Product', 'Offer'))::int" if shop else '0'} as trade from a),
best as (select page_id, arg_max({{'type': type, 'known': known, 'missing': list_concat(req, rec), 'points': points}}, trade * 100000 + points * 1000 - k % 1000) as x, count(*) as n from r group by 1),
sp as (select page_id, bool_or(json_extract(v, '$.speakable') is not null) as speakable from o group by 1),
n as (select page_id, count(*) as scripts, count(*) filter (v is null) as invalid from js group by 1),
z as (select d.page_id, coalesce(scripts, 0)::bigint as scripts, coalesce(invalid, 0)::bigint as invalid, x, coalesce(best.n, 0) as n, coalesce(speakable, false) as speakable from d left join n using (page_id) left join best using (page_id) left join sp using (page_id)),
y as (select *, (case when scripts = 0 then 0 when n = 0 then case when invalid > 0 then 1 else 0 end when x.known then x.points else 2 end)::bigint as score from z)
select page_id, scripts, invalid, x.type as type, array_to_string(x.missing, ', ') as missing, speakable, score, case when n = 0 then 'fail' when score = 5 and len(x.missing) = 0 then 'pass' else 'partial' end as state,
  {codes(("scripts = 0", "no_schema"), ("scripts > 0 and n = 0", "invalid_json"), ("n > 0 and not x.known", "unknown_schema"), ("len(x.missing) > 0", "missing_fields"))} as codes from y"""


_canonical = f"""{PAGE},
c as (select page_id, url, nullif(regexp_extract(head, '<link rel="canonical" href="([^"]*)"', 1), '') as href from d),
t as (select page_id, url, {absolute('href')} as canonical from c)
select page_id, canonical, case when canonical is null then 'none' when regexp_replace({host('canonical')}, '^www\\.', '') <> regexp_replace({host('url')}, '^www\\.', '') or {host('url')} = '' then 'other_site'
  when regexp_replace(regexp_replace(canonical, '[?#].*$', ''), '/+$', '') <> regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') then 'other_page' else 'self' end as kind from t"""

_freshness = f"""{PAGE}
select page_id, len(list_filter({LINKS}, lambda a: regexp_matches(lower({attr('a', 'href')} || ' ' || {text_of('a')}), 'blog|news|resources|updates|changelog|articles|insights'))) > 0 as section, regexp_matches(b, '<time datetime="[0-9-]+"') as dated,
  case when contains(head, 'href="/feed.xml"') and {host('url')} <> '' then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || '/feed.xml' else '' end as feeds,
  len(list_filter({LINKS}, lambda a: regexp_matches(lower({attr('a', 'href')} || ' ' || {text_of('a')}), 'blog|news|resources|updates|changelog|articles|insights'))) > 0 or regexp_matches(b, '<time datetime="[0-9-]+"') as available from d"""

_alternates = f"""{PAGE} select page_id, regexp_replace(url, '/+$', '') || '/index.md' as text_url, false as linked from d"""

_trust = f"""{PAGE},
a as (select {host('url')} as host, url, unnest({LINKS}) as a from d),
h as (select host, url, a, {absolute(attr('a', 'href'))} as href from a),
t as (select host, ' ' || trim(regexp_replace(lower(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' ' || {text_of('a')}), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from h where regexp_replace({host('href')}, '^www\\.', '') = regexp_replace(host, '^www\\.', '') and host <> ''),
k as (select host, {', '.join(f"bool_or(regexp_matches(t, ' ({p}) ')) as {k}" for k, p in {
    'about': 'about|company|mission|team|our story|who we are', 'contact': 'contact|contact us|get in touch|locations?', 'privacy': 'privacy', 'terms': 'terms|terms of service|terms and conditions|legal',
    'support': 'support|help center|customer service|faqs?', 'returns': 'returns?|return policy|refunds?|exchanges?', 'shipping': 'shipping|delivery|fulfillment'}.items())} from t group by 1),
j as (select h.host, {', '.join(f"coalesce({k}, false) as {k}" for k in ('about', 'contact', 'privacy', 'terms', 'support', 'returns', 'shipping'))} from (select distinct {host('url')} as host from d where {host('url')} <> '') h left join k using (host))
select host, concat_ws(' ', {', '.join(f"case when {k} then '{k}' end" for k in ('about', 'contact', 'privacy', 'returns', 'shipping', 'support', 'terms'))}) as found,
  concat_ws(' ', {', '.join(f"case when not {k} then '{k}' end" for k in ('about', 'contact', 'privacy'))}) as missing_core, concat_ws(' ', {', '.join(f"case when not {k} then '{k}' end" for k in ('terms', 'support'))}) as missing_more,
  concat_ws(' ', {', '.join(f"case when not {k} then '{k}' end" for k in ('returns', 'shipping'))}) as missing_shop, about and contact and privacy as ok from j"""

_metadata = f"""{OBJECTS},
n as (select page_id, count(*) as tops from o group by 1), i as (select page_id, count(*) filter (v is null) as invalid from js group by 1),
c as (select d.*, tops, invalid, nullif(regexp_extract(head, '<link rel="canonical" href="([^"]*)"', 1), '') as href from d left join n using (page_id) left join i using (page_id)),
e as (
  select {host('url')} as host, title = '' as no_title, href is null as no_canonical, href is not null and regexp_replace({host(absolute('href'))}, '^www\\.', '') <> regexp_replace({host('url')}, '^www\\.', '') as off_site, tops is null as no_schema, coalesce(invalid, 0) > 0 as bad_schema,
    regexp_matches(head, '(?i)<meta name="(robots|googlebot|bingbot)" content="[^"]*(noindex|none)') as blocked, regexp_matches(head, '<meta name="(robots|googlebot|bingbot)"') or headers['x-robots-tag'] is not null as told,
    len(regexp_extract_all({visible('m')}, '[A-Za-z0-9][A-Za-z0-9''_-]*')) < 40 as thin, strlen(html) > 15728640 as large from c),
s as (select host, count(*) as pages, {', '.join(f"count(*) filter ({c}) as {c}" for c in ('no_title', 'no_canonical', 'off_site', 'no_schema', 'bad_schema', 'blocked', 'told', 'thin', 'large'))} from e where host <> '' group by 1),
z as (select *, {codes(*[(f"{c} > 0", c) for c in ('no_title', 'no_canonical', 'off_site', 'no_schema', 'bad_schema', 'blocked', 'thin', 'large')])} as codes from s)
select *, codes = '' as ok from z"""

_extraction = f"""{OBJECTS},
ty as (
  with recursive q as (select page_id, v, 0 as depth, body from js where v is not null
    union all select page_id, unnest(case json_type(v) when 'ARRAY' then json_extract(v, '$[*]') when 'OBJECT' then json_extract(v, '$.*') else [] end), depth + 1, body from q where depth < 30 and json_type(v) in ('ARRAY', 'OBJECT'))
  select page_id, list_sort(list_distinct(flatten(list(case when json_type(json_extract(v, '$."@type"')) = 'ARRAY' then json_extract_string(v, '$."@type"[*]') else [json_extract_string(v, '$."@type"')] end)))) as types
  from q where json_type(v) = 'OBJECT' and json_extract(v, '$."@type"') is not null group by 1),
i as (select page_id, count(*) filter (v is null) as invalid from js group by 1),
e as (
  select d.page_id, html, {visible(SHOWN)} as shown, len(regexp_extract_all(m, {HIDDEN}))::bigint as hidden_nodes,
    list_sum(list_transform(regexp_extract_all(b, '(?s)<(?:nav|footer)>.*?</(?:nav|footer)>'), lambda x: {words(text_of('x'))})) as chrome_, {words(text_of("regexp_replace(regexp_extract(b, '(?s)<article>.*</article>'), " + HIDDEN + ", ' ', 'g')"))} as main_,
    list_sum(list_transform(regexp_extract_all(m, '(?s)<(?:script)[^>]*>.*?</script>|<style>.*?</style>'), lambda x: strlen(x))) as script_bytes, coalesce(types, []) as types, coalesce(invalid, 0) as invalid from d left join ty using (page_id) left join i using (page_id)),
f as (select *, {words('shown')}::bigint as words, strlen(html) as hb from e),
g as (select *, least(main_, words)::bigint as main_words, coalesce(chrome_, 0) as chrome from f),
h as (
  select *, case when words = 0 then 1 else (words - main_words) / words end as boilerplate, case when words = 0 then 1 else chrome / words end as navigation, coalesce(script_bytes, 0) / hb as script_share, hb / greatest(strlen(shown), 1) as html_ratio,
    case when words = 0 then 'blocked_or_empty' when words >= 50 then 'readable' else 'thin' end as rendering from g)
select page_id, hidden_nodes, words, main_words, round(boilerplate, 6) as boilerplate, round(navigation, 6) as navigation, round(script_share, 6) as script_share, round(html_ratio, 6) as html_ratio, rendering, array_to_string(types, ' ') as schema_types,
  {codes(("words = 0", "no_text"), ("words > 0 and main_words < 80", "thin_main"), ("boilerplate > 0.65", "boilerplate"), ("navigation > 0.45", "navigation"), ("script_share > 0.5", "scripts"), ("html_ratio > 40", "html_ratio"), ("rendering <> 'readable'", "rendering"), ("len(types) = 0 and invalid = 0", "no_schema"), ("invalid > 0", "bad_schema"))} as codes,
  {codes(("hidden_nodes > 0", "hidden_nodes"))} as caveats from h"""

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+(?:[''-][a-z0-9]+)?'), lambda t: length(t) > 1 and t not in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'our', 'that', 'the', 'this', 'to', 'we', 'with', 'you', 'your')))"
_NORMAL = "array_to_string(regexp_extract_all(translate(lower({0}), '-''', '  '), '[a-z0-9]+'), ' ')"
_YEAR = "list_max(list_transform(regexp_extract_all(coalesce({0}, ''), '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda y: y::int))"


def plain(u: str) -> str:
    """Host and path of http(s) urls without ports, as the tables have none."""
    path = f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"case when regexp_matches({u}, '(?i)^https?://[^/?#]') then lower(regexp_extract({u}, '^([A-Za-z]+):', 1)) || '://' || {host(u)} || case when {path} = '' then '/' else {path} end end"


def _far(c: str) -> str:
    return f"({_NORMAL.format('description')} <> {_NORMAL.format(c)} and len(lt) >= 5 and len({_TOKENS.format(c)}) >= 5 and len(list_intersect(lt, {_TOKENS.format(c)})) / len(lt) < 0.3)"


#: The article's text without its forms; every page of the tables has an article.
_MAIN = text_of("regexp_replace(regexp_extract(b, '(?s)<article>(.*?)</article>', 1), '(?s)<form.*?</form>', ' ', 'g')")
_blurbs = f"""{PAGE},
c as (
  select {host('url')} as host, url, nullif(title, '') as title, {meta('name', 'description')} as description, nullif({text_of("regexp_extract(b, '(?s)<h1>(.*?)</h1>', 1)")}, '') as h1, {_MAIN} as main, nullif(regexp_extract(head, '<link rel="canonical" href="([^"]*)"', 1), '') as href,
    {meta('property', 'og:description')} as og, {meta('name', 'twitter:description')} as tw from d),
e as (select *, {absolute('href')} as canonical, concat_ws(' ', title, h1, main) as told from c where host <> ''),
t as (select *, {plain('canonical')} as target, {plain('url')} as own, {_TOKENS.format('description')} as lt, {_TOKENS.format('told')} as rt, {_YEAR.format('told')} as seen from e),
one as (
  select host, count(*) as pages, count(*) filter (title is null) as no_title, count(*) filter (description is null) as no_description, count(*) filter (h1 is null) as no_h1, count(*) filter (canonical is null) as no_canonical, count(*) filter (main = '') as no_main,
    count(*) filter (length(description) < 50) as short, count(*) filter (length(description) > 200) as long, count(*) filter (regexp_matches(lower(description), 'lorem ipsum|description goes here|coming soon|all rights reserved|we use cookies')) as placeholder,
    count(*) filter (canonical is not null and target is null) as bad_canonical, count(*) filter (target is not null and {host('canonical')} <> host) as off_host, count(*) filter (target is not null and {host('canonical')} = host and target <> own) as not_self,
    count(*) filter (len(lt) >= 5 and len(rt) >= 12 and len(list_intersect(lt, rt)) / len(lt) < 0.2) as low_overlap,
    count(*) filter (coalesce({_YEAR.format('description')} < seen, false) or coalesce({_YEAR.format('og')} < seen, false) or coalesce({_YEAR.format('tw')} < seen, false)) as stale_year,
    sum(coalesce({_far('og')}, false)::bigint + coalesce({_far('tw')}, false)::bigint)::bigint as social_differs from t group by 1),
sd as (select host, sum(n)::bigint as n from (select host, count(*) as n from t where {_NORMAL.format('description')} <> '' group by host, {_NORMAL.format('description')} having count(*) > 1) group by 1),
st as (select host, sum(n)::bigint as n from (select host, count(*) as n from t where {_NORMAL.format('title')} <> '' group by host, {_NORMAL.format('title')} having count(*) > 1) group by 1),
co as (select host, sum(n)::bigint as n from (select host, count(distinct own) as n from t where target is not null and own is not null group by host, target having count(distinct own) > 1) group by 1)
select one.*, coalesce(sd.n, 0) as same_description, coalesce(st.n, 0) as same_title, coalesce(co.n, 0) as collisions from one left join sd using (host) left join st using (host) left join co using (host)"""

_ALIGN_TOKENS = "list_distinct(list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda t: length(t) > 2 and t not in ('about', 'and', 'are', 'for', 'from', 'home', 'into', 'official', 'our', 'that', 'the', 'this', 'with', 'your')))"


def _align(a: str, b: str) -> str:
    x, y = f"lower(trim({a}))", f"lower(trim({b}))"
    s, t = _ALIGN_TOKENS.format(x), _ALIGN_TOKENS.format(y)
    return f"({x} <> '' and {y} <> '' and ({x} = {y} or least(length({x}), length({y})) >= 4 and (contains({x}, {y}) or contains({y}, {x})) or len({s}) > 0 and len({t}) > 0 and len(list_intersect({s}, {t})) / least(len({s}), len({t})) >= 0.5))"


def _on(c: str) -> str:
    kinds = {
        "Instagram": "instagram\\.com/[\\w.-]+", "TikTok": "tiktok\\.com/@[\\w.-]+", "Facebook": "facebook\\.com/[\\w.-]+", "X/Twitter": "(twitter\\.com|x\\.com)/[\\w.-]+", "YouTube": "youtube\\.com/(channel/|c/|user/|@)[\\w.-]+",
        "LinkedIn": "linkedin\\.com/company/", "Pinterest": "pinterest\\.com/[\\w.-]+", "Reddit": "reddit\\.com/(r|user)/", "Medium": "medium\\.com/@?[\\w-]+", "Substack": "[\\w-]+\\.substack\\.com",
    }
    return "list_filter([" + ", ".join(f"case when len(list_filter({c}, lambda u: regexp_matches(u, '(?i){p}'))) > 0 then '{k}' end" for k, p in kinds.items()) + "], lambda x: x is not null)"


_entities = f"""{OBJECTS},
en as (
  select page_id, list(json_extract_string(v, '$.name')) filter (json_extract_string(v, '$.name') is not null) as named, list(json_extract_string(v, '$.headline')) filter (json_extract_string(v, '$.name') is null and json_extract_string(v, '$.headline') is not null) as headed,
    flatten(list(json_extract_string(v, '$.sameAs[*]'))) as same, count(*) filter (coalesce(json_extract_string(v, '$.logo.url'), '') <> '' or coalesce(json_extract_string(v, '$.image[0]'), '') <> '') as images
  from o where len(list_filter(types, lambda t: t in ('Article', 'LocalBusiness', 'Organization', 'Product', 'SoftwareApplication', 'WebSite'))) > 0 group by 1),
c as (
  select d.page_id, url, nullif(title, '') as title, {meta('name', 'description')} as description, nullif(regexp_extract(head, '<link rel="canonical" href="([^"]*)"', 1), '') as href, {meta('property', 'og:title')} as og_title, {meta('property', 'og:description')} as og_description,
    {meta('property', 'og:url')} as og_url, {meta('property', 'og:site_name')} as og_site, {meta('property', 'og:image')} as og_image, {meta('name', 'twitter:title')} as t_title, {meta('name', 'twitter:card')} as t_card, {meta('name', 'twitter:image')} as t_image,
    list_concat(coalesce(named, []), coalesce(headed, [])) as names, coalesce(same, []) as same, coalesce(images, 0) as images, list_transform({LINKS}, lambda a: {attr('a', 'href')}) as links from d left join en using (page_id)),
e as (select *, regexp_matches(url, '(?i)^https?://[^/?#]') as ok, {absolute('href')} as canonical, {_on('links')} as linked, {_on('same')} as mirrored, list_filter([og_site, og_title, title], lambda x: x is not null) as told from c),
f as (
  select *, case when ok and og_url is not null then 1 end as has_og_url, len(list_filter(names, lambda x: len(list_filter(told, lambda y: {_align('x', 'y')})) > 0)) > 0 as entity, len(list_intersect(linked, mirrored)) > 0 as overlap,
    ok and og_image is not null or t_image is not null as pictured, coalesce(t_card, t_title, t_image) is not null as card from e),
g as (
  select page_id, {_on('list_concat(links, same)')} as platforms, {codes(
    ("og_title is not null and title is not null and not " + _align('og_title', 'title'), "og_title_differs"), ("og_title is null or title is null", "no_og_title"), ("og_description is not null and description is not null and not " + _align('og_description', 'description'), "og_description_differs"),
    ("og_description is null or description is null", "no_og_description"), ("has_og_url is null", "no_og_url"), ("t_title is not null and og_title is not null and not " + _align('t_title', 'og_title'), "twitter_title_differs"), ("not card", "no_twitter_card"),
    ("not pictured", "no_social_image"), ("images = 0", "no_schema_image"), ("len(names) > 0 and not entity", "schema_name_differs"), ("len(names) = 0", "no_schema_name"), ("len(linked) > 0 and len(mirrored) > 0 and not overlap", "profiles_differ"),
    ("len(linked) > 0 and len(mirrored) = 0", "profiles_not_in_schema"), ("len(linked) = 0 and len(mirrored) = 0", "no_profiles"))} as codes, {codes(
    ("og_title is not null and title is not null and " + _align('og_title', 'title'), "og_title"), ("og_description is not null and description is not null and " + _align('og_description', 'description'), "og_description"), ("has_og_url = 1", "og_url"), ("card", "twitter_card"),
    ("pictured", "social_image"), ("images > 0", "schema_image"), ("entity", "schema_name"), ("overlap", "profiles_match"), ("len(linked) = 0 and len(mirrored) > 0", "profiles_in_schema"))} as positives from f),
h as (select *, (case when len(platforms) >= 3 and codes = '' then 2 when len(platforms) > 0 or len(string_split(positives, ' ')) >= 3 and positives <> '' then 1 else 0 end)::bigint as score from g)
select page_id, array_to_string(platforms, ', ') as platforms, score, case score when 2 then 'pass' when 1 then 'partial' else 'warn' end as state, codes, positives from h"""

_brands = f"""{OBJECTS},
n as (select page_id, list(json_extract_string(v, '$.name') order by k) filter (json_type(json_extract(v, '$."@type"')) = 'VARCHAR' and types[1] in ('Organization', 'LocalBusiness', 'WebSite')) as named from o group by 1),
c as (
  select d.page_id, list_concat([{meta('property', 'og:site_name')}], coalesce(named, []), [nullif(trim(split_part(split_part(title, '|', 1), ' - ', 1)), ''), nullif(coalesce(list_filter(string_split({host('url')}, '.'), lambda p: p not in ('www', 'com', 'net', 'org', 'io', 'co'))[1], {host('url')}), '')]) as names
  from d left join n using (page_id)),
f as (select page_id, list_filter(names, lambda x: coalesce(trim(x) <> '', false)) as names from c),
g as (select page_id, list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i) as names from f)
select page_id, array_to_string(names[1:4], ' | ') as names from g"""
_hints = f"""{PAGE} select page_id, {codes(("contains(head, 'type=\"application/rss+xml\"')", "content_feed"))} as hints from d"""
_reach = f"""{PAGE},
a as (select page_id, url, unnest(list_concat({LINKS}, regexp_extract_all(head, '<link [^>]*href="[^"]*"[^>]*>'))) as a from d),
h as (select page_id, url, {absolute(attr('a', 'href'))} as href from a where {attr('a', 'href')} <> ''),
q as (select page_id, regexp_replace(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path from h where {host('href')} = {host('url')})
select distinct page_id, path from q where path in ('/blog', '/about', '/contact', '/privacy', '/returns', '/feed.xml', '/a.css')"""

_in_sql = f"""{PAGE}, f as (select page_id, unnest(regexp_extract_all(b, '(?s)<form.*?</form>')) as f from d),
i as (select page_id, f, regexp_extract_all(f, '<input[^>]*>') as i, len(regexp_extract_all(f, '<(?:select|textarea)[\\s>]')) as others, len(regexp_extract_all(f, '<button[\\s>]')) as buttons from f)
select page_id, count(*) as forms, sum(others + len(list_filter(i, lambda x: not regexp_matches(x, 'type="(hidden|submit|button|reset|image)"'))))::bigint as fields, sum(buttons + len(list_filter(i, lambda x: regexp_matches(x, 'type="(submit|image)"'))))::bigint as submits from i group by 1"""
SQL = {
    "sql_structure": f"select page_id, h1, landmarks, links, forms from ({_structure})", "sql_form_fields": _in_sql, "sql_schema_types": f"{OBJECTS} select page_id, type, count(*) as objects from (select page_id, unnest(types) as type from o) group by 1, 2",
    "brand_names": _brands, "surface_hints": _hints, "surface_reach": _reach,
    "blurb_issues": _blurbs, "entity_coherence": _entities,
    "html_structure": _structure, "crawl_efficiency": _efficiency, "indexing_directives": _indexing, "structured_data": _structured(False), "structured_data_shop": _structured(True), "canonical_links": _canonical, "freshness_signals": _freshness,
    "text_alternates": _alternates, "trust_pages": _trust, "sampled_metadata": _metadata, "extraction_readiness": _extraction,
}
