"""DuckDB SQL for the registered queries, written apart from their DataFrame form."""

from __future__ import annotations

from sitegauge.sources import page_relations
from sitegauge.sources.evidence import PAGES_SQL
from sitegauge.sources.fixtures import with_relations

from . import evidence_oracles, fetch_oracles, page_oracles

# Fixed values, said here again so that the SQL does not lean on the operators.
APP_SHELL = ('__NEXT_DATA__', 'data-reactroot', 'ng-version', '/@vite/', '__NUXT__')
CHROME = ('nav', 'header', 'footer', 'aside')
ENTITIES = (('&nbsp;', ' '), ('&copy;', '©'), ('&middot;', '·'), ('&lt;', '<'), ('&gt;', '>'), ('&quot;', '"'), ('&#39;', "'"), ('&amp;', '&'))
HIDDEN = ('script', 'style', 'head', 'noscript', 'template', 'svg')
MAIN = ('main', 'article')
SEMVER = '^[0-9]+\\.[0-9]+(\\.[0-9]+)?([\\-+][0-9A-Za-z.\\-]+)?$'
COMPARED = ('product_name', 'price', 'availability', 'sku_or_gtin')
DNS_TOKENS = ('agent', 'mcp', 'a2a', 'aid')
JSON_SURFACES = ('API description', 'API catalog', 'ARD catalog', 'OAuth authorization metadata', 'OAuth protected resource metadata', 'Web Bot Auth directory', 'MCP server card', 'A2A agent card', 'Agent skills', 'WebMCP manifest', 'catalog JSON')
OCTET = '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])'
PRIVATE = '^(0|10|127)\\.|^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^192\\.168\\.|^192\\.0\\.[02]\\.|^198\\.(1[89]|51\\.100)\\.|^203\\.0\\.113\\.|^(22[4-9]|2[34][0-9]|25[0-5])\\.'
SOCIAL = {'Instagram': 'instagram\\.com/[\\w.\\-]+', 'TikTok': 'tiktok\\.com/@[\\w.\\-]+', 'Facebook': 'facebook\\.com/[\\w.\\-]+', 'X/Twitter': '(twitter\\.com|x\\.com)/[\\w.\\-]+', 'YouTube': 'youtube\\.com/(channel/|c/|user/|@)[\\w.\\-]+', 'LinkedIn': 'linkedin\\.com/company/', 'Pinterest': 'pinterest\\.com/[\\w.\\-]+', 'Reddit': 'reddit\\.com/(r|user)/', 'Medium': 'medium\\.com/@?[\\w\\-]+', 'Substack': '[\\w\\-]+\\.substack\\.com'}
TRUST = {'about': 'about|company|mission|team|our story|who we are', 'contact': 'contact|contact us|get in touch|locations?', 'privacy': 'privacy', 'terms': 'terms|terms of service|terms and conditions|legal', 'support': 'support|help center|customer service|faqs?', 'returns': 'returns?|return policy|refunds?|exchanges?', 'shipping': 'shipping|delivery|fulfillment'}
SIGNALS = ('ai-input', 'ai-train', 'search', 'tdm-reservation')
NO_FIELD = ("hidden", "submit", "button", "reset", "image")
GENERIC_NAMES = ("", "field", "input", "value", "data", "form", "formfield", "form_field")
PURPOSES = "address|city|company|country|email|family-name|first-name|given-name|last-name|name|organization|phone|postal|tel|username|zip"
PLACEHOLDERS = "\\blorem ipsum\\b|\\b(?:meta )?description (?:goes|comes) here\\b|\\b(?:insert|add|write) (?:a |your )?description\\b|\\bcoming soon\\b|^welcome to (?:our|my|the) (?:website|site)[.!]?$|\\ball rights reserved\\b|\\bwe use cookies\\b"
BOILERPLATE = ("all rights reserved", "we use cookies", "lorem ipsum", "coming soon")
STOPWORDS = "a an and are as at be by for from in is it of on or our that the this to we with you your".split()

GAP = "[ \\t\\n\\r\\f]+"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _element(tag: str, inner: bool = False) -> str:
    return f"(?is)<{tag}(?:\\s[^>]*)?>{'(.*?)' if inner else '.*?'}</{tag}\\s*>"


def _visible(e: str) -> str:
    e = f"regexp_replace({e}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in HIDDEN:
        e = f"regexp_replace({e}, '{_element(tag)}', ' ', 'g')"
    e = f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in ENTITIES:
        e = f"replace({e}, '{_q(name)}', '{_q(char)}')"
    return f"trim(regexp_replace({e}, '{GAP}', ' ', 'g'))"


def _words(e: str) -> str:
    return f"(case when {e} = '' then 0 else len(string_split({e}, ' ')) end)::bigint"


def _each(e: str, tag: str, value: str) -> str:
    return f"list_transform(regexp_extract_all({e}, '{_element(tag, True)}', 1), lambda p: {value})"


BODY = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def _key(u: str) -> str:
    return f"({HOST.replace('url', u)} || regexp_replace({PATH.replace('url', u)}, '/+$', ''))"


def _chromeless() -> str:
    e = BODY
    for tag in CHROME:
        e = f"regexp_replace({e}, '{_element(tag)}', ' ', 'g')"
    return e


_main = "greatest(" + ", ".join(f"list_max({_each(BODY, t, _words(_visible('p')))})" for t in MAIN) + ")"
_shell = " or ".join(
    ["len(regexp_extract_all(html, '(?i)<script\\s[^>]*src=')) >= 5", "regexp_matches(html, '(?i)<[a-z][^>]*\\sid=[\"'']?(root|app|__next|__nuxt|svelte)[\"'' >]')", *(f"contains(html[1:20000], '{m}')" for m in APP_SHELL)]
)
METRICS = f"""
with t as (select page_id, coalesce(html, '') as html, {_visible("coalesce(html, '')")} as txt from pages),
m as (
  select page_id, {_words('txt')} as visible_words, strlen(html)::bigint as html_bytes, strlen(txt)::bigint as text_bytes,
    coalesce({_main}, {_words(_visible(_chromeless()))}) as main,
    ({' + '.join(f"coalesce(list_sum({_each(BODY, t, _words(_visible('p')))}), 0)" for t in CHROME)})::bigint as chrome_words,
    ({' + '.join(f"coalesce(list_sum(list_transform(regexp_extract_all(html, '{_element(t)}'), lambda p: strlen(p))), 0)" for t in ('script', 'style'))})::bigint as script_style_bytes,
    ({_shell}) as app_shell from t),
r as (
  select *, least(main, visible_words) as main_words,
    case when visible_words < 50 and app_shell then 'probable_js_shell' when visible_words = 0 then 'blocked_or_empty' when visible_words >= 50 then 'readable' else 'thin' end as rendering from m)
"""
RAW = {
    "ssr_readability": METRICS
    + """, i as (
  select *, ((main_words < 80)::int + (case when visible_words = 0 then 1 else ((visible_words - main_words) / visible_words > 0.65)::int end)
    + (case when visible_words = 0 then 1 else (chrome_words / visible_words > 0.45)::int end) + (html_bytes > 0 and script_style_bytes / html_bytes > 0.5)::int
    + (html_bytes / greatest(text_bytes, 1) > 40)::int)::bigint as issues from r),
s as (
  select *, (case rendering when 'readable' then case when issues = 0 then 4 when issues < 3 then 3 else 2 end when 'thin' then case when issues < 3 then 2 else 1 end else 0 end)::bigint as score from i)
select page_id, rendering, visible_words, main_words, issues, case score when 4 then 'pass' when 0 then 'fail' else 'partial' end as state, score from s""",
    "extraction_efficiency": METRICS + "select page_id, visible_words, html_bytes, text_bytes, chrome_words, script_style_bytes, main_words, rendering from r",
    "homepages": f"select {HOST} as host, min(page_id) as page_id, arg_min(url, page_id) as url, count(*) as pages from pages where page_id is not null and {HOST} <> '' group by 1",
    "sitemap_hygiene": f"""
with k as (select {HOST} as host, {_key('url')} as key, count(*) as n, count(*) filter (lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) <> 'https') as plain from pages where {HOST} <> '' group by 1, 2)
select host, sum(n)::bigint as entries, count(*) as page_keys, sum(plain)::bigint as non_https, sum(n - 1)::bigint as repeated, max(n) as most_of_one_key from k group by 1""",
    "duplicate_titles": f"""
with t as (select {HOST} as host, lower(trim(regexp_replace(regexp_extract(html, '{_element('title', True)}', 1), '{GAP}', ' ', 'g'))) as title, page_id from pages)
select host, title, count(*) as pages, min(page_id) as first_page from t where title <> '' group by 1, 2 having count(*) > 1""",
    "language_path_mismatch": f"""
with t as (select lower(regexp_extract(html, '(?i)<html[^>]*\\slang=["'']?([A-Za-z-]+)', 1)) as declared, lower(regexp_extract({PATH}, '^/([A-Za-z]{{2}})(?:/|$)', 1)) as in_path from pages)
select declared, in_path, count(*) as pages, (declared <> in_path)::bigint as mismatch from t group by 1, 2""",
    "host_top_pages": METRICS
    + f""", h as (select {HOST} as host, page_id, main_words, row_number() over (partition by {HOST} order by main_words desc, page_id) as place from r join pages using (page_id))
select host, place, page_id, main_words from h where place <= 3""",
    "markdown_body_quality": """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')[1:6000] as t from documents),
c as (
  select doc_id, t, len(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9''_-]*'))::bigint as words, length(t)::bigint as chars, regexp_matches(lower(t), '^(<!doctype html|<html)') as is_html,
    starts_with(t, '#') or regexp_matches(t, '\\[[^\\]]+\\]\\([^)]+\\)') or regexp_matches(t, '(?m)^[-*]\\s+\\S') or regexp_matches(t, '(?m)^```') or regexp_matches(t, '(?m)^\\|.+\\|$') as marks from t),
m as (select *, not is_html and (words >= 30 or chars >= 200) as meaningful from c)
select doc_id, words, chars, is_html, marks and not is_html as structured, meaningful, chars < 80 or not meaningful and not is_html as too_short from m""",
    "opening_token_coverage": f"""
with t as (select doc_id, split_part(text, chr(10), 1) as l, substr(text, instr(text, chr(10)) + 1) as r from documents where contains(text, chr(10))),
k as (select doc_id, {', '.join(f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+(?:[''-][a-z0-9]+)?'), lambda t: length(t) > 1 and t not in ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in STOPWORDS)}))) as {c}" for c in ('l', 'r'))} from t),
c as (select doc_id, len(l)::bigint as left_tokens, len(r)::bigint as right_tokens, case when len(l) >= 5 and len(r) >= 12 then round(len(list_intersect(l, r)) / len(l), 6) end as coverage from k)
select *, coverage < 0.2 as low from c""",
    "text_flags_by_source": f"""
with t as (select source, lower(coalesce(text, '')) as t from documents),
c as (select source, ({' or '.join(f"contains(t, '{p}')" for p in BOILERPLATE)}) as phrase, list_max(list_transform(regexp_extract_all(t, '(?:^|[^0-9a-z])((?:19|20)[0-9]{{2}})(?:[^0-9a-z]|$)', 1), lambda y: y::bigint)) as y from t)
select source, count(*) as texts, count(*) filter (phrase) as boilerplate, count(y) as dated, max(y) as latest from c group by 1""",
    "rate_window_admission": """
select user_id as client, time_bucket(interval '1 minute', ts) as minute, least(count(*), 3)::bigint as admitted, greatest(count(*) - 3, 0)::bigint as rejected from events group by 1, 2""",
    "rate_window_rows": """
select event_id, user_id, k from (select event_id, user_id, row_number() over (partition by user_id, time_bucket(interval '1 minute', ts) order by ts, event_id) as k from events) where k <= 3""",
    "entity_cache_upsert": """
select user_id, event_type, event_id, round(value, 6) as value, writes from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k, count(*) over (partition by user_id, event_type) as writes from events) where k = 1""",
    "stored_upsert": """
select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, round(arg_max(value, (ts, event_id)), 6) as value from events group by 1, 2""",
    "ttl_cache_hits": """
with recursive e as (select user_id, event_type, epoch_us(ts) as t from events where ts is not null),
w as (
  select user_id, event_type, min(t) as t from e group by 1, 2
  union all
  select user_id, event_type, (select min(e.t) from e where e.user_id = w.user_id and e.event_type = w.event_type and e.t >= w.t + 30 * 86400000000) from w where t is not null)
select event_type, count(*) as lookups, count(*) - (select count(*) from w where w.event_type = e.event_type and t is not null) as hits from e group by 1""",
}

_HOME = "home as (select min(page_id) as page_id, arg_min(url, page_id) as url, arg_min(coalesce(html, ''), page_id) as html from pages where page_id is not null and " + HOST + " <> '' group by " + HOST + ")"


def _at_home(sql: str) -> str:
    """SQL of a page check over each host's homepage, without a response."""
    return sql.replace(PAGES_SQL, _HOME + ", evidence as (select page_id, url, html, 0::bigint as elapsed_ms, map([]::varchar[], []::varchar[]) as headers from home)")


RAW["site_audit"] = f"""
with home as ({RAW['homepages']}), ssr as ({RAW['ssr_readability']}), html as ({_at_home(page_oracles.SQL['html_structure'])}), ld as ({_at_home(page_oracles.SQL['structured_data'])}), ix as ({_at_home(page_oracles.SQL['indexing_directives'])}),
so as ({_at_home(page_oracles.SQL['entity_coherence'])}),
p as (
  select host, ssr.score + html.score + ld.score + ix.score + so.score as overall, 8::bigint as unknown_checks, round_even((ssr.score + html.score + ld.score + ix.score + so.score) / 20 * 100, 0)::bigint as percent
  from home join ssr using (page_id) join html using (page_id) join ld using (page_id) join ix using (page_id) join so using (page_id))
select host, overall, unknown_checks, percent, round_even((select count(*) from p q where q.percent <= p.percent) / (select count(*) from p) * 100, 0)::bigint as percentile from p"""

_SHORT = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*([?][^#]+)', 1)"
RAW["metric_labels"] = (
    METRICS
    + f""", z as (select page_id, url, html_bytes, case when visible_words = 0 then 1 else (visible_words - main_words) / visible_words end as b, html_bytes / greatest(text_bytes, 1) as h from r join pages using (page_id))
select page_id, round_even(b * 100, 0)::bigint || '%' as boilerplate, round_even(h, 0)::bigint || ':1' as html_text, case when html_bytes >= 1048576 then printf('%.1f MB', html_bytes / 1048576) when html_bytes >= 1024 then printf('%.1f KB', html_bytes / 1024) else html_bytes || ' B' end as bytes,
  case when regexp_matches(url, '^[A-Za-z]+://[^/?#]') then {_SHORT} else url end as shown, case when regexp_matches(url, '^[A-Za-z]+://[^/?#]') then regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/robots.txt' end as robots from z"""
)

LINES = """
with split as (select site_id, regexp_split_to_array(body, '\\r\\n|\\n|\\r') as l from robots),
raw as (select site_id, unnest(l) as raw, unnest(range(len(l))) as line_no from split),
ln as (select *, trim(split_part(raw, '#', 1)) as line from raw),
lines as (select *, contains(line, ':') as has_key, case when contains(line, ':') then lower(trim(split_part(line, ':', 1))) end as key,
  case when contains(line, ':') then trim(substr(line, instr(line, ':') + 1)) end as value from ln)
"""
GROUPS = (
    LINES
    + """, rel as (select *, key = 'user-agent' and coalesce(lag(key) over (partition by site_id order by line_no), 'allow') <> 'user-agent' as begins from lines where key in ('user-agent', 'allow', 'disallow')),
num as (select *, sum(begins::int) over (partition by site_id order by line_no) as group_id from rel),
grp as (
  select site_id, group_id::bigint as group_id, coalesce(list(lower(value) order by line_no) filter (key = 'user-agent'), []) as agents,
    coalesce(list(key || case when value = '' then ':' else ':' || lower(value) end order by line_no) filter (key <> 'user-agent'), []) as rules from num where group_id > 0 group by 1, 2)
"""
)
ACCESS = (
    GROUPS
    + """, kinds as (select *, case when raw = '' then 'blank' when key = 'user-agent' then 'agent' when key in ('allow', 'disallow') then 'rule' end as kind from lines),
k2 as (select *, kind = 'agent' and coalesce(lag(kind) over (partition by site_id order by line_no), 'blank') <> 'agent' as begins,
  last_value(case when kind <> 'rule' then kind end ignore nulls) over (partition by site_id order by line_no) as last_kind from kinds where kind is not null),
k3 as (select *, sum(begins::int) over (partition by site_id order by line_no) as entry from k2),
ent as (
  select site_id, entry, list(distinct lower(value)) filter (kind = 'agent') as agents,
    arg_min(key = 'allow' or value = '', line_no) filter (kind = 'rule' and value in ('*', '', '/')) as allowed
  from k3 where kind = 'agent' or kind = 'rule' and last_kind = 'agent' group by 1, 2 having count(*) filter (kind = 'rule') > 0),
sites as (select site_id, bot, purpose from robots, crawler where scored and trim(body) <> ''),
acc as (
  select s.site_id, bot, purpose,
    exists (select 1 from grp g where g.site_id = s.site_id and list_contains(agents, lower(bot))) as exact, exists (select 1 from grp g where g.site_id = s.site_id and list_contains(agents, '*')) as wild,
    (select arg_min({'a': allowed}, entry) from ent e where e.site_id = s.site_id and not list_contains(agents, '*') and len(list_filter(agents, lambda a: contains(lower(bot), a))) > 0) as own,
    (select arg_min({'a': allowed}, entry) from ent e where e.site_id = s.site_id and list_contains(agents, '*')) as other from sites s),
matrix as (
  select site_id, bot, purpose, case when exact or wild then (case when exact then 'explicit' else 'wildcard' end) || case when coalesce(case when own is not null then own.a else other.a end, true) then '_allowed' else '_blocked' end
    else 'not_mentioned' end as access from acc)
"""
)
DIRECTIVES = """
with p as (select site_id, unnest(string_split(lower(value), ',')) as d from x_robots),
q as (select site_id, regexp_replace(trim(regexp_replace(d, '\\s+', ' ', 'g')), '\\s*:\\s*', ':', 'g') as d from p),
r as (select *, regexp_matches(d, '^(googlebot|bingbot|duckduckbot|duckassistbot|googlebot-news|googlebot-image|googlebot-video|otherbot):.') as scoped from q where d <> ''),
directive as (select site_id, case when scoped then split_part(d, ':', 1) end as crawler, case when scoped then substr(d, instr(d, ':') + 1) else d end as directive from r)
"""
BOTS = """
with last as (select * from (select *, row_number() over (partition by site_id, bot order by attempt desc) as k from bot_fetch) where k = 1),
b as (
  select l.site_id, l.bot, case when l.status is null then 'error' when l.status in (401, 403, 429, 503) then 'HTTP ' || l.status when contains(lower(l.title), 'captcha') and not coalesce(contains(lower(o.title), 'captcha'), false) then 'challenge'
    when o.words >= 80 and l.words < greatest(20, o.words * 0.25) then 'thin' end as reason
  from last l left join last o on o.site_id = l.site_id and o.bot = 'browser' where l.bot <> 'browser')
"""
EVIDENCE = """evidence as (
  select site_id, sum(score)::bigint as earned, sum(max_score)::bigint as most, round_even(sum(score) / sum(max_score) * 100, 0)::bigint as percent
  from check_row join rubric using (check_name) where state <> 'locked' and evidence <> 'unknown' group by 1)"""
PEER = """peers as (select name, grp, size, sum(score)::bigint as points, sum(max_score)::bigint as most, round_even(sum(score) / sum(max_score) * 100, 0)::bigint as percent from peer join rubric using (check_name) group by 1, 2, 3)"""
EFFORT = "(case effort when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 2 end)"
DIMS = ("protocols", "account_auth", "ecommerce")
SCOPES = f"""
with g as (select site_id, split_part(o, '=', 1) as key, split_part(o, '=', 2) = 'true' as on_ from (select site_id, unnest(string_split(overrides, ' ')) as o from scope_request where overrides <> '')),
k as (select g.*, dimension, o.key is null as unknown from g left join override_key o on o.key = g.key),
p as (
  select site_id, bool_or(unknown) as bad, {', '.join(f"bool_or(on_) filter (key = '{d}') as set_{d}, coalesce(bool_or(on_) filter (dimension = '{d}' and key <> '{d}'), false) as by_{d}" for d in DIMS)},
    coalesce(list(key) filter (on_ and key not in ('protocols', 'account_auth', 'ecommerce')), []) as plus, coalesce(list(key) filter (not on_), []) as minus from k group by 1)
select r.site_id, r.preset, s.protocols is not null and not coalesce(bad, false) as valid, {', '.join(f"coalesce(set_{d}, s.{d} or coalesce(by_{d}, false)) as {d}" for d in DIMS)},
  array_to_string(list_sort(list_filter(list_distinct(list_concat(string_split(s.families, ' '), coalesce(plus, []))), lambda f: f <> '' and not list_contains(coalesce(minus, []), f))), ' ') as families
from scope_request r left join preset s using (preset) left join p using (site_id)"""
LD = """
with recursive j as (
  select site_id, script_no, try_cast(body as json) as v, 0 as d from json_ld
  union all
  select site_id, script_no, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') when json_type(v) = 'OBJECT' and json_extract(v, '$."@graph"') is not null then [json_extract(v, '$."@graph"')] else [] end), d + 1 from j where d < 6),
node as (select row_number() over () as node, site_id, script_no, v, json_extract(v, '$."@type"') as t from j where json_type(v) = 'OBJECT' and json_extract(v, '$."@type"') is not null),
typed as (select *, case when json_type(t) = 'ARRAY' then json_extract_string(t, '$[*]') else [json_extract_string(t, '$')] end as types from node)
"""


def _kinds(text: str, patterns: dict[str, str]) -> str:
    each = " union all ".join(f"select site_id, '{k}' as kind from link where regexp_matches({text}, '{p}')" for k, p in patterns.items())
    return f"select site_id, kind, count(*) as links from ({each}) group by 1, 2"


def _amount(c: str) -> str:
    t = f"regexp_replace({c}, '[^0-9.,]', '', 'g')"
    return f"try_cast(case when regexp_matches({t}, '^[0-9.]*,[0-9]{{1,2}}$') then replace(replace({t}, '.', ''), ',', '.') else replace({t}, ',', '') end as decimal(18,4))"


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[?#].*$', ''), '/+$', '')"


def _part(tag: str) -> str:
    return f"(?is)<(?:[a-z]+:)?{tag}(?:\\s[^>]*)?>(.*?)</(?:[a-z]+:)?{tag}\\s*>"


def _owned(d: str) -> str:
    return f"({d} = host or ends_with({d}, '.' || host))"


def _attr(tag: str, name: str) -> str:
    return f"lower(trim(regexp_extract({tag}, '(?i)\\s{name}\\s*=\\s*[\"'']?([^\"''>]*)[\"'']?', 1)))"


def _among(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


ON_RELATIONS = {
    "routing_differences": (
        """with d as (
  select r.site_id, r.bot, concat_ws(',', case when r.status is distinct from b.status then 'status' end, case when r.final_url is distinct from b.final_url then 'final_url' end, case when r.canonical is distinct from b.canonical then 'canonical' end,
    case when b.bytes >= 1024 and (r.bytes < b.bytes * 0.6 or r.bytes > b.bytes * 1.6) then 'bytes' end, case when b.words >= 80 and (r.words < b.words * 0.6 or r.words > b.words * 1.6) then 'words' end) as differs
  from route r join route b on b.site_id = r.site_id and b.bot = 'browser' where r.bot <> 'browser')
select * from d where differs <> ''""",
        "route",
    ),
    "dns_discovery": (
        "with h as (select *, " + " or ".join(f"contains(lower(txt), '{t}')" for t in DNS_TOKENS) + " as hit from dns where rtype = 'TXT') select site_id, count(*) filter (hit) as hits, min(name) filter (hit) as first_name from h group by 1",
        "dns",
    ),
    "surface_validity": (
        f"""with t as (select *, regexp_replace(body, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') as t from surface_body)
select site_id, kind, length(body)::bigint as chars, length(t) >= 20 and case when kind in {_among(JSON_SURFACES)} then coalesce(json_type(try_cast(t as json)) in ('ARRAY', 'OBJECT'), false)
  when kind = 'content feed' then regexp_matches(t, '(?i)^(<\\?xml[^>]*>\\s*)?<(rss|feed|rdf:rdf)[\\s>]') when kind = 'auth.md' then starts_with(t, '#') or contains(lower(t), 'authorization') else true end as valid from t""",
        "surface_body",
    ),
    "commerce_mismatch": (
        f"""with n as (select site_id, side, field, nullif(lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))), '') as value from commerce),
f as (select site_id, field, v.value as v, s.value as s from (select * from n where side = 'visible') v full join (select * from n where side = 'schema') s using (site_id, field)),
k as (select site_id, field, case when v is null and s is null then null when v is null then 'schema only' when s is null then 'visible only' when field in {_among(COMPARED)} and v <> s then 'different' end as mismatch from f)
select * from k where mismatch is not null""",
        "commerce",
    ),
    "cached_lookups": (
        """with l as (select *, row_number() over (partition by cache_key order by checked desc) as k from cache)
select cache_key, score, date_diff('day', checked::date, date '2024-06-01')::bigint as age_days, date_diff('day', checked::date, date '2024-06-01') < 30 as fresh from l where k = 1""",
        "cache",
    ),
    "report_checks_json": (
        """select site_id, to_json(list({'check_name': check_name, 'pillar': pillar, 'state': state, 'score': score, 'max_score': max_score} order by check_name))::varchar as checks from check_row join rubric using (check_name) group by 1""",
        "check_row", "rubric",
    ),
    "top_gap_per_pillar": (
        """select site_id, pillar, check_name, missing from (select site_id, pillar, check_name, max_score - score as missing, row_number() over (partition by site_id, pillar order by max_score - score desc, check_name) as k
  from check_row join rubric using (check_name) where state <> 'pass') where k = 1""",
        "check_row", "rubric",
    ),
    "form_affordances": (
        f"""with f as (select site_id, unnest(regexp_extract_all(html, '(?is)<form(?:\\s[^>]*)?>.*?</form\\s*>')) as f from form_page),
o as (select site_id, f, regexp_extract(f, '(?is)^<form(?:\\s[^>]*)?>') as o from f),
a as (
  select site_id, {_attr('o', 'action')} as action, {_attr('o', 'method')} as method, regexp_matches(f, '(?i)<button|<input[^>]*type=["'']?submit') as submits,
    list_filter(regexp_extract_all(f, '(?is)<(?:input|select|textarea)(?:\\s[^>]*)?>'), lambda t: not regexp_matches(t, '(?i)^<input') or {_attr('t', 'type')} not in {_among(NO_FIELD)}) as fields from o)
select site_id, count(*) as forms, count(*) filter (action = '') as no_action, count(*) filter (regexp_matches(action, '^(javascript:|#)')) as script_only, count(*) filter (method = '') as no_method,
  count(*) filter (method not in ('', 'get', 'post', 'dialog')) as odd_method, sum(len(list_filter(fields, lambda t: {_attr('t', 'name')} in {_among(GENERIC_NAMES)})))::bigint as unnamed_fields,
  sum(len(list_filter(fields, lambda t: regexp_matches(t, '(?i)^<input') and ({_attr('t', 'type')} in ('email', 'tel', 'url', 'password') or regexp_matches({_attr('t', 'name')} || ' ' || {_attr('t', 'id')} || ' ' || {_attr('t', 'placeholder')}, '{PURPOSES}'))
    and {_attr('t', 'autocomplete')} in ('', 'off'))))::bigint as no_autocomplete, count(*) filter (not submits) as no_submit,
  count(*) filter (action <> '' and not regexp_matches(action, '^(javascript:|#)') and method in ('get', 'post', 'dialog')) as usable from a group by 1""",
        "form_page",
    ),
    "url_normalise": (
        """with p as (
  select site_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as h, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as p,
    regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as q from url),
k as (select *, s in ('http', 'https') and h <> '' as ok, case when p = '' then '/' else p end as pp, case when s = 'http' then regexp_replace(h, ':80$', '') else regexp_replace(h, ':443$', '') end as hh from p)
select site_id, case when ok then s || '://' || hh || pp end as page_key, case when ok then s || '://' || h || pp || q end as exact_key from k""",
        "url",
    ),
    "entity_lookup_score": (
        """with j as (select site_id, coalesce(status, 0) <> 200 as failed, coalesce(in_wikidata, false) as a, coalesce(in_wikipedia, false) as b from lookup left join entity using (name))
select site_id, (case when failed then 2 when a and b then 4 when a then 3 when b then 2 else 0 end)::bigint as score, case when failed then 'warn' when a and b then 'pass' when a or b then 'partial' else 'fail' end as state,
  case when failed then 'unknown' else 'verified' end as evidence from j""",
        "lookup", "entity",
    ),
    "search_blurb_issues": (
        f"""with s as (select site_id, sum(n)::bigint as shared from (select site_id, lower(description) as k, count(*) as n from blurb where description is not null group by 1, 2 having count(*) > 1) group by 1),
c as (select site_id, count(*) as pages, count(*) filter (title is null) as no_title, count(*) filter (description is null) as no_description, count(*) filter (length(description) < 50) as short, count(*) filter (length(description) > 200) as long,
  count(*) filter (regexp_matches(description, '(?i){PLACEHOLDERS}')) as placeholder from blurb group by 1)
select c.*, coalesce(shared, 0) as shared from c left join s using (site_id)""",
        "blurb",
    ),
    "locked_rows": (
        """with s as (select site_id, pillar, sum(score)::bigint as points, sum(max_score)::bigint as open_most from check_row join rubric using (check_name) group by 1, 2),
l as (select pillar, sum(max_score)::bigint as locked_most from locked group by 1)
select site_id, pillar, points, open_most, coalesce(locked_most, 0) as locked_most, open_most + coalesce(locked_most, 0) as most from s left join l using (pillar)""",
        "check_row", "rubric", "locked",
    ),
    "llms_validity": (
        """with t as (select site_id, regexp_replace(coalesce(body, ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') as t from llms),
c as (select site_id, t, length(t) < 20 as short, starts_with(t, '#') as titled, regexp_matches(t, 'https?://[^ \\t\\r\\n)>"]+') or regexp_matches(t, '\\[[^\\]]+\\]\\([^)]+\\)') as linked from t)
select site_id, short, titled, linked, (case when not short and titled and linked then 2 when t <> '' then 1 else 0 end)::bigint as points from c""",
        "llms",
    ),
    "header_hints": (
        """with h as (select site_id, lower(name) as n, lower(value) as v from header)
select site_id, bool_or(n = 'vary' and len(list_filter(string_split(v, ','), lambda x: trim(x) in ('accept', '*'))) > 0) as vary_accept, bool_or(n = 'link' and contains(v, 'alternate') and regexp_matches(v, 'text/markdown|text/plain|\\.md|llms')) as link_hint,
  bool_or(n = 'content-location' and regexp_matches(v, '\\.(md|markdown|txt)$')) as location_hint, bool_or(n in ('content-signal', 'content-signals')) as signal,
  bool_or(n not in ('content-type', 'vary', 'link', 'content-location', 'content-signal', 'content-signals') and regexp_matches(n || ': ' || v, 'llms|markdown|agent|token')) as other_hint from h group by 1""",
        "header",
    ),
    "feed_freshness": (
        f"""with t as (select site_id, len(regexp_extract_all(body, '(?i)<(item|entry)[\\s>]'))::bigint as items, list_concat(list_concat({', '.join(f"regexp_extract_all(body, '{_part(t)}', 1)" for t in ('pubDate', 'updated'))}), regexp_extract_all(body, '{_part('published')}', 1)) as texts from feed),
d as (select site_id, items, list_transform(texts, lambda x: case when regexp_matches(trim(x), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(trim(x)[1:10] as date) else try_strptime(regexp_extract(x, '([0-9]{{1,2}} [A-Za-z]{{3}} [0-9]{{4}})', 1), '%d %b %Y')::date end) as d from t),
g as (select site_id, items, d, list_filter(d, lambda x: x is not null and x <= date '2024-06-01') as good from d)
select site_id, items, len(good)::bigint as dated, (len(d) - len(good))::bigint as faulty, list_max(good) as latest, coalesce(date_diff('day', list_max(good), date '2024-06-01') > 180, true) as stale from g""",
        "feed",
    ),
    "catalog_quality": (
        f"""with j as (select site_id, host, case when json_type(try_cast(body as json)) = 'OBJECT' then try_cast(body as json) end as j from catalog),
f as (select site_id, host, j, trim(json_extract_string(j, '$.specVersion')) as version, lower(json_extract_string(j, '$.host.domain')) as domain, case when json_type(json_extract(j, '$.entries')) = 'ARRAY' then json_extract(j, '$.entries[*]') end as e from j)
select site_id, j is not null as object, coalesce(regexp_matches(version, '{SEMVER}'), false) as version, coalesce({_owned('domain')}, false) as own_host, coalesce(len(e), -1)::bigint as entries,
  coalesce(len(list_filter(e, lambda x: not coalesce(regexp_matches(json_extract_string(x, '$.identifier'), '^urn:air:[^:]+:.') and {_owned("split_part(json_extract_string(x, '$.identifier'), ':', 3)")}, false))), 0)::bigint as foreign_entries from f""",
        "catalog",
    ),
    "orphan_surfaces": (
        """select site_id, path from surface s where found and not exists (select 1 from surface_link l where l.site_id = s.site_id
  and regexp_replace(lower(regexp_extract(href, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') = regexp_replace(host, '^www\\.', '') and regexp_replace(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = s.path)""",
        "surface", "surface_link",
    ),
    "agent_readiness": (
        """with c as (select site_id, count(*) as earned, count(*) filter (scope = 'core') as core_earned from probe_pass join probe using (ordinal) group by 1),
s as (select *, round_even(earned / (select count(*) from probe) * 100, 0)::bigint as score, round_even(core_earned / (select count(*) from probe where scope = 'core') * 100, 0)::bigint as core_score from c)
select *, case when score >= 70 then 'strong' when score >= 40 then 'developing' else 'limited' end as label from s""",
        "probe_pass", "probe",
    ),
    "peer_validation": (
        """with f as (
  select name, count(*) filter (r.check_name is null) as unknown_checks, 13 - count(*) filter (r.check_name is not null) as missing_checks, count(*) filter (max <> coalesce(max_score, max)) as wrong_max,
    count(*) filter (score < 0 or score > max) as score_out_of_range, count(*) filter (state not in ('pass', 'partial', 'fail', 'warn', 'locked')) as odd_states, count(*) filter (evidence not in ('verified', 'inferred', 'unknown')) as odd_evidence
  from snapshot s left join rubric r on r.check_name = s.check_name group by 1)
select * from f where unknown_checks + missing_checks + wrong_max + score_out_of_range + odd_states + odd_evidence > 0""",
        "snapshot", "rubric",
    ),
    "viewer_pillars": (
        """with s as (select site_id, pillar, sum(score)::bigint as points, sum(max_score)::bigint as most, count(*) filter (state <> 'pass') as open_rows from check_row join rubric using (check_name) where state <> 'locked' group by 1, 2),
p as (select *, floor(points * 100 / most + 0.5)::bigint as percent from s)
select *, case when percent >= 85 then 'Elite' when percent >= 70 then 'Strong' when percent >= 50 then 'Developing' else 'At risk' end as band from p""",
        "check_row", "rubric",
    ),
    "viewer_order": (
        """select site_id, check_name, state, row_number() over (partition by site_id order by case state when 'fail' then 0 when 'partial' then 1 when 'warn' then 2 when 'locked' then 3 else 4 end, max_score desc, check_name) as place
from check_row join rubric using (check_name)""",
        "check_row", "rubric",
    ),
    "report_summary": (
        "with " + EVIDENCE + """, pl as (select site_id, pillar, least(sum(score), any_value(cap)) as points from check_row join rubric using (check_name) join pillar_cap using (pillar) group by 1, 2),
o as (select site_id, sum(points)::bigint as overall from pl group by 1),
a as (
  select site_id, string_agg(check_name, ',' order by place) as attention from (
    select site_id, check_name, row_number() over (partition by site_id order by case state when 'fail' then 0 when 'partial' then 1 else 2 end, score / max_score, check_name) as place
    from check_row join rubric using (check_name) where state in ('fail', 'partial', 'warn')) where place <= 5 group by 1),
n as (select site_id, count(*) filter (state not in ('pass', 'locked')) as open_rows from check_row group by 1)
select site_id, overall, percent, attention, open_rows from o join evidence using (site_id) left join a using (site_id) join n using (site_id)""",
        "check_row", "rubric", "pillar_cap",
    ),
    "scope_resolution": (SCOPES, "scope_request", "preset", "override_key"),
    "probe_scope_matrix": (
        """with b as (select * from (values (false), (true)) v(x))
select p.x as protocols, a.x as account_auth, c.x as commerce, category, count(*) filter (scope = 'core' or scope = 'protocols' and p.x or scope = 'account_auth' and a.x or scope = 'commerce' and c.x) as included, count(*) as all_probes
from probe, b p, b a, b c group by 1, 2, 3, 4""",
        "probe",
    ),
    "jsonld_types": (LD + "select site_id, script_no, array_to_string(types, ' ') as types, len(json_keys(v))::bigint as n_fields from typed", "json_ld"),
    "jsonld_best_schema": (
        LD + """, known as (select site_id, node, v, unnest(types) as type, unnest(range(len(types))) as k from typed),
per as (
  select site_id, node, k, type, count(*) filter (required and (x is null or x in ('', '[]', 'null'))) as req, count(*) filter (not required and (x is null or x in ('', '[]', 'null'))) as rec
  from (select known.*, field, required, trim(json_extract_string(v, '$."' || field || '"')) as x from known join ld_field using (type)) group by 1, 2, 3, 4),
one as (select * from (select *, row_number() over (partition by node order by k) as r from per) where r = 1),
scored as (select t.site_id, coalesce(greatest(case when req > 0 then 1 else 3 end, 5 - 2 * req - least(rec, 2)), 2)::bigint as points, coalesce(type, 'other') as type from typed t left join one using (node)),
best as (select site_id, points, type from (select *, row_number() over (partition by site_id order by points desc, type) as r from scored) where r = 1),
tried as (select site_id, count(*) as scripts, count(*) filter (try_cast(body as json) is null) as invalid from json_ld group by 1)
select site_id, scripts, invalid, coalesce(points, case when invalid > 0 then 1 else 0 end)::bigint as score, type from tried left join best using (site_id)""",
        "json_ld", "ld_field",
    ),
    "sitemap_lastmod_quality": (
        """with d as (select *, coalesce(trim(value), '') <> '' as filled, case when regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(value[1:10] as date) end as day from lastmod)
select site_id, count(*) as entries, count(*) filter (not filled) as missing, count(*) filter (filled and day is null) as invalid, count(*) filter (day > date '2024-06-01') as future, max(day) filter (day <= date '2024-06-01') as latest from d group by 1""",
        "lastmod",
    ),
    "viewport_tokens": (
        """with t as (select *, list_transform(string_split(lower(content), ','), lambda x: trim(x)) as t, try_cast(nullif(regexp_extract(lower(content), 'maximum-scale\\s*=\\s*([0-9.]+)', 1), '') as double) as scale from viewport),
z as (select *, len(list_filter(t, lambda x: regexp_matches(x, '^user-scalable\\s*=\\s*(no|0)$'))) > 0 or coalesce(scale <= 1, false) as zoom_limited, len(list_filter(t, lambda x: regexp_matches(x, '^width\\s*=\\s*device-width$'))) > 0 as wide from t)
select site_id, (case when trim(content) = '' then 0 when not wide or zoom_limited then 2 else 4 end)::bigint as points, zoom_limited from z""",
        "viewport",
    ),
    "canonical_check": (
        f"""with c as (select site_id, not starts_with(http_final, 'https://') as plain_http, canonical is null or {_norm('canonical')} <> {_norm('final_url')} as bad_tag,
  coalesce(other_host <> regexp_extract(final_url, '^[a-z]+://([^/?#]+)', 1), false) as two_hosts from canonical),
n as (select *, (plain_http::int + bad_tag::int + two_hosts::int)::bigint as issues from c)
select *, (case issues when 0 then 5 when 1 then 3 else 1 end)::bigint as score, case issues when 0 then 'pass' when 1 then 'partial' else 'fail' end as state from n""",
        "canonical",
    ),
    "trust_surfaces": (_kinds("' ' || regexp_replace(lower(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' ' || label), '[^a-z0-9]+', ' ', 'g') || ' '", {k: f" ({p}) " for k, p in TRUST.items()}), "link"),
    "social_profiles": (_kinds("lower(href)", {k: p.lower() for k, p in SOCIAL.items()}), "link"),
    "price_normalise": (f"with a as (select site_id, {_amount('shown')} as shown, {_amount('declared')} as declared from price) select site_id, shown::double as shown, declared::double as declared, shown = declared as same from a", "price"),
    "public_addresses": (f"select site_id, ip, regexp_matches(ip, '^{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}$') and not regexp_matches(ip, '{PRIVATE}') as public from address", "address"),

    "robots_groups": (GROUPS + "select site_id, group_id, array_to_string(agents, ' ') as agents, array_to_string(rules, ' ') as rules from grp", "robots"),
    "robots_access_matrix": (ACCESS + "select * from matrix", "robots", "crawler"),
    "robots_access_score": (
        ACCESS + ", mean as (select site_id, purpose, weight, avg(points) as m, count(*) filter (access like '%blocked') as b from matrix join access using (access) join purpose using (purpose) group by 1, 2, 3) "
        "select site_id, round_even(round(sum(m * weight) / sum(weight) * 6, 9), 0)::bigint as score, sum(b)::bigint as blocked from mean group by 1",
        "robots", "crawler", "purpose", "access",
    ),
    "robots_quality": (
        LINES + """, n as (select *, coalesce(sum((key = 'user-agent')::int) over (partition by site_id order by line_no), 0) as agents from lines),
f as (
  select site_id, count(*) filter (line <> '' and (not has_key or key = '' or key in ('allow', 'disallow', 'crawl-delay') and agents = 0)) as malformed,
    count(*) filter (key = 'sitemap' and not regexp_matches(value, '(?i)^https?://[^/?#]+')) as bad_sitemaps, count(*) filter (key = 'crawl-delay') as delays,
    count(*) filter (key = 'crawl-delay' and coalesce(try_cast(value as double) < 0, true)) as bad_delays,
    (max(line_no) filter (key = 'user-agent') is not null and coalesce(max(line_no) filter (key in ('allow', 'disallow') and agents > 0), -1) < max(line_no) filter (key = 'user-agent'))::bigint as empty_groups from n group by 1)
select f.*, strlen(body)::bigint as bytes, least(2, (strlen(body) > 512000)::int + (malformed > 0 or empty_groups > 0)::int + (bad_sitemaps > 0)::int + (bad_delays > 0)::int)::bigint as penalty from f join robots using (site_id)""",
        "robots",
    ),
    "content_signals": (LINES + f"select distinct site_id, token from lines, (values {', '.join(f'({chr(39)}{s}{chr(39)})' for s in SIGNALS)}) t(token) where key in ('content-signal', 'content-signals') and contains(lower(value), token)", "robots"),
    "bot_blocked_reasons": (BOTS + "select * from b", "bot_fetch"),
    "bot_access_score": (
        BOTS + "select site_id, count(*) filter (reason is null) as open, count(*) as probed, round_even(count(*) filter (reason is null) / count(*) * 6, 0)::bigint as score, "
        "case when count(reason) = 0 then 'pass' when count(reason) < count(*) then 'partial' else 'fail' end as state from b group by 1",
        "bot_fetch",
    ),
    "x_robots_scopes": (DIRECTIVES + "select * from directive", "x_robots"),
    "indexing_precedence": (
        DIRECTIVES + """, s as (select x.site_id, (case when bool_or(directive in ('noindex', 'none')) then 0
    when bool_or(directive in ('nosnippet', 'noimageindex', 'max-snippet:0', 'max-image-preview:none', 'max-video-preview:0')) then 2 when bool_or(directive = 'max-image-preview:standard') then 4
    when bool_or(directive in ('nofollow', 'noarchive', 'notranslate') or directive like 'unavailable_after:%') then 3 else 5 end)::bigint as score from x_robots x left join directive d on d.site_id = x.site_id group by 1)
select site_id, score, case score when 5 then 'pass' when 0 then 'fail' else 'partial' end as state from s""",
        "x_robots",
    ),
    "hreflang_reciprocity": (
        f"""
with r as (select site_id, lang, href, {_key('src')} as page, {_key('href')} as target, regexp_matches(href, '(?i)^https?://') as absolute from hreflang),
c as (select site_id, count(*) filter (not (lang = 'x-default' or regexp_matches(lang, '^[a-z]{{2,3}}(-[a-z]{{4}})?(-([a-z]{{2}}|[0-9]{{3}}))?$'))) as invalid, count(*) filter (not absolute) as relative from r group by 1),
o as (select site_id, count(*) filter (not self) as no_self from (select site_id, page, bool_or(target = page) as self from r group by 1, 2) group by 1),
p as (select distinct site_id, page, target from r where absolute and lang <> 'x-default' and target <> page and split_part(page, '/', 1) = split_part(target, '/', 1)),
j as (select p.*, exists (select 1 from r where r.site_id = p.site_id and r.page = p.target) as known, exists (select 1 from r where r.site_id = p.site_id and r.page = p.target and r.target = p.page) as back from p)
select c.*, no_self, (select count(*) from j where j.site_id = c.site_id and known and not back) as not_returned, (select count(*) from j where j.site_id = c.site_id and not known) as unchecked from c join o using (site_id)""",
        "hreflang",
    ),
    "pillar_scores": (
        "with s as (select site_id, pillar, least(sum(score), any_value(cap))::bigint as points from check_row join rubric using (check_name) join pillar_cap using (pillar) group by 1, 2) select *, sum(points) over (partition by site_id)::bigint as overall from s",
        "check_row", "rubric", "pillar_cap",
    ),
    "evidence_score": ("with " + EVIDENCE + " select * from evidence", "check_row", "rubric"),
    "action_order": (
        f"select site_id, check_name, round((max_score - score) / {EFFORT}, 6) as gap, row_number() over (partition by site_id order by (max_score - score) / {EFFORT} desc, ordinal) as place from check_row join rubric using (check_name)",
        "check_row", "rubric",
    ),
    "attention_top5": (
        """select site_id, check_name, state, case when evidence in ('unknown', 'not_applicable') then 'unavailable' else evidence end as evidence, score, max_score, place from (
  select *, row_number() over (partition by site_id order by case state when 'fail' then 0 when 'partial' then 1 else 2 end, case when max_score > 0 then score / max_score else 0 end, check_name) as place
  from check_row join rubric using (check_name) where state in ('fail', 'partial', 'warn')) where place <= 5""",
        "check_row", "rubric",
    ),
    "readiness_cube": (
        """with r as (select s.*, p.category, (x.ordinal is not null)::int as hit from site_scope s cross join probe p left join (select distinct * from probe_pass) x on x.site_id = s.site_id and x.ordinal = p.ordinal
  where scope = 'core' or scope = 'protocols' and protocols or scope = 'account_auth' and account_auth or scope = 'commerce' and commerce),
g as (select protocols, account_auth, commerce, category, grouping_id(protocols, account_auth, commerce, category)::bigint as level, count(*) as asked, sum(hit)::bigint as passed from r group by cube (protocols, account_auth, commerce, category))
select *, round_even(passed / asked * 100, 0)::bigint as percent from g""",
        "site_scope", "probe_pass", "probe",
    ),
    "check_counts": (
        "select site_id, count(*) filter (state <> 'locked') as included, " + ", ".join(f"count(*) filter (state = '{s}') as n_{s}" for s in ("pass", "partial", "fail", "warn", "locked")) + " from check_row group by 1",
        "check_row",
    ),
    "peer_essentials": ("with " + PEER + " select * from peers", "peer", "rubric"),
    "peer_position": (
        "with " + EVIDENCE + ", " + PEER + """, q as (select list(percent order by percent) as s, len(list(percent)) as n from peers),
j as (select site_id, percent, round_even((select count(*) from peers p where p.percent <= e.percent) / n * 100, 0)::bigint as percentile, round_even((select median(percent) from peers), 0)::bigint as median, s[n // 4 + 1] as lower_quartile, s[n * 3 // 4 + 1] as upper_quartile from evidence e, q)
select *, case when percent >= upper_quartile then 'top' when percent >= median then 'above middle' when percent >= lower_quartile then 'within middle' else 'below most' end as position from j""",
        "check_row", "rubric", "peer",
    ),
    "peer_nearest3": (
        "with " + EVIDENCE + ", " + PEER + ", j as (select site_id, name, p.percent, row_number() over (partition by site_id order by abs(p.percent - e.percent), p.percent desc, name) as place from evidence e, peers p) select site_id, place, name, percent from j where place <= 3",
        "check_row", "rubric", "peer",
    ),
}

_LINES_SQL = LINES + "select * from lines"
ON_RELATIONS |= evidence_oracles.sql(ACCESS + " select * from matrix", ON_RELATIONS["robots_access_score"][0], ON_RELATIONS["robots_quality"][0], ON_RELATIONS["content_signals"][0], _LINES_SQL)

#: Relations that a query has at the size of the pages, by key.
FED = {"peer_essentials": {"peer": "name"}, "peer_bars": {"peer": "name"}, "peer_validation": {"snapshot": "name"}, "agent_peers": {"peer_probe": "name"}, "probe_scope_matrix": {"probe": "label"}, "cached_lookups": {"cache": "cache_key"}}
SQL: dict[str, str] = RAW | page_oracles.SQL | fetch_oracles.SQL | {name: with_relations(sql, *names, fed=FED.get(name)) for name, (sql, *names) in ON_RELATIONS.items()}
#: The SQL of operators on pages' evidence: that on literal rows, over the whole table with its planted markup.
ON_PAGES = ("trust_surfaces", "social_profiles", "form_affordances", "viewport_tokens", "jsonld_types")
SQL |= {f"page_{name}": f"with {PAGES_SQL}, {r} as ({page_relations.SQL[r].replace('from pages', 'from evidence')}) select * from ({sql})" for name in ON_PAGES for sql, r in [ON_RELATIONS[name]]}
SQL["page_url_normalise"] = f"with url as ({page_relations.SQL['url']}) select * from ({ON_RELATIONS['url_normalise'][0]})"
_CHECKS = ("robots_check", "bot_challenges", "entity_lookup_score", "surface_check", "text_access", "robots_access_matrix")
SQL |= fetch_oracles.audit(RAW, page_oracles.SQL, {name: ON_RELATIONS[name] for name in _CHECKS})
