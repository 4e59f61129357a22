"""DuckDB SQL for the operators over fetched evidence (site_evidence.py): the query's name, its SQL, and the relations it reads."""

from __future__ import annotations

WORD = "[A-Za-z0-9][A-Za-z0-9''_-]*"


def _trim(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


def _codes(*rules: tuple[str, str]) -> str:
    return "concat_ws(' ', " + ", ".join(f"case when {c} then '{code}' end" for c, code in rules) + ")"


_TEXT = "trim(regexp_replace(regexp_replace({0}, '(?s)<title>.*?</title>|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_JSON_KINDS = "'API description', 'API catalog', 'ARD catalog', 'OAuth authorization metadata', 'OAuth protected resource metadata', 'Web Bot Auth directory', 'MCP server card', 'A2A agent card', 'Agent skills', 'WebMCP manifest', 'agentic commerce metadata', 'catalog JSON'"
_IN = "(scope = 'core' or scope = 'protocols' and protocols or scope = 'account_auth' and account_auth or scope = 'commerce' and commerce)"
_KNOWN = "'protocols', 'account_auth', 'ecommerce', 'feed_discovery', 'article_schema', 'localbusiness_schema', 'news_article_schema', 'claimreview_schema', 'product_offer_schema', 'commerce_fields', 'api_catalog', 'mcp', 'a2a', 'agent_skills', 'webmcp', 'oauth_oidc', 'ard_catalog', 'auth_md'"


def sql(access: str, score: str, quality: str, signals: str, lines: str) -> dict[str, tuple[str, ...]]:
    """``access`` and so on are the SQL of the robots queries that robots_check is made of."""
    out = {
        "readiness_summary": (
            f"""with r as (select s.site_id, label, p.ordinal, pp.ordinal is not null as ok from site_scope s cross join probe p left join probe_pass pp on pp.site_id = s.site_id and pp.ordinal = p.ordinal where {_IN}),
c as (select site_id, count(*) filter (ok) as earned, count(*) as most, coalesce(string_agg(label, '; ' order by ordinal) filter (ok), '') as passed, coalesce(string_agg(label, '; ' order by ordinal) filter (not ok), '') as missing from r group by 1),
s as (select *, round_even(earned / most * 100, 0)::bigint as score from c)
select *, case when score >= 70 then 'strong' when score >= 40 then 'developing' else 'limited' end as label from s""",
            "site_scope", "probe_pass", "probe",
        ),
        "agent_nearest3": (
            f"""with o as (select s.site_id, protocols, account_auth, commerce, round_even(count(pp.ordinal) / count(*) * 100, 0)::bigint as score from site_scope s cross join probe p left join probe_pass pp on pp.site_id = s.site_id and pp.ordinal = p.ordinal where {_IN} group by 1, 2, 3, 4),
k as (select distinct protocols, account_auth, commerce from site_scope), l as (select k.*, label from k cross join probe where {_IN}), n as (select distinct name from peer_probe),
r as (select l.protocols, l.account_auth, l.commerce, n.name, round_even(count(*) filter (exists (select 1 from peer_probe x where x.name = n.name and x.label = l.label)) / count(*) * 100, 0)::bigint as percent from l cross join n group by 1, 2, 3, 4),
j as (select site_id, name, percent, row_number() over (partition by site_id order by abs(percent - score), percent desc, name) as place from o join r using (protocols, account_auth, commerce))
select site_id, place, name, percent from j where place <= 3""",
            "site_scope", "probe_pass", "probe", "peer_probe",
        ),
        "resolved_targets": (
            """with p as (select *, coalesce(not regexp_matches(ip, '^(0|10|127)\\.|^::1?$'), false) as public, contains(ip, ':') as later from resolved),
g as (select site_id, host, bool_and(public) as ok, arg_min(ip, later::int * 1000 + ordinal) as ip from p group by 1, 2)
select site_id, host, case when ok then ip end as ip from g""",
            "resolved",
        ),
        "robots_codes": (
            f"""with q as ({quality}) select site_id, {_codes(("bytes > 512000", "oversized"), ("malformed > 0", "malformed_lines"), ("empty_groups > 0", "empty_groups"), ("bad_sitemaps > 0", "bad_sitemaps"), ("bad_delays > 0", "bad_delays"))} as codes, delays > 0 as paced from q""",
            "robots",
        ),
        "discovery_score": (
            """with p as (select *, crawlers_allowed::int + sitemap_valid::int + (sitemap_valid and lastmod_good or freshness)::int + (sitemap_valid and sitemap_clean and metadata_ok and blurbs_ok)::int as n from discovery),
s as (select site_id, (case when hreflang_ok and trust_ok then n else least(n, 3) end)::bigint as score from p)
select site_id, score, case when score = 4 then 'pass' when score > 0 then 'partial' else 'warn' end as state from s""",
            "discovery",
        ),
        "viewer_open_rows": (
            """with o as (select site_id, check_name, state, max_score from check_row join rubric using (check_name) where state not in ('pass', 'locked'))
select site_id, check_name, state, row_number() over (partition by site_id order by case state when 'fail' then 0 when 'partial' then 1 when 'warn' then 2 else 5 end, max_score desc, check_name) as place from o""",
            "check_row", "rubric",
        ),
        "peer_bars": (
            """with p as (select name, round_even(sum(score) / sum(max_score) * 100, 0)::bigint as percent from peer join rubric using (check_name) where grp = 'corporate' group by 1)
select name, percent, greatest(least(percent, 100), 2) as width, row_number() over (order by percent desc, name) as place from p""",
            "peer", "rubric",
        ),
        "surface_check": (
            f"""with f as (select site_id, surface, {_trim('body')} as t, try_cast({_trim('body')} as json) as v from surface_fetch where status between 200 and 399),
g as (
  select distinct site_id, surface from f where surface = 'NLWeb /ask endpoint' or length(t) >= 20 and coalesce(case when surface in ({_JSON_KINDS}) then json_type(v) in ('ARRAY', 'OBJECT')
    when surface = 'legacy ai-plugin.json' then json_type(v) = 'OBJECT' and (len(list_intersect(json_keys(v), ['schema_version', 'name_for_model', 'name_for_human', 'description_for_model'])) > 0 or json_extract(v, '$.api.url') is not null)
    when surface = 'content feed' then regexp_matches(t, '^<(rss|feed)') when surface = 'auth.md' then starts_with(t, '#') or contains(lower(t), 'authorization') else true end, false)),
a as (select s.site_id, k.surface from site_scope s cross join (select distinct surface, scope from surface_kind) k where {_IN}),
n as (select a.site_id, count(*) as n, list(a.surface order by a.surface) filter (g.surface is not null) as found from a left join g on g.site_id = a.site_id and g.surface = a.surface group by 1),
h as (select site_id, list(distinct hint order by hint) as hints from hint group by 1),
r as (select n.site_id, (n + 2)::bigint as families, list_concat(coalesce(hints, []), coalesce(found, [])) as f from n left join h using (site_id))
select site_id, families, array_to_string(f, '; ') as found, least(len(f), 3)::bigint as score, case when len(f) >= 3 then 'pass' when len(f) > 0 then 'partial' else 'warn' end as state from r""",
            "site_scope", "surface_fetch", "hint", "surface_kind",
        ),
        "conventional_paths": (
            f"""with r as (select s.site_id, p.path, {_IN} as i, exists (select 1 from surface_fetch f where f.site_id = s.site_id and f.path = p.path and status between 200 and 399 and trim(coalesce(body, '')) <> '') as hit from site_scope s cross join usual_path p)
select site_id, coalesce(string_agg(path, ' ' order by path) filter (hit), '') as found, coalesce(string_agg(path, ' ' order by path) filter (not hit and i), '') as missing, coalesce(string_agg(path, ' ' order by path) filter (not hit and not i), '') as not_asked from r group by 1""",
            "site_scope", "surface_fetch", "usual_path",
        ),
        "website_variants": (
            """with h as (select site_id, regexp_extract(url, '^([A-Za-z]+)://', 1) as s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as h, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as n from dns_site),
v as (select site_id, s || '://' || h as own, s || '://' || case when starts_with(n, 'www.') then substr(n, 5) else 'www.' || n end as alt from h where n <> '')
select site_id, unnest(range(4))::bigint as ordinal, unnest([own || '/', own, alt || '/', alt]) as variant from v""",
            "dns_site",
        ),
        "scope_labels": (
            """select site_id, case when commerce then 'Commerce storefront' else 'General website' end || case when protocols then ' + API/protocol' else '' end || case when account_auth then ' + account/auth' else '' end as label,
  concat_ws('; ', case when protocols then 'API and protocol discovery' end, case when account_auth then 'Account/auth discovery' end, case when commerce then 'Commerce protocol metadata; Catalog JSON' end) as included,
  concat_ws('; ', case when not protocols then 'API and protocol discovery' end, case when not account_auth then 'Account/auth discovery' end, case when not commerce then 'Commerce protocol metadata; Catalog JSON' end) as excluded,
  case when protocols or account_auth or commerce then 'full' else 'common-contextual' end as surfaces from site_scope""",
            "site_scope",
        ),
        "nested_report": (
            """with r as (select *, (max_score - score) / (case effort when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 2 end) as gap from check_row join rubric using (check_name)),
p as (select site_id, pillar, least(sum(score), any_value(cap))::bigint as points from r join pillar_cap using (pillar) group by 1, 2),
s as (select site_id, sum(points)::bigint as overall, to_json(list({'pillar': pillar, 'points': points} order by pillar))::varchar as pillars from p group by 1),
c as (select site_id, to_json(list({'check_name': check_name, 'state': state, 'score': score, 'max_score': max_score} order by round(gap, 9) desc, ordinal))::varchar as checks from r group by 1),
l as (select site_id, case when commerce then 'Commerce storefront' else 'General website' end || case when protocols then ' + API/protocol' else '' end || case when account_auth then ' + account/auth' else '' end as label from site_scope)
select site_id, label, overall, pillars, checks from s join c using (site_id) left join l using (site_id)""",
            "check_row", "rubric", "pillar_cap", "site_scope",
        ),
        "catalog_issues": (
            f"""with t as (select site_id, regexp_replace(lower(host), '^www\\.', '') as host, {_trim('body')} as t from full_catalog),
j as (select *, case when starts_with(t, '{{') and json_type(try_cast(t as json)) = 'OBJECT' then try_cast(t as json) end as v from t),
k as (
  select *, trim(coalesce(json_extract_string(v, '$.specVersion'), '')) as ver, json_type(json_extract(v, '$.host')) = 'OBJECT' as hosted, coalesce(json_extract_string(v, '$.host.domain'), json_extract_string(v, '$.host.hostname'), json_extract_string(v, '$.host.url')) as dom,
    case when json_type(json_extract(v, '$.entries')) = 'ARRAY' then json_extract(v, '$.entries[*]') end as es from j),
u as (select site_id, host, unnest(es) as e, unnest(range(len(es))) as i from k),
w as (
  select site_id, i, json_type(e) = 'OBJECT' as ok, trim(coalesce(json_extract_string(e, '$.identifier'), '')) as id, host, json_extract(e, '$.url') is not null as hu, json_extract(e, '$.data') is not null as hd, e,
    list_filter(coalesce(json_extract_string(e, '$.capabilities[*]'), []), lambda x: trim(x) <> '') as caps, list_filter(coalesce(json_extract_string(e, '$.tags[*]'), []), lambda x: trim(x) <> '') as tags, coalesce(json_extract_string(e, '$.representativeQueries[*]'), []) as qs,
    coalesce(json_extract_string(e, '$.updated'), json_extract_string(e, '$.updatedAt'), json_extract_string(e, '$.lastUpdated'), '') as upd, regexp_replace(lower(split_part(json_extract_string(e, '$.identifier'), ':', 3)), '^www\\.', '') as pub from u),
x as (
  select site_id, i, case when not coalesce(ok, false) then i || '.object' else array_to_string(list_transform(list_filter([case when id = '' then 'identifier' end, case when id <> '' and not (regexp_matches(id, '^urn:air:[^:]+:.+') and (pub = host or ends_with(pub, '.' || host))) then 'foreign_identifier' end,
    case when coalesce(json_extract_string(e, '$.displayName'), '') = '' then 'display_name' end, case when coalesce(json_extract_string(e, '$.mediaType'), json_extract_string(e, '$.type'), '') = '' then 'media_type' end, case when hu = hd then 'url_or_data' end,
    case when hu and not hd and not regexp_matches(json_extract_string(e, '$.url'), '^https?://[^/?#]') then 'url' end, case when hd and not hu and json_type(json_extract(e, '$.data')) <> 'OBJECT' then 'data' end, case when coalesce(json_extract_string(e, '$.description'), '') = '' then 'description' end,
    case when len(caps) = 0 and len(tags) = 0 then 'capabilities' end, case when len(qs) = 0 or len(list_filter(qs, lambda q: trim(q) = '')) > 0 then 'queries' end, case when not regexp_matches(upd, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'updated' end], lambda c: c is not null), lambda c: i || '.' || c), ' ') end as c from w),
y as (select site_id, string_agg(c, ' ' order by i) filter (c <> '') as ec from x group by 1),
z as (
  select k.site_id, case when t = '' then 'empty' when v is null then 'no_object' else concat_ws(' ', case when ver = '' then 'version' end, case when ver <> '' and not regexp_matches(ver, '^[0-9]+\\.[0-9]+(\\.[0-9]+)?([-+][0-9A-Za-z.-]+)?$') then 'version_shape' end, case when not coalesce(hosted, false) then 'host' end,
    case when hosted and dom is null then 'host_domain' end, case when dom is not null and not (regexp_replace(lower(dom), '^www\\.', '') = host or ends_with(regexp_replace(lower(dom), '^www\\.', ''), '.' || host)) then 'other_host' end, case when es is null then 'entries' end, nullif(ec, '')) end as codes,
    nullif(ver, '') as version, coalesce(len(es), 0)::bigint as entries, coalesce(json_extract(v, '$.trustManifest') is not null or json_extract(v, '$.host.trustManifest') is not null or len(list_filter(es, lambda e: json_extract(e, '$.trustManifest') is not null)) > 0, false) as trusted from k left join y using (site_id))
select site_id, codes = '' as valid, version, entries, trusted, codes from z""",
            "full_catalog",
        ),
        "bot_challenges": (
            f"""with s as (
  select site_id, bot, status, error, regexp_matches(lower(coalesce(html, '')[1:20000] || ' ' || coalesce(headers, '')), 'just a moment|checking your browser|cf-chl|cloudflare ray id|verify you are human|access denied|datadome|perimeterx|akamai bot manager') as marked,
    contains(lower(regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1)), 'captcha') as captcha, regexp_replace(coalesce(html, ''), '(?s)<[^>]*>', ' ', 'g') as t from bot_page),
w as (select *, len(list_filter(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))::bigint as words from s),
b as (select site_id, bool_or(marked) as bm, bool_or(captcha) as bc, max(words) as bw from w where bot = 'browser' group by 1)
select w.site_id, w.bot, words, case when error is not null then 'fetch error' when status in (401, 403, 429, 503) then 'HTTP ' || status
  when (marked or captcha) and not (marked and coalesce(bm, false)) and not (captcha and coalesce(bc, false)) then 'challenge page' when coalesce(bw, 0) >= 80 and words < greatest(20, bw * 0.25) then 'thin response' end as reason from w left join b using (site_id) where w.bot <> 'browser'""",
            "bot_page",
        ),
        "robots_check": (
            f"""with m as ({access}), pts as ({score}), q as ({quality}), c as ({signals}), l as ({lines}),
per as (select site_id, count(*) as tracked, count(*) filter (access like '%blocked') as nb, count(*) filter (access like 'explicit%') as named, count(*) filter (access = 'explicit_allowed') as ne from m group by 1),
g as (select site_id, string_agg(purpose || ': ' || bots, '; ' order by purpose) as blocked from (select site_id, purpose, string_agg(bot, ', ' order by bot) as bots from m where access like '%blocked' group by 1, 2) group by 1),
j as (
  select r.site_id, trim(coalesce(r.body, '')) <> '' as there, coalesce(pts.score, 0) as points, coalesce(penalty, 0) as penalty, coalesce(tracked, 0) as tracked, coalesce(nb, 0) as nb, coalesce(ne, 0) as ne, coalesce(named, 0) as named, coalesce(g.blocked, '') as blocked,
    exists (select 1 from c where c.site_id = r.site_id) as a, exists (select 1 from signal_header h where h.site_id = r.site_id and regexp_matches(lower(coalesce(h.value, '')), 'search|ai-input|ai-train|tdm-reservation')) as b,
    exists (select 1 from l where l.site_id = r.site_id and l.key = 'schemamap') as schema_map
  from robots r left join pts on pts.site_id = r.site_id left join q on q.site_id = r.site_id left join per on per.site_id = r.site_id left join g on g.site_id = r.site_id)
select site_id, (case when there then greatest(least(points + (a or b)::int, 6) - penalty, 0) else 2 + b::int end)::bigint as score,
  case when not there then 'warn' when nb = 0 and ne = tracked and penalty = 0 then 'pass' when tracked > 0 and nb = tracked then 'fail' else 'partial' end as state, case when there then 'inferred' else 'unknown' end as evidence, blocked, named::bigint as named, schema_map from j""",
            "robots", "signal_header", "crawler", "purpose", "access",
        ),
        "sitemap_references": (
            """with s as (select site_id, regexp_split_to_array(coalesce(body, ''), '\\r\\n|\\n|\\r') as l from robots), r as (select site_id, unnest(l) as line, unnest(range(len(l))) as ordinal from s)
select site_id, ordinal::bigint as ordinal, trim(substr(line, instr(line, ':') + 1)) as value from r where contains(line, ':') and lower(trim(split_part(line, ':', 1))) = 'sitemap'""",
            "robots",
        ),
        "text_responses": (
            f"""with t as (select *, {_trim('body')}[1:6000] as t, lower(coalesce(content_type, '')) as k, coalesce(status between 200 and 399, false) as ok from text_fetch),
u as (select *, regexp_matches(lower(t), '^(<!doctype html|<html)') as html, len(regexp_extract_all(t, '{WORD}')) as n from t),
v as (
  select site_id, label, ok, html, not html and (n >= 30 or length(t) >= 200) as meaningful, regexp_matches(k, 'text/(markdown|x-markdown|plain)') as typed, k = '' as untyped, length(t) < 80 as short,
    not html and (starts_with(t, '#') or regexp_matches(t, '\\[[^\\]]+\\]\\([^)]+\\)') or regexp_matches(t, '(?m)^[-*]\\s+\\S') or regexp_matches(t, '(?m)^```') or regexp_matches(t, '(?m)^\\|.+\\|$')) as structured,
    len(list_filter(string_split(lower(coalesce(vary, '')), ','), lambda x: trim(x) in ('accept', '*'))) > 0 as varies from u)
select site_id, label, ok and meaningful and (typed or untyped and structured) as available, structured, {_codes(("not ok", "not_ok"), ("ok and (short or not meaningful and not html)", "too_short"), ("ok and html", "html_body"), ("ok and untyped", "no_content_type"), ("ok and not typed and not untyped", "other_content_type"), ("ok and not varies", "no_vary_accept"))} as codes from v""",
            "text_fetch",
        ),
        "llms_check": (
            f"""with t as (select *, {_trim('llms')} as t from text_site),
v as (select *, llms is not null and length(t) >= 20 and starts_with(t, '#') and (regexp_matches(t, 'https?://[^\\s)>"]+') or regexp_matches(t, '\\[[^\\]]+\\]\\([^)]+\\)')) as valid from t),
s as (select *, (case when not reached then 0 else least(5, case when llms is null then 0 when valid then 2 else 1 end + sitemap_valid::int + has_lastmod::int + in_robots::int + markdown::int) end)::bigint as score from v)
select site_id, score, case when not reached then 'warn' when score >= 4 then 'pass' when score > 0 then 'partial' else 'fail' end as state, case when reached then 'inferred' else 'unknown' end as evidence, valid from s""",
            "text_site",
        ),
        "json_documents": (
            """with j as (select site_id, label, coalesce(status between 200 and 399, false) and regexp_matches(lower(coalesce(content_type, '')), 'json|linkset') as ok, try_cast(body as json) as v, list_filter(string_split(keys, ' '), lambda k: k <> '') as wanted from json_document),
k as (select *, case when json_type(v) = 'OBJECT' then json_keys(v) end as own from j),
l as (select *, json_type(v) = 'OBJECT' and (len(own) = 0 or len(list_filter(own, lambda x: x not in ('error', 'message', 'status', 'code'))) > 0) and (len(wanted) = 0 or len(list_intersect(own, wanted)) > 0) or json_type(v) = 'ARRAY' and len(wanted) = 0 as good from k)
select site_id, label, coalesce(bool_or(ok and coalesce(good, false)), false) as available from l group by 1, 2""",
            "json_document",
        ),
        "auth_texts": (
            f"""with t as (select site_id, coalesce(status between 200 and 399, false) as ok, {_trim('body')} as t from auth_text)
select site_id, bool_or(ok and length(t[1:3000]) >= 20 and (starts_with(t, '#') or contains(lower(t[1:3000]), 'auth') and contains(lower(t[1:3000]), 'agent'))) as available from t group by 1""",
            "auth_text",
        ),
        "agent_links": (
            """with t as (select site_id, unnest(['api-catalog', 'oauth-authorization-server', 'oauth-protected-resource', 'mcp', 'agent', 'webmcp', 'auth.md']) as t, lower(coalesce(value, '')) as v from header where lower(name) = 'link')
select site_id, string_agg(distinct t, ' ' order by t) as tokens from t where contains(v, t) group by 1""",
            "header",
        ),
        "dns_names": (
            """with h as (select site_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]*)', 1)) as h from dns_site),
r as (select site_id, unnest(case when starts_with(h, 'www.') then [h, substr(h, 5)] else [h] end) as r, unnest(range(2)) as i from h where h <> ''),
n as (select site_id, i, r, unnest(['_index._agents', '_a2a._agents', '_mcp._agents']) as p, unnest(range(3)) as k from r where r is not null)
select site_id, (3 * i + k)::bigint as ordinal, p || '.' || r as name from n""",
            "dns_site",
        ),
        "json_feeds": (
            """with j as (select site_id, try_cast(body as json) as v from json_feed),
i as (select site_id, case when json_type(json_extract(v, '$.items')) = 'ARRAY' then json_extract(v, '$.items[*]') end as items from j),
t as (select site_id, items, list_transform(items, lambda x: list_filter([json_extract_string(x, '$.date_modified'), json_extract_string(x, '$.date_published'), json_extract_string(x, '$.updated'), json_extract_string(x, '$.published')], lambda y: trim(y) <> '')) as texts from i),
d as (select *, list_transform(texts, lambda x: list_filter(list_transform(x, lambda y: case when regexp_matches(trim(y), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(trim(y)[1:10] as date) end), lambda z: z <= date '2024-06-01')) as days from t)
select site_id, len(items)::bigint as items, len(list_filter(days, lambda x: len(x) > 0))::bigint as dated, (len(flatten(texts)) - len(flatten(days)))::bigint as faulty, list_max(flatten(days)) as latest from d""",
            "json_feed",
        ),
        "readiness_categories": (
            f"""with r as (select s.site_id, category, label, p.ordinal, {_IN} as i, pp.ordinal is not null as ok from site_scope s cross join probe p left join probe_pass pp on pp.site_id = s.site_id and pp.ordinal = p.ordinal),
c as (select site_id, category, count(*) filter (i and ok) as earned, count(*) filter (i) as most, coalesce(string_agg(label, '; ' order by ordinal) filter (i and ok), '') as passed, coalesce(string_agg(label, '; ' order by ordinal) filter (i and not ok), '') as missing, coalesce(string_agg(label, '; ' order by ordinal) filter (not i), '') as excluded from r group by 1, 2)
select *, (case when most > 0 then round_even(earned / most * 100, 0) else 0 end)::bigint as score from c""",
            "site_scope", "probe_pass", "probe",
        ),
        "scope_keys": ("select site_id, 'p' || protocols::int || '_a' || account_auth::int || '_c' || commerce::int as scope_key, (8 + 6 * protocols::int + 3 * account_auth::int + 4 * commerce::int)::bigint as most from site_scope", "site_scope"),
        "agent_peers": (
            f"""with k as (select distinct protocols, account_auth, commerce from site_scope), l as (select k.*, label from k cross join probe where {_IN}), n as (select distinct name from peer_probe),
r as (select l.protocols, l.account_auth, l.commerce, n.name, count(*) as most, count(*) filter (exists (select 1 from peer_probe x where x.name = n.name and x.label = l.label)) as earned from l cross join n group by 1, 2, 3, 4)
select protocols, account_auth, commerce, name, earned, most, round_even(earned / most * 100, 0)::bigint as percent from r""",
            "peer_probe", "probe", "site_scope",
        ),
        "agent_peer_position": (
            f"""with o as (select s.site_id, protocols, account_auth, commerce, count(*) as most, count(pp.ordinal) as earned from site_scope s cross join probe p left join probe_pass pp on pp.site_id = s.site_id and pp.ordinal = p.ordinal where {_IN} group by 1, 2, 3, 4),
w as (select *, round_even(earned / most * 100, 0)::bigint as score from o), k as (select distinct protocols, account_auth, commerce from site_scope), l as (select k.*, label from k cross join probe where {_IN}), n as (select distinct name from peer_probe),
r as (select l.protocols, l.account_auth, l.commerce, n.name, round_even(count(*) filter (exists (select 1 from peer_probe x where x.name = n.name and x.label = l.label)) / count(*) * 100, 0)::bigint as percent from l cross join n group by 1, 2, 3, 4),
q as (select protocols, account_auth, commerce, list(percent order by percent) as s, round_even(median(percent), 0)::bigint as median from r group by 1, 2, 3),
j as (select site_id, score, round_even(len(list_filter(s, lambda x: x <= score)) / len(s) * 100, 0)::bigint as percentile, median, s[len(s) // 4 + 1] as lo, s[len(s) * 3 // 4 + 1] as hi from w join q using (protocols, account_auth, commerce))
select site_id, score, percentile, median, case when score >= hi then 'top' when score >= median then 'above middle' when score >= lo then 'within middle' else 'below most' end as position from j""",
            "site_scope", "probe_pass", "probe", "peer_probe",
        ),
        "scope_faults": (
            f"""with o as (select f.site_id, f.preset, families, list_filter(string_split(overrides, ' '), lambda x: x <> '') as o from scope_fault f left join preset p on p.preset = f.preset),
k as (select *, list_transform(o, lambda x: split_part(x, '=', 1)) as keys, list_transform(list_filter(o, lambda x: ends_with(x, '=true')), lambda x: split_part(x, '=', 1)) as yes, list_transform(list_filter(o, lambda x: ends_with(x, '=false')), lambda x: split_part(x, '=', 1)) as no from o),
l as (select *, list_filter(list_concat(string_split(coalesce(families, ''), ' '), yes), lambda x: not list_contains(no, x)) as live from k)
select site_id, {_codes(("len(o) > 0 and preset is null", "overrides_without_preset"), ("len(o) > 0 and preset is not null and families is null", "unknown_preset"), (f"families is not null and len(list_filter(keys, lambda x: x not in ({_KNOWN}))) > 0", "unknown_key"),
  ("families is not null and list_contains(yes, 'protocols') and len(list_intersect(live, ['api_catalog', 'mcp', 'a2a', 'agent_skills', 'webmcp'])) = 0", "protocols_without_family"),
  ("families is not null and list_contains(yes, 'account_auth') and len(list_intersect(live, ['oauth_oidc', 'auth_md'])) = 0", "auth_without_family"),
  ("families is not null and list_contains(yes, 'ecommerce') and len(list_intersect(live, ['product_offer_schema', 'commerce_fields'])) = 0", "commerce_without_family"))} as codes from l""",
            "scope_fault", "preset",
        ),
        "public_targets": (
            """select site_id, ip, coalesce(case when ip like '::ffff:%' then not regexp_matches(substr(ip, 8), '^(0|10|127)\\.') when contains(ip, ':') then not regexp_matches(ip, '^(::1?$|fe[89ab]|f[cd]|ff|2001:db8:)')
  else regexp_matches(ip, '^[0-9.]+$') and not regexp_matches(ip, '^(0|10|127)\\.') end, false) as public from target""",
            "target",
        ),
        "bounded_bodies": (
            """with b as (select site_id, coalesce(body, '') as body, range(1, length(coalesce(body, '')) + 1) as r from body)
select site_id, case when strlen(body) > 9 then body[1:coalesce(list_max(list_filter(r, lambda k: strlen(body[1:k]) <= 9)), 0)] else body end as body, strlen(body) > 9 as cut from b""",
            "body",
        ),
    }
    texts = out["text_responses"][0]
    out["text_access"] = (
        f"""with r as ({texts}), k as (select *, case when label = 'negotiated' then '' else label end as o from r)
select site_id, bool_or(available) as available, arg_min(label, o) filter (available) as label, coalesce(arg_min(codes, o), '') as codes from k group by 1""",
        "text_fetch",
    )
    return out
