"""DuckDB SQL for the operators over recorded responses, from the facts that the responses' documents were made of (sources/fetches.py)."""

from __future__ import annotations

import re

from sitegauge.sources.evidence import PAGES_SQL
from sitegauge.sources.fetches import _CHILDREN, _HOST, _NAMED, CRAWL_SQL, DOWN, DOWN_AT, MAPS_SQL, _turned_sql
from sitegauge.sources.fixtures import sites_of, with_relations

_NORM = "regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', '')"
_OWN = "regexp_replace(lower(regexp_extract({0}, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '')"

SQL = {
    "sitemap_sample": f"""with recursive {CRAWL_SQL},
e as (select site_id, count(*) as urls, count(*) - count(distinct e.loc) as duplicates, count(*) filter ({_OWN.format('e.loc')} = {_OWN.format('root')}) as same_site, count(*) filter (not starts_with(e.loc, 'https:')) as non_https, count(e.lastmod) as dated
  from (select site_id, root, unnest(entries) as e from crawled) group by 1),
s as (select c.site_id, files::bigint as files, is_index, invalid::bigint as invalid_files, named, coalesce(urls, 0) as urls, coalesce(duplicates, 0) as duplicates, coalesce(same_site, 0) as same_site, coalesce(non_https, 0) as non_https, coalesce(dated, 0) as dated,
  missing as undated, bad as bad_dates, future as future_dates from crawled c left join e using (site_id))
select *, urls > 0 and same_site = urls and non_https = 0 and duplicates = 0 as clean from s""",
    "sitemap_pages": f"""with recursive {CRAWL_SQL}, e as (select site_id, unnest(entries[1:5]) as e, unnest(range(least(len(entries), 5))) as place from crawled) select site_id, place::bigint as place, e.loc as loc, e.lastmod as lastmod from e""",
    "best_sitemap": f"""with recursive {MAPS_SQL}, c as (select site_id, unnest(files) as f, unnest(range(len(files))) as k from picked),
b as (select c.site_id, arg_max({{'n': m.n, 'dated': m.dated, 'is_index': m.is_index}}, m.n * 100 - c.k) as x from c join map m using (site_id, f) where m.valid group by 1)
select p.site_id, coalesce(x.n, 0) > 0 as valid, coalesce(x.n, 0)::bigint as urls, coalesce(x.dated, false) as dated, coalesce(x.is_index, false) as is_index, named as in_robots from picked p left join b using (site_id)""",
    "sitemap_entries": f"""with recursive {MAPS_SQL}
select e.site_id, e.root || e.path as url, false as is_index, j::bigint as ordinal, loc, m as lastmod from map_entry e
union all select site_id, root || case f when 1 then '/sitemap.xml' else '/index.xml' end, true, unnest(range(len(v)))::bigint, unnest(v), null from (
  select site_id, root, f, case when f = 1 then {_turned_sql(_CHILDREN[1], 'k % 4', False)} else {_turned_sql(_CHILDREN[4], 'k % 5', False)} end as v from map_file where kind = 'index')""",
}


def _own(sql: str, relations: tuple[str, ...]) -> str:
    """The SQL of an operator over literal relations, each dealt by its own number of sites, with the robots bodies as the responses have them."""
    text = with_relations(sql, *relations)
    for r in relations:
        dealt_ = re.search(rf"(?<![a-z_]){r} as \(select p\.page_id as site_id, l\.\* exclude \(site_id\) from pages p join literal_{r} l on l\.site_id = p\.page_id % \d+ \+ 1 where p\.page_id is not null\)", text)
        if dealt_:
            plain = dealt_[0].replace(re.search(r"% \d+ \+ 1", dealt_[0])[0], f"% {sites_of(r)} + 1")
            if r == "robots":
                names = _turned_sql(_NAMED, "((abs(page_id) * 5) % 6)", False).replace("root ||", "'https://p' || page_id || '.' || coalesce(" + _HOST + ", 'none.example') ||")
                plain = (
                    f"all_{plain}, robots as (select r.site_id, case when abs(r.site_id) % 12 <> 7 then regexp_replace(body, 'Sitemap:[^\\n]*', '', 'g') || chr(10) || array_to_string(list_transform({names}[1:abs(page_id) % 7], lambda x: 'Sitemap: ' || x), chr(10)) end as body "
                    "from all_robots r join (select page_id, min(url) as url from pages group by 1) p on p.page_id = r.site_id)"
                )
            elif r == "signal_header":
                plain = plain[:-1] + f" and abs(p.page_id) % {DOWN} <> {DOWN_AT})"
            text = text.replace(dealt_[0], plain)
    return text


def audit(raw: dict[str, str], pages: dict[str, str], literal: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The SQL of the whole audit from that of its checks: each over its own evidence, joined to the rubric with fallback rows."""
    sub = {n: _own(sql, names) for n, (sql, *names) in literal.items()}
    up = f"abs(page_id) % {DOWN} <> {DOWN_AT}"
    on_page = {"html_structure": ("html_structure", "'inferred'"), "schema_ld": ("structured_data", "'inferred'"), "pagespeed": ("crawl_efficiency", "'inferred'"), "indexing": ("indexing_directives", "'inferred'"), "social": ("entity_coherence", "'verified'")}
    only_up = f"page_id is not null and {up}"
    reached = {n: sql.replace(PAGES_SQL, PAGES_SQL.rstrip()[:-1] + f" where {only_up})") for n, sql in pages.items()}
    blurbs = [c for c in ("no_title", "no_description", "no_h1", "no_canonical", "no_main", "short", "long", "placeholder", "bad_canonical", "off_host", "not_self", "low_overlap", "stale_year", "social_differs", "same_description", "same_title", "collisions")]
    checks = {
        "robots_txt": f"select site_id, score, state, evidence from ({sub['robots_check']})",
        "bot_access": f"select site_id, round_even(count(*) filter (reason is null) / count(*) * 6, 0)::bigint as score, case when count(reason) = 0 then 'pass' when count(reason) < count(*) then 'partial' else 'fail' end as state, 'inferred' as evidence from ({sub['bot_challenges']}) group by 1",
        **{name: f"select page_id as site_id, score, state, {evidence} as evidence from ({reached[q]})" for name, (q, evidence) in on_page.items()},
        "ssr": f"with {PAGES_SQL}, shown as (select * from evidence where {only_up}) select page_id as site_id, score, state, case when state = 'pass' then 'verified' else 'inferred' end as evidence from ({raw['ssr_readability'].replace('from pages', 'from shown')})",
        "wikipedia": f"select site_id, score, state, evidence from ({sub['entity_lookup_score']})",
        "machine_surfaces": f"select site_id, score, state, 'verified' as evidence from ({sub['surface_check']})",
        "llms_txt": f"""with l as (select page_id as site_id, llms from pages p join ({with_relations('select * from literal_text_site', 'text_site')}) t on t.site_id = abs(page_id) % {sites_of('text_site')} + 1),
  x as (select l.site_id, regexp_replace(coalesce(llms, ''), '^\\s+|\\s+$', '', 'g') as t, llms is not null as there, b.valid, b.dated, b.in_robots, coalesce(m.available, false) as markdown
    from l join ({SQL['best_sitemap']}) b using (site_id) left join ({sub['text_access']}) m using (site_id)),
  y as (select site_id, least(5, case when not there then 0 when length(t) >= 20 and starts_with(t, '#') and (regexp_matches(t, 'https?://[^\\s)>"]+') or regexp_matches(t, '\\[[^\\]]+\\]\\([^)]+\\)')) then 2 else 1 end + valid::int + dated::int + in_robots::int + markdown::int)::bigint as score from x)
  select site_id, score, case when score >= 4 then 'pass' when score > 0 then 'partial' else 'fail' end as state, 'inferred' as evidence from y""",
        "canonical": f"""with c as (select page_id, canonical, url from ({reached['canonical_links']}) join (select page_id, min(url) as url from pages group by 1) using (page_id)),
  x as (select page_id as site_id, (abs(page_id) % 3 = 0)::int + (canonical is null or {_NORM.format('canonical')} <> {_NORM.format('url')})::int + (abs(page_id) % 4 = 1)::int as n from c)
  select site_id, (case n when 0 then 5 when 1 then 3 else 1 end)::bigint as score, case n when 0 then 'pass' when 1 then 'partial' else 'fail' end as state, 'verified' as evidence from x""",
        "search_discovery": f"""with a as (select distinct site_id from ({sub['robots_access_matrix']}) where bot in ('Googlebot', 'Bingbot') and access like '%blocked'),
  m as (select site_id, urls > 0 as valid, urls > 0 and dated / greatest(urls, 1) >= 0.8 and bad_dates = 0 and future_dates = 0 as good, clean from ({SQL['sitemap_sample']})), f as (select page_id as site_id, available from ({reached['freshness_signals']})),
  h as (select page_id as site_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host from pages where {only_up}),
  g as (select h.site_id, coalesce(s.ok, false) as metadata_ok, coalesce({' + '.join('b.' + c for c in blurbs)} = 0, false) as blurbs_ok, coalesce(t.ok, false) as trust_ok from h left join ({reached['sampled_metadata']}) s using (host) left join ({reached['blurb_issues']}) b using (host) left join ({reached['trust_pages']}) t using (host)),
  x as (select m.site_id, (a.site_id is null)::int + m.valid::int + (m.valid and m.good or coalesce(f.available, false))::int + (m.valid and m.clean and coalesce(metadata_ok, false) and coalesce(blurbs_ok, false))::int as p, coalesce(trust_ok, false) as trust_ok
    from m left join a using (site_id) left join f using (site_id) left join g using (site_id)),
  y as (select site_id, (case when trust_ok then p else least(p, 3) end)::bigint as score from x)
  select site_id, score, case when score = 4 then 'pass' when score > 0 then 'partial' else 'warn' end as state, 'inferred' as evidence from y""",
    }
    found = "\nunion all ".join(f"select site_id, '{name}' as check_name, score, state, evidence from ({sql})" for name, sql in checks.items())
    rows = with_relations(
        f"""with found as ({found}), sites as (select distinct page_id as site_id from pages where page_id is not null)
select s.site_id, pillar, r.check_name, coalesce(score, 0)::bigint as score, max_score, coalesce(state, 'warn') as state, coalesce(evidence, 'unknown') as evidence from sites s cross join rubric r left join found f on f.site_id = s.site_id and f.check_name = r.check_name""",
        "rubric",
    )
    scores = f"""with rows_ as ({rows}), p as (
  select site_id, sum(score)::bigint as overall, count(*) filter (evidence = 'unknown') as unknown_checks, round_even(coalesce(sum(score) filter (evidence <> 'unknown') / sum(max_score) filter (evidence <> 'unknown') * 100, 0), 0)::bigint as percent from rows_ group by 1),
c as (select percent, sum(count(*)) over (order by percent) / sum(count(*)) over () as upto from p group by 1)
select site_id, overall, unknown_checks, p.percent, round_even(upto * 100, 0)::bigint as percentile from p join c using (percent)"""
    ok = "count(*) filter (status between 200 and 399)"
    asked = f"""with recursive {MAPS_SQL},
parts as (
  select bot as agent, {ok} as answers, 0 as moved from bot_page group by 1 union all select 'markdown', {ok}, 0 from text_fetch union all select 'lookup', {ok}, 0 from lookup
  union all select 'auditor', {ok}, 0 from surface_fetch union all select 'auditor', count(llms), 0 from text_site
  union all select 'auditor', count(*) filter (k % {DOWN} <> {DOWN_AT}) + count(*) filter (k % 12 <> 7) + count(*) + count(*) filter (k % 4 <> 2), count(*) filter (k % {DOWN} <> {DOWN_AT}) + count(*) filter (k % 3 <> 0) + count(*) filter (k % 4 in (0, 3)) from site
  union all select 'auditor', count(*), count(*) filter (url <> final_url) from map where ok)
select agent, sum(answers)::bigint as answers, sum(moved)::bigint as moved from parts group by 1 having sum(answers) > 0"""
    return {"audit_rows": rows, "fetched_audit": scores, "recorded_responses": _own(asked, ("bot_page", "text_fetch", "lookup", "surface_fetch", "text_site"))}
