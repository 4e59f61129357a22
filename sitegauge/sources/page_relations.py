"""The evidence that pages hold, as the relations of the operators, over whole tables; with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.html import host

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
_GAP = r"[ \t\n\r\f]"
_A = rf"(?is)<a{_GAP}[^>]*href{_GAP}*={_GAP}*[^>]*>.*?</a{_GAP}*>"
_HREF = rf"""(?is)^<a{_GAP}[^>]*?href{_GAP}*={_GAP}*["']?([^"' \t\n\r\f>]*)"""
_META = rf"(?is)<meta{_GAP}[^>]*>"
_VIEWPORT = rf"""(?is){_GAP}name{_GAP}*={_GAP}*["']?viewport["' \t\n\r\f/>]"""
_CONTENT = rf"""(?is){_GAP}content{_GAP}*={_GAP}*(?:"([^"]*)"|'([^']*)')"""
_LD = rf"""(?is)<script{_GAP}[^>]*application/ld\+json[^>]*>(.*?)</script{_GAP}*>"""


def urls(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("site_id"), "url")


def links(pages: DataFrame) -> DataFrame:
    """Every anchor with a target, its href made absolute; the site is the page's host."""
    rows = pages.select(host(F.col("url")).alias("site_id"), F.explode(F.regexp_extract_all("html", F.lit(_A), F.lit(0))).alias("a"))
    h = F.regexp_extract("a", _HREF, 1)
    rows = rows.select("site_id", h.alias("h"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), f"{_GAP}+", " ")).alias("label"))
    there = rows.where("site_id <> '' and h <> ''").where(~F.col("h").rlike("(?i)^(#|mailto:|tel:|javascript:|data:)"))
    base = F.concat(F.lit("https://"), F.col("site_id"))
    whole = F.when(F.col("h").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("h")).when(F.startswith("h", F.lit("//")), F.concat(F.lit("https:"), "h"))
    return there.select("site_id", whole.when(F.startswith("h", F.lit("/")), F.concat(base, "h")).otherwise(F.concat(base, F.lit("/"), "h")).alias("href"), "label")


def forms(pages: DataFrame) -> DataFrame:
    return pages.select(host(F.col("url")).alias("site_id"), "html")


def viewports(pages: DataFrame) -> DataFrame:
    """The content of each page's first viewport tag; empty where there is none."""
    tag = F.get(F.filter(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda t: t.rlike(_VIEWPORT)), F.lit(0))
    return pages.select(F.col("page_id").alias("site_id"), F.coalesce(F.concat(F.regexp_extract(tag, _CONTENT, 1), F.regexp_extract(tag, _CONTENT, 2)), F.lit("")).alias("content"))


def scripts(pages: DataFrame) -> DataFrame:
    """The JSON-LD scripts of every page, numbered from 1."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(_LD), F.lit(1))).alias("k", "body")
    return pages.select(F.col("page_id").alias("site_id"), found).select("site_id", (F.col("k") + 1).cast("long").alias("script_no"), "body")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The same relations in SQL, by the names the operators' SQL uses.
SQL = {
    "url": "select page_id as site_id, url from pages",
    "link": f"""select site_id, case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') then h when starts_with(h, '//') then 'https:' || h when starts_with(h, '/') then 'https://' || site_id || h else 'https://' || site_id || '/' || h end as href, label
  from (select site_id, regexp_extract(a, {_q(_HREF)}, 1) as h, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '{_GAP}+', ' ', 'g')) as label
    from (select {_HOST} as site_id, unnest(regexp_extract_all(html, {_q(_A)})) as a from pages))
  where site_id <> '' and h <> '' and not regexp_matches(h, '(?i)^(#|mailto:|tel:|javascript:|data:)')""",
    "form_page": f"select {_HOST} as site_id, html from pages",
    "viewport": f"""select site_id, coalesce(regexp_extract(t, {_q(_CONTENT)}, 1) || regexp_extract(t, {_q(_CONTENT)}, 2), '') as content
  from (select page_id as site_id, list_filter(regexp_extract_all(html, {_q(_META)}), lambda t: regexp_matches(t, {_q(_VIEWPORT)}))[1] as t from pages)""",
    "json_ld": f"select site_id, k as script_no, b[k] as body from (select site_id, b, unnest(range(1, len(b) + 1)) as k from (select page_id as site_id, regexp_extract_all(html, {_q(_LD)}, 1) as b from pages))",
}
