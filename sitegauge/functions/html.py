"""Column expressions over raw HTML: built-in regular expressions only, so they stay inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Elements whose content is never visible text.
HIDDEN = ("script", "style", "head", "noscript", "template", "svg")
CHROME = ("nav", "header", "footer", "aside")
MAIN = ("main", "article")
LANDMARKS = ("main", "nav", "header", "footer", "article", "section", "aside")
#: Named character references that occur in running text, in the order they are replaced.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
APP_SHELL = ("__NEXT_DATA__", "data-reactroot", "ng-version", "/@vite/", "__NUXT__")
WORD_GAP = r"[ \t\n\r\f]+"


def element(tag: str) -> str:
    """Pattern of an element with its content, up to the first end tag."""
    return rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"


def content_of(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


def opening(tag: str) -> str:
    return rf"(?i)<{tag}(?:\s[^>]*)?>"


def visible_text(markup: Column) -> Column:
    """Text without comments, hidden elements and tags; runs of white space are one blank."""
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->", " ")
    for tag in HIDDEN:
        out = F.regexp_replace(out, element(tag), " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, WORD_GAP, " "))


def words(text: Column) -> Column:
    """Number of words of a text as visible_text() returns it."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("long")


def words_within(markup: Column, tags: tuple[str, ...]) -> Column:
    """Words inside all elements of the given tags."""
    parts = [F.aggregate(F.regexp_extract_all(markup, F.lit(content_of(t)), F.lit(1)), F.lit(0).cast("long"), lambda n, p: n + words(visible_text(p))) for t in tags]
    return sum(parts[1:], parts[0])


def most_words_within(markup: Column, tags: tuple[str, ...]) -> Column:
    """Words of the wordiest element of the given tags; null where there is none."""
    return F.greatest(*[F.array_max(F.transform(F.regexp_extract_all(markup, F.lit(content_of(t)), F.lit(1)), lambda p: words(visible_text(p)))) for t in tags])


def bytes_of_elements(markup: Column, tags: tuple[str, ...]) -> Column:
    parts = [F.aggregate(F.regexp_extract_all(markup, F.lit(element(t)), F.lit(0)), F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p)) for t in tags]
    return sum(parts[1:], parts[0])


def count_tags(markup: Column, tag: str) -> Column:
    return F.regexp_count(markup, F.lit(opening(tag))).cast("long")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """Host and path without query, fragment and closing slash: urls with one key are one page."""
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))
