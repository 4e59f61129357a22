"""Operators over running text (doc_id, text): Markdown body quality, token coverage, stale years and placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import tokens

from .site_search import LEAST_LEFT, LEAST_RIGHT, LOW_OVERLAP, STOPWORDS, WORD

#: Fixed values.
BOILERPLATE = ("all rights reserved", "we use cookies", "lorem ipsum", "coming soon")
SAMPLE, SHORT, LEAST_WORDS, LEAST_CHARS = 6000, 80, 30, 200


def markdown_quality(docs: DataFrame) -> DataFrame:
    """Whether each text would do as a Markdown body, judged on its first ``SAMPLE`` characters without outer white space: words or
    characters enough, no HTML, and marks of structure (title, link, list, code fence, table). A null text is empty; repeated rows give a row each."""
    t = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), 1, SAMPLE)
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0)))
    html = F.lower(t).rlike("^(<!doctype html|<html)")
    marks = F.startswith(t, F.lit("#")) | t.rlike(r"\[[^\]]+\]\([^)]+\)") | t.rlike(r"(?dm)^[-*]\s+\S") | t.rlike(r"(?dm)^```") | t.rlike(r"(?dm)^\|.+\|$")
    meaningful = ~html & ((words >= LEAST_WORDS) | (F.length(t) >= LEAST_CHARS))
    return docs.select("doc_id", words.cast("long").alias("words"), F.length(t).cast("long").alias("chars"), html.alias("is_html"), (marks & ~html).alias("structured"), meaningful.alias("meaningful"), ((F.length(t) < SHORT) | (~meaningful & ~html)).alias("too_short"))


def opening_coverage(docs: DataFrame) -> DataFrame:
    """The share of the first line's tokens that the rest of the text has; null where either has too few. Texts of one line have no row."""
    t = F.coalesce("text", F.lit(""))
    first, rest = F.substring_index(t, "\n", 1), F.expr("substring(coalesce(text, ''), instr(coalesce(text, ''), '\n') + 1)")
    d = docs.where(F.instr(t, "\n") > 0).select("doc_id", *[tokens(c, WORD, 2, STOPWORDS).alias(n) for c, n in ((first, "l"), (rest, "r"))])
    enough = (F.size("l") >= LEAST_LEFT) & (F.size("r") >= LEAST_RIGHT)
    coverage = F.when(enough, F.round(F.size(F.array_intersect("l", "r")) / F.size("l"), 6))
    return d.select("doc_id", F.size("l").cast("long").alias("left_tokens"), F.size("r").cast("long").alias("right_tokens"), coverage.alias("coverage"), (coverage < LOW_OVERLAP).alias("low"))


def flags_by_source(docs: DataFrame) -> DataFrame:
    """Per source: texts, texts with boilerplate phrases, with years, and the latest year named."""
    low = F.lower(F.coalesce("text", F.lit("")))
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    years = F.transform(F.regexp_extract_all(low, F.lit("(?:^|[^0-9a-z])((?:19|20)[0-9]{2})(?:[^0-9a-z]|$)"), F.lit(1)), lambda y: y.cast("long"))
    d = docs.select("source", phrase.alias("phrase"), F.array_max(years).alias("year"))
    return d.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("phrase").alias("boilerplate"), F.count("year").alias("dated"), F.max("year").alias("latest"))
