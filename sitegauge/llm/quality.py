"""Quality rules: line-first cleaning.

Method: every line with a word is judged on its own by punctuation, navigation and boilerplate rules; failing
lines are taken out, and a document that loses more than ``max_loss`` of its word characters this way
is rejected. Base rules on the whole text come first.

Line rules (a line fails on any):
* punctuation: more than a fifth as many symbols ``#*$%&|<>`` as words, or more than half as many ``!`` as
  words from three words on, or no closing mark ``.!?…:;"')»”`` at the end of a line of under five words;
* navigation: two or more of the separators ``|``, ``»``, ``›``, ``•``;
* boilerplate: one of the phrases of ``BOILERPLATE``, lower-cased, in a line of 30 words at most.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES

SYMBOLS = b"#*$%&|<>"
CLOSING = tuple(".!?…:;\"')»”")
SEPARATORS = re.compile("[|»›•]")
#: Phrases of lines that are not content.
BOILERPLATE = re.compile(
    "all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie policy|use of cookies|"
    "enable javascript|lorem ipsum|subscribe to our|sign up for|click here|read more|share this|powered by"
)
MIN_WORDS, MAX_REPEATED, MAX_LOSS = 50, 50, 0.5
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, kept_chars long"


def line_fails(line: str, raw: bytes, n_words: int) -> bool:
    """Whether a line of ``n_words`` (at least one) fails a rule."""
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if 5 * symbols > n_words or n_words >= 3 and 2 * raw.count(b"!") > n_words:
        return True
    if n_words < 5 and not line.rstrip(" \t\r\x0b\x0c").endswith(CLOSING):
        return True
    if len(SEPARATORS.findall(line)) >= 2:
        return True
    return n_words <= 30 and BOILERPLATE.search(line.lower()) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that is found twice or more, its first place included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple] = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    count = last = 0
    for i, w in enumerate(windows):
        if w in twice:
            count += i + 3 - max(i, last)
            last = i + 3
    return count


def judge(text: str, max_loss: float = MAX_LOSS) -> tuple:
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    twice = failed = lost = 0
    for line in text.split("\n"):
        own = line.encode()
        parts = own.split()
        if not parts:
            continue
        if line in seen:
            twice += 1
        seen.add(line)
        if line_fails(line, own, len(parts)):
            failed += 1
            lost += len(line) - (len(own) - len(own.translate(None, SPACES)))
    repeats = repeated_words(words)
    base = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED * len(words)
    kept = not base and lost <= max_loss * chars
    return len(words), chars, symbols, twice, repeats, base, kept, failed, chars - lost


def clean(text: str) -> str:
    """The text without its failing lines; lines without a word stay."""
    out = []
    for line in text.split("\n"):
        own = line.encode()
        n = len(own.split())
        if not n or not line_fails(line, own, n):
            out.append(line)
    return "\n".join(out)


def quality_rules(docs: DataFrame, max_loss: float = MAX_LOSS, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, base_failed, kept, n_failed_lines, kept_chars (and clean_text).

    A null or empty text has no words, fails the base rules and is not kept. Repeated rows give a row each
    and null ids stay null. Other columns play no part. One narrow pass, no shuffle.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = [pa.array(c) for c in zip(*(judge(t, max_loss) for t in texts))] if texts else [pa.array([], pa.bool_() if k.endswith("boolean") else pa.int64()) for k in FIELDS.split(", ")]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            if with_text:
                columns.append(pa.array([clean(t) for t in texts], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}" + ", clean_text string" * with_text)


def quality_sql(max_loss: float = MAX_LOSS) -> str:
    """DuckDB SQL for the rows of quality_rules() over the table ``documents``."""
    word, space = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]"
    closing = "[.!?…:;\"'')»”][ \\t\\r\\x0b\\x0c]*$"
    letters = "length(regexp_replace({0}, '" + space + "', '', 'g'))"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{word}') as words from documents),
lines as (select rid, unnest(string_split(text, chr(10))) as line from d),
worded as (
  select rid, line, len(regexp_extract_all(line, '{word}')) as n, len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols, len(regexp_extract_all(line, '!')) as marks,
    len(regexp_extract_all(line, '{SEPARATORS.pattern}')) as separators, {letters.format('line')} as chars from lines where regexp_matches(line, '{word}')),
judged as (
  select *, 5 * symbols > n or n >= 3 and 2 * marks > n or n < 5 and not regexp_matches(line, '{closing}') or separators >= 2
    or n <= 30 and regexp_matches(lower(line), '{BOILERPLATE.pattern}') as fails from worded),
by_line as (select rid, count(*) - count(distinct line) as twice, count(*) filter (fails) as failed, coalesce(sum(chars) filter (fails), 0) as lost from judged group by 1),
w as (select rid, unnest(words) as a, unnest(range(len(words))) as i from d),
windows as (select rid, i, a, lead(a) over p as b, lead(a, 2) over p as c from w window p as (partition by rid order by i)),
found as (select rid, i, c is not null and count(*) over (partition by rid, a, b, c) > 1 as r from windows),
marked as (select rid, r or coalesce(lag(r) over p, false) or coalesce(lag(r, 2) over p, false) as m from found window p as (partition by rid order by i)),
repeats as (select rid, count(*) filter (m) as n from marked group by 1),
counts as (
  select d.rid, doc_id, len(words)::bigint as n_words, {letters.format('text')}::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(twice, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words, coalesce(failed, 0)::bigint as n_failed_lines, coalesce(lost, 0)::bigint as lost
  from d left join by_line on by_line.rid = d.rid left join repeats on repeats.rid = d.rid),
base as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= {max_loss} * word_chars as kept, n_failed_lines, word_chars - lost as kept_chars from base"""
