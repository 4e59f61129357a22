"""URL filter: path rules, and a character language-model ratio for the urls that no rule decides.

Method: urls that a rule allows or blocks are the accepted and the rejected sample, all of them. For each, an
interpolated (Witten-Bell) Markov model of order two, one and zero is counted over ``ALPHABET``; the table of log ratios
of the two models has 40^3 entries whatever the input. A url's score is its summed log ratio over its
characters, divided by their number, in bins of a hundredth; the models are counted on half of the samples, and the threshold is the
middle of the bins that separate the other half with the least sum of error rates. Only DataFrame functions are used: the counts are summed before the one
shuffle, the table (of fixed size) reaches the scan as a constant and the threshold as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (verdict, host and path): the longest that fits decides.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-~"  # the last stands for any other
SIZE = len(ALPHABET)
BINS = 2000  # scores are held within that many hundredths either way
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = F.endswith(F.concat(F.lit("."), host), F.lit("." + rule[:at])) & F.startswith(path, F.lit(rule[at:]))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Numbers of all three-character strings of host and path, which follow two ``/``."""
    text = F.regexp_replace(F.translate(F.concat(host, path), _UPPER, _LOWER), r"(?s:[^a-z0-9/.\-])", "~")
    text = F.concat(F.lit("//"), text)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.greatest(F.length(text) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * SIZE * SIZE + b * SIZE)
    return F.zip_with(pairs, F.slice(codes, F.lit(3), n), lambda ab, c: ab + c)


def _log_model(counts: DataFrame, n: str) -> Column:
    """ln P(c | a, b) by windows over the dense table with columns a, b, c and the count ``n``."""

    def total(*by: str) -> Column:
        return F.sum(n).over(Window.partitionBy(*by))

    one = (total("c") + F.lit(0.5)) / (total("all") + F.lit(0.5 * SIZE))
    seen_b = F.sum(F.when((F.col("a") == 0) & (F.col(f"{n}2") > 0), 1).otherwise(0)).over(Window.partitionBy("b"))
    two = (F.col(f"{n}2") + seen_b * one) / F.when(total("b") + seen_b > 0, total("b") + seen_b)
    two = F.coalesce(two, one)
    seen_ab = F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).over(Window.partitionBy("a", "b"))
    three = F.coalesce((F.col(n) + seen_ab * two) / F.when(total("a", "b") + seen_ab > 0, total("a", "b") + seen_ab), two)
    return F.log(three)


def ratio_table(labelled: DataFrame) -> DataFrame:
    """One row: ``model``, the log ratios (allow over block, in millionths) of all three-character strings; null without both samples."""
    spark = labelled.sparkSession
    counts = labelled.select("label", F.explode("grams").alias("g")).groupBy("g").agg(
        F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("x"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("y")
    )
    dense = spark.range(SIZE**3).select(F.col("id").cast("int").alias("g")).join(counts, "g", "left")
    dense = dense.select(
        "g", F.floor(F.col("g") / SIZE**2).alias("a"), (F.floor(F.col("g") / SIZE) % SIZE).alias("b"), (F.col("g") % SIZE).alias("c"), F.lit(0).alias("all"),
        F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"),
    )
    by = Window.partitionBy("b", "c")
    dense = dense.withColumns({"x2": F.sum("x").over(by), "y2": F.sum("y").over(by)})
    d = F.round((_log_model(dense, "x") - _log_model(dense, "y")) * 1_000_000).cast("long")
    table = dense.select("g", d.alias("d"), "x", "y").groupBy().agg(
        F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda s: s["d"]).alias("model"), F.sum("x").alias("x"), F.sum("y").alias("y")
    )
    return table.select(F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("model")).alias("model"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score_bin (null where a rule decides or nothing was learned).

    The models are counted on the half of the rule-decided urls whose digest begins with an even digit, the threshold is that of the least sum of
    both error rates on the other half. A null url, or one without ``://``, has empty host and path. A url without a character to score, or any when one of
    the samples is empty in either half, is allowed. Null ids stay null, repeated rows give a row each and count each in the
    models; other columns play no part.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # equal urls are in one half, so what calibrates the threshold was not counted by the models
    half = F.instr(F.lit("02468ace"), F.substring(F.md5(F.concat("host", "path")), 1, 1)) == 0
    rows = rows.select("id", "host", "path", name.alias("rule"), verdict.alias("label"), half.alias("held"), grams(F.col("host"), F.col("path")).alias("grams"))
    table = ratio_table(rows.where("label is not null and not held")).select(F.array_join("model", ",")).first()[0]  # 40^3 numbers
    model = F.split(F.lit(table), ",").cast("array<bigint>")  # folded into one constant
    mean = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + F.element_at(model, g + 1)) / F.size("grams")
    bin_ = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(mean / 10_000))).cast("int")
    scored = rows.select("id", "host", "path", "rule", "label", "held", F.when(F.size("grams") > 0, bin_).alias("bin"))
    known = scored.where("label is not null and held and bin is not null").groupBy("bin").agg(
        F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("x"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("y")
    )
    below = Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over bins, not rows
    whole = Window.partitionBy()
    wrong = F.coalesce(F.sum("x").over(below), F.lit(0)) / F.sum("x").over(whole) + (F.sum("y").over(whole) - F.coalesce(F.sum("y").over(below), F.lit(0))) / F.sum("y").over(whole)
    # every threshold above the bin before and up to this one errs alike: the middle is taken
    before = F.lag("bin").over(Window.partitionBy().orderBy("bin"))
    middle = F.coalesce(F.floor((before + F.col("bin") + 1) / 2).cast("int"), F.col("bin"))
    threshold = known.select("bin", F.round(wrong, 9).alias("wrong"), middle.alias("middle")).agg(F.min(F.struct("wrong", "bin", "middle"))["middle"].alias("t")).scalar()
    verdict = F.when(F.coalesce(F.col("bin") < threshold, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("label", verdict).alias("verdict"), F.when(F.col("label").isNull(), F.col("bin")).alias("score_bin")
    )


def judge_sql(rules=RULES) -> str:
    """DuckDB SQL for the rows of judge() over the table ``pages``."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    fits = {r: f"ends_with('.' || host, '.{r[: r.index('/')]}') and starts_with(path, '{r[r.index('/'):]}')" for _, r in ordered}
    rule = " ".join(f"when {fits[r]} then '{r}'" for _, r in ordered)
    label = " ".join(f"when {fits[r]} then '{k}'" for k, r in ordered)

    def log_model(n: str) -> str:
        one = f"((sum({n}) over (partition by c) + 0.5::double) / (sum({n}) over () + {0.5 * SIZE}::double))"
        seen_b = f"(sum(case when a = 0 and {n}2 > 0 then 1 else 0 end) over (partition by b))"
        two = f"coalesce(({n}2 + {seen_b} * {one}) / nullif(sum({n}) over (partition by b) + {seen_b}, 0)::double, {one})"
        seen = f"(sum(case when {n} > 0 then 1 else 0 end) over (partition by a, b))"
        return f"ln(coalesce(({n} + {seen} * {two}) / nullif(sum({n}) over (partition by a, b) + {seen}, 0)::double, {two}))"

    return f"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (
  select page_id, host, path, case {rule} end as rule, case {label} end as label,
    '//' || regexp_replace(translate(host || path, '{_UPPER}', '{_LOWER}'), '[^a-z0-9/.\\-]', '~', 'gs') as s, instr('02468ace', md5(host || path)[1]) = 0 as held from u),
g as (
  select page_id, host, path, rule, label, held, case when length(s) > 2 then list_transform(range(1, length(s) - 1), lambda i:
    (instr('{ALPHABET}', s[i]) - 1) * {SIZE**2} + (instr('{ALPHABET}', s[i + 1]) - 1) * {SIZE} + instr('{ALPHABET}', s[i + 2]) - 1) else [] end as grams from r),
e as (select label, unnest(grams) as g from g where label is not null and not held),
counts as (select g, sum(case when label = 'allow' then 1 else 0 end) as x, sum(case when label = 'block' then 1 else 0 end) as y from e group by g),
dense as (
  select i.g, i.g // {SIZE**2} as a, i.g // {SIZE} % {SIZE} as b, i.g % {SIZE} as c, coalesce(x, 0) as x, coalesce(y, 0) as y
  from (select unnest(range({SIZE**3})) as g) i left join counts on counts.g = i.g),
dense2 as (select *, sum(x) over (partition by b, c) as x2, sum(y) over (partition by b, c) as y2 from dense),
ratios as (select g, x, y, round(({log_model('x')} - {log_model('y')}) * 1000000)::bigint as d from dense2),
model as (select case when sum(x) > 0 and sum(y) > 0 then list(d order by g) end as m from ratios),
scored as (
  select page_id, host, path, rule, label, held, case when len(grams) > 0 then
    greatest(-{BINS}, least({BINS}, floor(list_sum(list_transform(grams, lambda k: m[k + 1]))::double / len(grams) / 10000)))::int end as bin from g, model),
bins as (
  select bin, sum(case when label = 'allow' then 1 else 0 end) as x, sum(case when label = 'block' then 1 else 0 end) as y
  from scored where label is not null and held and bin is not null group by bin),
errors as (
  select bin, round(coalesce(sum(x) over w, 0)::double / (sum(x) over ())::double + ((sum(y) over ()) - coalesce(sum(y) over w, 0))::double / (sum(y) over ())::double, 9) as wrong, coalesce(floor((lag(bin) over (order by bin) + bin + 1) / 2)::int, bin) as middle
  from bins window w as (order by bin rows between unbounded preceding and 1 preceding)),
cut as (select (select middle from errors order by wrong, bin limit 1) as t)
select page_id, host, path, rule, coalesce(label, case when coalesce(bin < t, false) then 'block' else 'allow' end) as verdict,
  case when label is null then bin end as score_bin from scored, cut"""
