import random

import duckdb

from sitegauge.llm.common import prepare
from sitegauge.llm.urls import judge, judge_sql


def compare(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = judge(df).toPandas()
    pages = df.toPandas()  # noqa: F841
    want = duckdb.sql(f"select * from ({judge_sql()})").df()
    key = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False)))
    norm = lambda f: [x.replace(".0", "") for x in key(f)]
    assert norm(got) == norm(want[list(got.columns)])
    return got


def test_against_sql(spark):
    prepare(spark)
    rng = random.Random(1)
    rows = []
    for i in range(400):
        host = rng.choice(["", "www.", "A.b."]) + rng.choice(["foo", "bar", "example", "xn--q"]) + rng.choice([".com", ".net", ".org"])
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '?q=1', '#x', '.html'])}", "v"))
    rows += [(900, None, "v"), (901, "", "v"), (902, "no scheme", "v"), (903, "x://", None), (904, "a://b://c/en/", "v"), (905, "http://com/en/\nß?", "v"), (None, "http://Q.COM/en/7", "v"), (3, rows[3][1], "v")]
    rows += [(906, "http://example.com?x/en/", "v"), (907, "http://example.com/en/71", "v"), (908, "http://notexample.com/en/71", "v"), (909, "http://a.org/" + "z" * 20000, "v")]
    got = compare(spark, rows).set_index("page_id")
    assert got.rule[907] == "example.com/en/7" and got.verdict[907] == "allow"
    assert got.rule[908] == "com/en/" and got.host[904] == "b:" and got.path[906] == ""
    assert got.host[900] == got.path[902] == "" and got.verdict[900] == "allow"


def test_few(spark):
    compare(spark, [(1, "http://a.fr/x", "v"), (2, None, None)])
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_held_out_urls(spark):
    """Hosts of two makes, each with its own rule: the urls that no rule decides get the verdict of their make, but for a few."""
    prepare(spark)
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        good = rng.random() < 0.5
        host = "".join(rng.choice("aeioulmn" if good else "xzqkwvjy") for _ in range(8)) + (".net" if good else ".com")
        rows.append((i, f"https://{host}/{rng.choice(['de', 'en', 'fr'])}/{''.join(rng.choice('aeioulmn' if good else 'xzqkwvjy') for _ in range(6))}", "v"))
    got = judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    free = [r for r in got if r.rule is None]
    assert len(free) > 700 and sum((r.verdict == "allow") == r.host.endswith(".net") for r in free) / len(free) > 0.97
