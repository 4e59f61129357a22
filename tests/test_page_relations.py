import duckdb
import pytest

import __spark_entry__ as entry

HTML = """<html><head><meta name="viewport" content="width=device-width, maximum-scale=1"><script type="application/ld+json">{"@type": "Article", "name": "x"}</script></head>
<body><a href="/about-us">About</a> <A class=x href='https://www.instagram.com/shop'>pics</A><a href="#top">Contact</a><a href="help/faq">?</a><form method="get"><input name="q"></form></body></html>"""


@pytest.mark.parametrize("name", sorted(n for n in entry.SQL if n.startswith("page_")))
def test_whole_table(spark, tmp_path, name):
    """Every page of the table counts, in the operator as in its SQL; the literal rows play no part."""
    rows = [(i, f"https://S{i % 3}.example/p/{i}?x={i}", HTML) for i in range(30)] + [(30, None, None), (31, "", "<p>plain"), (None, "http://s1.example:80/", HTML)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(entry.SQL[name])
    got = entry.QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    found = sorted(map(tuple, got.select(*want.columns).collect()), key=str)
    assert found == sorted(want.fetchall(), key=str)
    if name in ("page_trust_surfaces", "page_social_profiles", "page_form_affordances"):
        assert sum(r[1] if name == "page_form_affordances" else r[2] for r in found if "example" in r[0]) >= 31
    else:
        assert len(found) >= 31
