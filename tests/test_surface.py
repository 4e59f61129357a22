"""Table functions and views: checks in SQL against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import site_checks
from sitegauge.runtime import ship
from sitegauge.sources import surface
from sitegauge.sources.dom import dom, tags
from sitegauge.sources.evidence import evidence_pages

BASE = '<html><head><title>Shop</title></head><body><nav><a href="/a">A</a></nav><article><h1>Head</h1><p>words</p></article><footer>end</footer></body></html>'


@pytest.fixture(scope="module")
def page(spark):
    rows = evidence_pages(spark.createDataFrame([(k, "https://shop.example/", BASE) for k in range(8)] + [(8, None, None), (9, "u", "<![x[")], "page_id long, url string, html string")).cache()
    surface.register(ship(spark), page=rows)
    return rows


def listed(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_structure(spark, page):
    assert listed(spark.sql(surface.STRUCTURE)) == listed(site_checks.html_structure(dom(page)).select("page_id", "h1", "landmarks", "links", "forms"))


def test_structure_joins_nothing(spark, page):
    """No join by the HTML, which would be held whole by the driver; null and repeated numbers, and equal pages, are rows of their number."""
    assert "Join" not in spark.sql(surface.STRUCTURE)._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE), (3, ""), (None, BASE), (None, None)], "page_id long, html string")
    got = spark.sql(surface.STRUCTURE.replace("from page p", "from {rows} p").replace("from page)", "from {rows})"), rows=rows)
    assert listed(got) == [(1, 2, 3, 2, 0), (2, 1, 3, 1, 0), (3, 0, 0, 0, 0), (None, 1, 3, 1, 0)]


def test_form_fields(spark, page):
    nodes = dom(page).select("page_id", "nodes", F.explode(tags("form")).alias("f"))
    kind = lambda n: F.lower(F.coalesce(n["attrs"]["type"], F.lit("text")))
    own = F.filter("nodes", lambda n: n["form"] == F.col("f.pre"))
    fields = F.size(F.filter(own, site_checks._is_field))
    submits = F.size(F.filter(own, lambda n: (n["tag"] == "button") | ((n["tag"] == "input") & kind(n).isin("submit", "image"))))
    want = nodes.groupBy("page_id").agg(F.count("*"), F.sum(fields), F.sum(submits))
    assert listed(spark.sql(surface.FORM_FIELDS)) == listed(want) and want.count() >= 2


def test_schema_types(spark, page):
    objects = site_checks.with_json_ld(dom(page)).select("page_id", F.explode(F.filter("objects", lambda o: o["top"])).alias("o")).select("page_id", F.explode("o.raw_types").alias("t"))
    want = listed(objects.groupBy("page_id", "t").count())
    assert listed(spark.sql(surface.SCHEMA_TYPES)) == want and len(want) >= 5


def test_rows_of_nothing(spark, page):
    assert spark.sql("select * from dom_nodes(null)").count() == spark.sql("select * from dom_nodes('<![x[')").count() == spark.sql("select * from ld_objects(null)").count() == spark.sql("select * from xml_nodes('<a>')").count() == 0
    assert listed(spark.sql("select name, depth from xml_nodes('<a><b/>t</a>')")) == [("a", 0), ("b", 1)]
