"""The SQL surface: pages' elements and JSON-LD objects as table functions, for LATERAL joins, and the relations as temporary views.

After ``register(spark)`` a query can say ``from pages p, lateral dom_nodes(p.html) n`` (a row an element, by ``pre``), ``lateral ld_objects(array_agg(...))`` (a row a typed object) and
``lateral xml_nodes(body)``. A null or empty argument, and one that its parser refuses, has no rows. Containment is a condition on ``pre`` and ``last``, or on ``form`` and ``around``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from . import dom, xml

_NODES = "pre int, last int, parent int, form int, around int, tag string, attrs map<string,string>, text string, words int, shown int, bytes int, pictured boolean, hidden boolean"
_OBJECTS = "no int, top boolean, types array<string>, raw_types array<string>, fields map<string,string>"
_XML = "pre int, parent int, depth int, space string, name string, text string, kids array<struct<space:string,name:string,text:string>>"


@udtf(returnType=_NODES)
class DomNodes:
    """The elements of a page, in order."""

    def eval(self, html: str):
        found, _ = dom._read(html)
        for n in found.nodes:
            yield n["pre"], n["last"], n["parent"], n["form"], n["around"], n["tag"], dict(n["attrs"]), found.text(n), n["words"], n["shown"], n["bytes"], n["pictured"], n["hidden"]


@udtf(returnType=_OBJECTS)
class LdObjects:
    """The typed objects of a page's JSON-LD scripts, given as an array of their texts."""

    def eval(self, bodies: list):
        for o in dom.ld_walk([b or "" for b in bodies or []])["objects"]:
            yield o["no"], o["top"], o["types"], o["raw_types"], dict(o["fields"])


@udtf(returnType=_XML)
class XmlNodes:
    """The elements of an XML document, in order."""

    def eval(self, body: str):
        for n in xml.parse(body):
            yield n["pre"], n["parent"], n["depth"], n["space"], n["name"], n["text"], n["kids"]


def register(spark: SparkSession, **relations: DataFrame) -> SparkSession:
    """Makes the table functions known to the session, and each of ``relations`` a temporary view of its name."""
    for name, function in (("dom_nodes", DomNodes), ("ld_objects", LdObjects), ("xml_nodes", XmlNodes)):
        spark.udtf.register(name, function)
    for name, rows in relations.items():
        rows.createOrReplaceTempView(name)
    return spark


#: Checks as Spark SQL over a view ``page`` (page_id, url, html): they give what the DataFrame operators give. Pages without a node come by a row of their own: a left lateral
#: join would be planned as a join of all nodes by their page's HTML.
STRUCTURE = """
with node as (select p.page_id, n.tag, n.attrs from page p, lateral dom_nodes(p.html) n union all select page_id, null, null from page)
select page_id, count_if(tag = 'h1') as h1, count(distinct case when tag in ('header', 'nav', 'main', 'article', 'section', 'footer', 'aside') then tag end) as landmarks,
  count_if(tag = 'a' and map_contains_key(attrs, 'href')) as links, count_if(tag = 'form') as forms
from node group by page_id"""
FORM_FIELDS = """
with node as (select p.page_id, n.* from page p, lateral dom_nodes(p.html) n)
select f.page_id, count(distinct f.pre) as forms, count_if(n.tag in ('select', 'textarea') or n.tag = 'input' and lower(coalesce(n.attrs['type'], 'text')) not in ('hidden', 'submit', 'button', 'reset', 'image')) as fields,
  count_if(n.tag = 'button' or n.tag = 'input' and lower(coalesce(n.attrs['type'], 'text')) in ('submit', 'image')) as submits
from node f left join node n on n.page_id = f.page_id and n.form = f.pre where f.tag = 'form' group by f.page_id"""
SCHEMA_TYPES = """
with script as (select p.page_id, collect_list(n.text) as bodies from page p, lateral dom_nodes(p.html) n where n.tag = 'script' and n.attrs['type'] = 'application/ld+json' group by p.page_id)
select s.page_id, t.type, count(*) as objects from script s, lateral ld_objects(s.bodies) o, lateral explode(o.raw_types) t(type) where o.top group by s.page_id, t.type"""
