"""The XML relation: each body as an array of element nodes, one narrow Arrow pass over a real parser; the rules over it are built-in functions.

A node has its place in document order (``pre``), its parent's place (-1 for the root), its depth (0 for the root), its namespace and local name, its own
text before its first child (trimmed; null without), and its children as (space, name, text), in order. A body that is no well-formed
XML, or null or empty, has no nodes: one error anywhere makes all of it none, as for any XML reader. Comments are none of it, CDATA and entities are text like any other.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.runtime import bounded, steps

_KID = pa.struct([("space", pa.string()), ("name", pa.string()), ("text", pa.string())])
_NODE = pa.struct([("pre", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("space", pa.string()), ("name", pa.string()), ("text", pa.string()), ("kids", pa.list_(_KID))])
NODE = "struct<pre:int,parent:int,depth:int,space:string,name:string,text:string,kids:array<struct<space:string,name:string,text:string>>>"


def _split(tag: str) -> tuple[str, str]:
    space, _, name = tag[1:].rpartition("}") if tag[:1] == "{" else ("", "", tag)
    return space, name


def _walk(body: str | None, deepest: int | None = None) -> list[tuple]:
    """The nodes of one body, down to a depth if one is given, each as the fields of ``NODE``; none where it is not well formed."""
    try:
        root = ET.fromstring(body or "")
    except (ET.ParseError, ValueError):
        return []
    names: dict[str, tuple[str, str]] = {}  # a document has few tags and many elements

    def named(e: ET.Element) -> tuple[str, str, str | None]:
        own = names.get(e.tag) or names.setdefault(e.tag, _split(e.tag))
        return *own, (e.text or "").strip() or None

    out, todo = [], [(root, -1, 0, named(root))]
    while todo:
        e, parent, depth, own = todo.pop()
        pre, kids = len(out), []
        if len(e):
            kids = [named(k) for k in e]
            if deepest is None or depth < deepest:
                todo += [(k, pre, depth + 1, x) for k, x in zip(reversed(e), reversed(kids), strict=True)]
        out.append((pre, parent, depth, *own, kids))
    return out


def parse(body: str | None) -> list[dict]:
    """The nodes of one body; none where it is not well formed."""
    named = [f.name for f in _KID]
    return [dict(zip((f.name for f in _NODE), n, strict=True)) | {"kids": [dict(zip(named, k, strict=True)) for k in n[-1]]} for n in _walk(body)]


def _lists(lists: list[list[tuple]], kind: pa.StructType, inner: list[pa.Array] | None = None) -> pa.ListArray:
    """Lists of structs, column by column; ``inner``: the last columns, made already."""
    flat = [x for part in lists for x in part]
    columns = [*zip(*flat, strict=True)] if flat else [()] * len(kind)
    inner = inner or []
    arrays = [pa.array(c, f.type) for c, f in zip(columns[: len(kind) - len(inner)], kind, strict=False)] + inner
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind)))


def nodes_of(bodies: list[str | None], deepest: int | None = None) -> pa.ListArray:
    """The nodes of each body, as a column."""
    found = [_walk(b, deepest) for b in bodies]
    return _lists(found, _NODE, [_lists([n[-1] for nodes in found for n in nodes], _KID)])


def xml(rows: DataFrame, body_col: str = "body", deepest: int | None = None) -> DataFrame:
    """``rows`` with ``xml_nodes`` (array of ``NODE``) in place of the body. Repeated rows give a row each.

    With ``deepest`` the nodes below that depth are left out (the children of the deepest still stand in their ``kids``), and ``pre`` counts the others. A task holds the nodes of one step of bodies at a time.
    """
    bounded(rows.sparkSession)
    others = [c for c in rows.columns if c != body_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[F.col(f"`{c}`") for c in others]).schema.fields)

    def run(batches):
        for batch in (part for whole in batches for part in steps(whole, pc.fill_null(pc.binary_length(whole.column(len(others))), 0).to_pylist())):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nodes_of(batch.column(len(others)).to_pylist(), deepest)], names=[*others, "xml_nodes"])

    return rows.select(*[F.col(f"`{c}`") for c in others], body_col).mapInArrow(run, f"{fields}, xml_nodes array<{NODE}>")


def root(nodes: str | Column = "xml_nodes") -> Column:
    """The root's local name; null where there is no XML."""
    return F.get(nodes, F.lit(0))["name"]


def below(depth: int, *names: str, nodes: str | Column = "xml_nodes") -> Column:
    """The nodes of a depth with one of the local names."""
    return F.filter(nodes, lambda n: (n["depth"] == depth) & n["name"].isin(*names))


def child_text(node: Column, name: str, space: str) -> Column:
    """The text of a node's first child of that name in the namespace, or if there is none of the first in no namespace."""
    own = F.filter(node["kids"], lambda k: (k["name"] == name) & k["space"].isin(space, ""))
    return F.coalesce(F.get(F.filter(own, lambda k: k["space"] == space), F.lit(0)), F.get(own, F.lit(0)))["text"]
