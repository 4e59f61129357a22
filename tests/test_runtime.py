"""Steps of Arrow batches: all rows once, in order, however long they are; what the Python passes hold at a time."""

import pyarrow as pa
import pytest

from sitegauge.operators import site_checks
from sitegauge.runtime import steps
from sitegauge.sources import dom as D
from sitegauge.sources import xml as X


@pytest.mark.parametrize("sizes", [[], [0], [9], [1, 1, 9, 1, 0, 4, 1], [0] * 7, [5, 5, 5], [2, 2, 2, 2]])
def test_steps(sizes):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64())], names=["k"])
    parts = [p.column(0).to_pylist() for p in steps(batch, iter(sizes), most=5, rows=4)]
    assert [k for p in parts for k in p] == list(range(len(sizes))) and all(parts) or not sizes
    assert all(len(p) == 1 or len(p) <= 4 and sum(sizes[k] for k in p) <= 5 for p in parts if p)


def given(name, columns, run):
    """The sizes of the batches that a pass gives for one batch of input: its function is caught where it is handed to Spark."""
    caught = []

    class Frame:
        sparkSession = type("S", (), {"conf": type("C", (), {"set": staticmethod(lambda *a: None)})})
        schema = type("T", (), {"fields": []})

        def __init__(self, *names):
            self.columns = names

        def select(self, *names):
            return Frame(*names)

        def mapInArrow(self, function, schema):  # noqa: N802
            caught.append(function)

    run(Frame(name))
    return [b.num_rows for b in caught[0](iter([pa.RecordBatch.from_arrays([columns], names=[name])]))]


def test_a_pass_holds_one_step():
    """2,000 pages in one batch: their nodes go out in steps, not all at once."""
    page = "<p>word</p>" * 400
    sizes = given("html", pa.array([page] * 1000 + [None] * 1000), D.dom)
    assert sum(sizes) == 2000 and max(sizes) <= 256 and len(sizes) >= 8
    sizes = given("bodies", pa.array([['{"@type": "A"}'] * 300] * 1000 + [None, [], [None]]), D.json_ld)
    assert sum(sizes) == 1003 and max(sizes) <= 256
    sizes = given("body", pa.array(["<a>" + "<b>x</b>" * 2000 + "</a>"] * 300 + [None]), X.xml)
    assert sum(sizes) == 301 and max(sizes) <= 70


def test_rows_are_whole(spark):
    """Steps and batches change no row."""
    rows = [(k, None if k % 7 == 0 else f'<p>{k}</p><script type="application/ld+json">{{"@type": "T{k}"}}</script>' * (k % 40)) for k in range(1200)]
    got = {r.page_id: (len(r.nodes), len(r.objects)) for r in site_checks.with_json_ld(D.dom(spark.createDataFrame(rows, "page_id long, html string").coalesce(1))).collect()}
    assert got == {k: (0, 0) if h is None else (2 * (k % 40), 2 * (k % 40)) for k, h in rows}


def test_xml_columns_and_depth():
    """The nodes as a column are the nodes as dicts; down to a depth they are those of that depth and above, with all their children named."""
    bodies = ['<a xmlns="u"><b> t </b><c x="1">q<d><e>z</e></d></c><b/></a>', None, "", "<a>", "<a/>", '<s:a xmlns:s="v"><s:b><i:c xmlns:i="w">1</i:c></s:b></s:a>']
    column = X.nodes_of(bodies)
    assert column.equals(pa.array([X.parse(b) for b in bodies], column.type)) and X.nodes_of([]).type == column.type
    bare = lambda nodes: [{k: v for k, v in n.items() if k not in ("pre", "parent")} for n in nodes]
    for deepest in (0, 1, 2):
        flat = X.nodes_of(bodies, deepest).to_pylist()
        assert [bare(n) for n in flat] == [bare([x for x in n if x["depth"] <= deepest]) for n in column.to_pylist()]
        assert all(n[x["parent"]]["depth"] == x["depth"] - 1 for n in flat for x in n[1:])
