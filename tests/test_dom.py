"""The DOM relation: linear on hostile pages, and what stands around a node against a search over the tree."""

import random
import time

import pytest

from sitegauge.operators import site_checks, site_search
from sitegauge.sources.dom import AROUND, NESTED, Dom, dom


@pytest.mark.parametrize(
    "parts",
    [
        ("<span>", "<p>"), ("<a href=x>",), ("<p>",), ("<button><span>",), ("<li><b>",), ("<a href=x><img alt=y>",), ("<form><label>",), ("<div data-x=1>word ",), ("<label>word ",), ("</p></div>",), ("<ul><li>", "</ul>"), ("<table><tr><td>",), ("<",), ("<p hidden>",),
    ],
)
def test_time_is_linear(parts):
    """Four times the page takes about four times as long, sixteen times if pairs were searched; a megabyte takes seconds. CPU time, for the machine may be busy."""

    def took(size):
        html = "".join(p * (size // sum(map(len, parts))) for p in parts)
        began = time.process_time()
        Dom(html)
        return time.process_time() - began

    small, large = took(250_000), took(1_000_000)
    assert large < 9 * max(small, 0.2) and large < 30


def test_around_against_search():
    """Form, label, head, main, article and chrome of every node, from its ancestors."""
    rng = random.Random(4)
    for _ in range(200):
        parts = ["<html><head><meta name=a><link rel=b></head><body>"]
        for _ in range(60):
            t = rng.choice(["form", "label", "main", "article", "nav", "div", "a", "button", "li", "ul", "p", "span", "input", "img"])
            parts.append(rng.choice([f"<{t}>", f"<{t} data-k=1 alt=q>", f"</{t}>", "some words "]))
        nodes = Dom("".join(parts)).nodes
        for n in nodes:
            over = [m for m in nodes if m["pre"] < n["pre"] <= m["last"]]
            assert n["form"] == max((m["pre"] for m in over if m["tag"] == "form"), default=-1)
            assert n["around"] == sum({AROUND[m["tag"]] for m in over if m["tag"] in AROUND})
            assert n["parent"] == max((m["pre"] for m in over), default=-1)
            if n["tag"] in ("a", "button"):
                assert n["pictured"] == any(m["tag"] == "img" and "alt" in dict(m["attrs"]) for m in nodes[n["pre"] + 1 : n["last"] + 1])


def test_anchors_end_anchors():
    nodes = Dom('<a href="/1">one <a href="/2">two</a> <button>x<button>y</button>').nodes
    assert [(n["tag"], n["text"]) for n in nodes] == [("a", "one"), ("a", "two"), ("button", "x"), ("button", "y")]


def test_references_end_in_a_semicolon():
    """Cut and unknown references are text, as the tables' cut titles have them; scripts are as they came, and a page may hold the mark."""
    d = Dom('<title>A&amp;B &amp &amp;amp &ampx; &#38; &eacute;&copy</title><a href="/?a=1&copy=2&amp;b=\ue000" t&amp=1>\ue000&lt</a><script>a&&b&amp;c&lt</script>')
    title, a, script = d.nodes
    assert title["text"] == "A&B &amp &amp &ampx; & é&copy" and script["text"] == "a&&b&amp;c&lt" and script["bytes"] == len("<script>a&&b&amp;c&lt</script>")
    assert dict(a["attrs"]) == {"href": "/?a=1&copy=2&b=\ue000", "t&amp": "1"} and a["text"] == "\ue000&lt" and d.words[-1] == "\ue000&lt"


def test_texts_of_deep_elements():
    nodes = Dom("<label>w" * (NESTED + 5)).nodes
    assert [n["text"] == "" for n in nodes] == [False] * NESTED + [True] * 5


def test_many_fields_and_forms(spark):
    """10,000 fields in 1,000 forms, one of them without a submit: one row each, in seconds."""
    form = "<form action=/s method=get>" + "<label>n<input name=good></label>" * 10
    html = (form + "<button>Go</button></form>") * 999 + form + "</form><form action=/s method=get><input name=q></form>"
    d = dom(spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string"))
    began = time.time()
    got = site_checks.html_structure(d).collect()[0]
    assert got.forms == 1001 and {"form_without_named_submit", "fields_without_label"} <= set(got.codes.split())
    site_search.extraction_readiness(site_checks.with_json_ld(d)).collect()
    assert time.time() - began < 60


def test_no_text_is_lost(monkeypatch):
    """Elements without a copy of their text have it by their place, as if all had copies."""
    rng = random.Random(11)
    for _ in range(100):
        html = "".join(rng.choice(["<div data-k=é>", "<a href=x>", "<button>", "<h1>", "<label>", "<td>", "</div>", "</a>", "</h1>", " é日   two ", "word", "&amp;&lt x", " ", "<script>a<b</script>", "<br data-x>"]) for _ in range(80))
        monkeypatch.setattr("sitegauge.sources.dom.NESTED", 10**9)
        whole = [n["text"] for n in Dom(html).nodes]
        monkeypatch.setattr("sitegauge.sources.dom.NESTED", 2)
        d = Dom(html)
        assert [d.text(n) for n in d.nodes] == whole


def test_deep_elements_count_as_others(spark):
    """What stands in more elements with attributes of their own than have copies of their text is read like what does not."""
    own = "".join(f'<a href="/p{k}">Page number {k}</a> ' for k in range(9)) + '<a href="/x">About us, é</a><a href="/y"><b>Click</b> here</a><button>Buy</button><button> </button><h1>Chair</h1>'
    own += '<title>T</title><script type="application/ld+json">{"@type": "Product", "name": "Chair"}</script><style>@media (min-width: 3em) {}</style><time>2024-05-01</time>'
    pages = [(k, f"https://{k}.example/", f"<div {a}>" * (NESTED + 5) + own, 100, {}) for k, a in ((1, "class=c"), (2, "data-k=1"))]
    d = site_checks.with_json_ld(dom(spark.createDataFrame(pages, "page_id long, url string, html string, elapsed_ms long, headers map<string,string>")))
    for check in (site_checks.html_structure, site_checks.structured_data, site_checks.crawl_efficiency, site_search.freshness, lambda x: site_search.extraction_readiness(x, True).drop("script_share", "html_ratio"), site_search.blurbs, site_search.trust_pages):
        flat, deep = ([str(v).replace("2.example", "1.example") for v in r[1:]] for r in sorted(check(d).collect()))
        assert flat == deep
    got = {r.page_id: r for r in site_checks.html_structure(d).collect()}[2]
    assert (got.links, got.vague_links) == (11, 1) and "no_title" not in got.codes and "controls_without_name" in got.codes
