"""The sitemap crawl over hand-made responses, with values worked out by hand, and against a plain crawl over random sites."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import sitemaps as maps
from sitegauge.sources.xml import below, parse, root, xml

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
DAY = "2024-06-01"


def urlset(*entries, space=NS):
    return f"<urlset {space}>" + "".join(f"<url><loc>{loc}</loc>" + (f"<lastmod>{mod}</lastmod>" if mod else "") + "</url>" for loc, mod in entries) + "</urlset>"


def index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{loc}</loc></sitemap>" for loc in locs) + "</sitemapindex>"


def crawled(spark, fetches, robots, sites=((1, "https://a.example"),)):
    """fetches: (site, url, final_url or None, status, body)."""
    f = spark.createDataFrame(fetches, "site_id long, url string, final_url string, status int, body string")
    r = spark.createDataFrame(robots, "site_id long, body string")
    s = spark.createDataFrame(list(sites), "site_id long, root string")
    files = maps.parsed(f, DAY)
    c = maps.candidates(s, r, files)
    w = maps.crawl(c, files)
    return {x.site_id: x for x in maps.sitemap_sample(w).collect()}, {x.site_id: x for x in maps.best_sitemap(c).collect()}, [tuple(x) for x in maps.sampled_pages(w).orderBy("site_id", "place").collect()]


def test_dates_count_beyond_the_cap(spark):
    """60 urls, bad dates after the 25th: all of a file's entries are held against the day, 25 are taken."""
    entries = [(f"https://a.example/{k}", "soon" if k >= 25 else "2024-01-01") for k in range(60)]
    got, _, pages = crawled(spark, [(1, "https://a.example/sitemap.xml", None, 200, urlset(*entries))], [])
    assert (got[1].urls, got[1].bad_dates, got[1].undated, got[1].dated, got[1].clean, got[1].named) == (25, 35, 0, 25, True, False)
    assert pages == [(1, k, f"https://a.example/{k}", "2024-01-01") for k in range(5)]


def test_broken_files_use_up_places(spark):
    """Four names, the first of them broken and one empty: the fifth candidate is not read."""
    a = "https://a.example"
    fetches = [(1, f"{a}/sitemap.xml", None, 200, "<urlset><url>"), (1, f"{a}/1.xml", None, 200, "<urlset></urlset>"), (1, f"{a}/2.xml", None, 200, urlset((f"{a}/x", None))), (1, f"{a}/3.xml", None, 500, urlset((f"{a}/y", None))), (1, f"{a}/4.xml", None, 200, urlset((f"{a}/z", None))), (1, f"{a}/5.xml", None, 200, urlset((f"{a}/w", None)))]
    got, best, _ = crawled(spark, fetches, [(1, "".join(f"Sitemap: /{k}.xml\n" for k in range(1, 6)))])
    # candidates: the broken one, 1, 2, 4 (3 failed; 5 is the fifth name)
    assert (got[1].files, got[1].invalid_files, got[1].urls, got[1].undated) == (2, 2, 2, 2) and best[1].urls == 1


def test_index_children_and_seen(spark):
    """Children are read to the budget of files; one that was read before is not read again, one that fails is told."""
    a = "https://a.example"
    fetches = [
        (1, f"{a}/sitemap.xml", f"{a}/maps/index.xml", 200, index("c1.xml", "/b.xml", "gone.xml", "c2.xml")), (1, f"{a}/b.xml", None, 200, urlset((f"{a}/b", "2999-01-01"))), (1, f"{a}/maps/c1.xml", None, 200, urlset((f"{a}/c1", None), ("http://a.example/c1", None))),
        (1, f"{a}/maps/c2.xml", None, 200, urlset((f"{a}/c2", None))),
    ]
    got, best, pages = crawled(spark, fetches, [(1, "sitemap: b.xml # not a comment here\nSITEMAP : https://a.example/b.xml\nSitemap: /maps/index.xml")])
    # /b.xml was seen as a candidate; the first name has the comment in it and fails; the index stands for /maps/index.xml; its first three children are c1, b and gone
    assert (got[1].files, got[1].is_index, got[1].invalid_files, got[1].urls, got[1].future_dates, got[1].non_https, got[1].named) == (3, True, 1, 3, 1, 1, True)
    assert [p[2] for p in pages] == [f"{a}/c1", "http://a.example/c1", f"{a}/b"] and (best[1].urls, best[1].is_index) == (4, True)


def test_budget_of_urls_across_levels(spark):
    a = "https://a.example"
    many = [(f"{a}/{k}", None) for k in range(20)]
    fetches = [(1, f"{a}/sitemap.xml", None, 200, index("1.xml", "2.xml", "3.xml")), *[(1, f"{a}/{k}.xml", None, 200, urlset(*many)) for k in (1, 2, 3)], (1, f"{a}/4.xml", None, 200, urlset((f"{a}/w", "bad")))]
    got, *_ = crawled(spark, fetches, [(1, "Sitemap: /4.xml")])
    assert (got[1].files, got[1].urls, got[1].undated, got[1].duplicates, got[1].bad_dates) == (3, 25, 40, 5, 0)


def test_xml_is_read_as_xml(spark):
    """Images, comments, CDATA, entities, prefixes, a foreign namespace, a body after the end of the root."""
    a = "https://a.example"
    body = (
        f'<?xml version="1.0"?><!-- <url><loc>no</loc></url> --><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="i"><s:url><image:image><image:loc>{a}/p.png</image:loc></image:image><s:loc> <![CDATA[{a}/?a=1&b=2]]> </s:loc></s:url>'
        f"<s:url><s:loc>{a}/?c=1&amp;d=2</s:loc><s:lastmod> 2024-02-30 </s:lastmod></s:url><s:url><image:loc>{a}/q.png</image:loc></s:url><s:other><s:loc>{a}/o</s:loc></s:other></s:urlset>"
    )
    got, best, pages = crawled(spark, [(1, f"{a}/sitemap.xml", None, 200, body)], [])
    assert [p[2:] for p in pages] == [(f"{a}/?a=1&b=2", None), (f"{a}/?c=1&d=2", "2024-02-30")] and (best[1].urls, got[1].bad_dates, got[1].undated) == (2, 1, 1)
    for wrong in (urlset((f"{a}/1", None)) + "x", urlset((f"{a}/1", None))[:-2], urlset((f"{a}/1?a&b", None)), urlset((f"{a}/1", None), space='xmlns="other"'), "<rss><url><loc>x</loc></url></rss>", "", None, "\x00<urlset/>"):
        got, best, _ = crawled(spark, [(1, f"{a}/sitemap.xml", None, 200, wrong)], [])
        assert (got[1].files, got[1].urls, got[1].invalid_files, best[1].valid) == (0, 0, 1, False)


def test_images_win_nothing(spark):
    a = "https://a.example"
    with_image = f"<urlset {NS}><url><loc>{a}/1</loc><i:i xmlns:i='x'><i:loc>p</i:loc></i:i></url></urlset>"
    _, best, _ = crawled(spark, [(1, f"{a}/sitemap.xml", None, 200, urlset((f"{a}/1", "2024-01-01"))), (1, f"{a}/b.xml", None, 200, with_image)], [(1, "Sitemap: /b.xml")])
    assert (best[1].urls, best[1].dated) == (1, True)


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2024-05-01", "2024-05-01"), (" 2024-05-01 ", "2024-05-01"), ("2024-05-01 and more", "2024-05-01"), ("2024-05-01T23:30:00-02:00", "2024-05-02"), ("2024-05-01T00:30:00+01:00", "2024-04-30"), ("2024-05-01T10:00Z", "2024-05-01"), ("2024-05-01T10:00:00.123Z", "2024-05-01"),
        ("2024-05-01T25:00:00Z", None), ("2024-05-01Z", None), ("2024-02-30", None), ("1 May 2024", None), ("", None), ("2024-05-01T10:00:00", "2024-05-01"), ("2024-05-01Ta", None),
    ],
)
def test_days(spark, text, day):
    got = spark.createDataFrame([(text,)], "v string").select(maps.lastmod_day(F.col("v"))).first()[0]
    assert got == (datetime.date.fromisoformat(day) if day else None)


def test_nodes(spark):
    nodes = parse('<a xmlns="n"><b>x<c/>y</b><d xmlns=""/></a>')
    assert [(n["pre"], n["parent"], n["depth"], n["space"], n["name"], n["text"]) for n in nodes] == [(0, -1, 0, "n", "a", None), (1, 0, 1, "n", "b", "x"), (2, 1, 2, "n", "c", None), (3, 0, 1, "", "d", None)]
    assert [k["name"] for k in nodes[0]["kids"]] == ["b", "d"]
    deep = "<a>" * 100_000 + "</a>" * 100_000
    assert len(parse(deep)) in (0, 100_000)
    rows = xml(spark.createDataFrame([(1, "<r><x/></r>", 2), (1, "<r>", 2), (None, None, None)], "xml_nodes_ long, body string, pre long")).select(root().alias("r"), F.size(below(1, "x")).alias("n"), "pre").collect()
    assert sorted(map(tuple, rows), key=str) == [("r", 1, 2), (None, 0, 2), (None, 0, None)]


def plain(site_root, robots, fetches):
    """The crawl as a loop: candidates, then files in order, with a seen-set and two budgets. fetches: {url: (final, status, kind, entries or locs)}."""
    from urllib.parse import urljoin

    def get(url):
        return (url, *fetches.get(url, (url, 404, "none", [])))

    def valid(r):
        return r[3] in ("urls", "index") and bool(r[4])

    first = get(site_root + "/sitemap.xml")
    seen, candidates = {first[0], first[1]}, [first] if first[2] == 200 else []
    for name in robots[:4]:
        url = urljoin(site_root, name)
        if url in seen:
            continue
        r = get(url)
        if r[2] == 200 and r[1] not in seen:
            candidates.append(r)
        seen |= {url, r[1]}
    entries, files, is_index, invalid, missing = [], 0, False, 0, 0
    for r in candidates[:4]:
        if not valid(r):
            invalid += 1
            continue
        files += 1
        if r[3] == "urls":
            missing += sum(m is None for _, m in r[4])
            entries += r[4][: max(25 - len(entries), 0)]
        else:
            is_index = True
            if len(entries) < 25:
                kids = []
                for loc in r[4][: max(4 - files, 0)]:
                    url = urljoin(r[1], loc)
                    if url not in seen:
                        kids.append(get(url))
                        seen |= {url, kids[-1][1]}
                for c in kids:
                    if c[2] != 200 or not valid(c):
                        invalid += 1
                        continue
                    files += 1
                    if c[3] == "urls":
                        missing += sum(m is None for _, m in c[4])
                        entries += c[4][: max(25 - len(entries), 0)]
                    if len(entries) >= 25:
                        break
        if len(entries) >= 25:
            break
    return files, is_index, invalid, missing, [e[0] for e in entries]


def test_against_a_plain_crawl(spark):
    """300 random sites: indexes that name each other and themselves, redirects onto other files, failures, empty and broken files."""
    rng = random.Random(11)
    fetches, robots, sites, want = [], [], [], {}
    for site in range(300):
        top = f"https://s{site}.example"
        sites.append((site, top))
        paths = ["/sitemap.xml", "/a.xml", "/b/i.xml", "/b/c.xml", "/d.xml", "/e.xml"]
        known = {}
        for path in paths:
            if rng.random() < 0.85:
                kind = rng.choice(["urls", "urls", "urls", "index", "index", "broken", "empty"])
                if kind == "urls":
                    content = [(f"{top}{path}/{k}", rng.choice([None, "2024-01-01"])) for k in range(rng.randrange(1, 31))]
                elif kind == "index":
                    content = [rng.choice([p, p.lstrip("/"), top + p, "nowhere.xml"]) for p in rng.choices(paths, k=rng.randrange(1, 6))]
                else:
                    content = []
                body = {"urls": lambda c: urlset(*c), "index": lambda c: index(*c), "broken": lambda _: "<urlset><url>", "empty": lambda _: "<urlset/>"}[kind](content)
                final = top + rng.choice(paths) if rng.random() < 0.15 else top + path
                status = 200 if rng.random() < 0.9 else 503
                known[top + path] = (final, status, kind, content)
                fetches.append((site, top + path, final, status, body))
        names = [rng.choice([p, top + p, p.lstrip("/")]) for p in rng.choices(paths, k=rng.randrange(0, 7))]
        robots.append((site, "".join(f"Sitemap: {n}\n" for n in names)))
        want[site] = plain(top, names, known)
    f = spark.createDataFrame(fetches, "site_id long, url string, final_url string, status int, body string")
    files = maps.parsed(f, DAY).cache()
    w = maps.crawl(maps.candidates(spark.createDataFrame(sites, "site_id long, root string"), spark.createDataFrame(robots, "site_id long, body string"), files), files)
    got = {r.site_id: (r.files, r.is_index, r.invalid, r.missing, [e["loc"] for e in r.entries]) for r in w.collect()}
    assert {k: (v, got[k]) for k, v in want.items() if v != got[k]} == {}
    assert sum(v[1] for v in want.values()) > 60 and sum(len(v[4]) == 25 for v in want.values()) > 30
