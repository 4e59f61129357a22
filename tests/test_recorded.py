"""Recorded responses: round trip, redirect chains, pushed filters, broken files."""

import gzip

import pytest

from sitegauge.runtime import ship
from sitegauge.sources.recorded import register, rows


@pytest.fixture(scope="module")
def source(spark):
    register(ship(spark))
    return spark


ROWS = [
    ("a.example", "auditor", "https://a.example/", "https://a.example/", 200, {"content-type": "text/html"}, "<p>é\r\n\r\nWARC/1.0 is no record here</p>", None, 12, []),
    ("a.example", "GPTBot", "http://a.example/x", "https://a.example/y", 404, {}, "", None, None, ["http://a.example/x", "https://a.example/x"]),
    ("b.example", "auditor", "https://b.example/", "https://b.example/", None, {}, None, "timeout", None, []),
    ("b.example", "auditor", "https://b.example/r", "https://c.example/r", 200, {"link": "<a>, <b>"}, "body", None, 5, ["https://b.example/r"]),
]
SCHEMA = "host string, agent string, url string, final_url string, status int, headers map<string,string>, body string, error string, elapsed_ms bigint, redirects array<string>"


def listed(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_round_trip(source, tmp_path):
    path = str(tmp_path / "w")
    source.createDataFrame(ROWS, SCHEMA).repartition(3).write.format("recorded").mode("append").save(path)
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_")]
    back = source.read.format("recorded").load(path)
    assert listed(back) == sorted(ROWS, key=str)
    source.createDataFrame(ROWS[:1], SCHEMA).select("url", "status").write.format("recorded").mode("append").save(path)
    assert source.read.format("recorded").load(path).count() == len(ROWS) + 1  # files are listed when a read is planned


def test_filters_are_pushed(source, tmp_path):
    path = str(tmp_path / "w")
    source.createDataFrame(ROWS, SCHEMA).coalesce(1).write.format("recorded").mode("append").save(path)
    back = source.read.format("recorded").load(path)
    for test, want in (("host = 'a.example'", 2), ("host in ('b.example', 'z') and status >= 200", 1), ("status in (404, 503)", 1), ("status > 200 and agent = 'GPTBot'", 1), ("status is null", 1), ("host = 'b.example' or status = 404", 3)):
        assert back.where(test).count() == want, test
    plan = back.where("host = 'a.example' and status < 300 and agent = 'auditor'")._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter") : plan.index("\n", plan.index("Filter"))]
    assert "agent" in kept and "a.example" not in kept and "300" not in kept


def test_files(source, tmp_path):
    """Gzip files of several members, a record that breaks off, other kinds of records, a folder without files."""
    import sitegauge.sources.recorded as recorded

    raw = [recorded.record(dict(zip(recorded.SCHEMA.replace("map<string,string>", "map").split(", "), ROWS[0], strict=True)) | {"url": f"https://a.example/{k}", "status": 200, "body": "x" * k}) for k in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "b.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" + raw[0] + raw[1][:-30])
    (tmp_path / "note.txt").write_text("no")
    back = source.read.format("recorded").load(str(tmp_path))
    assert [r[0] for r in sorted(back.select("url").collect())] == ["https://a.example/0", "https://a.example/0", "https://a.example/1", "https://a.example/2"]
    (tmp_path / "none").mkdir()
    assert source.read.format("recorded").load(str(tmp_path / "none")).count() == 0
    assert list(rows(b"")) == list(rows(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")) == []


def test_a_file_is_a_stream():
    """Records over the edges of reads, after rubbish, and broken off: as from the whole bytes, and no more is read ahead than a step."""
    import io
    import random

    import sitegauge.sources.recorded as recorded

    rng = random.Random(3)
    raw = b""
    for k in range(60):
        raw += rng.choice([b"", b"WAR", b"\r\nWARC", b"x" * 50]) + recorded.record({"url": f"https://a.example/{k}", "status": 200, "headers": {}, "body": "b" * rng.choice([0, 10, 3000]) + "WARC/"})
    raw += raw[: rng.randrange(200, 900)]

    class Slow(io.BytesIO):
        def read(self, size=-1):
            return super().read(min(size, rng.choice([1, 7, 500])))

    want = list(recorded.records(raw))
    assert len(want) >= 60 and list(recorded.records(Slow(raw))) == want
    large = io.BytesIO(raw * 400)
    next(recorded.records(large))
    assert large.tell() <= recorded.STEP_BYTES < len(raw) * 400 / 8
    found = list(recorded.rows(raw * 400))
    parts = list(recorded.batches(iter(found)))
    assert sum(p.num_rows for p in parts) == len(found) and max(p.num_rows for p in parts) <= recorded.STEP_ROWS
    assert [x for p in parts for x in p.column("url").to_pylist()] == [r[2] for r in found]


def test_headers_of_arrow_rows(source, tmp_path):
    """More rows than a step: maps, lists and nulls come through."""
    path = str(tmp_path / "w")
    source.createDataFrame(ROWS * 300, SCHEMA).coalesce(1).write.format("recorded").mode("append").save(path)
    assert listed(source.read.format("recorded").load(path)) == sorted(ROWS * 300, key=str)
