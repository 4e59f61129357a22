"""Recorded responses as a data source: WARC files, read and written as rows of the ``fetch`` relation.

``spark.read.format("recorded").load(path)`` gives host, agent, url, final_url, status, headers (lower-cased names), body, error, elapsed_ms and redirects. A file is a partition (``.warc``, or
``.warc.gz`` with a member a record or one for all). Response records are HTTP messages; a redirect whose target is the next response of the same agent is
not a row of its own but part of that row's chain: ``url`` is what was asked for, ``final_url`` what answered, ``redirects`` the urls before it. A metadata record with a line
``error: ...`` is a failed request (null status). Filters on host (equal, in) and status (equal, in, bounds) are pushed: records of other hosts are passed over unparsed.

``df.write.format("recorded").save(path)`` writes a file a task, under a name of its own that only a committed job's files get; rows need url and status or error, other columns
may be missing. Nothing is fetched. Bodies are UTF-8, other bytes are replaced; records that break off end their file. A file is read as a stream: a task holds a step of
rows, whatever the file's size, or one longer record.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from sitegauge.runtime import STEP_BYTES, STEP_ROWS, bounded

SCHEMA = "host string, agent string, url string, final_url string, status int, headers map<string,string>, body string, error string, elapsed_ms bigint, redirects array<string>"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("host", "agent", "url", "final_url")] + [("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("error", pa.string()), ("elapsed_ms", pa.int64()), ("redirects", pa.list_(pa.string()))]
)
_BOUNDS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    """The first line of a header block, and its fields; of a name twice the values are joined."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return first, out


def records(raw: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of every whole record of a file, as its bytes or open; no more of it is held than a record and a step."""
    file = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    held = bytearray()

    def more() -> bool:
        got = file.read(STEP_BYTES)
        held.extend(got)
        return bool(got)

    while True:
        while (begin := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not more():
                return
        del held[:begin]
        after = 0
        while (end := held.find(b"\r\n\r\n", after)) < 0:
            after = max(len(held) - 3, 0)
            if not more():
                return
        _, fields = _headers(bytes(held[:end]))
        size = fields.get("content-length", "")
        upto = end + 4 + (int(size) if size.isdigit() else 0)
        while len(held) < upto:
            if not more():
                return
        yield fields, bytes(held[end + 4 : upto])
        del held[:upto]


def rows(raw: bytes | BinaryIO, hosts: set[str] | None = None, wanted=lambda status: True) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of a file; ``hosts``: of these only; ``wanted``: of such a status only."""
    chains: dict[str, tuple[str, list[str]]] = {}  # by agent: the url that a redirect leads to, and the urls so far
    for fields, content in records(raw):
        url, kind, agent = fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-type"), fields.get("warc-agent", "auditor")
        if kind not in ("response", "metadata"):
            continue
        target, chain = chains.pop(agent, ("", []))
        if target != url:
            chain = []
        first = chain[0] if chain else url
        elapsed = fields.get("warc-elapsed-ms", "")
        elapsed = int(elapsed) if elapsed.isdigit() else None
        if kind == "metadata":
            error = next((x[6:].strip() for x in content.decode("utf-8", "replace").splitlines() if x.lower().startswith("error:")), None)
            if error is not None and (hosts is None or _host(first) in hosts) and wanted(None):
                yield _host(first), agent, first, url, None, {}, None, error, elapsed, chain
            continue
        head, _, body = content.partition(b"\r\n\r\n")
        line, http = _headers(head)
        status = line.split(" ")[1] if line.startswith("HTTP/") and line.count(" ") else ""
        status = int(status) if status.isdigit() else None
        if status is not None and 300 <= status < 400 and http.get("location"):
            chains[agent] = (urljoin(url, http["location"]), [*chain, url])
            continue
        if (hosts is None or _host(first) in hosts) and wanted(status):
            yield _host(first), agent, first, url, status, http, body.decode("utf-8", "replace"), None, elapsed, chain


def batches(found: Iterator[tuple], most: int = STEP_BYTES, most_rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a step each."""
    held, total = [], 0
    for row in found:
        if held and (total >= most or len(held) >= most_rows):
            yield _batch(held)
            held, total = [], 0
        held.append(row)
        total += len(row[6] or "")
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    columns[5] = [list(h.items()) for h in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def record(row: dict) -> bytes:
    """The records of a row: its redirects, then the response or the failure."""

    def one(kind: str, url: str, content: bytes) -> bytes:
        extra = f"WARC-Elapsed-Ms: {row['elapsed_ms']}\r\n" if row.get("elapsed_ms") is not None else ""
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Target-URI: {url}\r\nWARC-Agent: {row.get('agent') or 'auditor'}\r\n{extra}Content-Length: {len(content)}\r\n\r\n"
        return head.encode() + content + b"\r\n\r\n"

    url, final = row["url"], row.get("final_url") or row["url"]
    chain = list(row.get("redirects") or ([url] if final != url else []))
    out = b"".join(one("response", a, f"HTTP/1.1 301 Moved\r\nLocation: {b}\r\n\r\n".encode()) for a, b in zip(chain, [*chain, final][1:], strict=True))
    if row.get("status") is None:
        return out + one("metadata", final, f"error: {row.get('error') or 'failed'}\r\n".encode())
    fields = "".join(f"{k}: {v}\r\n" for k, v in (row.get("headers") or {}).items() if v is not None)
    return out + one("response", final, f"HTTP/1.1 {row['status']} x\r\n{fields}\r\n".encode() + (row.get("body") or "").encode("utf-8", "replace"))


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    made: str | None


class RecordedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.hosts, self.tests = path, None, []

    def pushFilters(self, filters):
        for f in filters:
            name, value = f.attribute if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if isinstance(f, (EqualTo, In)) and name == ("host",) and value is not None:
                own = set(value if isinstance(f, In) else [value])
                self.hosts = own if self.hosts is None else self.hosts & own
            elif name == ("status",) and type(f) in _BOUNDS and value is not None:
                self.tests.append((type(f), value))
            elif name == ("status",) and isinstance(f, In):
                self.tests.append((In, tuple(value)))
            else:
                yield f

    def partitions(self):
        files, path = _open(self.path)
        info = files.get_file_info(path)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(path, recursive=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_"))] or [File("")]

    def read(self, partition):
        if not partition.path:
            return
        with _open(self.path)[0].open_input_stream(partition.path, compression=None) as f:
            tests = self.tests
            found = rows(gzip.GzipFile(fileobj=f) if partition.path.endswith(".gz") else f, self.hosts, lambda status: not tests or status is not None and all(status in v if t is In else _BOUNDS[t](status, v) for t, v in tests))
            yield from batches(found)


class RecordedWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.job = path, columns, uuid.uuid4().hex

    def write(self, iterator):
        files, path = _open(self.path)
        made, out = None, None
        for row in iterator:
            if out is None:
                files.create_dir(path, recursive=True)
                made = f"_{self.job}-{uuid.uuid4().hex}.warc"
                out = files.open_output_stream(f"{path}/{made}")
            out.write(record(dict(zip(self.columns, row, strict=True))))
        if out is not None:
            out.close()
        return Written(made)

    def commit(self, messages):
        files, path = _open(self.path)
        for m in messages:
            if m and m.made:
                files.move(f"{path}/{m.made}", f"{path}/{m.made[1:]}")

    def abort(self, messages):
        files, path = _open(self.path)
        for m in messages:
            if m and m.made:
                files.delete_file(f"{path}/{m.made}")


class RecordedResponses(DataSource):
    @classmethod
    def name(cls):
        return "recorded"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RecordedReader(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("recorded responses are only appended to")
        return RecordedWriter(self.options["path"], [f.name for f in schema])


def register(spark) -> None:
    """Makes the source known to the session, with filters pushed to it; rows go to its writers in bounded batches."""
    bounded(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedResponses)
