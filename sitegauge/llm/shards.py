"""Token ids as binary shards in training order.

Method. Every sequence (at most ``stride`` ids of one text) has a number: a hash of its document's id and text, and its place in the
document. So the numbers do not depend on how the input is split into files or tasks. A Feistel
network keyed by ``key`` permutes the numbers; its own domain is a power of four, and results outside ``DOMAIN`` go through it again
(cycle-walking), so the codes are a bijection of the numbers. The order of the codes is the training order: a
sequence's global slot is the rank of its code (then of id and place, for the few documents whose hashes are equal; rows alike in
id and text are alike in bytes, and so may change places). The codes are spread evenly, so equal ranges of them are equal shares: each task
gets whole ranges, sorted by code, and writes one shard of records of fixed size for each. Slot s is record s - base of
the shard whose base is the last not above s, and reading goes on from any slot.

Slots are ranks, and not the codes of a dense numbering, because a dense number needs all counts before the
shuffle: the ids would have to be made twice, or kept a second time (over three times the input on disk, with shuffle and shards).
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.runtime import shared_dir

from .bpe import load
from .common import text_buffer

STRIDE, ROUNDS = 256, 6
#: Numbers are hash * PLACES + place, below DOMAIN; a place beyond PLACES goes on with the next hash.
DOMAIN, PLACES = 10**18, 10**5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the sequence numbers: a bijection on 0 .. n-1."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, f"{key}/{r}").bytes[:8], "big")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            f = (right + k) * _M1
            f = (f ^ (f >> np.uint64(29))) * _M2
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << half | right

    out = once(numbers.astype(np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _sequences(docs: DataFrame, path: str, stride: int, shards: int, key: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    width = -(-DOMAIN // shards)

    def run(batches):
        model = load(path)
        wide = "<u2" if model.size <= 1 << 16 else "<u4"
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            for first, ids, counts in model.encode(data, bounds):
                rows, piece, packed, at = [], [], [], 0
                for k, n in enumerate(counts.tolist(), first):
                    own = np.append(ids[at : at + n], end_id).astype(wide)
                    at += n
                    for i, a in enumerate(range(0, len(own), stride)):
                        rows.append(k), piece.append(i), packed.append(zlib.compress(own[a : a + stride].tobytes(), 1))
                number = np.asarray(batch.column(2))[rows] % (DOMAIN // PLACES) * PLACES + np.array(piece, np.int64)
                code = permute(number % DOMAIN, DOMAIN, key)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(packed, pa.binary()), pa.array(code), pa.array((code // width).astype(np.int32))],
                    names=[id_col, "piece", "packed", "code", "shard"],
                )

    hashed = F.xxhash64(F.col(id_col).cast("string"), text_col).alias("hash")
    return docs.select(id_col, text_col, hashed).mapInArrow(run, f"`{id_col}` {kind}, piece int, packed binary, code long, shard int")


def materialise(
    docs: DataFrame, out: str, path: str, stride: int = STRIDE, shards: int | None = None, key: int = 1, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the shards to the folder ``out`` (shared, any store pyarrow reaches) and return a row for each sequence.

    id, piece, slot, shard, place (in the shard), n_ids, ids_crc32 (little-endian unsigned 32-bit). There are ``shards`` ranges, by
    default as many as shuffle partitions. A file appears under its name only when whole, and a task that runs again writes the
    same bytes. A null or empty text is the one id ``end_id``; null ids and repeated rows are sequences like any other.
    An empty table has no shard. Rows are written beside the shards, and read again once all counts are known.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = 2 if load(path).size <= 1 << 16 else 4
    record = 4 + wide * stride
    where, folder = _filesystem(out)
    where.create_dir(folder, recursive=True)
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        where, folder = _filesystem(out)
        stream, current, written, own = None, None, 0, uuid.uuid4().hex

        def finish():
            if stream is not None:
                stream.close()
                where.move(f"{folder}/.{own}-{current}", f"{folder}/{name(current)}")

        for batch in batches:
            sizes, crcs, places = [], [], []
            for packed, number in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if number != current:
                    finish()
                    stream, current, written = where.open_output_stream(f"{folder}/.{own}-{number}"), number, 0
                raw = zlib.decompress(packed)
                sizes.append(len(raw) // wide)
                places.append(written)
                written += 1
                stream.write(np.uint32(sizes[-1]).tobytes() + raw.ljust(record - 4, b"\0"))
                crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{wide}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array(places, pa.int64()), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())],
                names=[id_col, "piece", "shard", "place", "n_ids", "ids_crc32"],
            )
        finish()

    rows = _sequences(docs, path, stride, shards, key, end_id, id_col, text_col).repartitionById(shards, "shard").sortWithinPartitions("code", id_col, "piece")
    index = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    rows.mapInArrow(write, f"`{id_col}` {kind}, piece int, shard int, place long, n_ids int, ids_crc32 long").write.parquet(index)
    placed = spark.read.parquet(index)
    counts = placed.groupBy("shard").count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    base = counts.select("shard", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    sizes = {r["shard"]: r["count"] for r in base.collect()}
    with where.open_output_stream(f"{folder}/meta.json") as f:
        f.write(json.dumps({"stride": stride, "id_bytes": wide, "record": record, "key": key, "shards": sorted(sizes.items())}).encode())
    return placed.join(base, "shard").select(id_col, "piece", (F.col("base") + F.col("place")).alias("slot"), "shard", "place", "n_ids", "ids_crc32")


def name(number: int) -> str:
    return f"shard-{number:08d}.bin"


def read(out: str, first: int = 0, many: int | None = None):
    """The id arrays of slots first .. first + many - 1, read in order from the shards in ``out``."""
    where, folder = _filesystem(out)
    with where.open_input_stream(f"{folder}/meta.json") as f:
        meta = json.loads(f.read())
    base, record = 0, meta["record"]
    last = sum(n for _, n in meta["shards"]) if many is None else first + many
    for number, n in meta["shards"]:
        if base + n > first and base < last:
            with where.open_input_file(f"{folder}/{name(number)}") as f:
                f.seek((max(first, base) - base) * record)
                for _ in range(max(first, base), min(last, base + n)):
                    raw = f.read(record)
                    yield np.frombuffer(raw, f"<u{meta['id_bytes']}", int.from_bytes(raw[:4], "little"), 4)
        base += n


def default_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
