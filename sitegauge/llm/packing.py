"""Best-fit packing of token pieces into fixed-length sequences.

Method: bulk-synchronous best-fit. Pieces are range-sorted by length and sequences by their free gap. Lengths
and gaps are whole numbers up to the capacity, so either sorted order is a list of at most ``capacity`` runs of
equal values, and a round moves whole runs: the longest pieces not yet placed sweep the gaps upwards from
their successor (the least gap that holds them), each gap takes as many as fit, the gaps are updated, what found
no gap opens new sequences, and the next length follows. Which piece of a run goes where is settled by its
rank in the run. The ranks are taken over all pieces in parallel (a hot length is dealt over many buckets, and
the buckets' counts are summed), so the result is that of best-fit decreasing on the whole input, at one
tokenisation and two shuffles of rows of five numbers.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.runtime import cut

from .bpe import load
from .common import text_buffer

_RANKS = 1 << 44  # more than the pieces of one length


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids (and ``end_id``): doc_id, piece, start, length, ids_crc32.

    Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids, the first of which
    may be shorter. A null or empty text is the single id ``end_id``.
    """

    def run(batches):
        model = load(path)
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            rows, piece, start, length, crc = [], [], [], [], []
            for first, ids, counts in model.encode(data, bounds):
                ids, at = ids.astype("<u4"), 0
                for k, n in enumerate(counts.tolist(), first):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    a, b, i = 0, len(own) % capacity or capacity, 0
                    while a < len(own):
                        rows.append(k), piece.append(i), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                        a, b, i = b, b + capacity, i + 1
            whole = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(whole), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The rounds over runs: rows (length, first rank, sequences, pieces in each, first sequence, offset in it).

    ``counts`` has how many pieces each length has. Its size, and so the work, is bounded by the capacity.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    out: list[tuple[int, ...]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(free: int, first: int, many: int) -> int:
            """Put the next pieces into ``many`` sequences with ``free`` left; how many of these it touches."""
            nonlocal left, rank
            fit = free // length
            full = min(many, left // fit)
            for used, each in ((full, fit), (int(full < many and left - full * fit > 0), left - full * fit)):
                if used:
                    out.append((length, rank, used, each, first, capacity - free))
                    if free > each * length:
                        gaps[free - each * length].append((first, used))
                    first, rank, left = first + used, rank + used * each, left - used * each
            return first

        for free in sorted(g for g in gaps if g >= length):
            if not left:
                break
            runs = gaps.pop(free)
            while runs and left:
                first, many = runs.pop()
                after = place(free, first, many)
                if after < first + many:
                    runs.append((after, first + many - after))
            if runs:
                gaps[free] += runs
        if left:
            opened = place(capacity, opened, -(-left // (capacity // length)))
    return np.array(out, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (each of 1 to ``capacity`` ids) with sequence_id and offset.

    The pieces are checkpointed once, so a task that runs anew sees the same rows. Repeated rows and null
    ids are pieces like any other; ties of rank are between pieces of equal length, which may change places.
    """
    pieces = cut(pieces)
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt in turn, and the checkpoint fixes the turn: identical rows are dealt like any others
    dealt = pieces.withColumn("bucket", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(buckets)).cast("int"))
    counts = cut(dealt.groupBy("length", "bucket").count())
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    plan = sweep(by_length, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    sent = spark.sparkContext.broadcast(plan[order])  # at most a few runs for each pair of length and gap
    below = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(base, ["length", "bucket"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))

    def run(batches):
        runs = sent.value
        keys = runs[:, 0] * _RANKS + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            r = runs[np.searchsorted(keys, length * _RANKS + rank, "right") - 1]
            beyond = rank - r[:, 1]
            sequence, offset = r[:, 4] + beyond // r[:, 3], r[:, 5] + beyond % r[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece."""
    return pack(token_pieces(docs, path, capacity, end_id, id_col, text_col), capacity, id_col)
