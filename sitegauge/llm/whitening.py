"""Whitening of embeddings over a tiled covariance.

Method. Entries become whole numbers x = floor(scale * c). The fit list has each distinct x vector once. Its sums are exact. For the covariance the
dimensions are parted into blocks of ``TILE``: every row-block of the fit list sends its column blocks to the tiles (pairs of blocks) they take part
in, a tile's two column blocks meet by row-block, are centred and multiplied, each task adds up its products by tile, and the tasks' sums are added by cell.
What goes to the driver is the sums and the covariance, d and d * (d + 1) / 2 numbers for d dimensions, whatever the rows; it is assembled and
eigendecomposed there, and the components are sent back with the tasks. A last pass over the fit list gives the covariance of what was whitened.

The fit list is written to the shared folder, so row-blocks are the same when a lost task runs again. Narrow whole numbers travel in two or four bytes.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry or one that is no long after scaling take no part, nor do those whose length
is not that of most distinct vectors (ties: the greater length). Null ids and repeated rows are rows like any other. With no row left there is no row. A component
whose eigenvalue is zero to rounding (all of them if there is one distinct vector) has no direction: its ``whitened`` is null, its ``explained`` 0, or
null where all are; ``identity_error`` is over the others, null if there is none. A ``deviation`` beyond a long is null. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.runtime import shared_dir

#: Dimensions of a block, and rows of a row-block.
TILE, ROWS = 32, 2048
_LONG = 1 << 63


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column by length: row numbers and a matrix of doubles. Null and empty vectors and those that hold a null are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(offsets)
    good = size > 0
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    if values.null_count:
        holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
        good &= holes[offsets[1:]] == holes[offsets[:-1]]
    values = values.to_numpy(zero_copy_only=False)
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        yield rows, values[offsets[rows][:, None] + np.arange(n)].astype(np.float64)


def _whole(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and x vectors, by length, of the rows that take part."""
    for rows, matrix in vectors(column):
        with np.errstate(over="ignore", invalid="ignore"):
            matrix = np.floor(matrix * scale)
            good = (np.abs(matrix) < _LONG / 2).all(axis=1)  # false for what is not finite, too
        if good.any():
            yield rows[good], matrix[good].astype(np.int64)


def _bytes(x: np.ndarray) -> np.ndarray:
    """Each row as bytes: the width of its numbers, then the numbers. Equal vectors give equal bytes."""
    return np.concatenate((np.full((len(x), 1), x.dtype.itemsize, np.uint8), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)), axis=1)


def _packed(x: np.ndarray) -> Iterator[bytes]:
    most = np.abs(x).max(axis=1)
    for low, high, kind in ((0, 1 << 15, "<i2"), (1 << 15, 1 << 31, "<i4"), (1 << 31, _LONG, "<i8")):
        own = x[(most >= low) & (most < high)]
        if len(own):
            yield from map(np.ndarray.tobytes, _bytes(own.astype(kind)))


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), d), np.int64)
    sizes = np.array([b[0] for b in raw], np.uint8)
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        out[at] = np.frombuffer(b"".join(raw[k][1:] for k in at.tolist()), f"<i{width}").reshape(-1, d)
    return out


def _centred(x: np.ndarray, shift: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the mean, which is ``shift`` (whole numbers) and ``rest`` (below one): the large part goes exactly."""
    return (x - shift).astype(np.float64) - rest


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension."""

    def work(batches):
        for batch in batches:
            x = _unpacked(batch.column(0), d)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low), pa.array([len(x)] * d, pa.int64())], names=["i", "high", "low", "n"])

    parts = fit.mapInArrow(work, "i int, high long, low long, n long")
    rows = parts.groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")), F.sum("n").alias("n")).orderBy("i").collect()
    return rows[0].n, [int(r.high) * (1 << 32) + int(r.low) for r in rows]


def _covariance(fit: DataFrame, d: int, n: int, shift: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The covariance of the fit list, tile by tile."""
    cuts = list(range(0, d, TILE)) + [d]
    blocks = len(cuts) - 1

    def column_blocks(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = _unpacked(batch.column(0), d)
            for at in range(0, len(x), ROWS):
                part, rows = x[at : at + ROWS], []
                own = [next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", _LONG)) if np.abs(part[:, a:b]).max() < top) for a, b in zip(cuts, cuts[1:], strict=False)]
                sent = [np.ascontiguousarray(part[:, a:b].astype(k)).tobytes() for (a, b), k in zip(zip(cuts, cuts[1:], strict=False), own, strict=True)]
                for a in range(blocks):
                    rows += [(number, a, b, side, int(own[c][-1]), sent[c]) for b in range(a, blocks) for side, c in enumerate((a, b)[: 1 + (a != b)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["rows", "a", "b", "side", "width", "data"])
                number += 1

    def products(batches):
        """Column blocks come by tile and row-block, the left one first; the tiles' sums are at most the covariance itself."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        left = None
        for batch in batches:
            for _, a, b, side, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = cuts[(a, b)[side]], cuts[(a, b)[side] + 1]
                block = _centred(np.frombuffer(data, f"<i{width}").reshape(-1, high - low).astype(np.int64), shift[low:high], rest[low:high])
                if side == 0:
                    left = block
                if side == 1 or a == b:
                    sums[a, b] = sums.get((a, b), 0.0) + left.T @ block
        for (a, b), own in sums.items():
            i, j = (g.ravel() for g in np.meshgrid(np.arange(cuts[a], cuts[a + 1]), np.arange(cuts[b], cuts[b + 1]), indexing="ij"))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(own.ravel())], names=["i", "j", "value"])

    sent = fit.mapInArrow(column_blocks, "rows long, a int, b int, side int, width int, data binary")
    tiles = sent.repartition("rows", "a", "b").sortWithinPartitions("a", "b", "rows", "side").mapInArrow(products, "i int, j int, value double")
    cells = tiles.where("i <= j").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((d, d))
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells["value"] / n
    return out


def whiten(df: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each remaining row and each of the first ``components`` components: id, component (from 1, by falling eigenvalue), n (distinct vectors),
    deviation (exact sum over dimensions of (n * x - sum)^2), whitened, explained (share of the variance), identity_error (one value)."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    source = df.select(id_col, vector_col)

    def pack(batches):
        for batch in batches:
            for _, x in _whole(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(list(_packed(x)), pa.binary()), pa.array([x.shape[1]] * len(x), pa.int32())], names=["x", "d"])

    folder = f"{shared_dir(spark)}/whitening-{uuid.uuid4().hex}"
    source.select(vector_col).mapInArrow(pack, "x binary, d int").distinct().write.parquet(folder)
    fit = spark.read.parquet(folder)
    lengths = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0].d
    fit = fit.where(F.col("d") == d).select("x")
    n, total = _sums(fit, d)
    shift = np.array([round(Fraction(s, n)) for s in total], np.int64)
    rest = np.array([float(Fraction(s, n) - int(m)) for s, m in zip(total, shift, strict=True)])
    covariance = _covariance(fit, d, n, shift, rest)
    values, directions = np.linalg.eigh(covariance)
    k = min(components, d)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    trace = float(np.trace(covariance))
    real = values > d * np.finfo(float).eps * max(values[0], 0.0)
    project = directions[:, real] / np.sqrt(values[real])

    def square(batches):
        for batch in batches:
            own = _centred(_unpacked(batch.column(0), d), shift, rest) @ project
            yield pa.RecordBatch.from_arrays([pa.array(range(own.shape[1] ** 2), pa.int32()), pa.array((own.T @ own).ravel())], names=["cell", "value"])

    error = None
    if real.any():
        cells = fit.mapInArrow(square, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()
        error = float(np.abs(np.array([c.value for c in cells]).reshape(real.sum(), -1) / n - np.eye(real.sum())).max())
    explained = [max(v, 0.0) / trace if trace > 0 else None for v in values.tolist()]
    widest = max(map(abs, total))

    def rows(batches):
        for batch in batches:
            for at, x in _whole(batch.column(1), scale):
                if x.shape[1] != d:
                    continue
                apart = n * int(np.abs(x).max()) + widest
                if apart * apart * d < _LONG:
                    deviation = ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [v if v < _LONG else None for v in ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1).tolist()]
                whitened = np.full((len(x), k), np.nan)
                whitened[:, real] = _centred(x, shift, rest) @ project
                take = pa.array(np.repeat(at, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array([n] * k * len(x), pa.int64()),
                        pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                        pa.array(whitened.ravel(), pa.float64(), mask=np.tile(~real, len(x))),
                        pa.array(explained * len(x), pa.float64()),
                        pa.array([error] * k * len(x), pa.float64()),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return source.mapInArrow(rows, schema)
