"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Method. Coarse centroids, a scale for each list (its residuals' spread, so that dense lists are told apart as finely as wide ones), the codebooks of the residuals' parts
and the number of lists to probe are fitted on a bounded sample of ``SAMPLE`` vectors, those of the least hash. Every vector is then given its list
and its codes. Lists are parted into blocks of about ``BLOCK`` vectors (a long list over several, short ones together), queries into chunks of as many. A query is sent to
the blocks of its nearest lists (a dense list far off may hold nearer members than a wide one close by, so a list's spread counts, too); there the codes of these lists are summed over its asymmetric distance tables, the best ``RERANK`` are measured exactly on the original vectors, and
the best ``k`` of each block meet by query. A block and a chunk are all that a task holds, whatever the length of a list or the number of queries.

How many lists are probed is measured on the sample: so many that they hold ``TARGET`` of the sample's own nearest neighbours. Where the vectors have clusters
that is a few; where they have none it is most lists, and the work is near that of comparing all. A query goes on to further lists while those it has hold fewer than ``RERANK`` rows.

Defined results: rows with a null id, and those whose vector is null, empty, zero, or holds a null or non-finite component, take no part; nor do those whose length is not that of
most vectors (ties: the greater length). Rows equal in id and vector are one row; of rows with one id and several vectors each is a candidate, and each a query whose own rows are all those of
its id; the found rows of one id are ranked together. Equal distances are ranked by id. Fewer candidates than ``k``: all of them. No query or no candidate: no row. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.runtime import shared_dir

from .whitening import vectors

SAMPLE, BLOCK, RERANK, TARGET = 16384, 8192, 200, 0.97
#: Coarse centroids at most, codes of a vector, codewords of each, rounds of k-means, and sample rows that the number of probes is measured with.
LISTS, PARTS, WORDS, ROUNDS, TRIALS = 1024, 16, 256, 10, 512
#: Deviations below its mean at which a list's nearest members are looked for.
NEAR = 2.5
_AT_ONCE = 64


class Index(NamedTuple):
    """What is fitted: centroids, the spread of each list, where parts begin, their codewords, how many lists to probe."""

    centroids: np.ndarray
    spreads: np.ndarray
    cuts: list[int]
    words: list[np.ndarray]
    probes: int

    @property
    def scales(self) -> np.ndarray:
        """What a list's residuals are divided by."""
        return np.where(self.spreads > 0, self.spreads, 1.0)

    def parts(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts[:-1], self.cuts[1:], strict=True))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of every vector."""
        own = nearest(x, self.centroids)
        rest = (x - self.centroids[own]) / self.scales[own, None]
        return own, np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.parts(), self.words, strict=True)], axis=1).astype(np.uint8)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of several."""
    norms = (centres**2).sum(axis=1)
    return np.concatenate([(norms - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def list_order(x: np.ndarray, centroids: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """For each row the lists by how near their nearest members may be: by the squared distance that a member has on average, less ``NEAR`` deviations of it."""
    apart = np.maximum((x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * x @ centroids.T, 0.0)
    return np.argsort(apart + spreads**2 - 2 * NEAR * np.sqrt(apart) * spreads / np.sqrt(x.shape[1]), axis=1, kind="stable")


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k different rows; a centre without rows stays where it is."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        centres[own[order[first]]] = np.add.reduceat(x[order], first) / np.diff(first, append=len(x))[:, None]
    return centres


def fit(sample: DataFrame, lists: int, dims: int) -> Index:
    """The index's parameters from a bounded sample, a table of rows (id, vector): the coarse ones here, a codebook a task."""
    spark = sample.sparkSession
    rows = sample.toArrow()
    x = np.concatenate([m for _, m in vectors(rows.column(1))])
    centroids = k_means(x, lists, ROUNDS, 0)
    own = nearest(x, centroids)
    rest = x - centroids[own]
    count = np.bincount(own, minlength=len(centroids))
    spreads = np.sqrt(np.bincount(own, (rest**2).sum(axis=1), len(centroids)) / np.maximum(count, 1))
    rest /= np.where(spreads > 0, spreads, 1.0)[own, None]
    cuts = np.linspace(0, dims, min(PARTS, dims) + 1).astype(int).tolist()

    def codebook(part: pa.Table) -> pa.Table:
        data, width = part.column(1)[0].as_py(), part.column(2)[0].as_py()
        words = k_means(np.frombuffer(data).reshape(-1, width), WORDS, ROUNDS, 1)
        return pa.table({"part": part.column(0), "words": pa.array([words.tobytes()], pa.binary())})

    parts = [(j, np.ascontiguousarray(rest[:, a:b]).tobytes(), b - a) for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    made = spark.createDataFrame(parts, "part int, data binary, width int").groupBy("part").applyInArrow(codebook, "part int, words binary").collect()
    words = [np.frombuffer(bytes(r.words)).reshape(-1, parts[r.part][2]) for r in sorted(made)]
    return Index(centroids, spreads, cuts, words, _probes(x, own, centroids, spreads))


def _probes(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, spreads: np.ndarray, k: int = 10) -> int:
    """So many of its nearest lists hold ``TARGET`` of a sampled row's ``k`` nearest sampled rows, on average."""
    trial = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    norms, depth = (x**2).sum(axis=1), []
    for a in range(0, len(trial), _AT_ONCE):
        q = trial[a : a + _AT_ONCE]
        apart = norms - 2 * x[q] @ x.T
        apart[np.arange(len(q)), q] = np.inf
        near = np.argpartition(apart, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(q), 0), int)
        rank = np.argsort(list_order(x[q], centroids, spreads), axis=1)
        depth.append(np.take_along_axis(rank, own[near], axis=1).ravel())
    depth = np.concatenate(depth)
    return int(np.quantile(depth, TARGET, method="higher")) + 1 if len(depth) else 1


def _blocks(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every list; short lists share one."""
    first, many, at, held = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for k in range(lists):
        n = sizes.get(k, 0)
        if n > BLOCK or held + n > BLOCK:
            at, held = at + (held > 0), 0
        first[k], many[k] = at, max(1, -(-n // BLOCK))
        if n > BLOCK:
            at += int(many[k])
        else:
            held += n
    return first, many


def _scan(index: Index, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of the index against a chunk of queries: the k nearest of the block for each query, by exact distance."""

    def work(block: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(block) or not len(asked):
            return schema.empty_table()
        block = block.sort_by([("vec_id", "ascending")])  # of equal approximations the least ids
        ids, own = (np.asarray(block.column(c)) for c in ("vec_id", "list"))
        x = next(vectors(block.column("embedding")))[1]
        codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        scales = index.scales
        decoded = np.concatenate([w[codes[:, j]] for j, w in enumerate(index.words)], axis=1) * scales[own, None]
        fixed = ((index.centroids[own] + decoded) ** 2).sum(axis=1) - (index.centroids[own] ** 2).sum(axis=1)
        order = np.argsort(own, kind="stable")
        here, starts = np.unique(own[order], return_index=True)
        members = dict(zip(here.tolist(), np.split(order, starts[1:]), strict=True))
        q, query_ids = (np.asarray(asked.column(c)) for c in ("q", "query_id"))
        y = next(vectors(asked.column("embedding")))[1]
        probed = asked.column("lists").to_pylist()
        best = min(RERANK, len(x))
        out = []
        for a in range(0, len(q), _AT_ONCE):
            ys = y[a : a + _AT_ONCE]
            tables = [ys[:, lo:hi] @ w.T for (lo, hi), w in zip(index.parts(), index.words, strict=True)]
            coarse = (index.centroids[here] ** 2).sum(axis=1) - 2 * ys @ index.centroids[here].T
            guess = np.full((len(ys), len(x)), np.inf)
            asks: dict[int, list[int]] = {}
            for r, lists in enumerate(probed[a : a + _AT_ONCE]):
                for c in lists:
                    asks.setdefault(c, []).append(r)
            for c, r in asks.items():
                rows, r = members.get(c), np.array(r)
                if rows is None:
                    continue
                dot = np.zeros((len(r), len(rows)))
                for j, t in enumerate(tables):
                    dot += t[r][:, codes[rows, j]]
                guess[r[:, None], rows] = coarse[r, np.searchsorted(here, c)][:, None] + fixed[rows] - 2 * scales[c] * dot
            guess[ids[None, :] == query_ids[a : a + _AT_ONCE, None]] = np.inf
            for r in range(len(ys)):
                chosen = np.argsort(guess[r], kind="stable")[:best] if best < len(x) else np.arange(len(x))
                chosen = chosen[np.isfinite(guess[r, chosen])]
                score = np.sqrt(((x[chosen] - ys[r]) ** 2).sum(axis=1))
                first = np.lexsort((ids[chosen], score))[:k]
                out.append((np.full(len(first), q[a + r]), np.full(len(first), query_ids[a + r]), ids[chosen[first]], score[first]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return work


def search(df: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each row that ``asked`` holds for: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("embedding", lambda c: c != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("embedding") == lengths[0].d)
    kind = df.schema[vector_col].dataType.simpleString()
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    rows.groupBy("vec_id", "embedding").agg(F.max("asked").alias("asked")).write.parquet(folder)
    rows = spark.read.schema(f"vec_id long, embedding {kind}, asked boolean").parquet(folder)
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").select("vec_id", "embedding").limit(SAMPLE)
    index = fit(sample, max(1, min(LISTS, round(lengths[0]["count"] ** 0.5))), lengths[0].d)
    sent = spark.sparkContext.broadcast(index)  # LISTS centroids and WORDS codewords of each part, whatever the rows

    def listed(batches):
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(nearest(x, sent.value.centroids), pa.int32())], names=["list"])

    def encode(batches):
        for batch in batches:
            for _, x in vectors(batch.column(1)):
                own, codes = sent.value.encode(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(list(map(bytes, codes)), pa.binary())], names=["vec_id", "embedding", "list", "codes"])

    sizes = {r.list: r["count"] for r in rows.select("embedding").mapInArrow(listed, "list int").groupBy("list").count().collect()}
    held = rows.select("vec_id", "embedding").mapInArrow(encode, f"vec_id long, embedding {kind}, list int, codes binary")
    first, many = _blocks(sizes, len(index.centroids))
    counts = np.array([sizes.get(c, 0) for c in range(len(index.centroids))])
    chunks = max(1, -(-rows.where("asked").count() // BLOCK))
    at = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(many[c])) for c in sizes], "list int, first long, many long"))  # a row a list
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", "embedding"), "many")
    blocks = held.join(at, "list").select(block.alias("block"), "vec_id", "list", "codes", "embedding", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def probe(batches):
        for batch in batches:
            for _, y in vectors(batch.column(2)):
                order = list_order(y, index.centroids, index.spreads)
                enough = (np.cumsum(counts[order], axis=1) <= RERANK).sum(axis=1) + 1
                taken, to, lists = [], [], []
                for r, n in enumerate(np.maximum(enough, index.probes).tolist()):
                    parted: dict[int, list[int]] = {}
                    for c in order[r, :n].tolist():
                        for b in range(first[c], first[c] + many[c]):
                            parted.setdefault(int(b), []).append(c)
                    taken += [r] * len(parted)
                    to += parted
                    lists += parted.values()
                sent_on = batch.take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays([*sent_on.columns, pa.array(to, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "block", "lists"])

    queries = rows.where("asked").select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "embedding")
    queries = queries.mapInArrow(probe, f"q long, query_id long, embedding {kind}, block long, lists array<int>").withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int"))
    found = blocks.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(_scan(index, k), "q long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
