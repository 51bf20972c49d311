"""A stored vector index for exact nearest neighbours: blocks of near vectors, bounded by their distances to pivots.

Vectors go to the nearest of some pivots and are sorted by their distance to it; runs of
them are blocks. A block knows the least and the largest distance of its vectors to every
pivot. By the triangle inequality a query at distance d of a pivot is at least
max(d - largest, least - d) away from all of a block, for every pivot, so the largest of
these bounds the block. A search reads the blocks of the least bounds, and then only those
whose bound is within the distance of the k-th vector found.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import materialise, prepare
from ..sources.tables import table
from .retrieval import _VEC

#: Numbers that a task works on at once; a batch of Spark's can hold a hundred times as many.
TOGETHER = 1_000_000
BLOCKS = "block long, n long, ids array<long>, vectors array<float>, low array<double>, high array<double>"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to each of b: differences squared and summed, in parts of bounded size."""
    step = max(1, TOGETHER // max(1, a.shape[1] * len(a)))
    return np.concatenate([np.sqrt(((a[:, None] - b[None, lo : lo + step]) ** 2).sum(axis=2)) for lo in range(0, max(1, len(b)), step)], axis=1) if len(b) else np.empty((len(a), 0))


def _cells(pivots: np.ndarray) -> Callable:
    """Each vector with its nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(_matrix(batch.column(1), batch.num_rows), pivots)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], names=["id", "v", "cell", "away"])

    return run


def _blocked(pivots: np.ndarray, size: int) -> Callable:
    """Sorted vectors in blocks of `size`; a block never spans two tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, vectors = np.empty(0, np.int64), np.empty((0, pivots.shape[1]))

        def out(n: int) -> pa.RecordBatch:
            nonlocal number, ids, vectors
            far = distances(vectors[:n], pivots)
            row = [pa.array([number]), pa.array([n]), *(pa.array([x.tolist()], t) for x, t in ((ids[:n], pa.list_(pa.int64())), (vectors[:n].ravel(), pa.list_(pa.float32())), (far.min(axis=0), pa.list_(pa.float64())), (far.max(axis=0), pa.list_(pa.float64()))))]
            number, ids, vectors = number + 1, ids[n:], vectors[n:]
            return pa.RecordBatch.from_arrays(row, names=["block", "n", "ids", "vectors", "low", "high"])

        for batch in batches:
            if batch.num_rows:
                ids, vectors = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([vectors, _matrix(batch.column(1), batch.num_rows)])
                while len(ids) >= size:
                    yield out(size)
        if len(ids):
            yield out(len(ids))

    return run


@dataclass
class VectorIndex:
    """A written table of blocks of vectors of one dimension, and the pivots."""

    blocks: DataFrame
    pivots: np.ndarray
    vectors: int


def _whole(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")


def build(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 16, size: int = 64) -> VectorIndex:
    """An index of the vectors of dimension `dim`; null ids and vectors, and those that hold a null, are not in it.

    Pivots are the farthest of each other among at most 4096 vectors, drawn by a hash of the
    id; they change how much a search reads, never what it finds.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = _whole(vectors, id_col, vector_col).where(F.size("v") == dim)
    drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("id", "v")).limit(4096).select("v").collect()], np.float64).reshape(-1, dim)
    chosen, near = drawn[:1], np.full(len(drawn), np.inf)
    while 0 < len(chosen) < min(pivots, len(drawn)):
        near = np.minimum(near, distances(drawn, chosen[-1:])[:, 0])
        chosen = np.concatenate([chosen, drawn[near.argmax()][None]])
    if not len(chosen):
        chosen = np.zeros((1, dim))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(_cells(chosen), "id bigint, v array<float>, cell int, away double").repartitionByRange(ranges, "cell", "away", "id").sortWithinPartitions("cell", "away", "id")
    blocks = materialise(dealt.select("id", "v").mapInArrow(_blocked(chosen, size), BLOCKS), "vectors")
    return VectorIndex(blocks, chosen, blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _slices(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Batches of blocks in slices, so that those bounded at once for all queries don't grow with the index."""
    step = max(1, TOGETHER // max(1, queries))
    for batch in batches:
        yield from (batch.slice(lo, step) for lo in range(0, batch.num_rows, step))


def _bounds(batch: pa.RecordBatch, far: np.ndarray) -> np.ndarray:
    """Of each query and block the least distance that the pivots allow; far: queries by pivots."""
    low, high = (_matrix(batch.column(i), batch.num_rows) for i in (1, 2))
    out = np.zeros((len(far), batch.num_rows))
    for p in range(far.shape[1]):
        np.maximum(out, np.maximum(far[:, p, None] - high[None, :, p], low[None, :, p] - far[:, p, None]), out=out)
    return out


def _first(far: np.ndarray, first: int) -> Callable:
    """The blocks of the least bounds for each query, those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in far]
        for batch in _slices(batches, len(far)):
            bounds, blocks = _bounds(batch, far), batch.column(0).to_pylist()
            for q, own in enumerate(best):
                some = np.argsort(bounds[q], kind="stable")[:first].tolist()
                best[q] = heapq.nsmallest(first, own + [(float(bounds[q, b]), blocks[b]) for b in some])
        yield pa.RecordBatch.from_arrays([pa.array([q for q, own in enumerate(best) for _ in own], pa.int64()), pa.array([b for own in best for _, b in own], pa.int64()), pa.array([d for own in best for d, _ in own], pa.float64())], names=["q", "block", "bound"])

    return run


def _within(far: np.ndarray, least: np.ndarray) -> Callable:
    """All blocks whose bound is within the distance of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(far)):
            q, b = np.nonzero(_bounds(batch, far) <= least[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), batch.column(0).take(pa.array(b, pa.int64()))], names=["q", "block"])

    return run


def _nearest(vectors: np.ndarray, k: int) -> Callable:
    """The k nearest of each block to each query that wants it, ties of the last one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, wanted in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = ids.values.to_numpy()
                own = np.array(wanted.as_py())
                far = distances(vectors[own], held.values.to_numpy().astype(np.float64).reshape(len(key), -1))
                edge = np.partition(far, k - 1, axis=1)[:, k - 1] + 1e-9 if len(key) > k else np.full(len(own), np.inf)
                q, i = np.nonzero(far <= edge[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(own[q], pa.int64()), pa.array(key[i]), pa.array(far[q, i])], names=["q", "key", "distance"])

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", first: int = 4, block: int = 1024, seen: list | None = None) -> DataFrame:
    """(query_id, key, distance, rank): the k vectors of the index nearest to each query, ties by key. Exact.

    Queries of another dimension have none. They go to the tasks in blocks of `block`; for
    each block the bounds are read twice and of the vectors what they leave. `seen` gets, for
    each block of queries, how many pairs of a query and a vector were compared and how many
    there are.
    """
    spark, dim = index.blocks.sparkSession, index.pivots.shape[1]
    asked = _whole(queries, id_col, vector_col).where(F.size("v") == dim)
    parts, out = 1 + asked.count() // block, None
    edges = index.blocks.select("block", "low", "high")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.round("distance", 9), "key")).cast("bigint")).where(F.col("rank") <= k)
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id").collect()
        if not own:
            continue
        vectors = np.array([r[1] for r in own], np.float64)
        far = distances(vectors, index.pivots)

        def read(pairs: DataFrame, vectors: np.ndarray = vectors) -> DataFrame:
            wanted = pairs.groupBy("block").agg(F.sort_array(F.collect_list("q")).alias("wanted"))
            return index.blocks.join(wanted, "block").select("ids", "vectors", "wanted").mapInArrow(_nearest(vectors, k), "q bigint, key bigint, distance double")

        order = Window.partitionBy("q").orderBy("bound", "block")
        one = edges.mapInArrow(_first(far, first), "q bigint, block bigint, bound double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= first)
        one = materialise(one.select("q", "block"), "first")
        found = materialise(best(read(one)), "found")
        least = np.full(len(own), np.inf)
        for r in found.where(F.col("rank") == k).collect():  # a number for each query of the block
            least[r["q"]] = r["distance"] + 1e-9 * (1 + r["distance"])
        rest = materialise(edges.mapInArrow(_within(far, least), "q bigint, block bigint").join(one, ["q", "block"], "left_anti"), "rest")
        if seen is not None:
            seen.append((one.unionByName(rest).join(index.blocks.select("block", "n"), "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], index.vectors * len(own)))
        names = F.broadcast(spark.createDataFrame([(q, r[0]) for q, r in enumerate(own)], "q bigint, query_id bigint"))
        every = best(found.drop("rank").unionByName(read(rest))).join(names, "q").select("query_id", "key", "distance", "rank")
        out = every if out is None else out.unionByName(every)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, key bigint, distance double, rank bigint")


@query("knn_index_topk", f"WITH {_VEC} SELECT query_id, key, round(distance, 6) AS distance, rank FROM vec WHERE rank <= 10")
def knn_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 50, from a stored index."""
    e = table(spark, sf_dir, "embeddings")
    return search(build(e, 64), e.where("vec_id % 50 = 0"), 10).select("query_id", "key", F.round("distance", 6).alias("distance"), "rank")
