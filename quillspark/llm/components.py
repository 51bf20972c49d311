"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

PAIR = "a long, b long"


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch of edges: (member, smallest member) for each component seen."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x] = root
                x = up
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            low, high = (ra, rb) if ra < rb else (rb, ra)
            parent[low] = low
            if low != high:
                parent[high] = low
        members = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array([find(x) for x in members], pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node links to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(others).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is in an edge (a, b) of two longs; root: the smallest node it reaches.

    Alternating large and small stars, each round written to the shared folder, until
    nothing changes: the number of rounds grows with the logarithm of the size. Nothing
    is collected but a count and a checksum. Null ends and loops are no edges; a root
    with no edge left gets no row of its own.
    """
    spark = edges.sparkSession
    prepare(spark)
    edges = edges.selectExpr("a", "b").where("a <> b").mapInArrow(_local_stars, PAIR).distinct()
    now, seen = materialise(edges, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if seen == mark or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, now = mark, materialise(_small_star(_large_star(now)), "edges")
