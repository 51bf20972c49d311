"""SimHash fingerprints and their links, found by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32 bits. Two fingerprints that
differ in at most four bits differ in at most one bit of the first segment, or in at
most two bits of the second. The first segment is looked up by enumerating the ball of
radius one around it in a table of exact values; of the second, both the table and the
query hold balls of radius one, so that a distance of two meets at a value between.
Every match is verified over all 64 bits.

Buckets of more than ``bucket_limit`` members are not compared in pairs. Their members
are expanded to all points within two bits instead: two fingerprints share such a point
exactly when they differ in at most four bits, so one link from each member to the
smallest at a point keeps every component. That is linear in the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, shuffle_partitions
from .components import connected_components

LANES = np.uint64(0x0101010101010101)
EIGHT = np.arange(8, dtype=np.uint64)[:, None]


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words, lower-cased in A-Z, joined by one space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # eight counters of a byte in each word
        lanes = ((hashes[None, at : at + 255] >> EIGHT) & LANES).sum(axis=1, dtype=np.uint64)
        counts += lanes.view(np.uint8).reshape(8, 8).T.reshape(64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((majority(shingle_hashes(t.as_py() or b"", width)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id long, fp long) of each row; a text that is null or has no word gets 0."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The different pairs, smaller fingerprint first."""
    pair = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    pair = np.unique(pair[pair[:, 0] < pair[:, 1]], axis=0) if len(pair) else pair.reshape(0, 2)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


BALL1 = np.concatenate(([0], np.uint64(1) << np.arange(32, dtype=np.uint64))).astype(np.uint64)
TABLE, QUERY, BOTH, CROWDED = 1, 2, 3, 0
LOW = np.uint64(0xFFFFFFFF)


def _keys(limit: int) -> Callable:
    """Rows of (key, fp, kind) for the tables and the queries of both segments.

    A key with over `limit` members in one block of fingerprints is crowded: `limit` + 1
    of its rows stay as a sign to the others, all its members are told as CROWDED.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            high, low = fp >> np.uint64(32), fp & LOW
            keys = np.concatenate([high, (high[:, None] ^ BALL1[1:]).ravel(), (low[:, None] ^ BALL1).ravel() | np.uint64(1 << 32)])
            kind = np.repeat(np.array([TABLE, QUERY, BOTH], np.int8), [len(fp), 32 * len(fp), 33 * len(fp)])
            own = np.concatenate([fp, np.repeat(fp, 32), np.repeat(fp, 33)])
            _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
            if counts.max(initial=0) > limit:
                order = np.argsort(at, kind="stable")
                place = np.empty(len(at), np.int64)
                place[order] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
                full = counts[at] > limit
                crowded = np.unique(own[full])
                stay = ~full | (place <= limit)
                keys, kind, own = (np.concatenate(x) for x in ((keys[stay], crowded), (kind[stay], np.zeros(len(crowded), np.int8)), (own[stay], crowded)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own.view(np.int64)), pa.array(kind)], names=["key", "fp", "kind"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that equal keys are never parted by more than they must: whole keys only."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _matches(limit: int, bits: int) -> Callable:
    """Verified links (a, b) of the rows that share a key; (fp, null) for a member of a crowded key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, kind in _runs(batches):
            alone = kind == CROWDED
            crowded = [fp[alone]]
            key, fp, kind = key[~alone], fp[~alone], kind[~alone]
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            size = np.repeat(counts, counts)
            crowded.append(fp[size > limit])
            some = (size > 1) & (size <= limit)
            key, fp, kind = key[some], fp[some], kind[some]
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for step in range(1, int(size[some].max(initial=1))):
                x, y = fp[:-step], fp[step:]
                near = (key[:-step] == key[step:]) & ((kind[:-step] & kind[step:] & 1) | (kind[:-step] | kind[step:] == BOTH)).astype(bool)
                near &= np.bitwise_count((x ^ y).view(np.uint64)) <= bits
                a.append(x[near])
                b.append(y[near])
            yield _pairs(np.concatenate(a), np.concatenate(b))
            apart = np.unique(np.concatenate(crowded))
            yield pa.RecordBatch.from_arrays([pa.array(apart), pa.nulls(len(apart), pa.int64())], names=["a", "b"])

    return run


BALL2 = np.array([0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))], np.uint64)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point, fp, null) for the smallest fingerprint of a block near a point; (null, a, b) for links within the block."""
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), 256):
            fp = np.sort(whole[at : at + 256])
            points = (fp.view(np.uint64)[:, None] ^ BALL2).ravel()
            own = np.repeat(fp, len(BALL2))
            _, first, back = np.unique(points, return_index=True, return_inverse=True)
            links = _pairs(own[first][back], own)
            n, m = len(first), links.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(points[first].view(np.int64)), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(own[first]), links.column(0)]), pa.concat_arrays([pa.nulls(n, pa.int64()), links.column(1)])],
                names=["point", "a", "b"],
            )


def _point_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link from each fingerprint near a point to the smallest there."""
    for point, fp in _runs(batches):
        _, first, counts = np.unique(point, return_index=True, return_counts=True)
        yield _pairs(np.repeat(np.minimum.reduceat(fp, first), counts), fp)


def links(fps: DataFrame, bits: int = 4, bucket_limit: int = 64) -> DataFrame:
    """Links (a, b) between different values of the column fp, in a whole cover of the components.

    Each link differs in at most `bits` (4 at most) bits; fingerprints in crowded
    buckets link to the smallest within reach instead of to every one.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4")
    spark = fps.sparkSession
    prepare(spark)
    nodes = fps.select("fp").where("fp is not null").distinct()
    parts = shuffle_partitions(spark)
    keys = nodes.mapInArrow(_keys(bucket_limit), "key long, fp long, kind byte")
    found = materialise(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_matches(bucket_limit, bits), "a long, b long"), "matches")
    direct = found.where("b is not null").distinct()
    if bits == 4:
        crowded = found.where("b is null").select("a").distinct()
        points = materialise(crowded.mapInArrow(_points, "point long, a long, b long"), "points")
        near = points.where("point is not null").select("point", "a")
        met = near.repartition(parts, "point").sortWithinPartitions("point").mapInArrow(_point_links, "a long, b long")
        return direct.union(points.where("point is null").select("a", "b")).union(met).distinct()
    return direct.union(_within(found.where("b is null").select("a").distinct(), bits)).distinct()


def _within(crowded: DataFrame, bits: int) -> DataFrame:
    """The links of crowded fingerprints for fewer than four bits: each enumerates its whole ball and looks up exact values."""
    ball = [0] + [sum(1 << i for i in c) for n in range(1, bits + 1) for c in combinations(range(64), n)]
    near = np.array(ball, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 64):
                fp = whole[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((fp.view(np.uint64)[:, None] ^ near).ravel().view(np.int64)), pa.array(np.repeat(fp, len(near)))], names=["a", "b"])

    return crowded.mapInArrow(run, "a long, b long").where("a < b").join(crowded, "a", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4, bucket_limit: int = 64) -> DataFrame:
    """(doc_id, fp long, component_id) of every row: the smallest doc_id reachable over links of fingerprints.

    Rows of equal fingerprints are linked; null and wordless texts have fingerprint 0
    and are linked like any other. A row whose id is null gets the component of its
    fingerprint, null if no row there has an id. Repeated rows stay as they are. An empty
    table gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(rows, bits, bucket_limit))
    of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(of.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs, with all columns, whose id is the smallest of its component.

    Rows without an id can't be named and stay, and so do rows that repeat an id that
    stays. Ids to drop are broadcast only if there are at most `broadcast_rows`.
    """
    near = near_duplicates(docs, id_col, text_col, width, bits)
    dropped = materialise(near.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= broadcast_rows else dropped
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(dropped, "doc_id", "left_anti").select("row.*")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
