"""Stored indexes: the same answers as reading everything, and most of it not read."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import trigram_index, vector_index
from quillspark.operators.retrieval import nearest

WORDS = ["lorem", "ipsum", "dolor", "sitam", "conse", "adipi", "elits", "sedde", "eiusm", "tempo"]


def index_rows(spark, n, rng):
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 40)))
        rows.append((k, rng.choice(["", None, "Needle One", "other title"]) if k % 97 == 0 else "", "Ann Needle" if k % 211 == 0 else "", "x" * (k % 3), text + (" needle thread" * (k % 400 == 7) + " néedle" * (k % 50 == 3))))
    return rows, spark.createDataFrame(rows, "key long, title string, creators string, abstract string, chunk_text string").repartitionByRange(4, "key")


def brute(rows, literal, k):
    folded = [(r[0], [(x or "").lower() for x in r[1:]]) for r in rows]
    dl = {key: sum(max(len(x) - 2, 0) for x in f) for key, f in folded}
    mean = sum(dl.values()) / len(dl)
    out = []
    for key, f in folded:
        hits = sum(w * x.count(literal.lower()) for w, x in zip((8, 4, 2, 1), f, strict=True))
        if hits:
            out.append((-round(hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * dl[key] / mean)), 9), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


def test_keyword_index(spark):
    rng = random.Random(3)
    rows, frame = index_rows(spark, 3000, rng)
    literals = {1: "Needle", 2: "needle thread", 3: "NÉE", 4: "absent words", 5: "lorem ipsum", 6: "xx", 7: "xxx", 8: "em lorem d"}
    index = trigram_index.build(frame, size=16)
    seen: list = []
    queries = spark.createDataFrame(list(literals.items()), "query_id long, literal string")
    got: dict = {}
    for r in trigram_index.search(index, queries, 5, seen=seen).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["key"], round(r["weight"], 9)))
    want = {q: b for q, t in literals.items() if len(t) > 2 and (b := brute(rows, t, 5))}
    assert got == want and set(got) == {1, 2, 3, 5, 8}
    # rare literals: of all blocks those that hold their trigrams; hits in titles leave the texts' blocks unread
    blocks, rare, title = index.blocks.count(), [], []
    trigram_index.search(index, queries.where("query_id IN (1, 2, 3)"), 3, first=2, seen=rare)
    assert rare[1] <= rare[0] < 3 * blocks / 5
    trigram_index.search(index, queries.where("query_id = 1"), 3, seen=title)
    assert title[1] < title[0] / 2 < blocks / 8, title


def test_keyword_index_of_nothing(spark):
    empty = spark.createDataFrame([], "key long, title string, creators string, abstract string, chunk_text string")
    queries = spark.createDataFrame([(1, "abc"), (2, None)], "query_id long, literal string")
    assert trigram_index.search(trigram_index.build(empty), queries, 3).count() == 0
    one = spark.createDataFrame([(4, None, None, None, "abcabc")], empty.schema)
    assert [tuple(r)[:2] for r in trigram_index.search(trigram_index.build(one), queries, 3).collect()] == [(1, 4)]


def test_vector_index(spark):
    """Clusters, repeated vectors and ties; equal to reading all vectors, which it does not."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 20
    vectors = np.concatenate([c + rng.normal(size=(50, 8)) * 0.3 for c in centres]).astype(np.float32)
    vectors[100:105] = vectors[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist()), (9000, None), (9001, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = frame.where("vec_id % 50 = 0")
    index, seen = vector_index.build(frame, 8), []
    got = vector_index.search(index, queries, 7, block=16, seen=seen)
    key = lambda df: sorted((r["query_id"], r["rank"], r["key"], round(r["distance"], 6)) for r in df.collect())
    want = nearest(frame.where(F.size("embedding") == 8), queries, 7)
    assert key(got) == key(want) and index.vectors == 2000
    compared, pairs = map(sum, zip(*seen, strict=True))
    assert pairs == 40 * 2000 and compared < pairs / 5


def test_vector_index_of_few(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    out = vector_index.search(vector_index.build(frame, 2), frame, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["key"], r["distance"]) for r in out] == [(1, 1, 0.0), (1, 2, 1.0), (2, 2, 0.0), (2, 1, 1.0)]
    assert vector_index.search(vector_index.build(frame.where("false"), 2), frame, 5).count() == 0
    assert vector_index.search(vector_index.build(frame, 2), frame.where("false"), 5).count() == 0


def test_bounds_of_many_blocks_are_small():
    """Ten thousand blocks in one batch: what a task holds follows the slice, and the bounds are those of the whole batch."""
    rng = np.random.default_rng(5)
    low, far = rng.random((10_000, 4)), rng.random((1_000, 4)) + 1
    flat = [pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, 4), pa.int32()), pa.array(x.ravel())) for x in (low, low + 0.1)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), *flat], names=["block", "low", "high"])
    bounds = vector_index._bounds(batch, far[:20])
    least = np.sort(bounds, axis=1)[:, 3]
    got = [set() for _ in range(20)]
    for out in vector_index._within(far[:20], least)(iter([batch])):
        for q, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[q].add(b)
    assert got == [set(np.flatnonzero(bounds[q] <= least[q]).tolist()) for q in range(20)]
    tracemalloc.start()
    for step in (vector_index._first(far, 4), vector_index._within(far, np.zeros(1_000))):
        tracemalloc.reset_peak()
        for _ in step(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 80_000_000
    tracemalloc.stop()
