"""Target-distribution importance resampling: documents whose features are likelier in the target are likelier to be drawn.

Two passes over Arrow batches. In the first each partition counts the buckets of its
features by np.bincount into one vector, and treeReduce adds the vectors of all
partitions. The counts of documents and target give a gain for each bucket. In the second
the gains are broadcast, each feature gathers its own, and bincount with these as weights
sums them by document. Gumbel noise from a hash of the id turns the highest scores into a
draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, shuffle_partitions
from .words import CRC, Words, parts


def features(words: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all runs of 1, 2 ... `longest` consecutive words of one text, joined by one space."""
    space = np.uint32(0x20)
    first, crc = np.arange(len(words.starts)), np.zeros(len(words.starts), np.uint32)
    for n in range(longest):
        if n:
            inside = first + n < len(words.starts)
            inside[inside] = words.text[first[inside] + n] == words.text[first[inside]]
            first, crc = first[inside], ~_one_more(~crc[inside], space)
        crc = words.crc32(first + n, crc)
        yield words.text[first], (crc % np.uint32(buckets)).astype(np.int64)


def _one_more(state: np.ndarray, byte: np.uint32) -> np.ndarray:
    return CRC[(state ^ byte) & 0xFF] ^ state >> 8


def _counted(longest: int, buckets: int, least: int) -> Callable:
    """One vector of a partition: the count of each bucket, then how many texts have at least `least` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                words = Words.of(part.column(0))
                for _, bucket in features(words, longest, buckets):
                    out[:-1] += np.bincount(bucket, minlength=buckets)
                out[-1] += (words.per_text() >= least).sum()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])

    return run


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000, least: int = 0) -> tuple[np.ndarray, int]:
    """How many features of the one column of texts are in each bucket, and how many texts have at least `least` words."""
    prepare(texts.sparkSession)
    vectors = texts.mapInArrow(_counted(longest, buckets, least), "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64), 0
    total = vectors.map(lambda r: np.frombuffer(bytes(r[0]), np.int64)).treeReduce(np.add)
    return total[:-1], int(total[-1])


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket 1000 times the logarithm of how much likelier it is in the target, add-one smoothed, rounded down."""
    buckets, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def _weighed(gains, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for batch in batches:
            for part in parts(batch, 1):
                words = Words.of(part.column(1))
                n, weight = np.zeros(words.texts, np.int64), np.zeros(words.texts, np.int64)
                for text, bucket in features(words, longest, len(gain)):
                    n += np.bincount(text, minlength=words.texts)
                    # sums of whole numbers below 2 ** 53 are exact in doubles
                    weight += np.bincount(text, gain[bucket], words.texts).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.per_text(), pa.int64()), pa.array(n), pa.array(weight)], names=["doc_id", "words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: str) -> Column:
    """Noise of Gumbel's distribution times 1000, rounded down, from the first 32 bits of sha256 of `<seed>:<id>`; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rank 1, 2, 3 ...: highest score first, then smallest id.

    Rows are dealt by ranges of the order and numbered within each; the sizes of the ranges,
    a number for each partition, put them one after another. No task holds more than a range.
    """
    spark, n = rows.sparkSession, max(1, shuffle_partitions(rows.sparkSession))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumn("range", F.shiftright("place", 33))
    sizes = placed.groupBy("range").agg((F.max("place") % (1 << 33) + 1).alias("n")).orderBy("range").collect()
    before = np.cumsum([0] + [r["n"] for r in sizes]).tolist()
    starts = spark.createDataFrame([(r["range"], b) for r, b in zip(sizes, before, strict=False)], "range long, before long")
    return placed.join(F.broadcast(starts), "range").withColumn("rank", F.col("place") % (1 << 33) + 1 + F.col("before")).drop("range", "place", "before")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs.

    Features are all runs of 1 to `longest` words; weight is the sum of their gains, score
    that and the noise of the id. Of the rows with at least `least` words the highest
    `percent` of a hundred, rounded down, have a rank, others null. A null or empty text,
    in either table, has no feature and the weight 0; rows that repeat, or have no id, each
    count and are drawn on their own, in any order among equal ones. Without a target all
    gains are those of an empty one; an empty table gives an empty result. Other columns
    are not read.
    """
    prepare(docs.sparkSession)
    corpus, eligible = bucket_counts(docs.select(F.col(text_col).cast("string")), longest, buckets, least)
    wanted, _ = bucket_counts(target.select(F.col(target_col).cast("string")), longest, buckets)
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(corpus, wanted))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_weighed(gains, longest), "doc_id long, words long, n_features long, weight long")
    scored = materialise(scored.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}), "scored")
    ranked = _ranked(scored.where(F.col("words") >= least)).withColumn("rank", F.when(F.col("rank") <= percent * eligible // 100, F.col("rank")))
    out = ranked.unionByName(scored.where(F.col("words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of the documents of at least 20 words, drawn towards the words of the benchmark; every document is returned."""
    return importance_resample(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
