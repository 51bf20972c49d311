"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide.

Each partition of the input builds a counting quotient filter of its fingerprints. The
filters are cut by ranges of quotients into shards; those of one shard merge by their
sorted remainders, which loses nothing, since quotient and remainder give back the whole
fingerprint. Only rows whose fingerprint has a count above one go on to a comparison of
the normalised bytes. A count also tells how many salts a hot group needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, shuffle_partitions, without_blanks

WIDTHS = {1: 8, 2: 16, 4: 32, 8: 64}


@dataclass
class CountingQuotientFilter:
    """Fingerprints of 64 bits: `q_bits` of quotient, the rest is the remainder.

    ``quotients`` and ``runs`` hold the occupied quotients and the length of the run of
    each, ``remainders`` the remainders sorted within a run, ``counts`` how often each
    fingerprint came.
    """

    q_bits: int
    quotients: np.ndarray
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, q_bits: int) -> CountingQuotientFilter:
        """From different sorted fingerprints and their counts."""
        r = np.uint64(64 - q_bits)
        quotients, runs = np.unique(fingerprints >> r, return_counts=True)
        return cls(q_bits, quotients.astype(np.uint32), runs.astype(np.uint32), fingerprints & ((np.uint64(1) << r) - np.uint64(1)), counts)

    @classmethod
    def build(cls, fingerprints: np.ndarray, q_bits: int) -> CountingQuotientFilter:
        seen, counts = np.unique(fingerprints, return_counts=True)
        return cls.of(seen, counts.astype(np.int64), q_bits)

    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(64 - self.q_bits) | self.remainders

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of all fingerprints together: sorted remainders side by side, counts added."""
        each = (self, *others)
        values, counts = np.concatenate([x.fingerprints() for x in each]), np.concatenate([x.counts for x in each])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
        return self.of(values[first], np.add.reduceat(counts, first) if len(first) else counts, self.q_bits)

    def shards(self, n: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The occupied ones of n parts by range of quotient."""
        shard = self.quotients.astype(np.int64) * n >> self.q_bits
        at = np.concatenate(([0], np.cumsum(self.runs, dtype=np.int64)))
        for k in np.unique(shard):
            lo, hi = np.searchsorted(shard, [k, k + 1])
            yield int(k), CountingQuotientFilter(self.q_bits, self.quotients[lo:hi], self.runs[lo:hi], self.remainders[at[lo] : at[hi]], self.counts[at[lo] : at[hi]])

    def pack(self) -> bytes:
        """Bytes; remainders take as many as they need, counts one, two, four or eight each."""
        wide = next(w for w in WIDTHS if w == 8 or self.counts.max(initial=0) < 1 << WIDTHS[w])
        r = -(-(64 - self.q_bits) // 8)
        head = np.array([self.q_bits, len(self.quotients), len(self.remainders), wide], np.int64)
        return b"".join([head.tobytes(), self.quotients.tobytes(), self.runs.tobytes(), self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :r].tobytes(), self.counts.astype(f"<u{wide}").tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        q_bits, n, m, wide = np.frombuffer(data, np.int64, 4).tolist()
        r, at = -(-(64 - q_bits) // 8), 32
        quotients, runs = np.frombuffer(data, np.uint32, n, at), np.frombuffer(data, np.uint32, n, at + 4 * n)
        at += 8 * n
        rest = np.zeros((m, 8), np.uint8)
        rest[:, :r] = np.frombuffer(data, np.uint8, m * r, at).reshape(m, r)
        return cls(q_bits, quotients, runs, rest.view("<u8").ravel(), np.frombuffer(data, f"<u{wide}", m, at + m * r).astype(np.int64))


def _filters(q_bits: int, shards: int, block: int = 4_000_000) -> Callable:
    """One filter of a partition (of each `block` fingerprints in it), cut into shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            cut = list(CountingQuotientFilter.build(np.concatenate(held), q_bits).shards(shards))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([f.pack() for _, f in cut], pa.binary())], names=["shard", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= block:
                yield out()
                held = []
        if held:
            yield out()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """The fingerprints of a shard whose merged count is above one."""
    first, *rest = (CountingQuotientFilter.unpack(x) for x in table.column("filter").to_pylist())
    merged = first.merge(*rest)
    some = merged.counts > 1
    return pa.table({"fp": merged.fingerprints()[some].view(np.int64), "n": merged.counts[some]})


def repeated_fingerprints(fps: DataFrame, q_bits: int = 20, shards: int | None = None) -> DataFrame:
    """(fp, n) of the values of the long column fp that occur n > 1 times.

    A shard holds the filters of all partitions for 1 / `shards` of the quotients, at
    most about nine bytes for each different fingerprint; `shards` follows
    spark.sql.shuffle.partitions, which has to follow the data.
    """
    prepare(fps.sparkSession)
    n = min(shards or 2 * shuffle_partitions(fps.sparkSession), 1 << q_bits)
    parts = fps.select("fp").mapInArrow(_filters(q_bits, n), "shard int, filter binary")
    return parts.groupBy("shard").applyInArrow(_repeated, "fp long, n long")


def _routed(docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """Normalised rows with the count n of their fingerprint where that is above one, else null; the whole row too."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("row", "doc_id", without_blanks(F.col("text")).alias("norm"), F.coalesce(F.length("text"), F.lit(0)).alias("points"))
    rows = rows.withColumn("fp", F.xxhash64("norm"))
    repeated = materialise(repeated_fingerprints(rows), "repeated")
    routed = rows.join(F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated, "fp", "left")
    return routed.withColumn("text_sha256", F.sha2("norm", 256))


def _matched(some: DataFrame, rows_per_salt: int) -> DataFrame:
    """Routed rows with the group that their bytes put them in; groups of many rows are salted by the count of their fingerprint."""
    groups = some.groupBy("text_sha256", "norm").agg(F.count("*").alias("group_size"), F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"))).alias("best"), F.max("n").alias("n"))
    groups = groups.select("text_sha256", "norm", "group_size", F.bitwise_not("best.id").alias("keep_id"), F.col("best.points").alias("most"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / rows_per_salt).cast("int"))).alias("salt"))
    # by the place of a row, not its id: rows that repeat one id, or have none, are spread too
    salted = some.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.floor(F.col("n") / rows_per_salt) + 1).cast("int"))
    return salted.join(groups, ["text_sha256", "norm", "salt"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, rows_per_salt: int = 5_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row.

    Rows are equal if their texts are the same bytes once the blanks `[\\x20\\x09-\\x0D]`
    are deleted; a null text is an empty one. The row with the most code points, then the
    smallest id (a null id comes last) stays. Rows that repeat the id of the row that
    stays, within its group, are all marked as kept. An empty table gives an empty result;
    other columns are not looked at. Repeated fingerprints are broadcast only if there are
    at most `broadcast_rows` of them; beyond that they meet their rows in a shuffle.
    """
    routed = _routed(docs, id_col, text_col, broadcast_rows)
    alone = routed.where("n is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    joined = _matched(routed.where("n is not null").drop("row"), rows_per_salt)
    return alone.union(joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, rows_per_salt: int = 5_000) -> DataFrame:
    """One row, with all its columns, of each group of equal texts: the one that exact_duplicates keeps; any one of rows that repeat it."""
    routed = _routed(docs, id_col, text_col, broadcast_rows)
    kept = _matched(routed.where("n is not null"), rows_per_salt).where("doc_id <=> keep_id and points = most")
    return routed.where("n is null").select("row.*").union(kept.dropDuplicates(["text_sha256", "norm"]).select("row.*"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The group of every document."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
